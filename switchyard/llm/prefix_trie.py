"""The trie of conversation prefixes, from partial tries merged by hash.

A node is a distinct sequence of first turns; its key is a 127-bit polynomial hash
of those turns' MD5 digests (two of N nodes meet with probability under
N^2 / 2^126).  Each partition combines its rows into a node table of its own;
tables are merged by key in rounds, first within ``SLOTS`` slots, then over all,
adding members and keeping the least conversation, the node's owner.  So a node
that holds all conversations comes to a merge as a few rows.

The rollup runs up every path at once, not level by level.  A conversation owns
the lower end of its path (it stays the least member once it is); above that end
it meets owners less than itself.  So each node of a subtree belongs to exactly
one member of its top, and sums over a subtree are sums over members:

- a leaf is counted by its owner, hence n_leaves is the number of members that
  own one;
- (n_convs - 1) times its bytes, summed over a subtree, is what its members hold
  below the top less what they own: per member but the owner, the bytes from the
  top down to where it begins to own.

Both need one number a conversation.  Nodes of a single member have one leaf and
save nothing, so only rows of shared nodes move.

Lists of ends are never gathered: they are sorted by range of (node, conv_id),
joined to texts of up to ``JOINED`` ids where they lie, and hashed in order as a
stream of those texts (a digest has no other order).

Defined results: rows without conv_id belong to no conversation; turns that tie
go by digest; equal rows are turns of their own; null role and text are empty;
texts count whole; an empty table gives an empty result; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.llm import _common as C
from switchyard.llm._running import running

SLOTS = 16
JOINED = 10_000
#: Nodes of more members than this are dealt over tasks where rows meet them.
HOT = 100_000
#: Rebuilt conversations take fewer turns than this from another.
HEADS = 9

_NO_ENDS = hashlib.sha256(b"").hexdigest()
_ROOT = b""  # key of the root, which has no turn


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, x, n_bytes, tie): a row's digest instead of its text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    x = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", x.alias("x"), F.octet_length(text).cast("long").alias("n_bytes"))
    return C.materialize(rows.withColumn("tie", F.monotonically_increasing_id()), "turns")


def rebuilt(rows: DataFrame) -> DataFrame:
    """The paths of rebuilt conversations: (conv_id, depth, path, n_bytes, total) from ``turns``.

    Conversation c takes its first h = crc32(c) % 9 turns from c - c % 5 and keeps its own after its first h.
    """
    placed = running(rows, "conv_id", F.col("turn").asc_nulls_first(), F.col("x").asc(), F.col("tie").asc()).select("conv_id", "idx", "x", "n_bytes")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    itself = F.col("conv_id") % 5 == 0
    own = placed.where(itself | (F.col("idx") > h)).select("conv_id", F.lit(1).alias("part"), "idx", "x", "n_bytes")
    takers = rows.select("conv_id").distinct().where(~itself).select(F.col("conv_id").alias("c"), (F.col("conv_id") - F.col("conv_id") % 5).alias("conv_id"), h.alias("h"))
    heads = placed.where(itself & (F.col("idx") < HEADS))  # a few rows a conversation
    taken = takers.join(heads, "conv_id").where(F.col("idx") <= F.col("h")).select(F.col("c").alias("conv_id"), F.lit(0).alias("part"), "idx", "x", "n_bytes")
    ordered = running(own.union(taken).withColumnRenamed("idx", "place"), "conv_id", F.col("part").asc(), F.col("place").asc())
    return C.materialize(ordered.select("conv_id", F.col("idx").alias("depth"), "path", "n_bytes", "total"), "paths")


def nodes(paths: DataFrame) -> DataFrame:
    """Node tables of the partitions, merged: (path, depth, n_bytes, total, owner, n_convs)."""
    facts = [F.first(c).alias(c) for c in ("depth", "n_bytes", "total")]
    tries = paths.withColumn("slot", F.pmod(F.xxhash64("conv_id"), F.lit(SLOTS))).groupBy("path", "slot").agg(*facts, F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"))
    return C.materialize(tries.groupBy("path").agg(*facts, F.min("owner").alias("owner"), F.sum("n_convs").alias("n_convs")), "nodes")


def digests(ends: DataFrame) -> DataFrame:
    """(path, ends_sha256) of (path, conv_id): SHA-256 of a node's conv_ids, ascending and joined by commas."""
    order = ["path", "conv_id"]

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, ids = None, []
        for batch in batches:
            out: list[tuple] = []
            for p, c in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if (p != path or len(ids) == JOINED) and ids:
                    out.append((path, ids[0], ",".join(map(str, ids))))
                    ids = []
                path = p
                ids.append(c)
            yield _texts(out)
        yield _texts([(path, ids[0], ",".join(map(str, ids)))] if ids else [])

    def hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for p, t in zip(batch.column("path").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if p == path and state is not None:
                    state.update(b",")
                else:
                    if state is not None:
                        done.append((path, state.hexdigest()))
                    path, state = p, hashlib.sha256()
                state.update(t.encode())
            yield _digests(done)
        yield _digests([(path, state.hexdigest())] if state is not None else [])

    texts = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join_ids, "path binary, first long, ids string")
    return texts.repartition("path").sortWithinPartitions("path", "first").mapInArrow(hash_texts, "path binary, ends_sha256 string")


def _texts(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["path", "first", "ids"])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["path", "ends_sha256"])


def _long(value: Column) -> Column:
    return value.cast("long")


def trie(conversations: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    rows = turns(conversations)
    paths = rebuilt(rows)
    table = nodes(paths)
    convs = rows.groupBy("conv_id").agg(F.lit(1).alias("_"))
    least, n_convs = convs.agg(F.min("conv_id"), F.count("*")).first()
    ends = paths.groupBy("conv_id").agg(F.max_by("path", "depth").alias("path"))
    ends = C.materialize(convs.select("conv_id").join(ends, "conv_id", "left").select("conv_id", F.coalesce("path", F.lit(_ROOT)).alias("path")), "ends")

    # a leaf is a node at which all members end
    ended = ends.groupBy("path").agg(F.count("*").alias("n_ends"))
    leaves = C.materialize(table.join(ended, "path").where("n_ends = n_convs").select(F.col("owner").alias("conv_id"), F.lit(1).alias("leaf")), "leaves")

    # rows of shared nodes, with their owners
    shared = table.where("n_convs > 1").select("path", "owner")
    met = C.materialize(C.spread_join(paths.select("conv_id", "depth", "path", "total"), shared, "path", "conv_id", HOT, counts=table.select("path", F.col("n_convs").alias("n"))), "shared")
    above = F.when(F.col("owner") != F.col("conv_id"), F.col("total"))  # bytes down to where the conversation begins to own
    each = met.groupBy("conv_id").agg(F.max(above).alias("above"), F.count("*").alias("n")).join(leaves, "conv_id", "left")
    each = C.materialize(each.select("conv_id", F.coalesce("above", F.lit(0)).alias("above"), F.coalesce("leaf", F.lit(0)).alias("leaf"), "n"), "members")
    summed = C.spread_join(met, each.drop("n"), "conv_id", "path", HOT, counts=each.select("conv_id", "n"))
    sums = summed.groupBy("path").agg(F.sum(F.when(F.col("owner") != F.col("conv_id"), F.col("above"))).alias("above"), F.sum("leaf").alias("n_leaves"))

    # a node's parent is its owner's node one turn up: shared, or the owner's own
    up = met.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("owner").alias("parent"))
    named = table.withColumnRenamed("owner", "conv_id").join(up, ["conv_id", "depth"], "left")
    parent = F.when(F.col("depth") == 1, F.lit(least)).otherwise(F.coalesce("parent", "conv_id"))
    named = C.materialize(named.withColumn("parent_conv_id", _long(parent)).drop("parent"), "named")
    children = named.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))

    root = table.agg(F.sum((F.col("n_convs") - 1) * F.col("n_bytes")).alias("above")).crossJoin(leaves.agg(F.count("*").alias("n_leaves")))  # one row by one row
    root = root.select(F.lit(least).cast("long").alias("conv_id"), _long(F.lit(0)).alias("depth"), F.lit(_ROOT).alias("path"), _long(F.lit(0)).alias("n_bytes"), _long(F.lit(0)).alias("total"), F.lit(n_convs).cast("long").alias("n_convs"), F.lit(None).cast("long").alias("parent_conv_id"), "above", F.greatest("n_leaves", F.lit(1)).alias("n_leaves")).where(F.lit(n_convs > 0))
    below = named.join(sums, "path", "left")
    everything = below.select(*root.columns).union(root).join(children, ["conv_id", "depth"], "left").join(digests(ends.select("path", "conv_id")), "path", "left")
    before = (F.col("n_convs") - 1) * (F.col("total") - F.col("n_bytes"))
    return everything.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
        _long(F.coalesce(F.col("above"), F.lit(0)) - before).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(C.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


PREFIX_TRIE_SQL = f"""
with placed as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, md5(length(r) || ':' || r || t)) as idx, r, t
       from (select conv_id, turn, coalesce(role, '') as r, coalesce(text, '') as t from conversations where conv_id is not null)),
     convs as (select conv_id, {C.crc32_sql('conv_id::varchar')} % {HEADS} as h from (select distinct conv_id from placed)),
     built as (select c.conv_id, 0 as part, p.idx, p.r, p.t from convs c join placed p on p.conv_id = c.conv_id - c.conv_id % 5 and p.idx <= c.h
       union all select c.conv_id, 1, p.idx, p.r, p.t from convs c join placed p on p.conv_id = c.conv_id and p.idx > c.h),
     seqs as (select c.conv_id, coalesce(list({{'r': b.r, 't': b.t}} order by b.part, b.idx) filter (where b.idx is not null), []) as s from convs c left join built b using (conv_id) group by c.conv_id),
     members as (select conv_id, len(s) as n_turns, unnest(range(0, len(s) + 1)) as depth, s from seqs),
     keyed as (select conv_id, depth, s[1:depth] as p, depth = n_turns as is_end from members),
     node as (select p, depth, min(conv_id) as conv_id, count(*) as n_convs, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where is_end), '') as ends from keyed group by p, depth),
     linked as (select n.*, u.conv_id as parent_conv_id, coalesce(strlen(n.p[n.depth].t), 0) as n_bytes from node n left join node u on u.depth = n.depth - 1 and u.p = n.p[1:n.depth - 1] and n.depth > 0),
     kids as (select parent_conv_id as conv_id, depth - 1 as depth, count(*) as n_children from linked where depth > 0 group by all),
     full_node as (select l.*, coalesce(k.n_children, 0) as n_children from linked l left join kids k using (conv_id, depth)),
     rolled as (select a.conv_id, a.depth, count(*) filter (where b.n_children = 0) as n_leaves, sum((b.n_convs - 1) * b.n_bytes)::bigint as saved_tokens
       from full_node a join full_node b on b.depth >= a.depth and b.p[1:a.depth] = a.p group by a.conv_id, a.depth)
select conv_id, depth::bigint as depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(ends) as ends_sha256 from full_node join rolled using (conv_id, depth)
"""
