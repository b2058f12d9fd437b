"""Document fingerprints by one-permutation MinHash, with DataFrame functions only.

A text is the set of its five-word shingles.  Each shingle is hashed once; the
hash names one of ``BINS`` bins and a value in it, and a bin keeps its least
value.  A bin that no shingle fell in borrows from another (optimal
densification): bin b walks the bins j = o_b + t / c_b (mod ``BINS``, a prime) for
t = 0, 1, ... and takes the first that is filled.  c_b and o_b are hashes of b,
so every bin walks in its own order, which is the same for all texts.  The
first ``PROBES`` steps are taken one by one; after them the walk is inverted,
t = c_b (j - o_b), and the filled bin of least t taken, which is the same bin.

Of each bin the low ``BITS`` bits are stored, as two hexadecimal digits.  Two
values that differ agree in those by chance once in 2^BITS; ``likeness`` takes
that share out.  It estimates the Jaccard similarity J of the shingle sets
without bias for J above a few hundredths (it is cut at 0), with a deviation
of about sqrt(J (1 - J) / BINS), at most 0.032.

``edits`` needs each document's successor by doc_id, without a window over the
table: keys, not texts, are sorted by range and numbered where they lie, so the
successor's number follows from the counts of the ranges (one row a range).
Texts then move once to their key, and what a predecessor takes of them to its key.

Defined results: words are what lies between ``[\\x20\\x09-\\x0D]``, in lower
case; fewer than five words form one shingle; a text without words (null and
empty ones too) has the empty fingerprint, is like another such (1) and unlike
all else (0).  doc_ids ascend with nulls first; rows that repeat a doc_id follow
each other by the digest of id and text; rows equal in id and text are each
other's successors, are fingerprinted once and written by one task (copies under
ids of their own are rows like all others).  A single document is its own
successor.  Texts are taken whole, however long.  An empty table gives an empty
result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.llm import _common as C

WORDS = 5
BINS = 257
BITS = 8
PROBES = 8

_TOP = 53  # bits of a value within its bin
_NONE = (1 << _TOP) - 1  # what an empty bin holds
_LOW = (1 << BITS) - 1


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once: inside a lambda a plain expression would be computed again for each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def shingle_hashes(text: Column) -> Column:
    """Hashes of all runs of ``WORDS`` words (of the whole where it has fewer), repeats included."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def runs(ws: Column) -> Column:
        full = F.transform(ws, lambda w, i: F.xxhash64(w, *[F.get(ws, i + k) for k in range(1, WORDS)]))
        return F.when(F.size(ws) >= WORDS, F.slice(full, 1, F.size(ws) - (WORDS - 1))).when(F.size(ws) > 0, F.array(F.xxhash64(ws))).otherwise(F.array().cast("array<bigint>"))

    return _bound(F.transform(words, lambda w: F.xxhash64(w)), runs)


def minima(hashes: Column) -> Column:
    """The least value of every bin in order, packed as bin * 2^53 + value; the value ``_NONE`` stands for an empty bin."""
    binned = F.transform(hashes, lambda h: F.shiftleft(F.pmod(h, F.lit(BINS)), _TOP) + F.shiftrightunsigned(h, 64 - _TOP))
    ends = F.transform(F.sequence(F.lit(-1), F.lit(BINS - 1)), lambda b: F.shiftleft(b.cast("bigint"), _TOP) + F.lit(_NONE))  # -1 lies before them all
    first = lambda s: F.filter(s, lambda x, i: F.get(s, i - 1) < x.bitwiseAND(F.lit(~_NONE)))
    return _bound(F.sort_array(F.concat(binned, ends)), first)


def walks() -> list[tuple[int, int]]:
    """(c, o) of every bin's walk."""
    drawn = [int.from_bytes(hashlib.sha256(f"walk {b}".encode()).digest()[:8]) for b in range(BINS)]
    return [(1 + x % (BINS - 1), x // BINS % BINS) for x in drawn]


def _table(values: list[int]) -> Column:
    """A constant array, folded when the plan is made."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def densified(dense: Column) -> Column:
    """The low bits of every bin's value, empty bins filled."""
    steps = [_table([(o + pow(c, -1, BINS) * t) % BINS for c, o in walks()]) for t in range(PROBES)]
    cs, os = _table([c for c, _ in walks()]), _table([o for _, o in walks()])

    def fill(low: Column, filled: Column) -> Column:
        def nearest(b: Column) -> Column:
            rank = lambda x: F.pmod(F.get(cs, b) * (F.shiftright(x, BITS) - F.get(os, b)), F.lit(BINS))
            return F.array_min(F.transform(filled, lambda x: F.shiftleft(rank(x), BITS) + x.bitwiseAND(F.lit(_LOW)))).bitwiseAND(F.lit(_LOW))

        return F.transform(low, lambda x, b: F.coalesce(x, *[F.get(low, F.get(step, b)) for step in steps], nearest(b)).cast("short"))

    value = lambda x: x.bitwiseAND(F.lit(_NONE))
    lows = F.transform(dense, lambda x: F.when(value(x) != _NONE, x.bitwiseAND(F.lit(_LOW)).cast("int")))

    def with_filled(low: Column) -> Column:
        places = F.transform(low, lambda x, b: F.shiftleft(b, BITS) + x)
        return _bound(F.filter(places, lambda x: x.isNotNull()), lambda filled: fill(low, filled))

    return _bound(lows, with_filled)


def bins(text: Column) -> Column:
    """The stored bits of a text, one number a bin; an empty array for a text without words."""
    return _bound(shingle_hashes(F.coalesce(text, F.lit(""))), lambda h: F.when(F.size(h) > 0, densified(minima(h))).otherwise(F.array().cast("array<smallint>")))


def packed(stored: Column) -> Column:
    """``bins`` as a string of hexadecimal digits, two a bin."""
    return F.array_join(F.transform(stored, lambda x: F.lpad(F.lower(F.hex(x)), BITS // 4, "0")), "")


def unpacked(fingerprint: Column) -> Column:
    """The ``bins`` of a fingerprint string."""
    places = F.sequence(F.lit(1), F.lit(BINS * BITS // 4), F.lit(BITS // 4))
    return F.when(fingerprint == "", F.array().cast("array<smallint>")).otherwise(F.transform(places, lambda i: F.conv(F.substring(fingerprint, i, F.lit(BITS // 4)), 16, 10).cast("short")))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity, 0 to 1, of two ``bins``."""
    chance = 1.0 / (1 << BITS)
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    estimate = F.greatest((same / F.lit(float(BINS)) - F.lit(chance)) / F.lit(1.0 - chance), F.lit(0.0))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), estimate).otherwise((F.size(a) == F.size(b)).cast("double"))


def _placed(keys: DataFrame) -> DataFrame:
    """``keys`` (doc_id, k, n_chars, copies) with the ``k_before`` and ``n_before`` of the row before each.

    Rows sorted by range are numbered as they lie: range * 2^33 + place.
    """
    spark = keys.sparkSession
    order = [F.col("doc_id").asc_nulls_first(), F.col("k").asc()]
    lying = C.materialize(keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "in-order")
    sizes = sorted((r.r, r.n) for r in lying.groupBy(F.shiftright("at", 33).alias("r")).agg(F.count("*").alias("n")).collect())  # one row a range
    ends = [((r << 33) + n - 1, sizes[(i + 1) % len(sizes)][0] << 33) for i, (r, n) in enumerate(sizes)]
    jumps = F.broadcast(spark.createDataFrame(ends, "at long, jump long"))  # one row a range
    after = lying.join(jumps, "at", "left").select(F.coalesce("jump", F.col("at") + 1).alias("at"), F.col("k").alias("k_before"), F.col("n_chars").alias("n_before"))
    return lying.join(after, "at").drop("at")


def edits(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, own, edited, next): the ``bins`` of a document and of its successor, and the edited text.

    The edited text ends in the successor's first floor(n_chars / 2) characters
    (all, where it has fewer) instead of its own last ones.
    """
    half = lambda n: F.floor(F.col(n) / 2).cast("int")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("k", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), F.lit(":"), F.col("text")).cast("binary")))
    keys = rows.select("doc_id", "k", F.length("text").alias("n_chars")).groupBy("doc_id", "k", "n_chars").agg(F.count("*").alias("copies"))
    # equal rows become one before they move; both sides below read this one exchange
    texts = rows.select("k", "text", bins(F.col("text")).alias("own")).groupBy("k").agg(F.first("text").alias("text"), F.first("own").alias("own"))
    here = texts.join(_placed(keys).hint("merge"), "k")
    mine = here.select("k", "doc_id", "n_chars", "copies", "own", F.left("text", F.col("n_chars") - half("n_chars")).alias("head"))
    sent = here.select(F.col("k_before").alias("k"), F.left("text", half("n_before")).alias("tail"), F.col("own").alias("next"))
    met = mine.join(sent.hint("merge"), "k").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    last = F.col("copy") == F.col("copies")
    return met.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        "own",
        F.concat("head", F.when(last, F.col("tail")).otherwise(F.left("head", half("n_chars")))).alias("edited"),
        F.when(last, F.col("next")).otherwise(F.col("own")).alias("next"),
    )


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edits(C.table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("changed", bins(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        packed(F.col("own")).alias("fingerprint"),
        packed(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
