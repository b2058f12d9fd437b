"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint takes 3-word shingles of the A-Z-lower-cased text (repeats
included), hashes each with XXH64 (seed 42) and sets a bit where over half the
hashes have it.  Fingerprints link at ``distance`` or fewer differing bits.

Candidate search runs on *distinct* fingerprints only.  The 64 bits are cut in
``distance + 2`` blocks; two close fingerprints agree in at least two of them,
so each pair of blocks is a join key (32 bits at distance 2) and every close
pair meets under one.  Keys held by one fingerprint are dropped by a counted
semi-join.  Buckets of up to ``bucket`` fingerprints are joined with themselves
and verified by Hamming distance.  Larger buckets (many near copies) never form
all pairs: their fingerprints already agree in the key, so they are split again
by pigeonhole on the *other* bits: two fingerprints within distance 2 both lie
within one flip of a common value, so each fingerprint is placed under itself
and each single flip of its bits outside the key, and those sharing such a
place are linked to the least of them.  That is exact and linear.  (For
distances above 2 the large buckets are joined in full.)

Defined results: null and empty texts have no shingle and fingerprint zero,
linked like any other; fewer than three words form one shingle; repeated rows
share their component; component_id is the least doc_id reachable (null if no
row of the component has one); texts are printed whole, however long; an empty
table gives an empty result; other
columns, whatever their names, are never read and ``keep_one`` passes them on.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.llm import _common as C
from switchyard.llm._graph import connected_components

WORDS = 3
DISTANCE = 2


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Unsigned 64-bit SimHash of a whole text."""
    ws = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not ws:
        return 0
    flat = b" ".join(ws)
    if len(ws) <= words:
        return xxhash.xxh64_intdigest(flat, 42)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    stops = ends[words - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    n = len(stops)
    for lo in range(0, n, 65_536):  # bounded memory for very long texts
        hs = np.array([xxhash.xxh64_intdigest(flat[a:b], 42) for a, b in zip(starts[lo : min(lo + 65_536, n)], stops[lo : lo + 65_536], strict=False)], dtype=">u8")
        ones += np.unpackbits(hs.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Fingerprints as signed longs."""
    for texts in batches:
        yield pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def _spans(distance: int) -> list[tuple[int, int]]:
    blocks = distance + 2
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(distance: int) -> list[int]:
    """Signed bit masks: one per pair of blocks that close fingerprints may share."""
    return [_signed(sum(((1 << (hi - lo)) - 1) << lo for lo, hi in pair)) for pair in combinations(_spans(distance), 2)]


def links(prints: DataFrame, distance: int = DISTANCE, bucket: int = 64) -> DataFrame:
    """Edges (a, b) over distinct fingerprints ``fp`` that connect exactly the close pairs' components."""
    keys = masks(distance)
    key = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for k, m in enumerate(keys)]))
    placed = prints.select("fp", key.alias("key")).select("fp", "key.k", "key.v")
    shared = placed.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1")
    placed = C.materialize(placed.join(shared, ["k", "v"]), "blocks")
    small = placed.where(F.col("n") <= bucket) if distance <= 2 else placed
    left, right = small.select("k", "v", F.col("fp").alias("a")), small.select("k", "v", F.col("fp").alias("b"))
    pairs = left.join(right, ["k", "v"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b")
    if distance > 2:
        return pairs.distinct()
    large = placed.where(F.col("n") > bucket)
    outside = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64) if not (m >> i) & 1]) for m in keys])
    flips = large.withColumn("place", F.explode(F.transform(F.element_at(outside, F.col("k") + 1), lambda f: F.col("fp").bitwiseXOR(f)))).select("k", "place", "fp")
    stars = flips.join(flips.groupBy("k", "place").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least < most"), ["k", "place"])
    return pairs.union(stars.where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))).distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Per row of (doc_id, text): doc_id, text_hash, fp (signed long), component (a fingerprint) and component_id."""
    printed = C.materialize(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.pandas_udf(fingerprints, "long")("text").alias("fp")), "prints")
    least = printed.groupBy("fp").agg(F.min("doc_id").alias("least"))
    comp = connected_components(links(least.select("fp"), distance))
    # distinct fingerprints -> least doc_id of their component
    joined = least.join(comp, F.col("fp") == F.col("vertex"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    roots = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = C.materialize(joined.join(roots, "component").select("fp", "component", "component_id"), "members")
    return C.spread_join(printed, by_print, "fp", "doc_id")  # one print may be that of very many rows


def keep_one(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one row of each near-duplicate group (its least doc_id, then the least hash of its text); columns unchanged.

    Rows that share a doc_id but not a group are told apart by their texts; of
    rows equal in both any one stays.  A row without doc_id can't be told from
    others and stays.
    """
    (h,) = C.unused(docs, "_text_hash")
    members = near_duplicates(docs.where("doc_id is not null"), distance)
    keep = members.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("k")).select("k.doc_id", F.col("k.text_hash").alias(h))
    kept = docs.withColumn(h, F.xxhash64("text")).join(keep, ["doc_id", h], "left_semi").dropDuplicates(["doc_id", h])
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
