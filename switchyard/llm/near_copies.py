"""Near copies by shared five-word shingles: candidates by MinHash, decided by exact Jaccard.

Words are split as for SimHash; a text is the set of its distinct five-word
shingles (fewer words form one).  ``BANDS`` bands of ``ROWS`` min-hashes each
put it in as many buckets: two texts at Jaccard 0.8 share none with probability
(1 - 0.8^4)^24 < 0.00001.  Whatever shares a bucket is decided by exact Jaccard.

Buckets never form all pairs.  In each round the least undecided rows of a
bucket lead it (one of them in the buckets of three bands, then one in those of
all) and are compared with all others in it;
a row with a lesser one at ``THRESHOLD`` or more is out and compared no more.
A bucket of near copies so takes one comparison a row.  Rows that still share a
bucket then are placed anew, under their rarest shingles (``_prefixes``: exact,
and texts that only quote the same passage part); rounds of 1, 8, 64, ... leaders
go on until no bucket holds two rows that were not compared.  Hence of any two rows kept
that share a bucket none is a near copy of the other, and every row that goes
has a chain of near copies, each lesser than the one before, to a row that
stays.

Defined results: null and empty texts have no shingle and stay, as do rows
without doc_id; rows of one doc_id and other texts are told apart by text; equal
rows share their fate (``simhash.keep_one`` takes exact copies); of two near
copies the one of greater doc_id goes, of equal ids that of the greater text hash;
texts are compared whole, however long; an empty table gives an empty result;
other columns, whatever their names, pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from switchyard.llm import _common as C

WORDS = 5
THRESHOLD = 0.8
BANDS = 24
ROWS = 4
GROWTH = 8
#: Bands of the first round: a large group of near copies goes there, before its rows meet under every band.
FIRST_BANDS = 3
#: Rows compared with one leader in one task.
PIECE = 1000

_RNG = np.random.default_rng(17)
_MULT = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None) -> np.ndarray:
    """Distinct shingle hashes of a whole text."""
    ws = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not ws:
        return np.zeros(0, np.uint64)
    flat = b" ".join(ws)
    if len(ws) <= WORDS:
        return np.array([xxhash.xxh64_intdigest(flat, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    stops = ends[WORDS - 1 :].tolist()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(flat[a:b], 42) for a, b in zip(starts, stops, strict=False)), np.uint64, len(stops)))


def buckets(hashes: np.ndarray) -> np.ndarray:
    """One signed key per band; none without a shingle."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for lo in range(0, len(hashes), 1024):  # bounded memory for very long texts
            np.minimum(least, (hashes[lo : lo + 1024, None] * _MULT + _ADD).min(0), out=least)
        key = np.arange(BANDS, dtype=np.uint64)
        for row in least.reshape(BANDS, ROWS).T:
            key = (key ^ row) * _MIX
            key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _placed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        sets = [shingles(t) for t in texts]
        yield pd.DataFrame({"n": np.array([len(s) for s in sets], np.int32), "keys": [buckets(s) for s in sets]})


def _hashes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([shingles(t).view(np.int64) for t in texts])


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The greater rows ``b`` of the pairs (a, b) at the threshold; a leader of many pairs is dealt over tasks."""
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
    dealt = pairs.join(counts, "a").withColumn("piece", F.pmod(F.xxhash64("b"), F.col("pieces")).cast("int"))
    lead = sets.select(F.col("k").alias("a"), F.col("s").alias("sa")).join(counts, "a").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    both = dealt.join(sets.select(F.col("k").alias("b"), F.col("s").alias("sb")), "b").join(lead, ["a", "piece"])
    shared = both.select("b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("m"))
    return shared.where(F.col("m") >= THRESHOLD * (F.col("na") + F.col("nb") - F.col("m"))).select("b").distinct()


def _prefixes(sets: DataFrame) -> DataFrame:
    """(k, n, band, bucket, at): every row under its rarest shingles, as many as two rows at the threshold can't both miss.

    Of two sets of which the greater has n members and that share enough of them,
    one of the n - ceil(THRESHOLD n) + 1 first in any common order is shared.  The
    order is by how many rows hold a shingle, so passages that many texts quote
    come last.  Exact; shingles of one row alone pair with nothing and go.  ``at``
    is a shingle's place in the order: two rows whose first shared shingle it is
    share at most what follows, which ``near_copies`` holds against what they need.
    """
    each = sets.select("k", F.size("s").alias("n"), F.explode("s").alias("bucket"))
    held = each.join(each.groupBy("bucket").agg(F.count("*").alias("rows")), "bucket")
    place = F.row_number().over(Window.partitionBy("k").orderBy("rows", "bucket"))
    first = held.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * THRESHOLD) + 1)
    return first.where("rows > 1").select("k", "n", F.lit(0).alias("band"), "bucket", F.col("place").alias("at"))


def near_copies(docs: DataFrame) -> DataFrame:
    """Keys ``k`` (doc_id and the text's hash) of the rows of (doc_id, text) that have a lesser near copy."""
    keyed = docs.where("doc_id is not null").select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("k"), "text")
    placed = C.materialize(keyed.select("k", F.pandas_udf(_placed, "n int, keys array<long>")("text").alias("p")).select("k", "p.n", F.posexplode("p.keys").alias("band", "bucket"), F.lit(1).alias("at")).distinct(), "near-placed")
    shared = placed.groupBy("bucket").agg(F.count("*").alias("rows")).where("rows > 1").select("bucket")
    open_ = C.materialize(placed.join(shared, "bucket"), "near-open")
    sets = C.materialize(keyed.join(open_.select("k").distinct(), "k").dropDuplicates(["k"]).select("k", F.pandas_udf(_hashes, "array<long>")("text").alias("s")), "near-sets")
    gone = open_.select("k").limit(0)
    rounds = 0
    while not open_.isEmpty():
        here = open_.where(F.col("band") < FIRST_BANDS) if rounds == 0 else open_
        leaders = GROWTH ** max(0, rounds - 2)
        order = Window.partitionBy("bucket").orderBy("k")
        first = here.withColumn("place", F.row_number().over(order)).where(F.col("place") <= leaders)
        led = C.materialize(first.select("bucket", F.col("k").alias("a"), F.col("n").alias("na"), F.col("at").alias("pa")), "near-led")
        pairs = led.join(here.select("bucket", F.col("k").alias("b"), F.col("n").alias("nb"), F.col("at").alias("pb")), "bucket").where("a < b")
        left = 1 + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))  # most that they share from here on
        need = THRESHOLD / (1 + THRESHOLD) * (F.col("na") + F.col("nb")) - 1e-6
        pairs = pairs.where((F.least("na", "nb") >= THRESHOLD * F.greatest("na", "nb")) & (left >= need)).select("a", "b").distinct()
        out = C.materialize(_similar(C.materialize(pairs, "near-pairs"), sets), "near-out").withColumnRenamed("b", "k")
        gone = gone.union(out)
        rest = open_.join(led.select("bucket", F.col("a").alias("k")), ["bucket", "k"], "left_anti").join(out, "k", "left_anti").select("k", "n", "band", "bucket", "at")
        open_ = _shared(rest, "near-open")
        rounds += 1
        if rounds == 2 and not open_.isEmpty():  # what still shares a bucket mostly quotes the same passages
            open_ = _shared(C.materialize(_prefixes(sets.join(open_.select("k").distinct(), "k", "left_semi")), "near-prefixes"), "near-open")
    return gone.distinct()


def _shared(rows: DataFrame, name: str) -> DataFrame:
    """The rows whose bucket holds another."""
    several = rows.groupBy("bucket").agg(F.count("*").alias("rows")).where("rows > 1").select("bucket")
    return C.materialize(rows.join(several, "bucket").select("k", "n", "band", "bucket", "at"), name)


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that have a lesser near copy; columns unchanged."""
    (key,) = C.unused(docs, "_key")
    gone = near_copies(docs).select(F.col("k").alias(key))
    return docs.join(gone, F.struct("doc_id", F.xxhash64("text").alias("h")) == F.col(key), "left_anti")
