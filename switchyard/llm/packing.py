"""Best-fit packing by large-item matching, planned on a histogram of lengths.

Documents become token ids (one separator id 0 appended); only those longer
than ``capacity`` are cut into capacity-long pieces.  Lengths are whole numbers
up to the capacity, so a packing is fully described by how many pieces of each
length there are: the plan works on that histogram (``capacity`` numbers, at
any corpus size) and yields runs of equal bins.

Plan: pieces above a third of the capacity share a bin with at most one other
such piece; a greedy matching gives each, from the longest down, the longest
partner that fits.  Smaller pieces, from the longest down, go to the tightest
gap that holds them (best fit), opening bins only when no gap does.

Ranks within a length come from counters kept while tokenising, per input
partition, plus per-partition offsets; nothing is sorted or gathered.

Token ids of a text are the ids of its space- or line-separated words in order
(white space is a hard boundary of the tokenizer), so words are cached: a
bounded two-generation cache per Python worker.

Defined results: null and empty texts are the one id 0; repeated rows are
packed each on their own; a null doc_id is kept as it is; an empty table packs to
nothing; pieces of equal length take places in the order in which the table's
partitions hold them (numbers of sequences are any); very long texts are cut into
full pieces and a rest; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from switchyard.llm import _common as C

CAPACITY = 2048
CACHE_WORDS = 800_000


#: Letters, then marks that can't combine with them.
MARKED = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]*)")


class WordIds:
    """word -> its token ids as little-endian unsigned 32-bit bytes; about 2 x ``cap`` words held."""

    def __init__(self, tokenizer, cap: int = CACHE_WORDS):
        self.tok, self.cap = tokenizer, cap
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        vocab = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        # for words already in the tokenizer's normal form: the same model, split at spaces only
        spec = json.loads(tokenizer.to_str())
        spec["normalizer"], steps = None, spec["pre_tokenizer"]["pretokenizers"]
        spec["pre_tokenizer"]["pretokenizers"] = [{"type": "WhitespaceSplit"}, *[x for x in steps if x["type"] == "ByteLevel"]]
        self.plain = type(tokenizer).from_str(json.dumps(spec))

    def _letters(self, words: list[str], tok) -> list[bytes]:
        """Words of letters only: one call, split at the ids that end a word."""
        ids = np.array(tok.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        at = np.nonzero(self.ends[ids])[0] + 1
        if len(at) == len(words):
            raw, cut = ids.tobytes(), (4 * at).tolist()
            return [raw[a:b] for a, b in zip([0, *cut[:-1]], cut, strict=True)]
        return self._each(words)

    def _each(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch(words, add_special_tokens=False)]

    def _missing(self, words: set[str]) -> set[str]:
        missing = words.difference(self.young)
        if self.old:
            kept = {w: self.old[w] for w in missing if w in self.old}
            self.young.update(kept)
            missing.difference_update(kept)
        return missing

    def load(self, words: set[str]) -> None:
        """Make every word of ``words`` available in ``young``."""
        if len(self.young) > self.cap:
            self.old, self.young = self.young, {"": b""}
        normal, odd, other, marked = set(), set(), set(), []
        for w in self._missing(words):
            if w.isalpha():
                core, marks = w, ""
            elif w[-1] in ".,!?" and w[:-1].isalpha():
                core, marks = w[:-1], w[-1]
            else:
                m = MARKED.fullmatch(w)
                if m is None or "'" in w or not m[1].isalpha():
                    other.add(w)
                    continue
                core, marks = m.groups()
            if core.isascii():
                core = core.lower()
                normal.add(core)
            elif core.islower() and unicodedata.is_normalized("NFC", core):
                normal.add(core)
            elif marks and not core.lower().isalpha():
                other.add(w)  # a lower case that ends in a mark joins the marks after it
                continue
            else:
                odd.add(core)
            if marks:
                other.add(marks)
            if core is not w:
                marked.append((w, core, marks))
        for group, tok in ((normal, self.plain), (odd, self.tok)):
            fresh = list(self._missing(group))
            for lo in range(0, len(fresh), 2000):
                self.young.update(zip(fresh[lo : lo + 2000], self._letters(fresh[lo : lo + 2000], tok), strict=True))
        fresh = list(self._missing(other))
        if fresh:
            self.young.update(zip(fresh, self._each(fresh), strict=True))
        for w, core, marks in marked:
            self.young[w] = self.young[core] + (self.young[marks] if marks else b"")

    @staticmethod
    def _lowered(text: str) -> str:
        """The tokenizer's own lower case, where it can be had for the whole text at once.

        Not with special tokens (case counts), capital sigma (its lower case
        depends on place here, not in the tokenizer) or text not composed
        before (the tokenizer composes first) or after (it would compose again).
        """
        if "<|" in text or "\u03a3" in text or not unicodedata.is_normalized("NFC", text):
            return text
        low = text.lower()
        return low if unicodedata.is_normalized("NFC", low) else text

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """Token ids of each text."""
        split = [self._lowered(text).replace("\n", " ").split(" ") for text in texts]
        get = self.young.get
        found = [list(map(get, words)) for words in split]
        gaps = []
        for values in found:
            at, i, index = [], -1, values.index
            try:
                while True:
                    i = index(None, i + 1)
                    at.append(i)
            except ValueError:
                gaps.append(at)
        if any(gaps):
            self.load({words[i] for words, at in zip(split, gaps, strict=True) for i in at})
            for words, values, at in zip(split, found, gaps, strict=True):
                for i in at:
                    values[i] = self.young[words[i]]
        return map(b"".join, found)


@lru_cache(maxsize=1)
def worker_words(source: str, cap: int) -> WordIds:
    """One tokenizer and word cache for each Python worker; it outlives a task, as its entries depend on nothing else."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
    from tokenizers import Tokenizer

    return WordIds(Tokenizer.from_str(source), cap)


def tokenizer_json(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32 and its rank among its partition's pieces of that length.

    ``cache_words`` trades a Python worker's memory (about 0.5 KB a word) for
    time; results don't depend on it.
    """
    spark = docs.sparkSession
    source = spark.sparkContext.broadcast(tokenizer_json(path))  # one vocabulary file: fixed size
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_words(source.value, cache_words)
        seen = np.zeros(capacity + 1, np.int64)
        part = TaskContext.get().partitionId()
        for batch in (b.slice(lo, 128) for b in batches for lo in range(0, b.num_rows, 128)):
            rows = {k: [] for k in ("row", "piece", "start", "length", "ids_crc32", "rank")}
            for k, raw in enumerate(words.ids([t or "" for t in batch.column(1).to_pylist()])):
                raw += b"\0\0\0\0"
                n = len(raw) // 4
                for p, at in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - at)
                    for key, v in zip(rows, (k, p, at, length, zlib.crc32(raw[4 * at : 4 * (at + length)]), seen[length]), strict=True):
                        rows[key].append(v)
                    seen[length] += 1
            take = pa.array(rows["row"], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), pa.array(rows["piece"], pa.int32()), *(pa.array(rows[k], pa.int64()) for k in ("start", "length", "ids_crc32", "rank")), pa.array([part] * len(take), pa.int32())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "rank", "part"],
            )

    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, rank long, part int"
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Placement runs for ``histogram[length]`` pieces, and the number of bins.

    A run (length, first rank, first bin, items a bin, offset) puts the pieces
    of that length from that rank on, ``items`` to each bin in turn.
    """
    left = np.array(histogram, dtype=np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    rank = np.zeros(capacity + 1, np.int64)
    gaps: list[int] = []  # sorted distinct gaps
    groups: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges (first bin, bins)
    bins = 0

    def give(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in groups:
                insort(gaps, gap)
                groups[gap] = []
            groups[gap].append((first, n))

    def place(length: int, first: int, n: int, items: int, offset: int) -> None:
        runs.append((length, int(rank[length]), first, items, offset))
        rank[length] += n

    large = capacity // 3
    live = [m for m in range(large + 1, capacity + 1) if left[m]]  # ascending
    while live:
        length = live[-1]
        k = bisect_left(live, capacity - length + 1) - 1
        while k >= 0 and not left[live[k]]:
            k -= 1
        partner = live[k] if k >= 0 else 0
        if not partner:
            n = int(left[length])
            place(length, bins, n, 1, 0)
            left[length] = 0
        elif partner == length:
            n = int(left[length]) // 2
            if n:
                place(length, bins, 2 * n, 2, 0)
                left[length] -= 2 * n
            else:  # one left over: try the next shorter partner
                rest = [m for m in live[:k] if left[m]]
                partner, n = (rest[-1] if rest else 0), 1
                place(length, bins, 1, 1, 0)
                left[length] = 0
                if partner:
                    place(partner, bins, 1, 1, length)
                    left[partner] -= 1
        else:
            n = int(min(left[length], left[partner]))
            place(length, bins, n, 1, 0)
            place(partner, bins, n, 1, length)
            left[length] -= n
            left[partner] -= n
        give(capacity - length - partner, bins, n)
        bins += n
        live = [m for m in live if left[m]] if not left[length] or (partner and not left[partner]) else live
    for length in range(large, 0, -1):
        n = int(left[length])
        while n:
            k = bisect_left(gaps, length)
            if k == len(gaps):
                items = capacity // length
                need = -(-n // items)
                give(capacity, bins, need)
                bins += need
                continue
            gap = gaps[k]
            first, have = groups[gap].pop()
            if not groups[gap]:
                del groups[gap]
                gaps.pop(k)
            items = gap // length
            full = min(have, n // items)
            if full:
                place(length, first, full * items, items, capacity - gap)
                give(gap - items * length, first, full)
                n -= full * items
                first, have = first + full, have - full
            if have and n and n < items:
                place(length, first, n, n, capacity - gap)
                give(gap - n * length, first, 1)
                n, first, have = 0, first + 1, have - 1
            give(gap, first, have)
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 5), bins


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = C.materialize(pieces(docs, path, capacity, cache_words), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = C.materialize(counts.withColumn("before", F.coalesce(before, F.lit(0))), "offsets")
    histogram = np.zeros(capacity + 1, np.int64)
    for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        histogram[r.length] = r.n
    runs, _ = plan(histogram, capacity)
    shared = spark.sparkContext.broadcast((runs, np.searchsorted(runs[:, 0], np.arange(capacity + 2))))  # a few thousand runs

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, starts = shared.value
        span = np.int64(1) << 40
        keys = runs[:, 0] * span + runs[:, 1]
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in ("length", "at"))
            k = np.searchsorted(keys, length * span + rank, side="right") - 1
            step = rank - runs[k, 1]
            out = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(runs[k, 2] + step // runs[k, 3]), pa.array(runs[k, 4] + step % runs[k, 3] * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    placed = cut.join(offsets.drop("n"), ["part", "length"]).withColumn("at", F.col("rank") + F.col("before")).select("doc_id", "piece", "start", "length", "ids_crc32", "at")
    return placed.mapInArrow(assign, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
