"""Embedding near-duplicates by randomised-rotation binary codes.

Each unit vector is turned by seeded random rotations; the signs are its binary
code and the inner product of the first code with the rotated vector is its
stored correction factor.  Beside them it stores its rotated components as
8-bit integers (a fixed dither per dimension makes their rounding unbiased) with
their offset and step.  Of a pair, one's code times the other's integers, over
the one's factor, estimates the cosine without bias: an inner product of small
whole numbers, exact in single precision.  The spread of the estimate follows
from the factor and the step; a pair whose confidence bound (``EPSILON``
deviations) lies below the threshold is rejected on that alone.  Only undecided
pairs are recomputed exactly, in double precision: links have to be exact, so
none is accepted on its estimate.

Candidates come from the same codes: ``bands`` bands of ``BAND_BITS`` sign bits.
Two vectors at cosine 0.98 agree in a bit with probability 1 - acos(0.98)/pi =
0.936, so one of 24 bands of 16 bits matches with probability
1 - (1 - 0.936^16)^24 > 0.9999 (closer pairs: more).  A pair counts only under
the first band in which it agrees, which its codes tell before it is recomputed:
one exact product a pair, and link counts need no pair table.

Equal vectors are collapsed first.  Buckets of one are dropped by a counted
join.  A bucket of more than ``tile`` vectors is dealt into square tiles, each
compared in its own task as a block: per vector only its number of links and
one edge to the least vector of its part leave the task, never the pairs.  Most
buckets hold two or three vectors; those of up to ``SMALL`` are compared many at
a time, pair by pair in arrays, by the same codes, estimates and products.

Defined results: vectors that are null, zero, or hold null or non-finite
components, rows with a null label or null vec_id, and vectors of other lengths
link with nothing: n_links 0, component_id = vec_id (null and kept where that is
null).  Repeated rows link with each other.  Vectors are told apart by their
values, never by vec_id: rows that share one but not the vector link as any two
do, and every row comes out once.  A vec_id of any orderable type will do.
Vectors are scaled by a power of two first, which changes no cosine, so that
squares of finite components neither overflow nor vanish.  An empty table gives
an empty result.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.llm import _common as C
from switchyard.llm._graph import connected_components

THRESHOLD = 0.98
BANDS = 24
BAND_BITS = 16
SEED = 17
EPSILON = 5.75


@lru_cache(maxsize=8)
def rotations(dim: int, count: int) -> np.ndarray:
    """``count`` random rotations, stacked: (count * dim) x dim."""
    rng = np.random.default_rng(SEED + dim)
    return np.vstack([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(count)])


@lru_cache(maxsize=8)
def dither(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED + dim + 1).random(dim)


LEVELS = 255


def encode(unit: np.ndarray, bands: int = BANDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors: codes (n x bands of 16 bits), correction factors, 8-bit components, their offsets and steps."""
    dim = unit.shape[1]
    turned = unit @ rotations(dim, -(-bands * BAND_BITS // dim)).T
    bits = turned[:, : bands * BAND_BITS] > 0
    first = turned[:, :dim]
    low = first.min(1)
    step = np.maximum((first.max(1) - low) / (LEVELS - 1), 1e-300)
    ints = np.clip(np.floor((first - low[:, None]) / step[:, None] + dither(dim)), 0, LEVELS).astype(np.uint8)
    return np.packbits(bits, axis=1).reshape(len(unit), -1), np.abs(first).sum(1) / np.sqrt(dim), ints, low, step


def _check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """vec_id, label, dim, raw double bytes and their digest; unusable vectors have none."""
    for b in batches:
        dims, raws, digests = [], [], []
        for v, label, vec_id in zip(b["embedding"], b["label"], b["vec_id"], strict=True):
            x = None
            if v is not None and len(v) and not pd.isna(label) and not pd.isna(vec_id):
                x = np.array([np.nan if c is None else c for c in v], dtype=np.float64) + 0.0  # -0.0 is 0.0
                most = np.abs(x).max() if np.isfinite(x).all() else 0.0
                x = np.ldexp(x, -np.frexp(most)[1]) if most > 0 else None  # exact
            raw = None if x is None else x.tobytes()
            dims.append(0 if x is None else len(x))
            raws.append(raw)
            digests.append(None if raw is None else hashlib.blake2b(raw, digest_size=16).digest())
        yield pd.DataFrame({"vec_id": b["vec_id"], "label": b["label"], "dim": np.array(dims, np.int32), "raw": raws, "digest": digests})


def _encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        codes, ints = [None] * len(b), [None] * len(b)
        numbers = np.zeros((3, len(b)))
        for dim, rows in b.groupby("dim").indices.items():
            x = np.frombuffer(b"".join(b["raw"].iloc[rows]), np.float64).reshape(-1, dim)
            c, factor, small, low, step = encode(x / np.linalg.norm(x, axis=1, keepdims=True))
            numbers[:, rows] = factor, low, step
            for i, code, own in zip(rows, c, small, strict=True):
                codes[i], ints[i] = code.tobytes(), own.tobytes()
        yield pd.DataFrame({"rep": b["rep"], "label": b["label"], "dim": b["dim"], "copies": b["copies"], "raw": b["raw"], "code": codes, "ints": ints, "factor": numbers[0], "low": numbers[1], "step": numbers[2]})


#: Pairs recomputed at a time where few of a block are undecided.
PAIRS = 65_536
#: Buckets (or tiles) of up to so many vectors are compared together.
SMALL = 64


class _Group:
    """Vectors of one bucket tile, ready for comparison."""

    def __init__(self, b: pd.DataFrame, threshold: float):
        self.threshold, self.dim, self.band = threshold, int(b["dim"].iloc[0]), int(b["band"].iloc[0])
        self.rep, self.copies = b["rep"].to_numpy(np.int64), b["copies"].to_numpy(np.int64)
        x = np.frombuffer(b"".join(b["raw"]), np.float64).reshape(-1, self.dim)
        self.unit = x / np.sqrt((x * x).sum(1))[:, None]
        self.codes = np.frombuffer(b"".join(b["code"]), np.uint16).reshape(len(b), -1)
        signs = np.unpackbits(self.codes.view(np.uint8).reshape(len(b), -1), axis=1)[:, : self.dim]
        self.signs = signs.astype(np.float32) * 2 - 1
        self.ints = np.frombuffer(b"".join(b["ints"]), np.uint8).reshape(len(b), self.dim).astype(np.float32)
        self.factor, self.low, self.step = (np.maximum(b[c].to_numpy(), least) for c, least in (("factor", 1e-6), ("low", -np.inf), ("step", 0)))
        self.slot = b["slot"].to_numpy()

    def estimates(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated cosines |a| x |b| from what is stored, and the deviation of each at the threshold."""
        width = self.signs.shape[1]
        scale = np.sqrt(width) * self.factor[a, None]
        product = (self.signs[a] @ self.ints[b, :width].T) * self.step[b] + self.signs[a].sum(1)[:, None] * self.low[b]
        f2 = self.factor[a, None] ** 2
        code = np.maximum(1 - f2, 0) / f2 * (1 - self.threshold**2) / max(self.dim - 1, 1)
        return product / scale, np.sqrt(code + (self.step[b] / 2) ** 2 / f2)

    def undecided(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a[k] and b[k] are not rejected on their estimate."""
        width = self.signs.shape[1]
        if width < self.dim:
            return np.ones(len(a), bool)
        signs, f2 = self.signs[a], self.factor[a] ** 2
        product = np.einsum("ij,ij->i", signs, self.ints[b, :width]) * self.step[b] + signs.sum(1) * self.low[b]
        code = np.maximum(1 - f2, 0) / f2 * (1 - self.threshold**2) / max(self.dim - 1, 1)
        return product / (np.sqrt(width) * self.factor[a]) >= self.threshold - EPSILON * np.sqrt(code + (self.step[b] / 2) ** 2 / f2)

    def adjacent(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Boolean |a| x |b|: linked, and this is the first band in which they agree."""
        estimate, spread = self.estimates(a, b)
        if self.signs.shape[1] < self.dim:  # vectors wider than their code: decided exactly
            estimate = np.full(estimate.shape, np.inf)
        r, c = np.nonzero(estimate >= self.threshold - EPSILON * spread)
        for k in range(self.band):  # found under an earlier band already
            new = self.codes[a[r], k] != self.codes[b[c], k]
            r, c = r[new], c[new]
        out = np.zeros(estimate.shape, bool)
        if 4 * len(r) > out.size:  # most are undecided: one product of the block
            out[r, c] = (self.unit[a] @ self.unit[b].T)[r, c] >= self.threshold
        else:
            for lo in range(0, len(r), PAIRS):
                i, j = r[lo : lo + PAIRS], c[lo : lo + PAIRS]
                out[i, j] = np.einsum("ij,ij->i", self.unit[a[i]], self.unit[b[j]]) >= self.threshold
        return out

    def compare_each(self, bucket: np.ndarray, band: np.ndarray, cross: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``compare`` for many small buckets or tiles at once; ``bucket`` numbers them, those of one stand together."""
        n = len(bucket)
        after = np.searchsorted(bucket, bucket, side="right") - np.arange(n) - 1
        starts = np.cumsum(after) - after
        rows, found = np.arange(n), []
        for lo, hi in _slices(after, PAIRS):
            a = np.repeat(rows[lo:hi], after[lo:hi])
            b = np.arange(len(a)) - np.repeat(starts[lo:hi] - starts[lo], after[lo:hi]) + a + 1
            keep = (self.codes[a] == self.codes[b]).argmax(1) == band[a]  # the first band in which they agree
            keep &= ~cross[a] | (self.slot[a] != self.slot[b])
            a, b = a[keep], b[keep]
            keep = self.undecided(a, b)
            a, b = a[keep], b[keep]
            keep = np.einsum("ij,ij->i", self.unit[a], self.unit[b]) >= self.threshold
            found.append((a[keep], b[keep]))
        a, b = map(np.concatenate, zip(*found, strict=True))
        some = np.unique(np.concatenate((a, b)))
        links = np.bincount(a, self.copies[b], n) + np.bincount(b, self.copies[a], n)
        root = self.rep.copy()
        while True:  # least label over neighbours until it stands still
            least = root.copy()
            np.minimum.at(least, a, root[b])
            np.minimum.at(least, b, root[a])
            if (least == root).all():
                return self.rep[some], root[some], links[some].astype(np.int64)
            root = least

    def compare(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per linked vector: rep, least rep of its part of the tile, copies linked."""
        if i == j:
            adj = self.adjacent(np.arange(len(self.rep)), np.arange(len(self.rep)))
            np.fill_diagonal(adj, False)
            adj |= adj.T
            order = np.arange(len(self.rep))
        else:
            a, b = np.nonzero(self.slot == i)[0], np.nonzero(self.slot == j)[0]
            cross = self.adjacent(a, b)
            order = np.concatenate((a, b))
            adj = np.zeros((len(order), len(order)), bool)
            adj[: len(a), len(a) :] = cross
            adj[len(a) :, : len(a)] = cross.T
        rep, copies = self.rep[order], self.copies[order]
        some = adj.any(1)
        if not some.any():
            return (np.zeros(0, np.int64),) * 3
        adj, rep, copies = adj[np.ix_(some, some)], rep[some], copies[some]
        root = rep.copy()
        while True:  # least label over neighbours until it stands still
            least = np.minimum(root, np.where(adj, root[None, :], np.iinfo(np.int64).max).min(1))
            if (least == root).all():
                return rep, root, adj @ copies
            root = least


def _slices(weights: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of places whose weights sum to about ``most``."""
    part = (np.cumsum(weights) - weights) // most
    cuts = np.nonzero(np.diff(part, prepend=-1))[0]
    yield from zip(cuts.tolist(), [*cuts[1:].tolist(), len(weights)], strict=True)


def compared(b: pd.DataFrame, starts: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Links of a frame of whole buckets or tiles, each from one of ``starts``."""
    sizes = np.diff(starts, append=len(b))
    for k in np.nonzero(sizes > SMALL)[0]:
        g = b.iloc[starts[k] : starts[k] + sizes[k]]
        yield _Group(g, threshold).compare(int(g["i"].iloc[0]), int(g["j"].iloc[0]))
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    small = np.nonzero((sizes[bucket] <= SMALL) & (sizes[bucket] > 1))[0]
    for _, of_dim in b["dim"].iloc[small].groupby(b["dim"].iloc[small].to_numpy()).indices.items():
        g = b.iloc[small[of_dim]]
        yield _Group(g, threshold).compare_each(bucket[small[of_dim]], g["band"].to_numpy(), (g["i"] != g["j"]).to_numpy())


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = 1024) -> DataFrame:
    """Per row of (vec_id, label, embedding): vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    kind = {f.name: f.dataType.simpleString() for f in vectors.schema}
    checked = C.materialize(vectors.select("vec_id", "label", "embedding").mapInPandas(_check, f"vec_id {kind['vec_id']}, label {kind['label']}, dim int, raw binary, digest binary"), "vectors")
    distinct = checked.where("digest is not null").groupBy("label", "dim", "digest").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("raw").alias("raw"))
    distinct = C.materialize(distinct.withColumn("rep", F.monotonically_increasing_id()), "distinct")  # a key of its own for every vector
    codes = C.materialize(distinct.select("rep", "label", "dim", "copies", "raw").mapInPandas(_encode, f"rep long, label {kind['label']}, dim int, copies long, raw binary, code binary, ints binary, factor double, low double, step double"), "codes")
    width = BAND_BITS // 8
    keys = F.posexplode(F.array(*[F.substring("code", k * width + 1, width) for k in range(BANDS)])).alias("band", "key")
    placed = codes.select("rep", "label", "dim", keys)
    bucket = ["label", "dim", "band", "key"]
    members = placed.join(placed.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1"), bucket)
    members = members.withColumn("tiles", F.ceil(F.col("n") / tile).cast("int")).withColumn("slot", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(*bucket, "rep", "slot", F.least("slot", "other").alias("i"), F.greatest("slot", "other").alias("j"))
    full = members.join(codes.drop("label", "dim"), "rep")
    group = [*bucket, "i", "j"]
    dealt = full.repartition(*group).sortWithinPartitions(*group)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None

        def whole():
            nonlocal rest
            for b in batches:
                b = b if rest is None or not len(rest) else pd.concat([rest, b], ignore_index=True)
                if not len(b):
                    continue
                b = b.reset_index(drop=True)
                new = np.ones(len(b), bool)
                new[1:] = False
                for c in group:
                    v = b[c].to_numpy()
                    new[1:] |= v[1:] != v[:-1]
                starts = np.nonzero(new)[0]
                if len(starts) > 1:
                    yield b.iloc[: starts[-1]], starts[:-1]
                rest = b.iloc[starts[-1] :]
            if rest is not None and len(rest):
                yield rest, np.zeros(1, np.int64)

        out, held = [], 0
        for b, starts in whole():
            for links in compared(b, starts, threshold):
                out.append(links)
                held += len(links[0])
                if held > 50_000:
                    yield pd.DataFrame(dict(zip(("a", "b", "n"), map(np.concatenate, zip(*out, strict=True)), strict=True)))
                    out, held = [], 0
        if held:
            yield pd.DataFrame(dict(zip(("a", "b", "n"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    found = C.materialize(dealt.mapInPandas(compare, "a long, b long, n long"), "links")
    comp = connected_components(found.select("a", "b"))
    linked = found.groupBy("a").agg(F.sum("n").alias("n"))
    reps = distinct.select("rep", "label", "dim", "digest", "least", "copies").join(linked, F.col("rep") == F.col("a"), "left").join(comp, F.col("rep") == F.col("vertex"), "left")
    reps = C.materialize(reps.select("label", "dim", "digest", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")), "reps")
    roots = reps.groupBy("component").agg(F.min("least").alias("component_id"))
    known = reps.join(roots, "component").select(F.col("label").alias("_l"), F.col("dim").alias("_m"), F.col("digest").alias("_g"), "n_links", "component_id")
    ids = checked.select("vec_id", "label", "dim", "digest")
    out = ids.join(known, (F.col("label") == F.col("_l")) & (F.col("dim") == F.col("_m")) & (F.col("digest") == F.col("_g")), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))


def planted(vectors: DataFrame) -> DataFrame:
    """The vectors, and two bent copies of each under ids of their own: near ones, and ones about the threshold."""
    wide = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))

    def bent(bend: float) -> Column:
        return F.transform("embedding", lambda x, i: x * (1 + F.lit(bend) * (((F.col("vec_id") * 31 + i * 17) % 7) - 3)))

    return wide.union(wide.select(F.col("vec_id") + 1_000_000_000, "label", bent(0.02))).union(wide.select(F.col("vec_id") + 2_000_000_000, "label", bent(0.1)))


def embedding_dedup_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(planted(C.table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")))


def links_sql(vectors: str = "select vec_id, label, embedding::double[] as embedding from embeddings") -> str:
    """All links by brute force and their components, in DuckDB SQL."""
    return f"""
with recursive v as materialized ({vectors}),
usable as materialized (select vec_id, label, embedding, sqrt(list_sum([x * x for x in embedding])) as norm from v
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and list_sum([x * x for x in embedding]) > 0),
pairs as materialized (select a.vec_id as a, b.vec_id as b from usable a join usable b on a.label = b.label and a.vec_id <> b.vec_id and len(a.embedding) = len(b.embedding)
  where list_inner_product(a.embedding, b.embedding) / (a.norm * b.norm) >= {THRESHOLD}),
reach as (select vec_id as a, vec_id as b from v union select r.a, p.b from reach r join pairs p on r.b = p.a),
least as (select a, min(b) as component_id from reach group by a),
counts as (select a, count(*) as n from pairs group by a)
select v.vec_id, coalesce(n, 0)::bigint as n_links, component_id::bigint as component_id, v.vec_id = component_id as kept
from v left join counts on counts.a = v.vec_id left join least on least.a = v.vec_id
"""


_BENT = " union all ".join(f"select vec_id + {k * 1_000_000_000}, label, [x * (1 + {bend}::double * (((vec_id * 31 + (i - 1) * 17) % 7) - 3)) for x, i in embedding::double[]] from embeddings" for k, bend in ((1, 0.02), (2, 0.1)))
PLANTED_SQL = links_sql("select vec_id, label, embedding::double[] as embedding from embeddings union all " + _BENT)
