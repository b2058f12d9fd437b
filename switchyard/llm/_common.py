"""Shared helpers: tables, scratch tables in the shared folder, bounded training samples."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local session uses a folder of this process; any
    other raises, as its executors would not see that folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        global _local
        if _local is None:
            _local = tempfile.TemporaryDirectory(prefix="switchyard-")
            atexit.register(_local.cleanup)
        found = f"file://{_local.name}"
    return found.rstrip("/")


_local: tempfile.TemporaryDirectory | None = None


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage durably: a lost executor costs one re-read, never a recompute
    of what came before.  The table goes when the session's JVM ends.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    home = spark._jvm.org.apache.hadoop.fs.Path(path)
    home.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(home)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table through Spark's own file system layer."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def give_back() -> None:
    """Return memory that a fit has freed to the system, where the C library can (elsewhere nothing happens)."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores in front until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out


def spread_join(rows: DataFrame, keyed: DataFrame, key: str, spread: str, hot: int = 100_000, parts: int = 64, counts: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``keyed`` (one row per key) on ``key``, hot keys dealt over tasks.

    The most frequent keys of more than ``hot`` rows (1,000 at most: any further
    one holds under a thousandth of all rows) get a salt from the hash of
    ``spread`` on the one side and a copy per salt on the other.  Without hot keys
    it is the plain join.  ``counts`` (key, n) spares the counting where it is known.
    """
    salt, heavy, n = unused(rows.join(keyed.limit(0), key), "_salt", "_heavy", "_n")
    counts = (rows.groupBy(key).agg(F.count("*").alias(n)) if counts is None else counts.withColumnRenamed("n", n)).where(F.col(n) > hot)
    found = counts.orderBy(F.desc(n)).limit(1000).select(key).collect()  # 1,000 keys at most
    if not found:
        return rows.join(keyed, key)
    kind = T.StructType([T.StructField(key, keyed.schema[key].dataType), T.StructField(heavy, T.BooleanType())])
    big = F.broadcast(rows.sparkSession.createDataFrame([(r[0], True) for r in found], kind))
    left = rows.join(big, key, "left").withColumn(salt, F.when(F.col(heavy), F.pmod(F.xxhash64(spread), F.lit(parts))).otherwise(0).cast("int"))
    copies = F.when(F.col(heavy), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    right = keyed.join(big, key, "left").withColumn(salt, F.explode(copies))
    return left.drop(heavy).join(right.drop(heavy), [key, salt]).drop(salt)


def fold(doc_id: Column, parts: int, held: int) -> Column:
    """Whether crc32(doc_id as text) mod ``parts`` is ``held``; a null id never is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == held, F.lit(False))


def bounded_sample(labelled: DataFrame, per_class: int, total: int) -> tuple[list[tuple[int, object]], dict]:
    """At most ``per_class`` rows of each class and about ``total`` in all, by hash order of doc_id.

    ``labelled`` has doc_id and y; an id with several labels takes the least.
    Returns [(doc_id, y)] in hash order and the row count of each class over
    *all* of ``labelled``.  With more than ``total`` classes the ``total`` largest
    are taken.  The counts give each class a cut on the hash below which its
    share of rows lies (six deviations of room); the rows under the cuts, about
    ``total``, are cut to size on the driver, so nothing is ever ordered or
    gathered by class on the cluster.
    """
    spark = labelled.sparkSession
    rows = labelled.where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.min("y").alias("y"))
    counts = {r.y: r["count"] for r in rows.groupBy("y").count().orderBy(F.desc("count"), "y").limit(total).collect()}
    if not counts:
        return [], {}
    each = max(1, min(per_class, total // len(counts)))
    room = each + 6 * each**0.5 + 10
    cuts = spark.createDataFrame([(y, int(min(1.0, room / n) * 2**62)) for y, n in counts.items()], T.StructType([labelled.schema["y"], T.StructField("cut", T.LongType())]))
    near = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id"), 2)).join(F.broadcast(cuts), "y").where("h <= cut")  # at most `total` classes
    taken: dict = {}
    picked = []
    for r in sorted(near.select("doc_id", "y", "h").collect(), key=lambda r: (r.h, r.doc_id)):
        taken[r.y] = taken.get(r.y, 0) + 1
        if taken[r.y] <= each:
            picked.append((r.doc_id, r.y))
    return picked, counts


def fetch_texts(docs: DataFrame, picked: list[tuple[int, object]], max_chars: int) -> dict:
    """doc_id -> whole text for the bounded list ``picked`` of (doc_id, class).

    Whole texts are taken in hash order until a class has used ``max_chars``
    characters (its first text always); long texts count, none is left out for
    its length.  An id with several texts takes the least.
    """
    if not picked:
        return {}
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(i, n) for n, (i, _) in enumerate(picked)], T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n", T.IntegerType())]))
    rows = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(wanted), "doc_id")  # at most `total` ids of the sample
        .groupBy("doc_id", "n")
        .agg(F.min("text").alias("text"))
        .orderBy("n")
    )
    classes, used, out = dict(picked), {}, {}
    for r in rows.toLocalIterator():
        y = classes[r.doc_id]
        if y not in used or used[y] + len(r.text) <= max_chars:
            used[y] = used.get(y, 0) + len(r.text)
            out[r.doc_id] = r.text
        else:
            used[y] = max_chars + 1
    return out


def training_set(docs: DataFrame, labelled: DataFrame, per_class: int, total: int, max_chars: int):
    """(texts, classes, y, weights): weights undo the class-balanced sampling."""
    picked, counts = bounded_sample(labelled, per_class, total)
    texts = fetch_texts(docs, picked, max_chars)
    give_back()
    picked = [(i, y) for i, y in picked if i in texts]
    classes = sorted({y for _, y in picked})
    y = np.array([classes.index(c) for _, c in picked], dtype=np.int64)
    have = np.bincount(y, minlength=len(classes)) if len(y) else np.zeros(0)
    share = np.array([counts.get(c, 1) for c in classes], float) / np.maximum(have, 1)
    weights = share[y] if len(y) else np.zeros(0)
    return [texts[i] for i, _ in picked], classes, y, weights / max(weights.mean(), 1e-9) if len(y) else weights


def crc32_sql(text: str) -> str:
    """CRC-32 of ASCII text in DuckDB SQL, bit by bit."""
    per_byte = "list_reduce(list_concat([xor(a, b)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda r, z: xor(r >> 1, (r & 1) * 3988292384))"
    return f"xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split({text}, ''), lambda ch: ascii(ch)::bigint)), lambda a, b: {per_byte}), 4294967295)"
