"""Staging as a stream: each event once by its earliest delivery; what comes again or too late is set aside.

A delivery is ``late`` if its load arrived more than ``late`` after the event: that
needs no state.  Of the others it is told per event id which stands: the first is
``kept``, one that precedes it by (load, row) but comes after it is ``revised`` and
takes its place, all others are ``repeated``.

State is what earlier batches stored as standing.  A batch is judged with it in
one window over event ids: no call of Python, no access to a state store an event.
Only events tried within ``late`` and ``disorder`` before the earliest arrival of
the batch are read, as no load can still arrive in time for others (``disorder``
is the room for deliveries of one event that disagree on its time): however long
the stream runs, no more is judged again.  That bound is on arrival: neither an
event dated in the future (quarantined before) nor an old one can move it.

A micro-batch is one write, under its own number: a batch tried again after a
failure sees what the batches before it stored and replaces itself, so what is
stored is as if each delivery had been seen once.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from switchyard.functions import as_of_column, quarantine_reason
from switchyard.operators.models import first_deliveries
from switchyard.schemas import RAW

#: Raw deliveries with the time their load arrived.
ARRIVALS = T.StructType([*RAW.fields, T.StructField("arrived_at", T.TimestampType())])
STORED = T.StructType([*ARRIVALS.fields, T.StructField("verdict", T.StringType())])


def _micros(t: timedelta) -> int:
    return t // timedelta(microseconds=1)


def _in_time(late: timedelta):
    return F.unix_micros("arrived_at") - F.unix_micros("occurred_at") <= _micros(late)


def deliveries(arrivals: DataFrame, late: timedelta, as_of: datetime | None = None, held: DataFrame | None = None) -> DataFrame:
    """Readable deliveries of a table of ``ARRIVALS`` with their ``verdict``; ``held`` are deliveries that stood before, in the same columns."""
    readable = arrivals.where(quarantine_reason(as_of_column(as_of)).isNull())
    rows = readable.where(_in_time(late)).withColumn("_held", F.lit(False))
    if held is not None:
        rows = rows.unionByName(held.withColumn("_held", F.lit(True)), allowMissingColumns=True)
    before = Window.partitionBy("event_id").orderBy(F.desc("_held"), "arrived_at", "_load_id", "_row_id").rowsBetween(Window.unboundedPreceding, -1)
    this = F.struct("_load_id", "_row_id")
    judged = rows.withColumn("_stands", F.min(this).over(before)).where("not _held")
    verdict = F.when(F.col("_stands").isNull(), "kept").when(this < F.col("_stands"), "revised").otherwise("repeated")
    return judged.withColumn("verdict", verdict).drop("_held", "_stands").unionByName(readable.where(~_in_time(late)).withColumn("verdict", F.lit("late")))


def _standing_before(rows: DataFrame, target: str, batch: int, late: timedelta, disorder: timedelta) -> DataFrame | None:
    """Of what batches before ``batch`` stored: the deliveries that stood, of events that can come again in ``rows``."""
    first = rows.where(_in_time(late)).agg(F.min(F.unix_micros("arrived_at"))).first()[0] if batch else None
    if first is None:
        return None
    schema = T.StructType([*[ARRIVALS[c] for c in ("event_id", "occurred_at", "arrived_at", "_load_id", "_row_id")], T.StructField("verdict", T.StringType()), T.StructField("batch", T.LongType())])
    past = rows.sparkSession.read.schema(schema).option("basePath", target).parquet(f"{target}/batch=*")
    since = F.timestamp_micros(F.lit(first - _micros(late) - _micros(disorder)))
    return past.where((F.col("batch") < batch) & F.col("verdict").isin("kept", "revised") & (F.col("occurred_at") >= since)).drop("verdict", "batch")


def write_batch(rows: DataFrame, target: str, batch: int) -> None:
    rows.write.mode("overwrite").partitionBy("verdict").parquet(f"{target}/batch={batch}")


def run_available(spark: SparkSession, source: str, target: str, checkpoint: str, late: timedelta, disorder: timedelta, as_of: datetime | None = None, files: int | None = None) -> None:
    """Judge and store what has landed in ``source`` since the last call, then stop.  ``files`` bounds a micro-batch."""

    def store(rows: DataFrame, batch: int) -> None:
        write_batch(deliveries(rows, late, as_of, _standing_before(rows, target, batch, late, disorder)), target, batch)

    reader = spark.readStream.schema(ARRIVALS)
    stream = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(source)
    query = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def stored(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(STORED).option("basePath", target).parquet(f"{target}/batch=*")


def standing(spark: SparkSession, target: str) -> DataFrame:
    """One delivery an event: what ``run_available`` kept, revisions in their places."""
    return first_deliveries(stored(spark, target).where(F.col("verdict").isin("kept", "revised"))).select(*RAW.names)
