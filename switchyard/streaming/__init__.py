"""Incremental staging with Structured Streaming."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.functions import as_of_column, quarantine_reason
from switchyard.operators.models import first_deliveries
from switchyard.schemas import RAW_TABLE


def admissible_once(raw: DataFrame, as_of: datetime | None = None, late: str = "2 days") -> DataFrame:
    """Admissible events of a stream, each id once within ``late``.

    The classifier comes before the watermark, so a future-dated row can't move
    it.  State is dropped ``late`` behind the newest event, and events that come
    later than that are dropped with it: for aggregates over a stream, not for
    keeping events (see ``load_available``).
    """
    rows = raw.where(quarantine_reason(as_of_column(as_of)).isNull())
    return rows.withWatermark("occurred_at", late).dropDuplicatesWithinWatermark(["event_id"])


def load_available(spark: SparkSession, source: str, target: str, checkpoint: str, as_of: datetime | None = None) -> None:
    """Store admissible events that have landed in ``source`` since the last call, each id once, then stop.

    The checkpoint holds the cursor.  A micro-batch is compared with what earlier
    batches stored of the days it touches, so events are told apart however late
    they come, without state, and none is dropped.  It is written to a folder of
    its own number: a batch that is tried again replaces itself.
    """
    home = spark._jvm.org.apache.hadoop.fs.Path(target)

    def store(rows: DataFrame, batch: int) -> None:
        session = rows.sparkSession
        fresh = first_deliveries(rows.where(quarantine_reason(as_of_column(as_of)).isNull()))
        if home.getFileSystem(session._jsc.hadoopConfiguration()).exists(home):
            touched = [r.day for r in rows.select("day").distinct().collect()]  # a row per day
            known = [d for d in touched if d is not None]
            stored = session.read.option("basePath", target).parquet(target).where((F.col("batch") != batch) & (F.col("day").isin(known) | F.col("day").isNull()))
            seen = stored.select(F.col("day").alias("_day"), F.col("event_id").alias("_id")).distinct()
            fresh = fresh.join(seen, F.col("day").eqNullSafe(F.col("_day")) & (F.col("event_id") == F.col("_id")), "left_anti")
        fresh.write.mode("overwrite").partitionBy("day").parquet(f"{target}/batch={batch}")

    stream = spark.readStream.schema(RAW_TABLE).parquet(source)
    query = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def interval_attempts(raw: DataFrame, minutes: int = 15, late: str = "2 days", as_of: datetime | None = None) -> DataFrame:
    """Attempts by tumbling interval and carrier, for append mode.

    Unreadable deliveries are left out and repeated ones counted once, before
    anything can move the watermark.
    """
    rows = admissible_once(raw, as_of, late)
    return rows.groupBy(F.window("occurred_at", f"{minutes} minutes"), "carrier_code").agg(F.count("*").alias("attempts"), F.count_if(F.col("disposition") == "answered").alias("answered_attempts"))
