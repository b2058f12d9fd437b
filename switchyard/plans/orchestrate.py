"""One logical day at a time, and the freshness objective."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.functions import as_of_column
from switchyard.plans.runner import Report, run
from switchyard.sources.catalogue import GeneratorConfig
from switchyard.sources.loaders import Destination, Source, load, read_raw


def with_retries(step: Callable, retries: int = 3, first_delay: float = 30.0, most: float = 600.0, sleep: Callable[[float], None] = time.sleep):
    """Run ``step``; retry with doubling delays.  For loads only: a gate's verdict is final."""
    for attempt in range(retries + 1):
        try:
            return step()
        except Exception:
            if attempt == retries:
                raise
            sleep(min(first_delay * 2**attempt, most))


def run_day(spark: SparkSession, logical_date: date, where: Destination, config: GeneratorConfig | None = None, as_of: datetime | None = None, source: Source | None = None, **retry) -> Report:
    """Load exactly that day, then build what it touches and test.  Nothing here asks what day it is."""
    as_of = as_of or datetime(logical_date.year, logical_date.month, logical_date.day, tzinfo=UTC) + timedelta(days=1)
    with_retries(lambda: load(spark, logical_date, 1, where, config, source=source), **retry)
    return run(spark, read_raw(spark, where), f"{where.root}/models", as_of, days=[logical_date])


def backfill(spark: SparkSession, start: date, end: date, where: Destination, config: GeneratorConfig | None = None, each: bool = False, source: Source | None = None, **retry) -> dict[date, Report]:
    """Days from ``start`` to ``end`` (both included).

    The range is loaded at once and its days are built once, so the work grows
    with the days and not with their square; every day gets the report of that
    build.  With ``each`` the days are run one by one; each builds what it touches.
    """
    days = [start + timedelta(days=k) for k in range((end - start).days + 1)]
    latest = datetime(end.year, end.month, end.day, tzinfo=UTC) + timedelta(days=1)
    if each:
        return {d: run_day(spark, d, where, config, latest, source, **retry) for d in days}
    with_retries(lambda: load(spark, start, len(days), where, config, source=source), **retry)
    return dict.fromkeys(days, run(spark, read_raw(spark, where), f"{where.root}/models", latest, days=days))


def freshness(raw: DataFrame, as_of: datetime | None = None, warn_hours: int = 2, error_hours: int = 6) -> DataFrame:
    """One row: newest event, its age in seconds, and pass, warn or error (error without rows)."""
    newest = raw.agg(F.max(F.unix_micros("occurred_at")).alias("us")).withColumn("age", F.floor((F.unix_micros(as_of_column(as_of)) - F.col("us")) / 1_000_000))
    status = F.when(F.col("age").isNull() | (F.col("age") > error_hours * 3600), "error").when(F.col("age") > warn_hours * 3600, "warn").otherwise("pass")
    return newest.select(F.col("us").alias("newest_us"), F.col("age").alias("age_seconds"), status.alias("status"))
