"""Uniqueness across days without reading the days again.

Beside a table kept by day lies a ledger: the 64-bit hashes of a day's keys, 8
bytes a row, written with the day and partitioned by it.  New keys meet the
ledger; only a day that holds one of their hashes is read, and only its rows
with those hashes are compared by key.  Two different keys share a hash with
probability n m / 2^64, so a day is read for nothing next to never, and the
comparison by key keeps the answer exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ledger(rows: DataFrame, key: str, day: str) -> DataFrame:
    """(day, h) of rows with a key, repeats within a day once."""
    return rows.where(F.col(key).isNotNull()).select(F.col(day).alias("day"), F.xxhash64(key).alias("h")).distinct()


def repeated(new: DataFrame, key: str, day: str, known: DataFrame, days_of: Callable[[list], DataFrame]) -> DataFrame:
    """(key, day, earlier_day, earlier_rows): keys of ``new`` that other days hold as well.

    ``known`` is the ledger; ``days_of`` reads (key, day) of the days it is given.
    Keys of the new rows are counted before anything is joined, so a key that
    repeats often is one row.
    """
    keys = new.where(F.col(key).isNotNull()).groupBy(F.col(key), F.col(day).alias("day")).agg(F.count("*").alias("_n")).drop("_n").withColumn("h", F.xxhash64(key))
    met = known.withColumnRenamed("day", "earlier_day").join(keys.select("h", "day"), "h").where("earlier_day <> day")
    hit = sorted(r.earlier_day for r in met.select("earlier_day").distinct().collect())  # a row a day
    held = days_of(hit).select(F.col(key), F.col(day).alias("earlier_day")).withColumn("h", F.xxhash64(key))
    # rows of the days hit whose hash is wanted, counted by key before they meet the new keys
    some = held.join(met.select("h").distinct(), "h", "left_semi").groupBy(key, "earlier_day").agg(F.count("*").alias("earlier_rows"))
    return keys.drop("h").join(some, key).where("earlier_day <> day")
