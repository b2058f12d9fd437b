"""A dimension with history: versions from daily observations, and joins as of a moment.

A day's observation of a carrier is its main destination and whether its
purchase rates are mostly known.  Days on which neither changed are one version
(gaps and islands), valid from its first day until the next version's; the last
one is open.  So versions of a carrier can't overlap or leave a gap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from switchyard.functions import share, surrogate_key

WATCHED = ["main_destination", "is_priced"]


def observed_by_day(stg: DataFrame, priced: float = 0.9) -> DataFrame:
    """(carrier_code, day, main_destination, is_priced): one row a carrier and day, from partial sums."""
    day = F.col("occurred_at_utc").cast("date").alias("day")
    each = stg.groupBy("carrier_code", day, "destination_code").agg(F.count("*").alias("n"), F.count_if("has_buy_rate").alias("known"))
    # most attempts, then the least code
    main = F.min_by("destination_code", F.struct((-F.col("n")).alias("n"), "destination_code")).alias("main_destination")
    return each.groupBy("carrier_code", "day").agg(main, (share(F.sum("known"), F.sum("n")) >= priced).alias("is_priced"))


def versions(daily: DataFrame, key: str = "carrier_code", watched: list[str] = WATCHED) -> DataFrame:
    """Versions of ``daily`` (one row a key and day): key, version (from 1), valid_from, valid_to (exclusive; null: open), is_current."""
    by_day = Window.partitionBy(key).orderBy("day")
    same = F.lit(True)
    for c in watched:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(by_day))
    first = F.lag("day").over(by_day).isNull()
    marked = daily.withColumn("_new", (first | ~same).cast("int")).withColumn("version", F.sum("_new").over(by_day))
    spans = marked.where("_new = 1").select(key, "version", F.col("day").alias("valid_from"), *watched)
    until = F.lead("valid_from").over(Window.partitionBy(key).orderBy("valid_from"))
    return spans.withColumn("valid_to", until).withColumn("is_current", F.col("valid_to").isNull()).select(key, "version", "valid_from", "valid_to", "is_current", *watched)


def dim_carrier_history(stg: DataFrame) -> DataFrame:
    rows = versions(observed_by_day(stg))
    return rows.select(surrogate_key(F.concat_ws("|", "carrier_code", F.col("version").cast("string"))).alias("carrier_version_key"), surrogate_key("carrier_code").alias("carrier_key"), *rows.columns)


def as_of(rows: DataFrame, history: DataFrame, key: str, at: str, days: int = 7) -> DataFrame:
    """``rows`` with the version that was valid at the date ``at``; rows before a key's first version get none.

    Both sides carry the number of the ``days``-wide range they fall in (a
    version once for each range it touches), so the join is on equal keys, a
    busy key is dealt over its ranges, and only versions of one range are
    compared by date.  An open version reaches as far as the rows do.
    """
    epoch = F.lit("1970-01-01").cast("date")
    bucket = lambda d: F.floor(F.datediff(d, epoch) / days)
    last = rows.agg(F.max(at).alias("last"))
    spans = history.crossJoin(last).where(F.col("valid_from") <= F.col("last"))  # by one row
    until = F.coalesce(F.date_sub("valid_to", 1), F.col("last"))
    spans = spans.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("valid_from")), bucket(F.greatest(F.least(until, F.col("last")), F.col("valid_from")))))).drop("last")
    given = [c for c in history.columns if c != key]
    spans = spans.withColumnsRenamed({key: "_key", "valid_from": "_from", "valid_to": "_to"})
    valid = (F.col(key) == F.col("_key")) & (bucket(F.col(at)) == F.col("_bucket")) & (F.col(at) >= F.col("_from")) & (F.col("_to").isNull() | (F.col(at) < F.col("_to")))
    return rows.join(spans, valid, "left").withColumnsRenamed({"_from": "valid_from", "_to": "valid_to"}).select(*rows.columns, *given)
