"""Synthetic call events as a declared plan: a range, hashes and one broadcast join.

An event is a function of (seed, day, place in the day): its eleven draws are
32-bit fractions of three MD5 hashes of that name.  So any day comes out the
same alone, in a range or on a re-run, a large day splits over as many tasks as
there are, and a lost task is simply computed again.  No Python runs on the
executors.
"""

from __future__ import annotations

from datetime import UTC, date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.schemas import RAW
from switchyard.sources.catalogue import GeneratorConfig, build

# Shape of the traffic.
HOUR_POWER, LAST_SECOND = 0.7, 86_399
OTHER_ENDS = ((0.30, "no_answer"), (0.38, "busy"), (0.44, "congestion"))  # above the answer rate; then "failed"
HUMAN_LEAST, HUMAN_MOST, MACHINE_LEAST, MACHINE_MOST = 6, 540, 1, 12
MARGIN_FLOOR, MARGIN_SPAN = 0.05, 0.45

#: The draws of an event, four to a hash.
DRAWS = ("group", "carrier", "time", "end", "human", "length", "margin", "priced", "broken", "damage", "again")
TASK_ROWS = 500_000


def fraction(digest: Column, place: int) -> Column:
    """The ``place``-th 32-bit fraction of a hexadecimal digest."""
    return F.conv(F.substring(digest, 8 * place + 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


def drawn(spark: SparkSession, start: date, n_days: int, config: GeneratorConfig) -> DataFrame:
    """One row per event before it is told: its day, its place in the day and its draws."""
    total = n_days * config.events_per_day
    ids = spark.range(0, total, 1, max(n_days, -(-total // TASK_ROWS)))
    nth = F.floor(F.col("id") / config.events_per_day).cast("int")
    placed = ids.select(nth.alias("nth"), (F.col("id") % config.events_per_day).alias("n"), F.date_add(F.lit(start), nth).cast("string").alias("on_day"))
    hashed = placed.select("*", *[F.md5(F.concat_ws("|", F.lit(str(config.seed)), "on_day", F.col("n").cast("string"), F.lit(str(k))).cast("binary")).alias(f"h{k}") for k in range(3)])
    return hashed.select("nth", "n", "on_day", *[fraction(F.col(f"h{k // 4}"), k % 4).alias(f"u_{name}") for k, name in enumerate(DRAWS)])


def picked(wheel, draw: str) -> Column:
    """Index of the first option of a wheel whose cumulative share exceeds the draw."""
    bounds = F.array(*[F.lit(b) for b in wheel.bounds[:-1]]) if len(wheel.bounds) > 1 else F.array().cast("array<double>")
    return F.size(F.filter(bounds, lambda b: b <= F.col(draw)))


def events(spark: SparkSession, start: date, n_days: int, config: GeneratorConfig | None = None, load_id: str = "0") -> DataFrame:
    """Raw deliveries of ``n_days`` days from ``start``; ``_row_id`` is the same on every run."""
    if n_days < 1:
        raise ValueError("n_days must be >= 1")
    config = config or GeneratorConfig()
    catalogue = build(config)
    rows = drawn(spark, start, n_days, config).withColumn("grp", picked(catalogue.wheel, "u_group"))
    routes = F.broadcast(catalogue.frame(spark).drop("share"))  # at most 480 groups x 4 carriers
    rows = rows.join(routes, "grp").where((F.col("u_carrier") >= F.col("lo")) & (F.col("u_carrier") < F.col("hi")))
    u = {name: F.col(f"u_{name}") for name in DRAWS}
    end = F.when(u["end"] < F.col("answers"), "answered")
    for more, name in OTHER_ENDS:
        end = end.when(u["end"] < F.col("answers") + more, name)
    rows = rows.withColumn("disposition", end.otherwise("failed"))
    answered = F.col("disposition") == "answered"
    rows = rows.withColumn("human_answered", answered & (u["human"] < F.col("humans")))
    talk = F.when(F.col("human_answered"), HUMAN_LEAST + F.floor(u["length"] * u["length"] * HUMAN_MOST)).when(answered, MACHINE_LEAST + F.floor(u["length"] * MACHINE_MOST)).otherwise(0)
    broken = u["broken"] < config.malformed_share  # stands in for the clean delivery, and comes once
    nameless, negative = broken & (u["damage"] < 0.5), broken & (u["damage"] >= 0.5)
    name = F.concat_ws("|", "on_day", F.col("n").cast("string"), "carrier_code", "destination_code", "origin_cc", "service_tier")
    buy = F.floor(F.col("sell_micro") * (1 - (MARGIN_FLOOR + u["margin"] * MARGIN_SPAN)) + 0.5)
    midnight = int(datetime(start.year, start.month, start.day, tzinfo=UTC).timestamp())
    copies = F.when(~broken & (u["again"] < config.duplicate_share), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("copy", F.explode(copies)).select(
        F.when(~nameless, F.substring(F.sha1(name.cast("binary")), 1, 20)).alias("event_id"),
        F.timestamp_seconds(F.lit(midnight) + F.col("nth").cast("long") * 86_400 + F.floor(F.pow(u["time"], F.lit(HOUR_POWER)) * LAST_SECOND)).alias("occurred_at"),
        "carrier_code",
        "destination_code",
        "origin_cc",
        "service_tier",
        "disposition",
        "human_answered",
        F.when(negative, -1 - talk).otherwise(talk).cast("long").alias("billable_seconds"),
        (F.col("sell_micro") / F.lit(1e6)).alias("sell_rate_eur_per_min"),
        F.when(u["priced"] >= config.missing_buy_rate_share, buy / F.lit(1e6)).alias("buy_rate_eur_per_min"),
        F.lit(load_id).alias("_load_id"),
        F.md5(F.concat_ws(":", "on_day", F.col("n").cast("string"), F.col("copy").cast("string")).cast("binary")).alias("_row_id"),
    ).to(RAW)
