"""The models, each a pure function of DataFrames."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from switchyard.functions import as_of_column, interval_bucket, micro, quarantine_reason, rounded, share, surrogate_key, utc_naive
from switchyard.schemas import GRAIN, TIERS


def classified(raw: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """``raw`` with its quarantine reason: one pass, fanned out to both sides."""
    return raw.withColumn("quarantine_reason", quarantine_reason(as_of_column(as_of)))


def first_deliveries(rows: DataFrame) -> DataFrame:
    """The earliest delivery of every event.

    Rows without an id are gone by now, so the window's key is uniform; the
    filter on the rank is pushed below the shuffle as a group limit.
    """
    order = Window.partitionBy("event_id").orderBy("_load_id", "_row_id")
    return rows.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def stg_call_events(raw: DataFrame, as_of: datetime | None = None, minutes: int = 15) -> DataFrame:
    """One row per call attempt: admissible, deduplicated, pinned to UTC, bucketed."""
    rows = first_deliveries(classified(raw, as_of).where("quarantine_reason is null"))
    at = utc_naive("occurred_at")
    return rows.select(
        "event_id",
        at.alias("occurred_at_utc"),
        interval_bucket(at, minutes).alias("interval_start_utc"),
        "carrier_code",
        "destination_code",
        "origin_cc",
        "service_tier",
        "disposition",
        (F.col("disposition") == "answered").alias("is_answered"),
        F.coalesce("human_answered", F.lit(False)).alias("is_human_answered"),
        "billable_seconds",
        (F.col("billable_seconds") / F.lit(60.0)).alias("billable_minutes"),
        "sell_rate_eur_per_min",
        "buy_rate_eur_per_min",
        F.col("buy_rate_eur_per_min").isNotNull().alias("has_buy_rate"),
        (F.col("sell_rate_eur_per_min") - F.col("buy_rate_eur_per_min")).alias("margin_eur_per_min"),
    )


def stg_call_events_quarantine(raw: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """Unreadable deliveries, kept and labelled."""
    kept = ["event_id", "occurred_at", "carrier_code", "destination_code", "origin_cc", "service_tier", "disposition", "billable_seconds", "sell_rate_eur_per_min", "buy_rate_eur_per_min", "quarantine_reason", "_load_id", "_row_id"]
    return classified(raw, as_of).where("quarantine_reason is not null").select(*kept)


_CODES = ("carrier_code", "destination_code", "service_tier")


def codes(stg: DataFrame) -> DataFrame:
    """What the dimensions are made of, in one pass over staging: a row for each code of each kind.

    Grouping sets; ``kind`` names the code that a row is about.
    """
    seen = [F.min("occurred_at_utc").alias("first_seen_at_utc"), F.max("occurred_at_utc").alias("last_seen_at_utc"), F.count("*").alias("attempt_count")]
    kind = F.when(F.grouping("carrier_code") == 0, "carrier_code").when(F.grouping("destination_code") == 0, "destination_code").otherwise("service_tier")
    return stg.groupingSets([[c] for c in _CODES], *_CODES).agg(kind.alias("kind"), *seen)


def _of(rows: DataFrame, code: str) -> DataFrame:
    """Rows of one kind of code, from ``codes`` or from staging."""
    return (rows if "kind" in rows.columns else codes(rows)).where(F.col("kind") == code)


def dim_carrier(stg: DataFrame) -> DataFrame:
    """From staging, or from its ``codes``."""
    return _of(stg, "carrier_code").select(surrogate_key("carrier_code").alias("carrier_key"), "carrier_code", "first_seen_at_utc", "last_seen_at_utc", "attempt_count")


def dim_destination(stg: DataFrame) -> DataFrame:
    part = lambda n: F.split_part("destination_code", F.lit("-"), F.lit(n))
    return _of(stg, "destination_code").select(surrogate_key("destination_code").alias("destination_key"), "destination_code", part(2).alias("country_code"), part(3).alias("network_type"), (part(3) == "MOB").alias("is_mobile"), "attempt_count")


def dim_service_tier(stg: DataFrame) -> DataFrame:
    """An unknown tier has no rank: a null that the not-null check reports."""
    rank = None
    for n, tier in enumerate(TIERS, 1):
        rank = (F if rank is None else rank).when(F.col("service_tier") == tier, n)
    return _of(stg, "service_tier").select(surrogate_key("service_tier").alias("service_tier_key"), "service_tier", rank.alias("tier_rank"), "attempt_count")


def fct_call_attempt(stg: DataFrame) -> DataFrame:
    """Foreign keys are computed, not looked up: no join."""
    keys = [surrogate_key(f"{d}_code" if d != "service_tier" else d).alias(f"{d}_key") for d in ("carrier", "destination", "service_tier")]
    dropped = {"event_id", "carrier_code", "destination_code", "service_tier"}
    return stg.select(F.col("event_id").alias("call_attempt_key"), *keys, *[c for c in stg.columns if c not in dropped])


#: A dimension of up to so many rows (two short codes each: some 10 MB) is broadcast.
SMALL_DIMENSION = 100_000


def looked_up(rows: DataFrame, dims: list[tuple[DataFrame, str, str]], most: int = SMALL_DIMENSION) -> DataFrame:
    """``rows`` that every dimension (table, key, code) covers, with its natural code.

    The dimensions' sizes are measured first, all in one job; a small one is
    broadcast, so the rows stay where they are.  A larger one is joined by
    shuffle, whose key then has many values.
    """
    narrow = [dim.select(key, code) for dim, key, code in dims]
    sized = [n.limit(most + 1).agg(F.lit(k).alias("k"), F.count("*").alias("n")) for k, n in enumerate(narrow)]
    sizes = {r.k: r.n for r in reduce(DataFrame.union, sized).collect()}
    for k, (_, key, _) in enumerate(dims):
        rows = rows.join(F.broadcast(narrow[k]) if sizes[k] <= most else narrow[k], key)
    return rows


def star(fact: DataFrame, carrier: DataFrame, destination: DataFrame, tier: DataFrame) -> DataFrame:
    """Rows that every dimension covers, with natural codes back."""
    return looked_up(fact, [(carrier, "carrier_key", "carrier_code"), (destination, "destination_key", "destination_code"), (tier, "service_tier_key", "service_tier")])


def agg_routing_interval(fact: DataFrame, carrier: DataFrame, destination: DataFrame, tier: DataFrame) -> DataFrame:
    """The decision mart.  Money is summed in whole second-microeuros and divided once.

    A key is the hash of its code, so attempts are grouped by the keys before
    any join: slots, not attempts, meet the dimensions.
    """
    n, secs = F.count("*"), F.col("billable_seconds")
    eur = F.lit(60_000_000.0)
    sell, buy, priced = micro("sell_rate_eur_per_min"), micro("buy_rate_eur_per_min"), F.col("has_buy_rate")
    slots = fact.groupBy("interval_start_utc", "carrier_key", "destination_key", "origin_cc", "service_tier_key").agg(
        n.alias("attempts"),
        F.count_if("is_answered").alias("answered_attempts"),
        F.count_if("is_human_answered").alias("human_answered_attempts"),
        share(F.count_if("is_answered"), n).alias("answer_rate"),
        share(F.count_if("is_human_answered"), n).alias("human_answer_rate"),
        F.sum(secs).alias("billable_seconds"),
        (F.sum(secs) / F.lit(60.0)).alias("billable_minutes"),
        F.avg(F.when(F.col("is_human_answered"), secs)).alias("avg_human_call_seconds"),
        (F.sum(secs * sell) / eur).alias("revenue_eur"),
        (F.sum(F.when(priced, secs * buy)) / eur).alias("cost_eur"),
        (F.sum(F.when(priced, secs * (sell - buy))) / eur).alias("margin_eur"),
        share(F.count_if(priced), n).alias("buy_rate_coverage"),
    )
    measures = [c for c in slots.columns if c not in GRAIN and not c.endswith("_key")]
    return star(slots, carrier, destination, tier).select(*GRAIN, *measures)


def dq_interval_density(mart: DataFrame, thick: int = 30) -> DataFrame:
    """One row: how thin the mart is.  The median is exact."""
    full = F.count_if(F.col("attempts") >= thick)
    return mart.agg(
        F.count("*").alias("slots"),
        F.sum("attempts").alias("attempts"),
        rounded(F.avg("attempts"), 2).alias("mean_attempts_per_slot"),
        F.percentile("attempts", F.lit(0.5)).alias("median_attempts_per_slot"),
        F.max("attempts").alias("max_attempts_per_slot"),
        full.alias("slots_at_or_above_30"),
        rounded(share(full, F.count("*")), 4).alias("share_at_or_above_30"),
        rounded(F.avg("buy_rate_coverage"), 4).alias("mean_buy_rate_coverage"),
        F.min("interval_start_utc").alias("first_interval_utc"),
        F.max("interval_start_utc").alias("last_interval_utc"),
    )
