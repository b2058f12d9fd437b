"""One explicit schema per layer; nothing is inferred."""

from pyspark.sql import types as T

RAW = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("occurred_at", T.TimestampType()),
        T.StructField("carrier_code", T.StringType()),
        T.StructField("destination_code", T.StringType()),
        T.StructField("origin_cc", T.StringType()),
        T.StructField("service_tier", T.StringType()),
        T.StructField("disposition", T.StringType()),
        T.StructField("human_answered", T.BooleanType()),
        T.StructField("billable_seconds", T.LongType()),
        T.StructField("sell_rate_eur_per_min", T.DoubleType()),
        T.StructField("buy_rate_eur_per_min", T.DoubleType()),
        T.StructField("_load_id", T.StringType()),
        T.StructField("_row_id", T.StringType()),
    ]
)
#: The raw table is partitioned by UTC day.
RAW_TABLE = T.StructType([*RAW.fields, T.StructField("day", T.DateType())])

# Code lists of the domain.
CARRIERS = tuple(f"CR-{k:02d}" for k in range(1, 13))
DESTINATIONS = tuple(f"DST-{k:02d}-{kind}" for k in range(1, 11) for kind in ("FIX", "MOB"))
ORIGINS = ("33", "34", "44", "49", "39", "32")
TIERS = ("economy", "standard", "premium", "critical")
DISPOSITIONS = ("answered", "no_answer", "busy", "failed", "congestion")
REASONS = ("missing_event_id", "negative_billable_seconds", "occurred_in_the_future")
GRAIN = ("interval_start_utc", "carrier_code", "destination_code", "origin_cc", "service_tier")
