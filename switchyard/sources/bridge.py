"""The ``events`` table re-read as call events: the same rows in Spark and in DuckDB SQL.

Every column says something: ``ts`` is when the call was tried, ``user_id`` the
group (destination, origin, tier) it belongs to, ``event_type`` how it ended,
``value`` (in hundredths) its seconds, its carrier among those of the group and
its purchase rate, ``props.k`` whether a person answered and whether the rate is
known.  What the table has no room for is planted by ``event_id``: missing ids,
negative seconds, dates in the future, and second deliveries in a later load.
"""

from __future__ import annotations

from datetime import UTC, date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.functions import instant
from switchyard.schemas import ORIGINS, RAW, TIERS

AS_OF = datetime(2024, 2, 1, tzinfo=UTC)
FIRST_DAY, DAYS = date(2024, 1, 1), 30  # of the given events
_FUTURE = 4_102_444_800  # 2100-01-01, UTC
_HEAVY = ((25, 0), (40, 1), (50, 2), (58, 3), (65, 4), (71, 5))  # shares of users, in hundredths, up to each of the busiest groups


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def call_events(spark: SparkSession, sf_dir: str, degraded: bool = False, start: date | None = None, n_days: int = 1) -> DataFrame:
    """Raw call events; ``degraded`` leaves most purchase rates out.

    With ``start``, only the events of ``n_days`` days: a filter on ``ts`` that reaches the scan.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    if start is not None:
        day = lambda k: F.to_timestamp_ntz(F.lit((start + timedelta(days=k)).isoformat()))
        events = events.where((F.col("ts") >= day(0)) & (F.col("ts") < day(n_days)))
    i, user = F.col("event_id"), F.col("user_id")
    said = events.select(
        i.alias("i"),
        "ts",
        (user * 37 % 100).alias("h"),
        user.alias("user"),
        "event_type",
        F.round(F.col("value") * 100).cast("long").alias("cents"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )
    i, h, cents, k, grp, c, copy = map(F.col, ("i", "h", "cents", "k", "grp", "c", "copy"))
    group = None
    for below, g in _HEAVY:
        group = (F if group is None else group).when(h < below, F.lit(g).cast("long"))
    said = said.withColumn("grp", group.otherwise(6 + F.col("user") % 18))
    said = said.withColumn("c", (grp * 5 + F.when(cents % 10 < 7, 0).otherwise(cents % (1 + grp % 3))) % 12 + 1)
    said = said.withColumn("copy", F.explode(F.when(i % 250 == 13, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    ends = F.col("event_type")
    answered = ends.isin("purchase", "signup")
    sell = 4000 + c * 100 + grp * 500
    no_rate = (k % 25 < 15) if degraded else (k % 25).isin(3, 11)
    buy = F.when(~no_rate, F.floor(sell * (50 + cents % 45) / 100.0))
    return said.select(
        F.when(i % 500 != 7, F.substring(F.sha1(F.concat_ws("|", F.col("ts").cast("date").cast("string"), i.cast("string"), ends).cast("binary")), 1, 20)).alias("event_id"),
        F.when(i % 2500 == 1999, F.timestamp_seconds(F.lit(_FUTURE))).otherwise(instant(F.col("ts"))).alias("occurred_at"),
        F.concat(F.lit("CR-"), F.lpad(c.cast("string"), 2, "0")).alias("carrier_code"),
        F.concat(F.lit("DST-"), F.lpad((grp % 10 + 1).cast("string"), 2, "0"), F.when(grp % 3 == 0, "-MOB").otherwise("-FIX")).alias("destination_code"),
        _pick(ORIGINS, grp % 6).alias("origin_cc"),
        _pick(TIERS, grp % 4).alias("service_tier"),
        F.when(answered, "answered").when(ends == "view", "no_answer").when(ends == "click", "busy").when(cents % 2 == 0, "congestion").otherwise("failed").alias("disposition"),
        F.when(~answered, F.lit(False)).when(k != 7, k % 3 != 0).alias("human_answered"),
        F.when(i % 500 == 257, -1 - cents % 60).when(answered, 1 + cents % 540).otherwise(F.lit(0)).cast("long").alias("billable_seconds"),
        (sell / F.lit(1e6)).alias("sell_rate_eur_per_min"),
        (buy.cast("double") / F.lit(1e6)).alias("buy_rate_eur_per_min"),
        (F.floor((F.dayofmonth("ts") - 1) / 10) + copy).cast("string").alias("_load_id"),
        F.md5(F.concat_ws(":", i.cast("string"), copy.cast("string")).cast("binary")).alias("_row_id"),
    ).to(RAW)


def call_events_sql(degraded: bool = False, start: date | None = None, n_days: int = 1) -> str:
    no_rate = "k % 25 < 15" if degraded else "k % 25 in (3, 11)"
    heavy = " ".join(f"when h < {below} then {g}" for below, g in _HEAVY)
    days = f" where ts >= timestamp '{start}' and ts < timestamp '{start + timedelta(days=n_days)}'" if start else ""
    return f"""
select case when i % 500 <> 7 then substr(sha1(concat_ws('|', ts::date::varchar, i::varchar, event_type)), 1, 20) end as event_id,
  case when i % 2500 = 1999 then make_timestamp({_FUTURE} * 1000000) else ts end as occurred_at,
  'CR-' || lpad(c::varchar, 2, '0') as carrier_code,
  'DST-' || lpad((grp % 10 + 1)::varchar, 2, '0') || case when grp % 3 = 0 then '-MOB' else '-FIX' end as destination_code,
  {list(ORIGINS)}[grp % 6 + 1] as origin_cc, {list(TIERS)}[grp % 4 + 1] as service_tier,
  case when event_type in ('purchase', 'signup') then 'answered' when event_type = 'view' then 'no_answer' when event_type = 'click' then 'busy' when cents % 2 = 0 then 'congestion' else 'failed' end as disposition,
  case when event_type not in ('purchase', 'signup') then false when k <> 7 then k % 3 <> 0 end as human_answered,
  (case when i % 500 = 257 then -1 - cents % 60 when event_type in ('purchase', 'signup') then 1 + cents % 540 else 0 end)::bigint as billable_seconds,
  sell / 1e6 as sell_rate_eur_per_min,
  case when not ({no_rate}) then floor(sell * (50 + cents % 45) / 100.0) / 1e6 end as buy_rate_eur_per_min,
  ((dayofmonth(ts) - 1) // 10 + copy)::varchar as _load_id, md5(i || ':' || copy) as _row_id
from (select *, 4000 + c * 100 + grp * 500 as sell from (
  select *, (grp * 5 + case when cents % 10 < 7 then 0 else cents % (1 + grp % 3) end) % 12 + 1 as c from (
    select *, case {heavy} else 6 + user_id % 18 end as grp from (
      select event_id as i, ts, user_id, user_id * 37 % 100 as h, event_type, round(value * 100)::bigint as cents, json_extract_string(props, '$.k')::bigint as k, unnest(case when event_id % 250 = 13 then [0, 1] else [0] end) as copy from events{days}))))
"""
