"""Queries beyond the reference's models: streams, history, shrinkage, regret, drill-down, each with its SQL.

``sql`` is written against the CTEs of ``queries`` (raw, flagged, stg, mart, ...).
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from switchyard.functions import instant
from switchyard.operators import counting, history, regret, shrinkage, uniqueness
from switchyard.operators import models as M
from switchyard.plans import scratch
from switchyard.sources.bridge import AS_OF, FIRST_DAY, call_events
from switchyard.streaming import once

#: name -> (query, SQL after the CTEs of the models)
INSIGHTS: dict[str, tuple] = {}


def insight(name: str, sql: str):
    def register(f):
        INSIGHTS[name] = (f, sql)
        return f

    return register


def _stg(spark, d):
    return M.stg_call_events(call_events(spark, d), AS_OF)


def _mart(spark, d, minutes: int = 15):
    stg = scratch.written(M.stg_call_events(call_events(spark, d), AS_OF, minutes), "stg")
    seen = scratch.written(M.codes(stg), "codes")
    return M.agg_routing_interval(M.fct_call_attempt(stg), M.dim_carrier(seen), M.dim_destination(seen), M.dim_service_tier(seen))


# ---- the stateful stream
LATE, DISORDER, LOAD_DAYS = timedelta(days=15), timedelta(days=10), 10
_ARRIVED = f"timestamp '{FIRST_DAY}' + to_days((_load_id::int + 1) * {LOAD_DAYS})"
_JUDGED = f"""
, judged as (select *, {_ARRIVED} - occurred_at > interval {LATE.days} days as is_late from flagged where quarantine_reason is null),
placed as (select *, row_number() over (partition by event_id order by _load_id, _row_id) as nth from judged where not is_late)
"""


def _streamed(spark, d) -> str:
    """The deliveries replayed load by load, one micro-batch each; the folder of what was stored."""
    root = scratch.folder(spark, "stream")
    start = instant(F.to_timestamp_ntz(F.lit(FIRST_DAY.isoformat())))
    arrivals = call_events(spark, d).withColumn("arrived_at", start + F.make_dt_interval((F.col("_load_id").cast("int") + 1) * LOAD_DAYS))
    for load in sorted(r[0] for r in arrivals.select("_load_id").distinct().collect()):  # a row a load
        arrivals.where(F.col("_load_id") == load).write.mode("append").parquet(f"{root}/in/load={load}")
        once.run_available(spark, f"{root}/in/load=*", f"{root}/out", f"{root}/checkpoint", LATE, DISORDER, AS_OF)
    return f"{root}/out"


@insight("stream_verdicts", f"{_JUDGED} select _row_id, event_id, 'late' as verdict from judged where is_late union all select _row_id, event_id, case when nth = 1 then 'kept' else 'repeated' end from placed")
def stream_verdicts(spark, d):
    """What the stream said of every readable delivery."""
    return once.stored(spark, _streamed(spark, d)).select("_row_id", "event_id", "verdict")


@insight("stream_staging", f"{_JUDGED} select event_id, occurred_at as occurred_at_utc, carrier_code, disposition, billable_seconds from placed where nth = 1")
def stream_staging(spark, d):
    """Staging of what the stream let stand: that of a batch over the deliveries that came in time."""
    return M.stg_call_events(once.standing(spark, _streamed(spark, d)), AS_OF).select("event_id", "occurred_at_utc", "carrier_code", "disposition", "billable_seconds")


# ---- history
_VERSIONS = """
, each_day as (select carrier_code, occurred_at_utc::date as day, destination_code, count(*) as n, count(*) filter (where has_buy_rate) as known from stg group by all),
daily as (select carrier_code, day, arg_min(destination_code, (-n, destination_code)) as main_destination, sum(known)::double / sum(n)::double >= 0.9 as is_priced from each_day group by all),
lagged as (select *, lag(main_destination) over w as before_destination, lag(is_priced) over w as before_priced, row_number() over w as nth from daily window w as (partition by carrier_code order by day)),
starts as (select *, row_number() over (partition by carrier_code order by day) as version, lead(day) over (partition by carrier_code order by day) as valid_to from lagged where nth = 1 or before_destination <> main_destination or before_priced <> is_priced)
"""


@insight("dim_carrier_history", f"{_VERSIONS} select md5(carrier_code || '|' || version) as carrier_version_key, md5(carrier_code) as carrier_key, carrier_code, version, day as valid_from, valid_to, valid_to is null as is_current, main_destination, is_priced from starts")
def dim_carrier_history(spark, d):
    return history.dim_carrier_history(_stg(spark, d))


@insight("fact_as_of_carrier", f"{_VERSIONS} select s.carrier_code, v.version, v.main_destination, count(*) as attempts, count(*) filter (where s.is_answered) as answered from stg s asof join starts v on s.carrier_code = v.carrier_code and s.occurred_at_utc::date >= v.day group by all")
def fact_as_of_carrier(spark, d):
    """Attempts by the version of their carrier that was valid on their day."""
    stg = scratch.written(_stg(spark, d), "stg")
    known = scratch.written(history.versions(history.observed_by_day(stg)), "carrier-versions")
    dated = stg.select("carrier_code", F.col("occurred_at_utc").cast("date").alias("day"), "is_answered")
    met = history.as_of(dated, known, "carrier_code", "day")
    return met.groupBy("carrier_code", "version", "main_destination").agg(F.count("*").alias("attempts"), F.count_if("is_answered").alias("answered"))


# ---- shrinkage
_GROUP = ", ".join(shrinkage.GROUP)


def _strength(of: str, parent: str) -> str:
    keys = f"{parent}, " if parent else ""
    own = "(case when k > 1 and beyond > 0 then greatest(least((y / n * (1 - y / n)) / beyond - 1, {most}), 0) else {most} end)::double".format(most=f"{shrinkage.MOST}::double")
    return f"(select *, {own} as strength from (select *, (yy - y / n * y - (k - 1) * (y / n * (1 - y / n))) / nullif(n - nn / n, 0) as beyond from (select {keys} sum(y)::bigint as y, sum(n)::bigint as n, count(*) as k, sum((y::double * y / n)::decimal(28, 10))::double as yy, sum(n::hugeint * n)::double as nn from {of} {'group by all' if parent else ''})))"


_SHRUNK = f"""
, slot as (select {_GROUP}, carrier_code, interval_start_utc, human_answered_attempts as y, attempts as n from mart),
route as {_strength('slot', f'{_GROUP}, carrier_code')},
grp as {_strength('route', _GROUP)},
whole as {_strength('grp', '')},
grp_rate as (select g.*, (g.y + w.strength * (w.y / w.n)) / (g.n + w.strength) as rate from grp g cross join whole w),
route_rate as (select r.*, (r.y + g.strength * g.rate) / (r.n + g.strength) as rate from route r join grp_rate g using ({_GROUP}))
select {', '.join(f's.{k}' for k in shrinkage.LEVELS[0])}, s.y as answered_by_people, s.n as attempts, round(s.y / s.n, 9) as raw_rate, round((s.y + r.strength * r.rate) / (s.n + r.strength), 9) as rate, round(r.rate, 9) as prior
from slot s join route_rate r using ({_GROUP}, carrier_code)
"""


@insight("shrunk_answer_rates", _SHRUNK)
def shrunk_answer_rates(spark, d):
    """Every slot's rate of answers by people, drawn towards its route's, group's and the whole's."""
    rows = shrinkage.shrunk(_mart(spark, d), "human_answered_attempts")
    return rows.select(*shrinkage.LEVELS[0], F.col("y").alias("answered_by_people"), F.col("n").alias("attempts"), *[F.round(c, 9).alias(c) for c in ("raw_rate", "rate", "prior")])


# ---- the decidable perimeter
_LEARN = "dayofyear(occurred_at_utc) % 2 = 1"
_VALUED = f"""
, route as (select {_GROUP}, carrier_code, count(*) filter (where {_LEARN}) as n_l, count(*) filter (where {_LEARN} and is_human_answered) as y_l, count(*) filter (where not {_LEARN}) as n_v, count(*) filter (where not {_LEARN} and is_human_answered) as y_v from stg group by all),
total as (select {_GROUP}, sum(n_l)::bigint as learned, sum(n_v)::bigint as attempts, sum(y_v)::bigint as successes, count(*) filter (where n_l > 0) as carriers from route group by all),
met as (select r.*, r.n_l::double / t.learned as p from route r join total t using ({_GROUP}) where r.n_l > 0 and r.n_l::double / t.learned >= {regret.FLOOR}),
named as (select *, count(*) over (partition by {_GROUP}) as choices, row_number() over (partition by {_GROUP} order by y_l::double / n_l desc, n_l desc, carrier_code) as place from met),
joined as (select t.*, m.carrier_code, m.p, m.y_v / m.p / t.attempts as value, m.y_v, coalesce(m.choices >= 2 and t.attempts > 0, false) as decidable from total t left join named m on t.destination_code = m.destination_code and t.origin_cc = m.origin_cc and t.service_tier = m.service_tier and m.place = 1),
valued as (select *, greatest(y_v / (p * p) / attempts - value * value, 0) as variance, successes::double / nullif(attempts, 0) as logged_value from joined),
result as (select {_GROUP}, attempts, carriers, decidable, case when decidable then carrier_code end as named, case when decidable then p end as propensity, logged_value, case when decidable then value end as policy_value,
  case when decidable then sqrt(variance / attempts) end as std_error, case when decidable then value - sqrt(2 * variance * ln(3 / {regret.DELTA}::double) / attempts) - 3 * ln(3 / {regret.DELTA}::double) / (p * attempts) end as lower_bound, case when decidable then value - logged_value end as regret from valued)
"""
_REAL = ("propensity", "logged_value", "policy_value", "std_error", "lower_bound", "regret")


def _valued(spark, d):
    return regret.valued(regret.by_route(_stg(spark, d), F.dayofyear("occurred_at_utc") % 2 == 1))


@insight("routing_regret", f"{_VALUED} select {_GROUP}, attempts, carriers, decidable, named, {', '.join(f'round({c}, 9) as {c}' for c in _REAL)} from result")
def routing_regret(spark, d):
    """Learned on odd days, valued on even ones."""
    return _valued(spark, d).select(*shrinkage.GROUP, "attempts", "carriers", "decidable", "named", *[F.round(c, 9).alias(c) for c in _REAL])


@insight("decidable_perimeter", f"{_VALUED} select count(*) as groups, count(*) filter (where decidable) as decidable_groups, sum(attempts)::bigint as attempts, sum(case when decidable then attempts else 0 end)::bigint as decidable_attempts, round(sum(case when decidable then (regret * attempts)::decimal(28, 10) end)::double / sum(case when decidable then attempts end), 9) as regret from result")
def decidable_perimeter(spark, d):
    return regret.perimeter(_valued(spark, d)).withColumn("regret", F.round("regret", 9))


# ---- counting
_QUANTILES = (0.25, 0.5, 0.9, 0.99)


@insight("value_quantiles", " select * from (" + " union all ".join(f"select {q}::double as quantile, round(quantile_cont(value, {q}), 9) as value from events" for q in _QUANTILES) + ")")
def value_quantiles(spark, d):
    """Exact quantiles of ``events.value`` by counting passes; only counts reach the driver."""
    events = spark.read.parquet(f"{d}/events.parquet")
    found = counting.exact_quantiles(events, "value", list(_QUANTILES))
    return events.sparkSession.createDataFrame(list(zip(_QUANTILES, found, strict=True)), "quantile double, value double").withColumn("value", F.round("value", 9))


@insight("distinct_by_day", " select * from (select occurred_at_utc::date::varchar as day, count(distinct event_id) as exact, true as is_near from stg group by all union all select 'all', count(distinct event_id), true from stg)")
def distinct_by_day(spark, d):
    """Sketches by day and their union, held against exact counts at four deviations."""
    stg = scratch.written(_stg(spark, d).select(F.col("occurred_at_utc").cast("date").cast("string").alias("day"), "event_id"), "ids")
    sketches = scratch.written(counting.distinct_sketches(stg, ["day"], "event_id"), "sketches")
    estimates = counting.distinct_counts(sketches, ["day"]).unionByName(counting.distinct_counts(sketches, []).withColumn("day", F.lit("all")))
    exact = stg.groupBy("day").agg(F.count_distinct("event_id").alias("exact"))
    exact = exact.unionByName(stg.agg(F.count_distinct("event_id").alias("exact")).withColumn("day", F.lit("all")))
    return exact.join(estimates, "day").select("day", "exact", (F.abs(F.col("estimate") - F.col("exact")) <= 4 * 1.04 / 2**7 * F.col("exact") + 1).alias("is_near"))


@insight("coverage_drill_down", " select carrier_code, service_tier, grouping(carrier_code) * 2 + grouping(service_tier) as level, count(*) as attempts, count(*) filter (where has_buy_rate) as covered, (count(*) filter (where has_buy_rate))::double / count(*) as coverage, (count(*) filter (where has_buy_rate))::double / count(*) < 0.92 as failing from stg group by cube (carrier_code, service_tier)")
def coverage_drill_down(spark, d):
    """Which carriers and tiers a coverage gate of 0.92 would fail on."""
    return counting.drill_down(_stg(spark, d), ["carrier_code", "service_tier"], F.col("has_buy_rate"), 0.92)


@insight("attempt_bursts", " select user_id, count(*) as attempts, min(ts) as first_at, max(ts) as last_at from (select *, sum(is_new) over (partition by user_id order by ts rows unbounded preceding) as run from (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 6 hours then 0 else 1 end as is_new from events)) group by user_id, run")
def attempt_bursts(spark, d):
    return counting.bursts(spark.read.parquet(f"{d}/events.parquet").select("user_id", "ts"), "user_id", "ts", "6 hours")


_BENT = "case event_id % 50 when 3 then props[:-2] when 7 then '{}' when 11 then '{\"k\": \"many\"}' when 13 then null else props end"


@insight("typed_props", f" select event_id, case when reason is null then json_extract_string(p, '$.k')::bigint end as k, reason from (select event_id, p, case when p is null then 'missing_props' when not json_valid(p) then 'malformed_props' when json_extract_string(p, '$.k') is null then 'missing_k' when try_cast(json_extract_string(p, '$.k') as bigint) is null then 'k_is_no_number' end as reason from (select event_id, {_BENT} as p from events))")
def typed_props(spark, d):
    """Properties read as numbers; some rows are bent first, so that each reason occurs."""
    i = F.col("event_id") % 50
    bent = F.when(i == 3, F.expr("left(props, length(props) - 1)")).when(i == 7, "{}").when(i == 11, '{"k": "many"}').when(i == 13, F.lit(None).cast("string")).otherwise(F.col("props"))
    return counting.typed_props(spark.read.parquet(f"{d}/events.parquet").select("event_id", bent.alias("props"))).select("event_id", "k", "reason")


# ---- uniqueness across days
_SPLIT = FIRST_DAY + timedelta(days=20)
_PLANTED = "(case when event_id % 500 = 3 and ts >= timestamp '{split}' then event_id % 4000 else event_id end)::varchar".format(split=_SPLIT)


@insight("repeated_across_days", f" select n.key, n.day, o.day as earlier_day, o.n as earlier_rows from (select distinct {_PLANTED} as key, ts::date::varchar as day from events where ts >= timestamp '{_SPLIT}') n join (select {_PLANTED} as key, ts::date::varchar as day, count(*) as n from events where ts < timestamp '{_SPLIT}' group by all) o using (key)")
def repeated_across_days(spark, d):
    """Late days, some of whose keys are given again from early ones, held against the ledger of the early days."""
    events, split = spark.read.parquet(f"{d}/events.parquet"), F.to_timestamp_ntz(F.lit(_SPLIT.isoformat()))
    again = (F.col("event_id") % 500 == 3) & (F.col("ts") >= split)
    keyed = events.select("ts", F.when(again, F.col("event_id") % 4000).otherwise(F.col("event_id")).cast("string").alias("key"), F.col("ts").cast("date").cast("string").alias("day"))
    root = scratch.folder(spark, "by-day")
    early = keyed.where(F.col("ts") < split).drop("ts")
    early.write.partitionBy("day").parquet(f"{root}/rows")
    uniqueness.ledger(early, "key", "day").write.partitionBy("day").parquet(f"{root}/ledger")
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{root}/{name}")
    return uniqueness.repeated(keyed.where(F.col("ts") >= split), "key", "day", read("ledger", "h long, day string"), lambda days: read("rows", "key string, day string").where(F.col("day").isin(days)))


# ---- the mart by day: thick slots
@insight("agg_routing_day", " select * from mart")
def agg_routing_day(spark, d):
    return _mart(spark, d, 1440)


@insight("dq_day_density", " select * from density")
def dq_day_density(spark, d):
    return M.dq_interval_density(_mart(spark, d, 1440))
