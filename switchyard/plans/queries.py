"""Registered queries over the bridge and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.functions import interval_bucket, micro, quarantine_reason, share, surrogate_key, utc_naive
from switchyard.operators import checks as K
from switchyard.operators import models as M
from switchyard.plans import damage, insight_queries, runner, scratch, source_queries
from switchyard.plans.orchestrate import backfill, freshness, run_day
from switchyard.schemas import GRAIN, REASONS
from switchyard.sources import loaders
from switchyard.sources.bridge import AS_OF, call_events, call_events_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_AS_OF = "timestamp '2024-02-01'"
_REASON = f"case when event_id is null then 'missing_event_id' when billable_seconds < 0 then 'negative_billable_seconds' when occurred_at > {_AS_OF} then 'occurred_in_the_future' end"
_CTES = f"""
raw as ({{raw}}),
flagged as (select *, {_REASON} as quarantine_reason from raw),
quarantine as (select * from flagged where quarantine_reason is not null),
ranked as (select *, row_number() over (partition by event_id order by _load_id, _row_id) as rn from flagged where quarantine_reason is null),
stg as (select event_id, occurred_at as occurred_at_utc, time_bucket(interval '15 minutes', occurred_at) as interval_start_utc, carrier_code, destination_code,
  origin_cc, service_tier, disposition, disposition = 'answered' as is_answered, coalesce(human_answered, false) as is_human_answered, billable_seconds,
  billable_seconds / 60.0::double as billable_minutes, sell_rate_eur_per_min, buy_rate_eur_per_min, buy_rate_eur_per_min is not null as has_buy_rate,
  sell_rate_eur_per_min - buy_rate_eur_per_min as margin_eur_per_min from ranked where rn = 1),
dim_carrier as (select md5(carrier_code) as carrier_key, carrier_code, min(occurred_at_utc) as first_seen_at_utc, max(occurred_at_utc) as last_seen_at_utc, count(*) as attempt_count from stg group by carrier_code),
dim_destination as (select md5(destination_code) as destination_key, destination_code, split_part(destination_code, '-', 2) as country_code,
  split_part(destination_code, '-', 3) as network_type, split_part(destination_code, '-', 3) = 'MOB' as is_mobile, count(*) as attempt_count from stg group by destination_code),
dim_service_tier as (select md5(service_tier) as service_tier_key, service_tier, (case service_tier when 'economy' then 1 when 'standard' then 2 when 'premium' then 3 when 'critical' then 4 end)::int as tier_rank, count(*) as attempt_count from stg group by service_tier),
fct as (select event_id as call_attempt_key, md5(carrier_code) as carrier_key, md5(destination_code) as destination_key, md5(service_tier) as service_tier_key,
  origin_cc, occurred_at_utc, interval_start_utc, disposition, is_answered, is_human_answered, billable_seconds, billable_minutes, sell_rate_eur_per_min, buy_rate_eur_per_min, has_buy_rate, margin_eur_per_min from stg),
star as (select f.*, c.carrier_code, d.destination_code, t.service_tier, round(sell_rate_eur_per_min * 1e6)::bigint as sell_micro, round(buy_rate_eur_per_min * 1e6)::bigint as buy_micro
  from fct f join dim_carrier c using (carrier_key) join dim_destination d using (destination_key) join dim_service_tier t using (service_tier_key)),
mart as (select interval_start_utc, carrier_code, destination_code, origin_cc, service_tier, count(*) as attempts,
  count(*) filter (where is_answered) as answered_attempts, count(*) filter (where is_human_answered) as human_answered_attempts,
  (count(*) filter (where is_answered))::double / count(*)::double as answer_rate, (count(*) filter (where is_human_answered))::double / count(*)::double as human_answer_rate,
  sum(billable_seconds)::bigint as billable_seconds, sum(billable_seconds)::bigint / 60.0::double as billable_minutes,
  avg(billable_seconds) filter (where is_human_answered) as avg_human_call_seconds,
  sum(billable_seconds * sell_micro)::bigint / 60000000.0::double as revenue_eur,
  (sum(billable_seconds * buy_micro) filter (where has_buy_rate))::bigint / 60000000.0::double as cost_eur,
  (sum(billable_seconds * (sell_micro - buy_micro)) filter (where has_buy_rate))::bigint / 60000000.0::double as margin_eur,
  (count(*) filter (where has_buy_rate))::double / count(*)::double as buy_rate_coverage
  from star group by interval_start_utc, carrier_code, destination_code, origin_cc, service_tier),
density as (select count(*) as slots, sum(attempts)::bigint as attempts, round(avg(attempts)::decimal(18,6), 2)::double as mean_attempts_per_slot,
  quantile_cont(attempts, 0.5)::double as median_attempts_per_slot, max(attempts) as max_attempts_per_slot, count(*) filter (where attempts >= 30) as slots_at_or_above_30,
  round(((count(*) filter (where attempts >= 30))::double / count(*))::decimal(18,6), 4)::double as share_at_or_above_30,
  round(avg(buy_rate_coverage)::decimal(18,6), 4)::double as mean_buy_rate_coverage, min(interval_start_utc) as first_interval_utc, max(interval_start_utc) as last_interval_utc from mart)
"""


def _sql(select: str, degraded: bool = False) -> str:
    return "with " + _CTES.replace("{raw}", call_events_sql(degraded)) + select


def query(name: str, sql: str | None = None, degraded: bool = False):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = _sql(sql, degraded)
        return f

    return register


def _stg(spark: SparkSession, d: str, degraded: bool = False) -> DataFrame:
    return M.stg_call_events(call_events(spark, d, degraded), AS_OF)


class Nodes(dict):
    """Every node over the bridge, built when asked for.

    What several nodes read (staging, the dimensions, the mart) is written once.
    ``damaged`` breaks each node after it is built from sound parents.
    """

    def __init__(self, spark: SparkSession, d: str, degraded: bool = False, damaged: bool = False):
        super().__init__()
        self.raw, self.damaged, self.sound = call_events(spark, d, degraded), damaged, {}

    def _built(self, name: str) -> DataFrame:
        if name not in self.sound:
            b = self._built
            if name == "call_events":
                out = self.raw
            elif name == "stg_call_events":
                out = scratch.written(M.stg_call_events(self.raw, AS_OF), name)
            elif name == "stg_call_events_quarantine":
                out = M.stg_call_events_quarantine(self.raw, AS_OF)
            elif name == "codes":
                out = scratch.written(M.codes(b("stg_call_events")), name)
            elif name.startswith("dim_"):
                out = getattr(M, name)(b("codes"))
            elif name == "fct_call_attempt":
                out = M.fct_call_attempt(b("stg_call_events"))
            elif name == "agg_routing_interval":
                out = scratch.written(M.agg_routing_interval(b("fct_call_attempt"), *map(b, _DIMS)), name)
            else:
                out = M.dq_interval_density(b("agg_routing_interval"))
            self.sound[name] = out
        return self.sound[name]

    def __missing__(self, name: str) -> DataFrame:
        out = self._built(name)
        self[name] = damage.damaged(name, out) if self.damaged else out
        return self[name]


_DIMS = ("dim_carrier", "dim_destination", "dim_service_tier")


# ---- raw layer
@query("raw_scan_counts", "select count(*) as delivered, count(distinct event_id) as distinct_events, count(*) filter (where event_id is null) as missing_ids, count(*) filter (where billable_seconds < 0) as negative from raw")
def raw_scan_counts(spark, d):
    return call_events(spark, d).agg(F.count("*").alias("delivered"), F.count_distinct("event_id").alias("distinct_events"), F.count_if(F.col("event_id").isNull()).alias("missing_ids"), F.count_if(F.col("billable_seconds") < 0).alias("negative"))


@query("quarantine_classify", "select _row_id, coalesce(quarantine_reason, 'admissible') as reason from flagged")
def quarantine_classify(spark, d):
    return M.classified(call_events(spark, d), AS_OF).select("_row_id", F.coalesce("quarantine_reason", F.lit("admissible")).alias("reason"))


_QUARANTINE = "event_id, carrier_code, destination_code, origin_cc, service_tier, disposition, billable_seconds, sell_rate_eur_per_min, buy_rate_eur_per_min, quarantine_reason, _load_id, _row_id"


@query("quarantine_rows", f"select {_QUARANTINE}, occurred_at as occurred_at_utc from flagged where quarantine_reason is not null")
def quarantine_rows(spark, d):
    rows = M.stg_call_events_quarantine(call_events(spark, d), AS_OF)
    return rows.select(*_QUARANTINE.split(", "), utc_naive("occurred_at").alias("occurred_at_utc"))


@query("staging_admissible", "select _load_id, count(*) as admissible from flagged where quarantine_reason is null group by _load_id")
def staging_admissible(spark, d):
    return M.classified(call_events(spark, d), AS_OF).where("quarantine_reason is null").groupBy("_load_id").agg(F.count("*").alias("admissible"))


@query("staging_dedup", "select event_id, _load_id, _row_id from ranked where rn = 1")
def staging_dedup(spark, d):
    return M.first_deliveries(M.classified(call_events(spark, d), AS_OF).where("quarantine_reason is null")).select("event_id", "_load_id", "_row_id")


@query("stg_call_events", "select * from stg")
def stg_call_events(spark, d):
    return _stg(spark, d)


@query("interval_bucket", "select event_id, time_bucket(interval '5 minutes', occurred_at_utc) as b5, interval_start_utc as b15, time_bucket(interval '60 minutes', occurred_at_utc) as b60, time_bucket(interval '1440 minutes', occurred_at_utc) as b1440, time_bucket(interval '7 minutes', occurred_at_utc, timestamp '2000-01-01') as b7, time_bucket(interval '2500 minutes', occurred_at_utc, timestamp '2000-01-01') as b2500 from stg")
def interval_buckets(spark, d):
    at = F.col("occurred_at_utc")
    return _stg(spark, d).select("event_id", *[interval_bucket(at, n).alias(f"b{n}") for n in (5, 15, 60, 1440, 7, 2500)])


@query("utc_day_rollup", "select occurred_at_utc::date as utc_day, count(*) as attempts from stg group by all")
def utc_day_rollup(spark, d):
    return _stg(spark, d).groupBy(F.col("occurred_at_utc").cast("date").alias("utc_day")).agg(F.count("*").alias("attempts"))


@query("duplicate_rate", "select count(*) as delivered, count(distinct event_id) as distinct_events, (count(event_id) - count(distinct event_id))::double / count(*)::double as duplicate_share from raw")
def duplicate_rate(spark, d):
    again = F.count("event_id") - F.count_distinct("event_id")
    return call_events(spark, d).agg(F.count("*").alias("delivered"), F.count_distinct("event_id").alias("distinct_events"), share(again, F.count("*")).alias("duplicate_share"))


@query("incremental_load", "select count(*) as appended, count(distinct event_id) as distinct_events, min(occurred_at) as first_at_utc from raw where occurred_at >= (select max(occurred_at) from raw where _load_id = '1' and occurred_at <= timestamp '2024-02-01') or occurred_at is null")
def incremental_load(spark, d):
    """What an append from the mark of load 1 would read again or anew (closed boundary)."""
    raw = call_events(spark, d)
    mark = raw.where((F.col("_load_id") == "1") & (F.col("occurred_at") <= F.lit(AS_OF))).agg(F.max(F.unix_micros("occurred_at"))).first()[0]  # one row, read before the rows
    fresh = raw.where(F.col("occurred_at").isNull() | (F.unix_micros("occurred_at") >= F.lit(mark)))
    return fresh.agg(F.count("*").alias("appended"), F.count_distinct("event_id").alias("distinct_events"), F.min(utc_naive("occurred_at")).alias("first_at_utc"))


@query("freshness_status", f"select epoch_us(max(occurred_at))::bigint as newest_us, floor((epoch_us({_AS_OF}) - epoch_us(max(occurred_at))) / 1000000.0)::bigint as age_seconds, case when epoch_us({_AS_OF}) - epoch_us(max(occurred_at)) > 21600000000 then 'error' when epoch_us({_AS_OF}) - epoch_us(max(occurred_at)) > 7200000000 then 'warn' else 'pass' end as status from flagged where quarantine_reason is null")
def freshness_status(spark, d):
    return freshness(M.classified(call_events(spark, d), AS_OF).where("quarantine_reason is null"), AS_OF)


# ---- star schema and mart
for _dim, _select in (("dim_carrier", "select * from dim_carrier"), ("dim_destination", "select * from dim_destination"), ("dim_service_tier", "select * from dim_service_tier")):
    query(_dim, _select)(lambda spark, d, build=getattr(M, _dim): build(_stg(spark, d)))


@query("fct_call_attempt", "select * from fct")
def fct_call_attempt(spark, d):
    return M.fct_call_attempt(_stg(spark, d))


@query("star_join", "select call_attempt_key, carrier_code, destination_code, service_tier from star")
def star_join(spark, d):
    n = Nodes(spark, d)
    return M.star(n["fct_call_attempt"], n["dim_carrier"], n["dim_destination"], n["dim_service_tier"]).select("call_attempt_key", "carrier_code", "destination_code", "service_tier")


@query("agg_routing_interval", "select * from mart")
def agg_routing_interval(spark, d):
    return Nodes(spark, d)["agg_routing_interval"]


@query("answer_rates", "select carrier_code, (count(*) filter (where is_answered))::double / count(*) as answer_rate, (count(*) filter (where is_human_answered))::double / count(*) as human_answer_rate from stg group by carrier_code")
def answer_rates(spark, d):
    n = F.count("*")
    return _stg(spark, d).groupBy("carrier_code").agg(share(F.count_if("is_answered"), n).alias("answer_rate"), share(F.count_if("is_human_answered"), n).alias("human_answer_rate"))


@query("filtered_avg", "select origin_cc, avg(billable_seconds) filter (where is_human_answered) as avg_human_call_seconds from stg group by origin_cc")
def filtered_avg(spark, d):
    return _stg(spark, d).groupBy("origin_cc").agg(F.avg(F.when(F.col("is_human_answered"), F.col("billable_seconds"))).alias("avg_human_call_seconds"))


@query("money_sums", "select destination_code, sum(billable_seconds * sell_micro)::bigint / 6e7 as revenue_eur, (sum(billable_seconds * buy_micro) filter (where has_buy_rate))::bigint / 6e7 as cost_eur from star group by destination_code")
def money_sums(spark, d):
    secs = F.col("billable_seconds")
    return _stg(spark, d).groupBy("destination_code").agg((F.sum(secs * micro("sell_rate_eur_per_min")) / F.lit(6e7)).alias("revenue_eur"), (F.sum(F.when(F.col("has_buy_rate"), secs * micro("buy_rate_eur_per_min"))) / F.lit(6e7)).alias("cost_eur"))


@query("dq_interval_density", "select * from density")
def dq_interval_density(spark, d):
    return Nodes(spark, d)["dq_interval_density"]


@query("slot_median", "select origin_cc, quantile_cont(attempts, 0.5)::double as median_attempts from mart group by origin_cc")
def slot_median(spark, d):
    return Nodes(spark, d)["agg_routing_interval"].groupBy("origin_cc").agg(F.percentile("attempts", F.lit(0.5)).alias("median_attempts"))


@query("threshold_share", "select service_tier, count(*) filter (where attempts >= 30) as thick, (count(*) filter (where attempts >= 30))::double / count(*) as thick_share from mart group by service_tier")
def threshold_share(spark, d):
    thick = F.count_if(F.col("attempts") >= 30)
    return Nodes(spark, d)["agg_routing_interval"].groupBy("service_tier").agg(thick.alias("thick"), share(thick, F.count("*")).alias("thick_share"))


# ---- checks: a summary each, on clean and on degraded rows
def _summary(selects: dict[str, str]) -> str:
    return " union all ".join(f"select '{n}' as \"check\", count(*) as failures, case when count(*) = 0 then 'PASS' else 'FAIL' end as status from ({s})" for n, s in selects.items())


_SQL_NODE = {"stg_call_events": "stg", "stg_call_events_quarantine": "quarantine", "fct_call_attempt": "fct", "agg_routing_interval": "mart", "dq_interval_density": "density", "dim_carrier": "dim_carrier", "dim_destination": "dim_destination", "dim_service_tier": "dim_service_tier"}
_SQL_NAME = _SQL_NODE


def _kind(prefix: str) -> list[K.Check]:
    return [c for c in K.CHECKS if c.name.startswith(prefix)]


def _generic(prefix: str, sql_of: Callable[[str, str], str]) -> dict[str, str]:
    out = {}
    for c in _kind(prefix):
        node = c.on[0]
        column = c.name.removeprefix(f"{prefix}{node}_")
        out[c.name] = sql_of(node, column)
    return out


_ACCEPTED = {"service_tier": ("economy", "standard", "premium", "critical"), "disposition": ("answered", "no_answer", "busy", "failed", "congestion"), "quarantine_reason": REASONS, "network_type": ("FIX", "MOB")}
_COVERAGE = "select count(*) as attempts, count(*) filter (where has_buy_rate) as with_buy_rate, (count(*) filter (where has_buy_rate))::double / count(*) as coverage from fct"
_FAMILIES = {
    "dq_not_null": _generic("not_null_", lambda n, c: f"select 1 from {_SQL_NODE[n]} where {c} is null"),
    "dq_unique": _generic("unique_", lambda n, c: f"select {c} from {_SQL_NODE[n]} where {c} is not null group by {c} having count(*) > 1"),
    "dq_accepted_values": _generic("accepted_values_", lambda n, c: f"select 1 from {_SQL_NODE[n]} where {c} not in {_ACCEPTED[c]}"),
    "dq_relationships": _generic("relationship_", lambda n, c: f"select 1 from fct where {c} is not null and not exists (select 1 from dim_{c.removesuffix('_key')} p where p.{c} = fct.{c})"),
    "assert_buy_rate_coverage_above_threshold": f"select * from ({_COVERAGE}) where coverage < 0.85",
    "assert_quarantine_volume_below_threshold": "select * from (select (select count(*) from quarantine) as q, (select count(*) from raw) as n) where q::double / nullif(n, 0) > 0.01 or q = 0",
    "assert_human_answer_implies_answer": "select 1 from fct where is_human_answered and not is_answered",
    "assert_no_billing_without_answer": "select 1 from fct where not is_answered and billable_seconds > 0",
    "assert_purchase_rate_below_sale": "select 1 from fct where has_buy_rate and buy_rate_eur_per_min >= sell_rate_eur_per_min",
    "assert_rates_are_within_bounds": "select 1 from mart where answer_rate not between 0 and 1 or human_answer_rate not between 0 and 1 or buy_rate_coverage not between 0 and 1 or human_answer_rate > answer_rate",
    "assert_routing_interval_grain_is_unique": f"select 1 from mart group by {', '.join(GRAIN)} having count(*) > 1",
    "assert_density_summary_is_one_row": "select count(*) from density having count(*) <> 1",
}
for _name, _selects in _FAMILIES.items():
    _selects = _selects if isinstance(_selects, dict) else {_name: _selects}
    _checks = [c for c in K.CHECKS if c.name in _selects]
    query(_name, _summary(_selects))(lambda spark, d, checks=_checks: K.report(checks, Nodes(spark, d)))
    # every check again where it must fail
    QUERIES[f"{_name}_damaged"] = lambda spark, d, checks=_checks: K.report(checks, Nodes(spark, d, damaged=True))
    ORACLE_SQL[f"{_name}_damaged"] = "with " + _CTES.replace("{raw}", call_events_sql()) + damage.sql_ctes(_SQL_NAME) + ", checked as (select 1) " + f"select * from ({_summary(damage.renamed(_selects, _SQL_NAME))})"
query("assert_buy_rate_coverage_above_threshold_degraded", _summary({"assert_buy_rate_coverage_above_threshold": _FAMILIES["assert_buy_rate_coverage_above_threshold"]}), True)(
    lambda spark, d: K.report([K.SINGULAR[0]], Nodes(spark, d, degraded=True))
)


@query("gate_buy_rate_coverage", _COVERAGE)
def gate_buy_rate_coverage(spark, d):
    return M.fct_call_attempt(_stg(spark, d)).agg(F.count("*").alias("attempts"), F.count_if("has_buy_rate").alias("with_buy_rate"), share(F.count_if("has_buy_rate"), F.count("*")).alias("coverage"))


@query("gate_quarantine_volume", "select q as quarantined, n as delivered, q::double / nullif(n, 0) as quarantined_share from (select (select count(*) from flagged where quarantine_reason is not null) as q, (select count(*) from raw) as n)")
def gate_quarantine_volume(spark, d):
    raw = call_events(spark, d)
    held = M.stg_call_events_quarantine(raw, AS_OF).agg(F.count("*").alias("quarantined"))
    both = held.crossJoin(raw.agg(F.count("*").alias("delivered")))  # one row by one row
    return both.withColumn("quarantined_share", share(F.col("quarantined"), F.col("delivered")))


# ---- source expressions
@query("top_carriers", "select carrier_code, count(*) as attempts from stg group by carrier_code order by attempts desc, carrier_code limit 3")
def top_carriers(spark, d):
    return _stg(spark, d).groupBy("carrier_code").agg(F.count("*").alias("attempts")).orderBy(F.desc("attempts"), "carrier_code").limit(3)


@query("event_id_hash", "select event_id as id, substr(sha1(concat_ws('|', ts::date::varchar, event_id::varchar, event_type)), 1, 20) as hashed from events")
def event_id_hash(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    return ev.select(F.col("event_id").alias("id"), F.substring(F.sha1(F.concat_ws("|", F.col("ts").cast("date").cast("string"), F.col("event_id").cast("string"), "event_type").cast("binary")), 1, 20).alias("hashed"))


@query("route_eligibility", "select distinct carrier_code, destination_code, origin_cc, service_tier, md5(carrier_code) as carrier_key from stg")
def route_eligibility(spark, d):
    return _stg(spark, d).select("carrier_code", "destination_code", "origin_cc", "service_tier", surrogate_key("carrier_code").alias("carrier_key")).distinct()


# ---- builds by touched day
@query("mart_by_days", "select * from mart where interval_start_utc < timestamp '2024-01-04'")
def mart_by_days(spark, d):
    """Three loaded days built in three steps: later days are first in the future, then admissible."""
    root, first, n = scratch.folder(spark, "by-days"), source_queries.FIRST_DAY, source_queries.DAYS
    where = loaders.destination("parquet", root)
    loaders.overwrite_days(call_events(spark, d, start=first, n_days=n), where)
    for k in range(n):
        as_of = datetime(2024, 1, 2 + k, tzinfo=UTC)
        runner.run(spark, loaders.read_raw(spark, where), f"{root}/models", as_of, [], [first] if k == 0 else [])
    return runner.Tables(spark, f"{root}/models").read("agg_routing_interval")


def _replay(d: str) -> loaders.Source:
    return lambda spark, start, n: call_events(spark, d, start=start, n_days=n)


@query("daily_runs", "select * from mart where interval_start_utc < timestamp '2024-01-04'")
def daily_runs(spark, d):
    """Three logical days, each loaded, built and tested by itself: the mart they leave."""
    first, where = source_queries.FIRST_DAY, loaders.destination("parquet", scratch.folder(spark, "daily"))
    for k in range(source_queries.DAYS):
        run_day(spark, first + timedelta(days=k), where, source=_replay(d))
    return runner.Tables(spark, f"{where.root}/models").read("agg_routing_interval")


@query("backfill_range", "select * from mart where interval_start_utc < timestamp '2024-01-04'")
def backfill_range(spark, d):
    """The same days as one load and one build."""
    first, where = source_queries.FIRST_DAY, loaders.destination("parquet", scratch.folder(spark, "backfill"))
    backfill(spark, first, first + timedelta(days=source_queries.DAYS - 1), where, source=_replay(d))
    return runner.Tables(spark, f"{where.root}/models").read("agg_routing_interval")


def _gated(spark, d, degraded: bool = False) -> DataFrame:
    report = runner.run(spark, call_events(spark, d, degraded), scratch.folder(spark, "gated"), AS_OF)
    rows = [(n, s, 0) for n, s in report.nodes.items()] + [(n, s, k) for n, (s, k) in report.checks.items()]
    return spark.createDataFrame(rows, "item string, status string, failures long")  # a row a node and a check


def _gated_sql(skipped: tuple[str, ...] = ()) -> str:
    """Nodes below a failure are skipped, and so are the checks that read them."""
    flat = {k: v for n, f in _FAMILIES.items() for k, v in (f if isinstance(f, dict) else {n: f}).items()}
    off = {c.name for c in K.CHECKS if set(c.on) & set(skipped)}
    nodes = " union all ".join(f"select '{n.name}' as item, '{'SKIPPED' if n.name in skipped else 'BUILT'}' as status, 0::bigint as failures" for n in runner.graph())
    tested = _summary({k: v for k, v in flat.items() if k not in off})
    return f" select * from ({nodes} union all select \"check\", status, failures from ({tested})" + "".join(f" union all select '{n}', 'SKIPPED', 0" for n in sorted(off)) + ")"


query("gated_build", _gated_sql())(_gated)
query("gated_build_degraded", _gated_sql(("agg_routing_interval", "dq_interval_density")), True)(lambda spark, d: _gated(spark, d, True))

for _name, (_query, _tail) in insight_queries.INSIGHTS.items():
    query(_name, _tail)(_query)
    if _name in ("agg_routing_day", "dq_day_density"):
        ORACLE_SQL[_name] = ORACLE_SQL[_name].replace("interval '15 minutes'", "interval '1440 minutes'")

QUERIES |= source_queries.QUERIES
ORACLE_SQL |= source_queries.ORACLE_SQL
