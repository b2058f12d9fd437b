"""Queries on what the source delivers: days, defects, routes, and loads of them, each with its SQL."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from switchyard.functions import share, utc_naive
from switchyard.operators import models as M
from switchyard.operators import routes as R
from switchyard.plans import scratch
from switchyard.sources import catalogue as C
from switchyard.sources import generator as G
from switchyard.sources import loaders as L
from switchyard.sources.bridge import AS_OF, FIRST_DAY, call_events, call_events_sql

QUERIES, ORACLE_SQL = {}, {}
DAYS = 3
#: Long enough for a delivery dated in the future to be among them.
APPENDED = 8


def _u(digest: str, place: int) -> str:
    return f"(('0x' || substr({digest}, {8 * place + 1}, 8))::bigint::double / 4294967296.0::double)"


def _bounds(n: int, alpha: float) -> str:
    """Rows (i, share, lo, hi) of a power law; the last interval takes what rounding leaves."""
    return f"(select r - 1 as i, w / sum(w) over () as share, coalesce(sum(w / total) over (order by r rows between unbounded preceding and 1 preceding), 0) as lo, case when r = {n} then 2.0::double else sum(w / total) over (order by r) end as hi from (select r, pow(r::double, -{alpha}::double) as w, sum(pow(r::double, -{alpha}::double)) over () as total from range(1, {n} + 1) t(r)))"


_GROUP, _ROUTE = ", ".join(R.GROUP), ", ".join(R.ROUTE)
_CTES = f"""
source as ({{source}}),
calls as (select * from source where event_id is not null and billable_seconds >= 0 and occurred_at <= timestamp '2024-02-01'),
routes as (select {_ROUTE}, count(*) as attempts from calls group by all),
catalogue as (select *, sum(attempts) over g as group_attempts, count(*) over g as carriers, attempts::double / sum(attempts) over g as share from routes window g as (partition by {_GROUP}))
"""


def query(name: str, select: str, days: int | None = None):
    def register(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = "with " + _CTES.replace("{source}", call_events_sql(start=FIRST_DAY if days else None, n_days=days or 1)) + select
        return f

    return register


def _raw(spark: SparkSession, d: str, days: int | None = None) -> DataFrame:
    return call_events(spark, d, start=FIRST_DAY if days else None, n_days=days or 1)


def _calls(spark: SparkSession, d: str) -> DataFrame:
    """Readable deliveries."""
    return M.classified(_raw(spark, d), AS_OF).where("quarantine_reason is null")


def _utc(rows: DataFrame) -> DataFrame:
    return rows.withColumn("occurred_at", utc_naive("occurred_at"))


# ---- deliveries by day
@query("source_one_day", "select * from source", 1)
def source_one_day(spark, d):
    """One logical day, read by a filter that the scan gets."""
    return _utc(_raw(spark, d, 1))


@query("source_range", "select * from source", DAYS)
def source_range(spark, d):
    return _utc(_raw(spark, d, DAYS))


@query("source_defects", "select occurred_at::date::varchar as on_day, count(*) as delivered, count(*) filter (where buy_rate_eur_per_min is null) as unpriced, count(*) filter (where event_id is null) as nameless, count(*) filter (where billable_seconds < 0) as negative, count(event_id) - count(distinct event_id) as again from source group by all")
def source_defects(spark, d):
    rows = _raw(spark, d).withColumn("on_day", utc_naive("occurred_at").cast("date").cast("string"))
    null = lambda c: F.count_if(F.col(c).isNull())
    return rows.groupBy("on_day").agg(F.count("*").alias("delivered"), null("buy_rate_eur_per_min").alias("unpriced"), null("event_id").alias("nameless"), F.count_if(F.col("billable_seconds") < 0).alias("negative"), (F.count("event_id") - F.count_distinct("event_id")).alias("again"))


@query("source_dispositions", "select carrier_code, destination_code, disposition, human_answered, count(*) as deliveries from source group by all")
def source_dispositions(spark, d):
    return _raw(spark, d).groupBy("carrier_code", "destination_code", "disposition", "human_answered").agg(F.count("*").alias("deliveries"))


@query("source_hours", "select occurred_at::date::varchar as on_day, hour(occurred_at)::int as hour_utc, count(*) as deliveries from source group by all")
def source_hours(spark, d):
    at = utc_naive("occurred_at")
    return _raw(spark, d).groupBy(at.cast("date").cast("string").alias("on_day"), F.hour(at).alias("hour_utc")).agg(F.count("*").alias("deliveries"))


@query("source_top3_share", "select sum(n)::bigint as top_deliveries, sum(n)::double / max(total) as top_share from (select count(*) as n, (select count(*) from source) as total from source group by carrier_code order by n desc, carrier_code limit 3)")
def source_top3_share(spark, d):
    each = _raw(spark, d).groupBy("carrier_code").agg(F.count("*").alias("n"))
    top = each.orderBy(F.desc("n"), "carrier_code").limit(3).agg(F.sum("n").alias("top_deliveries"))
    return top.crossJoin(each.agg(F.sum("n").alias("total"))).select("top_deliveries", share(F.col("top_deliveries"), F.col("total")).alias("top_share"))  # one row by one row


# ---- the catalogue that the deliveries show
@query("source_catalogue", f"select {_ROUTE}, attempts, group_attempts::bigint as group_attempts, carriers, share from catalogue")
def source_catalogue(spark, d):
    return R.catalogue(_calls(spark, d))


@query("source_catalogue_stats", f"select count(*) as groups, avg((n = 1)::int::double) as mono_carrier_share, avg(n) as mean_carriers from (select count(*) as n from routes group by {_GROUP})")
def source_catalogue_stats(spark, d):
    return R.shape(R.catalogue(_calls(spark, d)))


@query("source_route_quality", "select carrier_code, destination_code, count(*) as attempts, avg((disposition = 'answered')::int::double) as answers, (count(*) filter (where human_answered))::double / nullif(count(*) filter (where disposition = 'answered'), 0)::double as humans, round(max(sell_rate_eur_per_min) * 1e6)::bigint as sell_micro from calls group by all")
def source_route_quality(spark, d):
    answered = F.count_if(F.col("disposition") == "answered")
    return _calls(spark, d).groupBy("carrier_code", "destination_code").agg(
        F.count("*").alias("attempts"),
        share(answered, F.count("*")).alias("answers"),
        share(F.count_if("human_answered"), answered).alias("humans"),
        F.round(F.max("sell_rate_eur_per_min") * 1e6).cast("long").alias("sell_micro"),
    )


_LAWS = {"destination": ("destination_code", C.ALPHA_DESTINATION), "origin": ("origin_cc", C.ALPHA_ORIGIN), "tier": ("service_tier", C.ALPHA_TIER), "carrier": ("carrier_code", C.ALPHA_GROUP)}


def _law_sql(axis: str, column: str, alpha: float) -> str:
    return f"select '{axis}' as axis, rank::int as rank, member, round(n::double / sum(n) over (), 9) as share, round(pow(rank::double, -{alpha}::double) / sum(pow(rank::double, -{alpha}::double)) over (), 9) as law from (select {column} as member, count(*) as n, row_number() over (order by count(*) desc, {column}) as rank from calls group by {column})"


@query("source_zipf_weights", " union all ".join(_law_sql(k, *v) for k, v in _LAWS.items()))
def source_zipf_weights(spark, d):
    """Shares of the traffic by rank, beside what a power law would give the rank.  Axes are short code lists."""
    calls, out = _calls(spark, d), None
    for axis, (column, alpha) in _LAWS.items():
        counted = calls.groupBy(F.lit(axis).alias("axis"), F.col(column).alias("member")).agg(F.count("*").alias("n"))
        ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("axis").orderBy(F.desc("n"), "member")))  # at most 20 members
        whole, law = Window.partitionBy("axis"), R.zipf(F.col("rank"), alpha)
        part = ranked.select("axis", "rank", "member", F.round(F.col("n") / F.sum("n").over(whole), 9).alias("share"), F.round(law / F.sum(law).over(whole), 9).alias("law"))
        out = part if out is None else out.union(part)
    return out


@query("source_power_weights", f"select user_id, round(w / sum(w) over (), 9) as share from (select distinct user_id, pow(1 - {_u('md5(user_id::varchar)', 0)}, {C.CARRIER_POWER}::double) as w from events)")
def source_power_weights(spark, d):
    """A weight for every caller: a power of a uniform draw of its own."""
    users = spark.read.parquet(f"{d}/events.parquet").select("user_id").distinct()
    weighed = users.withColumn("w", F.pow(1 - G.fraction(F.md5(F.col("user_id").cast("string").cast("binary")), 0), F.lit(float(C.CARRIER_POWER))))
    return weighed.crossJoin(weighed.agg(F.sum("w").alias("all"))).select("user_id", F.round(F.col("w") / F.col("all"), 9).alias("share"))  # by one row


@query("source_weighted_pick", f"select b.i::int as picked, count(*) as picks from events e join {_bounds(12, 1.6)} b on {_u('md5(e.event_id::varchar)', 0)} >= b.lo and {_u('md5(e.event_id::varchar)', 0)} < b.hi group by b.i")
def source_weighted_pick(spark, d):
    """The wheel turned by every row of ``events``."""
    u = spark.read.parquet(f"{d}/events.parquet").select(G.fraction(F.md5(F.col("event_id").cast("string").cast("binary")), 0).alias("u"))
    return u.select(G.picked(C.power_law(12, 1.6), "u").alias("picked")).groupBy("picked").agg(F.count("*").alias("picks"))


_NOT_IN = f"select {_ROUTE}, count(*) as deliveries from calls s where not exists (select 1 from {{known}} c where {' and '.join(f's.{k} = c.{k}' for k in R.ROUTE)}) group by all"


@query("source_ineligible", _NOT_IN.replace("{known}", "catalogue"))
def source_ineligible(spark, d):
    """None: a catalogue of all traffic covers it."""
    calls = _calls(spark, d)
    return R.ineligible(calls, R.catalogue(calls))


@query("source_ineligible_elsewhere", _NOT_IN.replace("{known}", f"(select * from calls where occurred_at < timestamp '{FIRST_DAY + timedelta(days=1)}')"))
def source_ineligible_elsewhere(spark, d):
    """Traffic over routes that the first day did not know."""
    first = M.classified(_raw(spark, d, 1), AS_OF).where("quarantine_reason is null")
    return R.ineligible(_calls(spark, d), R.catalogue(first))


# ---- loading
def _days(spark: SparkSession, d: str, n: int, first: int = 0) -> DataFrame:
    return call_events(spark, d, start=FIRST_DAY + timedelta(days=first), n_days=n)


@query("load_overwrite", "select occurred_at::date::varchar as on_day, count(*) as stored, count(distinct event_id) as distinct_events from source group by all", DAYS)
def load_overwrite(spark, d):
    """Three days, then the second again: whole days are replaced."""
    where = L.destination("parquet", scratch.folder(spark, "load"))
    L.overwrite_days(_days(spark, d, DAYS), where)
    L.overwrite_days(_days(spark, d, 1, 1).where(F.col("occurred_at") <= AS_OF), where)
    return L.read_raw(spark, where).groupBy(F.col("day").cast("string").alias("on_day")).agg(F.count("*").alias("stored"), F.count_distinct("event_id").alias("distinct_events"))


_FIRST = f"occurred_at <= timestamp '2024-02-01' and occurred_at < timestamp '{FIRST_DAY + timedelta(days=1)}'"
_MARK = f"(select max(occurred_at) from source where {_FIRST})"


@query("load_append", f"select count(*) filter (where {_FIRST} or occurred_at > timestamp '2024-02-01' and _row_id in (select _row_id from first_day)) + count(*) filter (where occurred_at >= {_MARK}) as stored, count(distinct event_id) as distinct_events, max(epoch_us(occurred_at)) filter (where occurred_at <= timestamp '2024-02-01') as mark_us from source", APPENDED)
def load_append(spark, d):
    """One day appended, then eight: the boundary is read twice, the rest once; the mark moves, but not to the future row's date."""
    where = L.destination("parquet", scratch.folder(spark, "load"))
    for days in (1, APPENDED):
        L.append_new(_days(spark, d, days), where, AS_OF)
    mark = L.high_water_mark(spark, where)
    return L.read_raw(spark, where).agg(F.count("*").alias("stored"), F.count_distinct("event_id").alias("distinct_events")).withColumn("mark_us", F.lit(mark).cast("long"))


ORACLE_SQL["load_append"] = ORACLE_SQL["load_append"].replace("calls as (", f"first_day as ({call_events_sql(start=FIRST_DAY)}),\ncalls as (", 1)
