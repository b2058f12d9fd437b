"""Models, checks, gating, freshness and streaming."""

import os
import shutil
from datetime import UTC, date, datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from switchyard.functions import interval_bucket, micro, utc_naive
from switchyard.operators import checks as K
from switchyard.operators import models as M
from switchyard.plans import orchestrate, runner
from switchyard.plans.queries import ORACLE_SQL, QUERIES
from switchyard.schemas import RAW_TABLE
from switchyard.sources import loaders
from switchyard.sources.bridge import AS_OF, call_events
from switchyard.sources.catalogue import GeneratorConfig
from switchyard.sources.generator import events
from switchyard.streaming import interval_attempts, load_available

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@here
@pytest.mark.parametrize("name", ["raw_scan_counts", "quarantine_rows", "stg_call_events", "agg_routing_interval", "dq_interval_density", "dq_not_null", "dq_relationships", "assert_buy_rate_coverage_above_threshold_degraded", "source_range", "source_weighted_pick", "source_ineligible_elsewhere", "load_overwrite", "load_append", "star_join", "mart_by_days", "daily_runs", "backfill_range", "gated_build", "gated_build_degraded"])
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{SF}/events.parquet'")
    same(con.execute(ORACLE_SQL[name]).df(), QUERIES[name](spark, SF).toPandas())


def same(want, got):
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: sorted(str([None if v is None or v != v else v for v in r]) for r in df[columns].astype(object).itertuples(index=False, name=None))
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_rates_finer_than_a_millionth_raise(spark):
    rates = lambda *v: spark.createDataFrame([(x,) for x in v], "r double").select(micro("r").alias("m"))
    assert [r.m for r in rates(0.002091, 0.1, 12.000001, None).collect()] == [2091, 100_000, 12_000_001, None]
    with pytest.raises(Exception, match="finer than a millionth"):
        rates(0.0020915).collect()


def test_there_are_57_checks():
    assert len(K.CHECKS) == len({c.name for c in K.CHECKS}) == 57


def test_buckets(spark):
    with pytest.raises(ValueError):
        interval_bucket(F.lit(None), 0)
    df = spark.sql("select timestamp_ntz'2026-03-01 13:14:59.5' as t union all select null")
    got = [str(r.b) for r in df.select(interval_bucket(F.col("t")).alias("b")).collect()]
    assert sorted(got) == ["2026-03-01 13:00:00", "None"]


@here
def test_session_time_zone_changes_nothing(spark):
    rows = lambda: sorted(map(str, M.stg_call_events(call_events(spark, SF), AS_OF).collect()))
    want = rows()
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert rows() == want
        t = spark.sql("select timestamp_micros(1793512800000000) as t").select(utc_naive("t").alias("u")).first().u
        assert t == datetime(2026, 11, 1, 6)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@here
def test_gate(spark, tmp_path):
    good = runner.run(spark, call_events(spark, SF), str(tmp_path), AS_OF)
    assert good.ok and len(good.checks) == 57 and set(good.nodes.values()) == {"BUILT"}
    store = runner.Tables(spark, str(tmp_path))
    slots = store.read("agg_routing_interval").count()
    bad = runner.run(spark, call_events(spark, SF, degraded=True), str(tmp_path), AS_OF)
    assert not bad.ok and bad.checks["assert_buy_rate_coverage_above_threshold"] == ("FAIL", 1)
    assert bad.nodes["agg_routing_interval"] == bad.nodes["dq_interval_density"] == "SKIPPED" and bad.nodes["fct_call_attempt"] == "BUILT"
    assert bad.checks["assert_density_summary_is_one_row"][0] == "SKIPPED"
    assert store.read("agg_routing_interval").count() == slots  # the older table stays


@here
@pytest.mark.parametrize("family", ["dq_not_null", "dq_unique", "dq_accepted_values", "dq_relationships", *(c.name for c in K.SINGULAR)])
def test_each_check_fails_where_it_must(spark, family):
    sf = SF.replace("0.001", "0.01")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{sf}/events.parquet'")
    got = QUERIES[f"{family}_damaged"](spark, sf).toPandas()
    same(con.execute(ORACLE_SQL[f"{family}_damaged"]).df(), got)
    assert (got.failures > 0).all() and (got.status == "FAIL").all()


@here
def test_a_report_scans_each_node_once(spark):
    nodes = {"stg_call_events": M.stg_call_events(call_events(spark, SF), AS_OF)}
    plan = K.report([c for c in K.CHECKS if c.on == ("stg_call_events",) and c.bad], nodes)
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_large_dimensions_are_not_broadcast(spark):
    rows, dim = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a", "A"), ("c", "C")], "k string, code string")
    hint = lambda most: "BROADCAST" in M.looked_up(rows, [(dim, "k", "code")], most)._jdf.queryExecution().analyzed().toString().upper()
    assert hint(2) and not hint(1)
    assert [tuple(r) for r in M.looked_up(rows, [(dim, "k", "code")]).collect()] == [("a", "A")]


@here
def test_a_build_of_nothing(spark, tmp_path):
    report = runner.run(spark, call_events(spark, SF).limit(0), str(tmp_path), AS_OF, checks=[])
    assert set(report.nodes.values()) == {"BUILT"} and runner.Tables(spark, str(tmp_path)).read("dq_interval_density").count() == 1


def test_daily_runs(spark, tmp_path):
    where = loaders.destination("parquet", str(tmp_path))
    config = GeneratorConfig(events_per_day=400, malformed_share=0.005)
    day = date(2026, 3, 1)
    reports = orchestrate.backfill(spark, day, day + timedelta(days=1), where, config)
    assert list(reports) == [day, day + timedelta(days=1)]
    assert all(set(r.nodes.values()) == {"BUILT"} for r in reports.values())
    one_by_one = orchestrate.backfill(spark, day, day + timedelta(days=1), loaders.destination("parquet", str(tmp_path / "each")), config, each=True)
    built = lambda root: sorted(map(str, runner.Tables(spark, f"{root}/models").read("agg_routing_interval").collect()))
    assert one_by_one[day].ok == reports[day].ok and built(tmp_path) == built(tmp_path / "each")
    exact = GeneratorConfig(events_per_day=400, malformed_share=0)
    assert M.stg_call_events(events(spark, day, 2, exact)).count() == 800


def test_builds_by_day_equal_whole_builds(spark, tmp_path):
    """Changed, added, undated and vanished days, a failure in between, and an earlier ``as_of``."""
    where, first = loaders.destination("parquet", str(tmp_path)), date(2026, 3, 1)
    day = lambda k: first + timedelta(days=k)
    config = GeneratorConfig(events_per_day=300, malformed_share=0.02, duplicate_share=0.05)
    store = runner.Tables(spark, f"{tmp_path}/models")
    step = lambda days, as_of, **k: runner.run(spark, loaders.read_raw(spark, where), store.root, as_of, days=days, **k)
    content = lambda s, t: sorted(map(str, s.read(t).collect()))

    def equal(as_of):
        whole = runner.Tables(spark, f"{tmp_path}/whole")
        runner.run(spark, loaders.read_raw(spark, where), whole.root, as_of, [])
        for t in (n.name for n in runner.graph()):
            assert content(store, t) == content(whole, t), t

    late = datetime(2026, 3, 10, tzinfo=UTC)
    loaders.load(spark, first, 3, where, config)
    step([day(0)], late, checks=[])  # the first build takes all there is
    files = lambda: {d: sorted(f for f in os.listdir(f"{store.root}/fct_call_attempt/day={d}") if f.startswith("part")) for d in store.days("fct_call_attempt")}
    held = files()
    loaders.overwrite_days(events(spark, day(1), 1, GeneratorConfig(seed=5, events_per_day=200)), where)
    step([day(1)], late, checks=[])
    now = files()
    assert [d for d in now if now[d] != held[d]] == [str(day(1))]  # the other days were not written again
    undated = events(spark, day(1), 1, config).limit(3).withColumn("occurred_at", F.lit(None).cast("timestamp"))
    loaders.append_new(undated, where, late)
    loaders.load(spark, day(3), 1, where, config)
    gone = K.Check("always_fails", ("stg_call_events",), lambda stg: stg.limit(1))
    report = step([day(3)], late, checks=[gone])
    assert report.nodes["fct_call_attempt"] == "SKIPPED" and str(day(3)) not in store.days("fct_call_attempt")
    loaders.load(spark, day(4), 1, where, config)
    step([day(4)], late, checks=[])  # brings what the failure kept back
    equal(late)
    early = datetime(2026, 3, 3, 12, tzinfo=UTC)
    step([], early, checks=[])
    equal(early)
    shutil.rmtree(f"{where.raw}/day={day(0)}")
    step([day(0)], late, checks=[])
    equal(late)
    assert str(day(0)) not in store.days("stg_call_events") | store.days("fct_call_attempt")


def test_retries():
    calls, waits = [], []

    def step():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "done"

    assert orchestrate.with_retries(step, sleep=waits.append) == "done" and waits == [30.0, 60.0]
    with pytest.raises(OSError):
        orchestrate.with_retries(lambda: (_ for _ in ()).throw(OSError()), retries=1, sleep=waits.append)


@here
def test_freshness(spark):
    raw = call_events(spark, SF).where(F.col("occurred_at") < F.lit(AS_OF))
    newest = raw.agg(F.max("occurred_at").alias("m")).first().m.replace(tzinfo=UTC)
    for hours, want in ((1, "pass"), (3, "warn"), (7, "error")):
        assert orchestrate.freshness(raw, newest + timedelta(hours=hours)).first().status == want
    assert orchestrate.freshness(raw.limit(0), AS_OF).first().status == "error"


def test_stream_loads_each_event_once(spark, tmp_path):
    where = loaders.destination("parquet", str(tmp_path / "w"))
    config = GeneratorConfig(events_per_day=300)
    args = (str(tmp_path / "out"), str(tmp_path / "check"))
    for k in range(2):
        loaders.overwrite_days(events(spark, date(2026, 3, 1) + timedelta(days=k), 1, config), where)
        load_available(spark, where.raw, *args)
    load_available(spark, where.raw, *args)  # nothing new: nothing twice
    got = spark.read.parquet(args[0])
    want = M.stg_call_events(loaders.read_raw(spark, where)).count()
    assert got.count() == got.select("event_id").distinct().count() == want
    late = events(spark, date(2025, 1, 1), 1, config)  # a year behind what is there: stored all the same
    loaders.overwrite_days(late, where)
    load_available(spark, where.raw, *args)
    assert spark.read.parquet(args[0]).count() == want + M.stg_call_events(late).count()


def test_a_future_row_does_not_move_the_windows(spark, tmp_path):
    """Two batches; the first holds a row of the year 2100, the second ordinary rows that must still count."""
    config, as_of = GeneratorConfig(events_per_day=300, malformed_share=0), datetime(2026, 4, 1, tzinfo=UTC)
    day = events(spark, date(2026, 3, 1), 3, config)
    loaders.with_day(day.limit(1).withColumn("occurred_at", F.lit(datetime(2100, 1, 1, tzinfo=UTC))).withColumn("event_id", F.lit("x"))).write.parquet(str(tmp_path / "in"))
    run = lambda: interval_attempts(spark.readStream.schema(RAW_TABLE).parquet(str(tmp_path / "in")), late="1 hour", as_of=as_of).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    run()
    loaders.with_day(day).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    run()
    got = spark.read.parquet(str(tmp_path / "out"))
    newest = day.agg(F.max("occurred_at")).first()[0]
    each = day.groupBy(F.window("occurred_at", "15 minutes").alias("w"), "carrier_code").agg(F.count_distinct("event_id").alias("attempts"))
    want = each.where(F.col("w.end") < F.lit(newest) - F.expr("interval 2 hours")).select(F.col("w.start").alias("s"), "carrier_code", "attempts")
    assert want.join(got.select(F.col("window.start").alias("s"), "carrier_code", "attempts"), ["s", "carrier_code", "attempts"], "left_anti").count() == 0 < want.count()
