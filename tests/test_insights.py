"""Streams that fail and resume, histories, shrinkage, regret, quantiles by counting, marks and JDBC reads."""

import os
import random
from datetime import UTC, date, datetime, timedelta

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from switchyard.functions import interval_bucket
from switchyard.operators import counting, history, regret, routes, shrinkage, uniqueness
from switchyard.operators import models as M
from switchyard.plans.insight_queries import INSIGHTS
from switchyard.plans.queries import ORACLE_SQL, QUERIES
from switchyard.plans.source_queries import QUERIES as SOURCE
from switchyard.schemas import RAW
from switchyard.sources import loaders
from switchyard.sources.bridge import AS_OF, FIRST_DAY, call_events
from switchyard.streaming import once

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def _rows(df, columns):
    plain = lambda v: None if pd.isna(v) else float(v) if isinstance(v, int | float) else v
    return sorted(str([plain(v) for v in r]) for r in df[columns].astype(object).itertuples(index=False, name=None))


@here
@pytest.mark.parametrize("name", sorted({*INSIGHTS, *SOURCE} - {"dim_carrier_history", "source_range", "source_weighted_pick", "source_ineligible_elsewhere", "load_overwrite", "load_append"}))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{SF}/events.parquet'")
    want, got = con.execute(ORACLE_SQL[name]).df(), QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and _rows(got, columns) == _rows(want, columns)


# ---- stream
def _arrival(event, load, row, at, arrived, seconds=0):
    t = lambda h: datetime(2024, 1, 1, tzinfo=UTC) + timedelta(hours=h)
    return (event, t(at), "CR-01", "DST-01-FIX", "33", "economy", "answered", True, seconds, 0.01, None, load, row, t(arrived))


def _land(spark, path, rows):
    spark.createDataFrame(rows, once.ARRIVALS).coalesce(1).write.mode("append").parquet(path)


def test_stream_judges_each_delivery(spark, tmp_path):
    run = lambda: once.run_available(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c"), timedelta(hours=10), timedelta(hours=2), datetime(2024, 2, 1, tzinfo=UTC))
    batches = [
        [_arrival("a", "2", "a2", 0, 3), _arrival("b", "2", "b2", 1, 3), _arrival("b", "2", "b1", 1, 3), _arrival(None, "2", "n", 1, 3), _arrival("f", "2", "f", 9999, 3), _arrival("x", "2", "x", 1, 3, -1)],
        [_arrival("a", "1", "a1", 0, 4), _arrival("b", "3", "b3", 1, 4)],
        [_arrival("z", "9", "z", 60, 90), _arrival("y", "9", "y", 85, 90)],
        [_arrival("a", "9", "a9", 0, 91), _arrival("y", "8", "y8", 85, 91)],
    ]
    for rows in batches:
        _land(spark, str(tmp_path / "in"), rows)
        run()
    run()  # nothing new
    got = {r._row_id: r.verdict for r in once.stored(spark, str(tmp_path / "out")).collect()}
    assert got == {"a2": "kept", "b1": "kept", "b2": "repeated", "a1": "revised", "b3": "repeated", "z": "late", "y": "kept", "a9": "late", "y8": "revised"}
    standing = {r.event_id: r._row_id for r in once.standing(spark, str(tmp_path / "out")).collect()}
    assert standing == {"a": "a1", "b": "b1", "y": "y8"}


@here
def test_stream_killed_and_resumed_equals_batch(spark, tmp_path, monkeypatch):
    """The sink dies after it has written a batch; the next run takes that batch again, from the state before it."""
    raw = call_events(spark, SF.replace("0.001", "0.01")).withColumn("arrived_at", F.timestamp_seconds(F.lit(1_704_067_200) + (F.col("_load_id").cast("int") + 1) * 864_000))
    again = raw.where("_row_id < '2'").withColumn("_row_id", F.concat(F.lit("!"), "_row_id")).withColumn("_load_id", F.lit("3")).withColumn("arrived_at", F.lit(datetime(2024, 2, 10, tzinfo=UTC)))
    for k in "0123":
        raw.unionByName(again).where(F.col("_load_id") == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    args = (spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c"), timedelta(days=30), timedelta(days=10), AS_OF, 1)
    fail, store = {1, 2}, once.write_batch

    def dies(rows, target, batch):
        store(rows, target, batch)
        if batch in fail:
            fail.discard(batch)
            raise OSError("killed")

    monkeypatch.setattr(once, "write_batch", dies)
    failures = 0
    for _ in range(4):
        try:
            once.run_available(*args)
        except Exception:
            failures += 1
    assert failures == 2
    stored = once.stored(spark, str(tmp_path / "out"))
    readable = M.classified(raw.unionByName(again), AS_OF).where("quarantine_reason is null")
    assert stored.count() == stored.select("_row_id").distinct().count() == readable.count()
    want = M.first_deliveries(readable).select(*RAW.names)
    got = once.standing(spark, str(tmp_path / "out"))
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_stream_calls_no_python_and_reads_only_what_can_come_again(spark, tmp_path):
    """A batch is judged by one window, with the standing deliveries of events that are not yet too old for it."""
    target, late, disorder = str(tmp_path / "out"), timedelta(hours=10), timedelta(hours=2)
    first = spark.createDataFrame([_arrival("old", "1", "o", 0, 1), _arrival("young", "1", "y", 85, 86)], once.ARRIVALS)
    once.write_batch(once.deliveries(first, late, AS_OF), target, 0)
    again = spark.createDataFrame([_arrival("young", "2", "y2", 85, 90), _arrival("new", "2", "n", 89, 90), _arrival("old", "2", "o2", 0, 90)], once.ARRIVALS)
    held = once._standing_before(again, target, 1, late, disorder)
    assert [r.event_id for r in held.collect()] == ["young"]
    judged = once.deliveries(again, late, AS_OF, held)
    assert {r._row_id: r.verdict for r in judged.collect()} == {"y2": "repeated", "n": "kept", "o2": "late"}
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Python" not in plan and "Pandas" not in plan


# ---- history
def test_versions_neither_overlap_nor_leave_gaps(spark):
    rng = random.Random(4)
    start = date(2024, 1, 1)
    daily = [(c, start + timedelta(days=k), rng.choice(["x", "x", "x", "y", None]), rng.random() < 0.8) for c in ("CR-01", "CR-02", "CR-03") for k in range(60) if rng.random() < 0.8]
    got = history.versions(spark.createDataFrame(daily, "carrier_code string, day date, main_destination string, is_priced boolean")).collect()
    for c in ("CR-01", "CR-02", "CR-03"):
        own = sorted((r for r in got if r.carrier_code == c), key=lambda r: r.valid_from)
        days = sorted(d for d in daily if d[0] == c)
        assert [r.version for r in own] == list(range(1, len(own) + 1)) and own[0].valid_from == days[0][1]
        assert all(a.valid_to == b.valid_from > a.valid_from for a, b in zip(own, own[1:], strict=False)) and own[-1].valid_to is None and own[-1].is_current
        for _, day, main, priced in days:
            (valid,) = [r for r in own if r.valid_from <= day and (r.valid_to is None or day < r.valid_to)]
            assert (valid.main_destination, valid.is_priced) == (main, priced)


@pytest.mark.parametrize("width", [1, 7, 400])
def test_as_of_takes_the_version_of_the_day(spark, width):
    d = lambda k: date(2024, 1, 1) + timedelta(days=k)
    known = spark.createDataFrame([("a", 1, d(5), d(9)), ("a", 2, d(9), d(200)), ("a", 3, d(200), None), ("b", 1, d(0), None)], "k string, version int, valid_from date, valid_to date")
    rows = [("a", d(n)) for n in (0, 4, 5, 8, 9, 10, 199, 200, 365)] + [("b", d(0)), ("b", d(99)), ("c", d(1)), (None, d(1)), ("a", None)]
    got = history.as_of(spark.createDataFrame(rows, "k string, day date"), known, "k", "day", width)
    found = {(r.k, r.day): r.version for r in got.collect()}
    version = lambda n: None if n < 5 else 1 if n < 9 else 2 if n < 200 else 3
    assert found == {(k, day): (version((day - d(0)).days) if k == "a" and day else 1 if k == "b" else None) for k, day in rows}
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].replace("BroadcastNestedLoopJoin BuildRight, Cross", "")


# ---- shrinkage and regret
@here
def test_thin_slots_come_nearer_to_their_prior(spark):
    sf = SF.replace("0.001", "0.01")
    rows = shrinkage.shrunk(QUERIES["agg_routing_day"](spark, sf), "human_answered_attempts").toPandas()
    moved = (rows.rate - rows.prior).abs() / (rows.raw_rate - rows.prior).abs().clip(lower=1e-12)
    assert ((moved < 1 + 1e-9) | (rows.raw_rate == rows.prior)).all() and rows.rate.between(0, 1).all()
    for _, route in rows.assign(moved=moved).groupby(shrinkage.LEVELS[1]):
        by_size = route.sort_values("n").moved.to_numpy()
        assert (by_size[1:] >= by_size[:-1] - 1e-9).all()


def test_shrinkage_finds_planted_variance(spark):
    """Slots drawn from Beta(a, b): the strength of their prior is about a + b."""
    rng = random.Random(2)
    rows = []
    for slot in range(3000):
        p, n = rng.betavariate(8, 12), rng.randint(5, 60)
        rows.append((sum(rng.random() < p for _ in range(n)), n, slot))
    (got,) = shrinkage.strengths(spark.createDataFrame(rows, "y long, n long, slot long"), []).collect()
    assert abs(got.y / got.n - 0.4) < 0.02 and 15 < got.strength < 26


def test_regret_by_inverse_propensity(spark):
    """Three carriers at shares 0.6, 0.3, 0.1 and rates 0.3, 0.5, 0.9: the best is worth 0.9, the log 0.42."""
    rng = random.Random(3)
    rows = []
    for k in range(40_000):
        c = rng.choices([0, 1, 2], [0.6, 0.3, 0.1])[0]
        rows.append(("D", "33", "economy", f"CR-{c}", k % 2 == 0, rng.random() < (0.3, 0.5, 0.9)[c]))
    rows += [("E", "33", "economy", "CR-0", k % 2 == 0, True) for k in range(100)] + [("F", "33", "economy", f"CR-{k % 2}", True, True) for k in range(10)]
    calls = spark.createDataFrame(rows, "destination_code string, origin_cc string, service_tier string, carrier_code string, learn boolean, is_human_answered boolean")
    got = {r.destination_code: r for r in regret.valued(regret.by_route(calls, F.col("learn"))).collect()}
    d = got["D"]
    assert d.decidable and d.named == "CR-2" and abs(d.policy_value - 0.9) < 4 * d.std_error < 0.2 and abs(d.logged_value - 0.42) < 0.02
    assert d.lower_bound < 0.9 and abs(d.regret - 0.48) < 0.1
    assert not got["E"].decidable and got["E"].regret is None and not got["F"].decidable
    (total,) = regret.perimeter(spark.createDataFrame(list(got.values()))).collect()
    assert total.decidable_groups == 1 and abs(total.regret - d.regret) < 1e-9


def test_routes(spark):
    calls = spark.createDataFrame([("c1", "d", "o", "t")] * 3 + [("c2", "d", "o", "t"), ("c1", "e", "o", "t")], "carrier_code string, destination_code string, origin_cc string, service_tier string")
    known = routes.catalogue(calls)
    assert {(r.carrier_code, r.destination_code): r.share for r in known.collect()} == {("c1", "d"): 0.75, ("c2", "d"): 0.25, ("c1", "e"): 1.0}
    assert tuple(routes.shape(known).first()) == (2, 0.5, 1.5)
    assert routes.ineligible(calls, known.where("carrier_code = 'c1'")).count() == 1


# ---- counting
def test_quantiles_by_counting_equal_percentile(spark):
    rng = random.Random(1)
    data = {"ties": [rng.choice([1.0, 1.0, 2.0, 5.0]) for _ in range(999)], "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(2000)], "one": [3.5], "normal": [rng.gauss(0, 1) for _ in range(5000)], "none": []}
    quantiles = [0.0, 0.1, 0.5, 0.75, 1.0]
    for name, values in data.items():
        df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double")
        want = df.where("v is not null and not isnan(v)").agg(F.percentile("v", F.array(*map(F.lit, quantiles)))).first()[0] if values else [None] * 5
        got = counting.exact_quantiles(df, "v", quantiles, bins=16)
        assert got == want or all(abs(a - b) <= 1e-12 * max(abs(a), abs(b)) for a, b in zip(got, want, strict=True)), name


def test_a_gap_of_just_the_width_is_within_a_burst(spark):
    times = spark.sql("select 1 as u, explode(array(timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2024-01-01 06:00:00', timestamp_ntz'2024-01-01 12:00:00.000001', null)) as ts")
    assert sorted(r.attempts for r in counting.bursts(times, "u", "ts", "6 hours").collect()) == [1, 2]


def test_props_are_typed_or_told_why_not(spark):
    rows = [('{"k": 5}',), ('{"k": "7"}',), ('{"k": 1.5}',), ('{"k": "x"}',), ("{}",), ('{"k": null}',), ("{",), (None,)]
    got = [(r.k, r.reason) for r in counting.typed_props(spark.createDataFrame(rows, "props string").coalesce(1)).collect()]
    assert got[0] == (5, None) and got[1] == (7, None) and got[3:] == [(None, "k_is_no_number"), (None, "missing_k"), (None, "missing_k"), (None, "malformed_props"), (None, "missing_props")]


def test_sketches_merge(spark):
    ids = spark.range(50_000).select((F.col("id") % 30_000).alias("id"), F.floor(F.col("id") / 5000).alias("day"))
    merged = counting.distinct_counts(counting.distinct_sketches(ids, ["day"], "id"), []).first().estimate
    assert abs(merged - 30_000) < 4 * 1.04 / 128 * 30_000


def test_buckets_of_any_width_count_from_one_origin(spark):
    times = spark.sql("select explode(array(timestamp_ntz'2000-01-01 00:00:00', timestamp_ntz'2000-01-01 00:06:59.999999', timestamp_ntz'1999-12-31 23:59:00', timestamp_ntz'2024-02-29 12:34:56.789')) as t")
    got = {str(r.t): str(r.b) for r in times.select("t", interval_bucket(F.col("t"), 7).alias("b")).collect()}
    want = duckdb.sql("select t::varchar as t, time_bucket(interval '7 minutes', t, timestamp '2000-01-01')::varchar as b from (select unnest([timestamp '2000-01-01 00:00:00', timestamp '2000-01-01 00:06:59.999999', timestamp '1999-12-31 23:59:00', timestamp '2024-02-29 12:34:56.789']) as t)").fetchall()
    clean = lambda s: s.rstrip("0").rstrip(".") if "." in s else s
    assert {clean(k): clean(v) for k, v in got.items()} == {clean(k): clean(v) for k, v in want}


# ---- uniqueness
def test_only_days_hit_are_read(spark, tmp_path):
    rows = [(f"k{i}", f"2024-01-{1 + i % 9:02d}") for i in range(900)] + [(None, "2024-01-01")] * 3 + [("k4", "2024-01-05")]
    old = spark.createDataFrame(rows, "key string, day string")
    known = uniqueness.ledger(old, "key", "day")
    assert known.count() == 900
    asked = []

    def days_of(days):
        asked.extend(days)
        return old.where(F.col("day").isin(days))

    new = spark.createDataFrame([("k4", "2024-01-20"), ("k4", "2024-01-21"), ("k13", "2024-01-20"), ("new", "2024-01-20"), (None, "2024-01-20"), ("k0", "2024-01-01")], "key string, day string")
    got = uniqueness.repeated(new, "key", "day", known, days_of)
    assert {tuple(r) for r in got.select("key", "day", "earlier_day", "earlier_rows").collect()} == {("k4", "2024-01-20", "2024-01-05", 2), ("k4", "2024-01-21", "2024-01-05", 2), ("k13", "2024-01-20", "2024-01-05", 1)}
    assert asked == ["2024-01-05"]
    assert uniqueness.repeated(new.where("key = 'new'"), "key", "day", known, days_of).count() == 0 and asked == ["2024-01-05"]


# ---- loading
@here
def test_append_reads_rows_once_and_ignores_the_future(spark, tmp_path):
    where = loaders.destination("parquet", str(tmp_path))
    reads = spark.sparkContext.accumulator(0)
    rows = call_events(spark, SF, start=FIRST_DAY, n_days=2)
    future = rows.limit(1).withColumn("occurred_at", F.lit(datetime(2100, 1, 1, tzinfo=UTC)))

    def count(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    watched = rows.unionByName(future).mapInArrow(count, RAW)
    loaders.append_new(watched, where, AS_OF)
    assert reads.value == rows.count() + 1
    newest = rows.agg(F.max(F.unix_micros("occurred_at"))).first()[0]
    assert loaders.high_water_mark(spark, where) == newest
    loaders.append_new(future, where, AS_OF)  # nothing that could move the mark
    assert loaders.high_water_mark(spark, where) == newest and loaders.read_raw(spark, where).count() == rows.count() + 2


def test_jdbc_reads_take_a_task_a_day(spark, monkeypatch):
    days = [date(2024, 1, 2), None, date(2024, 1, 1)]
    predicates = loaders.day_predicates(days)
    con = duckdb.connect()
    con.execute("create table t as select unnest([date '2024-01-01', date '2024-01-01', date '2024-01-02', null, date '2024-01-03']) as day")
    assert [con.execute(f"select count(*) from t where {p}").fetchone()[0] for p in predicates] == [2, 1, 2]
    assert loaders.day_predicates([None]) == loaders.day_predicates([]) == ["true"]
    monkeypatch.setenv("POSTGRES_PASSWORD", "p")
    seen = {}

    class Reader:
        def format(self, kind):
            return self

        def options(self, **o):
            seen["options"] = o
            return self

        def load(self):
            return spark.createDataFrame([(d,) for d in days], "day date")

        def jdbc(self, url, table, predicates, properties):
            seen.update(url=url, table=table, predicates=predicates, properties=properties)
            return "rows"

    class Session:
        read = Reader()

    assert loaders.read_raw(Session(), loaders.destination("postgres")) == "rows"
    assert seen["predicates"] == predicates and seen["table"] == loaders.TABLE and seen["options"]["query"].startswith("select distinct day")
    assert seen["properties"]["driver"] == "org.postgresql.Driver" and "url" not in seen["properties"]
