"""The event source, its catalogue, loading and the cursor; each property has a negative twin."""

from collections import Counter
from dataclasses import replace
from datetime import UTC, date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from switchyard import cli
from switchyard.schemas import CARRIERS, DISPOSITIONS
from switchyard.sources import loaders
from switchyard.sources.catalogue import GeneratorConfig, build, power_law, random_powers
from switchyard.sources.generator import events

DAY = date(2026, 3, 2)
SMALL = GeneratorConfig(events_per_day=2000, malformed_share=0)


@pytest.fixture(scope="module")
def made(spark):
    """A day's deliveries as dicts."""
    known = {}

    def make(config, day=DAY):
        if (config, day) not in known:
            known[config, day] = [r.asDict() for r in events(spark, day, 1, config).orderBy("_row_id").collect()]
        return known[config, day]

    return make


def test_days_are_reproducible_and_differ(spark, made):
    again = [r.asDict() for r in events(spark, DAY, 1, SMALL).orderBy("_row_id").collect()]
    assert made(SMALL) == again
    assert made(SMALL) != made(SMALL, DAY + timedelta(days=1)) and made(SMALL) != made(replace(SMALL, seed=1))


def test_a_day_is_the_same_alone_and_in_a_range(spark):
    alone = events(spark, DAY, 1, SMALL)
    ranged = events(spark, DAY - timedelta(days=1), 3, SMALL).where(F.col("occurred_at").cast("date") == F.lit(DAY))
    assert alone.exceptAll(ranged.withColumn("_load_id", F.lit("0"))).count() == 0 and alone.count() == ranged.count()
    split = events(spark, DAY, 1, SMALL).repartition(7)
    assert alone.exceptAll(split).count() == 0


def test_invariants(made):
    rows = made(SMALL)
    top = Counter(e["carrier_code"] for e in rows).most_common(3)
    assert sum(n for _, n in top) > 0.5 * len(rows)
    start = datetime(2026, 3, 2, tzinfo=UTC)
    for e in rows:
        assert e["carrier_code"] in CARRIERS and e["disposition"] in DISPOSITIONS
        assert start <= e["occurred_at"].astimezone(UTC) < start + timedelta(days=1)
        assert e["disposition"] == "answered" or (e["billable_seconds"] == 0 and not e["human_answered"])
        assert e["sell_rate_eur_per_min"] > 0
        assert e["buy_rate_eur_per_min"] is None or 0 < e["buy_rate_eur_per_min"] < e["sell_rate_eur_per_min"]


def test_defects_and_their_switches(made):
    rows = made(SMALL)
    missing = sum(e["buy_rate_eur_per_min"] is None for e in rows) / len(rows)
    assert 0.6 * 0.08 < missing < 1.4 * 0.08 and len({e["event_id"] for e in rows}) < len(rows)
    clean = made(replace(SMALL, missing_buy_rate_share=0, duplicate_share=0))
    assert len({e["event_id"] for e in clean}) == len(clean) == 2000 and all(e["buy_rate_eur_per_min"] for e in clean)
    bad = made(replace(SMALL, malformed_share=0.25))
    broken = [e for e in bad if e["event_id"] is None or e["billable_seconds"] < 0]
    assert 0.15 < len(broken) / len(bad) < 0.35
    assert {e["event_id"] is None for e in broken} == {True, False}


def test_catalogue(made):
    c = build(GeneratorConfig())
    assert c == build(GeneratorConfig()) or [r.carriers for r in c.routes] == [r.carriers for r in build(GeneratorConfig()).routes]
    keys = [(r.destination, r.origin, r.tier) for r in c.routes]
    assert len(set(keys)) == 24 and 1.5 < c.mean_carriers_per_group() < 3 and 0.15 < c.mono_carrier_share() < 0.6
    assert abs(sum(c.wheel.shares) - 1) < 1e-9 and all(abs(sum(r.wheel.shares) - 1) < 1e-9 for r in c.routes)
    allowed = {(k, x) for k, r in zip(keys, c.routes, strict=True) for x in r.carriers}
    assert {((e["destination_code"], e["origin_cc"], e["service_tier"]), e["carrier_code"]) for e in made(SMALL)} <= allowed
    with pytest.raises(ValueError, match="exceeds"):
        build(GeneratorConfig(n_groups=481))


def test_wheels():
    w = power_law(3, 1.0)
    assert [w.at(u) for u in (0.0, 0.54, 0.55, 0.81, 0.82, 0.999999)] == [0, 0, 1, 1, 2, 2] and w.at(1.0) == 2
    p = random_powers([("x", i) for i in range(5)], 2.0)
    assert abs(sum(p.shares) - 1) < 1e-9 and p.shares == random_powers([("x", i) for i in range(5)], 2.0).shares


def test_empty_range(spark):
    with pytest.raises(ValueError):
        events(spark, DAY, 0)


def test_load_again_and_backfill(spark, tmp_path):
    where = loaders.destination("parquet", str(tmp_path))
    config = replace(SMALL, events_per_day=300)
    loaders.load(spark, DAY, 2, where, config)
    before = loaders.read_raw(spark, where)
    n, ids = before.count(), before.select("event_id").distinct().count()
    assert ids == 600 <= n
    loaders.load(spark, DAY, 1, where, config)  # an earlier day again, after a later one
    assert loaders.read_raw(spark, where).count() == n
    loaders.load(spark, DAY, 3, where, config)
    raw = loaders.read_raw(spark, where)
    assert raw.select("event_id").distinct().count() == 900 and raw.select("day").distinct().count() == 3


def test_append_from_the_mark(spark, tmp_path):
    where = loaders.destination("parquet", str(tmp_path))
    config = replace(SMALL, events_per_day=300)
    count = lambda: loaders.read_raw(spark, where).select("event_id").distinct().count()
    loaders.load(spark, DAY, 1, where, config, mode="append")
    n = loaders.read_raw(spark, where).count()
    loaders.load(spark, DAY, 1, where, config, mode="append", load_id="again")
    assert count() == 300 and loaders.read_raw(spark, where).count() > n  # the boundary is read again
    loaders.load(spark, DAY, 2, where, config, mode="append", load_id="more")
    assert count() == 600
    future = loaders.read_raw(spark, where).drop("day").limit(1).withColumn("occurred_at", F.lit(datetime(2100, 1, 1, tzinfo=UTC)))
    mark = loaders.high_water_mark(spark, where)
    loaders.append_new(future, where, datetime(2026, 4, 1, tzinfo=UTC))
    assert loaders.high_water_mark(spark, where) == mark  # a future row is kept but moves nothing
    undated = future.withColumn("occurred_at", F.lit(None).cast("timestamp"))
    loaders.append_new(undated, where, datetime(2026, 4, 1, tzinfo=UTC))
    assert loaders.read_raw(spark, where).where("occurred_at is null").count() == 1 and loaders.high_water_mark(spark, where) == mark


def test_postgres_overwrite_goes_over_jdbc(spark, tmp_path, monkeypatch):
    """No server here: the statements and the rows are caught on their way."""
    monkeypatch.setenv("POSTGRES_PASSWORD", "x")
    said = []
    monkeypatch.setattr(loaders, "jdbc_write", lambda rows, table, mode: said.append((table, mode, rows.count(), "day" in rows.columns)))
    monkeypatch.setattr(loaders, "jdbc_execute", lambda session, statements: said.append([x.split()[0] for x in statements]))
    where = loaders.destination("postgres", str(tmp_path))
    n = events(spark, DAY, 1, replace(SMALL, events_per_day=50)).count()
    loaders.load(spark, DAY, 1, where, replace(SMALL, events_per_day=50))
    assert said == [("raw.call_events_incoming", "overwrite", n, True), ["create", "delete", "insert", "drop"]] and not list(tmp_path.iterdir())


def test_cli(spark, tmp_path, capsys):
    args = ["--start", "2026-03-01", "--days", "2", "--warehouse", str(tmp_path), "--events-per-day", "200"]
    assert cli.main(args) == 0 and loaders.read_raw(spark, loaders.destination("parquet", str(tmp_path))).select("day").distinct().count() == 2
    assert cli.main([*args, "--mode", "append"]) == 0
    code = cli.main([*args, "--build"])
    said = capsys.readouterr().out
    assert code in (0, 1) and said.count("2026-03-0") == 2


def test_destinations(monkeypatch):
    monkeypatch.delenv("POSTGRES_PASSWORD", raising=False)
    with pytest.raises(RuntimeError):
        loaders.destination("postgres")
    with pytest.raises(ValueError):
        loaders.destination("other")
    monkeypatch.setenv("POSTGRES_PASSWORD", "x")
    assert loaders.destination("postgres").state != loaders.destination().state
