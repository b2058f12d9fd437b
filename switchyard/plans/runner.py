"""Build the models in order, test each, and skip what stands on a failure."""

from __future__ import annotations

from collections.abc import Callable, Collection
from dataclasses import dataclass, field
from datetime import UTC, date, datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from switchyard.functions import utc_naive
from switchyard.operators import models as M
from switchyard.operators.checks import CHECKS, Check
from switchyard.operators.checks import report as counted


@dataclass(frozen=True)
class Node:
    name: str
    on: tuple[str, ...]
    build: Callable[..., DataFrame]
    #: The UTC day of a row, for tables kept by day; they read their first parent day by day.
    day: Callable[[], Column] | None = None
    #: Rows come out of a shuffle by other keys: they are gathered by day before they are written.
    mixed: bool = False


def graph(as_of: datetime | None = None) -> list[Node]:
    dims = ("dim_carrier", "dim_destination", "dim_service_tier")
    return [
        Node("stg_call_events", ("call_events",), lambda raw: M.stg_call_events(raw, as_of), lambda: F.to_date("occurred_at_utc"), True),
        Node("stg_call_events_quarantine", ("call_events",), lambda raw: M.stg_call_events_quarantine(raw, as_of), lambda: utc_naive("occurred_at").cast("date")),
        *(Node(d, ("stg_call_events",), getattr(M, d)) for d in dims),
        Node("fct_call_attempt", ("stg_call_events",), M.fct_call_attempt, lambda: F.to_date("occurred_at_utc")),
        Node("agg_routing_interval", ("fct_call_attempt", *dims), M.agg_routing_interval, lambda: F.to_date("interval_start_utc"), True),
        Node("dq_interval_density", ("agg_routing_interval",), M.dq_interval_density),
    ]


def ordered(nodes: list[Node], given: set[str]) -> list[Node]:
    """Parents first; raises on a cycle or an unknown parent."""
    done, out, left = set(given), [], list(nodes)
    while left:
        ready = [n for n in left if set(n.on) <= done]
        if not ready:
            raise ValueError(f"no order for {[n.name for n in left]}")
        out += ready
        done |= {n.name for n in ready}
        left = [n for n in left if n.name not in done]
    return out


@dataclass
class Report:
    nodes: dict[str, str] = field(default_factory=dict)
    checks: dict[str, tuple[str, int]] = field(default_factory=dict)

    @property
    def ok(self) -> bool:
        return set(self.nodes.values()) <= {"BUILT"} and all(s == "PASS" for s, _ in self.checks.values())


#: The folder name Spark gives to a null partition value.
UNDATED = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Touched:
    """Days to build: those given, those without a date, and all from ``since`` on."""

    days: frozenset[str]
    since: str

    def rows(self, day: Column) -> Column:
        return day.isNull() | day.isin([date.fromisoformat(d) for d in sorted(self.days)]) | (day >= F.lit(date.fromisoformat(self.since)))

    def __contains__(self, day: str) -> bool:
        return day == UNDATED or day in self.days or day.startswith("+") or day >= self.since  # "+": beyond the year 9999


class Tables:
    """Parquet tables below one folder, some partitioned by day.

    Days are replaced by Spark's dynamic partition overwrite; a replaced day that
    gets no row is removed.  Beside the tables lie two notes, a row a day at
    most: as of when the last build saw the rows (``as_of``), and for each table
    the days that a failure kept from it (``pending``).
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}"))

    def read(self, name: str, days: Collection[str] | None = None, schema: StructType | None = None) -> DataFrame:
        """A table; of one kept by day, only ``days`` where they are given (a filter on the partitions).

        Without ``schema`` that of the files, so a table without rows needs it.
        """
        reader = self.spark.read if schema is None else self.spark.read.schema(StructType([*schema.fields, StructField("day", DateType())]))
        df = reader.parquet(f"{self.root}/{name}")
        if days is None:
            return df.drop("day")
        dates = [date.fromisoformat(d) for d in sorted(set(days) - {UNDATED})]
        return df.where(F.col("day").isin(dates) | (F.col("day").isNull() if UNDATED in days else F.lit(False))).drop("day")

    def replace(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def days(self, name: str) -> set[str]:
        """The days a table holds."""
        if not self.exists(name):
            return set()
        return {s.getPath().getName()[4:] for s in self._fs.listStatus(self._path(f"{self.root}/{name}")) if s.getPath().getName().startswith("day=")}

    def replace_days(self, name: str, df: DataFrame, node: Node, replaced: Collection[str] | Touched | None) -> set[str]:
        """Replace the days ``replaced`` (all: None) by those in ``df``, which holds no others; returns the days that changed.

        Rows gathered by day are dealt over tasks by size again (adaptive
        rebalancing), so one large day is not one task.
        """
        before = {d for d in self.days(name) if replaced is None or d in replaced}
        seen = Observation()
        dated = df.withColumn("day", node.day())
        dated = dated.hint("rebalance", "day") if node.mixed else dated
        # dates beyond the year 9999 can't be collected: their names can
        dated = dated.observe(seen, F.collect_set(F.coalesce(F.col("day").cast("string"), F.lit(UNDATED))).alias("days"))  # a value a day
        mode = "dynamic" if replaced is not None and self.exists(name) else "static"
        dated.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("day").parquet(f"{self.root}/{name}")
        now = set(seen.get["days"])
        for day in before - now:
            self._fs.delete(self._path(f"{self.root}/{name}/day={day}"), True)
        return before | now

    def note(self, name: str, values: Collection[str]) -> None:
        self.spark.createDataFrame([(v,) for v in sorted(values)], "value string").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/notes/{name}")

    def noted(self, name: str) -> set[str]:
        return {r.value for r in self.spark.read.parquet(f"{self.root}/notes/{name}").collect()} if self.exists(f"notes/{name}") else set()


def run(spark: SparkSession, raw: DataFrame, root: str, as_of: datetime | None = None, checks: list[Check] | None = None, days: Collection[date] | None = None) -> Report:
    """Build every node whose ancestors passed.

    Staging is written once and read by its four children.  A node's checks run
    as soon as all the nodes they read exist; a failure skips every descendant
    of any of those nodes that is not built yet, leaving older tables in place.

    With ``days``, ``raw`` has a column ``day`` and only those days changed since
    the last build.  They are read anew, with the undated rows and the days whose
    verdict the move of ``as_of`` can change; a table kept by day then rebuilds
    the days of its parent that changed, also those that an earlier failure kept
    from it.  Dimensions, the density summary and all checks read whole tables
    (narrow columns), so the gate is as strict as on a whole build.  The result
    is that of a whole build where the deliveries of an event share their day;
    where they don't, the uniqueness check of staging fails.  A day whose build
    was cut short is to be given again.
    """
    checks = CHECKS if checks is None else checks
    as_of = as_of or datetime.now(UTC)
    as_of = as_of if as_of.tzinfo else as_of.replace(tzinfo=UTC)
    store, report = Tables(spark, root), Report()
    last = max(store.noted("as_of"), default=None)
    touched = None
    if days is not None and last is not None:
        touched = Touched(frozenset(d.isoformat() for d in days), min(datetime.fromisoformat(last), as_of).astimezone(UTC).date().isoformat())
    frames: dict[str, DataFrame] = {"call_events": raw}
    changed: dict[str, set[str] | None] = {}
    broken: set[str] = set()
    waiting = list(checks)
    for node in ordered(graph(as_of), set(frames)):
        parent = node.on[0]
        pending = store.noted(f"pending/{node.name}") if node.day else set()
        if broken & set(node.on):
            report.nodes[node.name] = "SKIPPED"
            broken.add(node.name)
            # what its parent changed, or would have: the next build takes it in
            changed[node.name] = (changed.get(parent) or set()) | pending
            if node.day:
                store.note(f"pending/{node.name}", changed[node.name])
            continue
        parents = [frames[p] for p in node.on[1:]]
        if node.day is None:
            frames[node.name] = store.replace(node.name, node.build(frames[parent], *parents))
        else:
            if touched is None:
                part, replaced = frames[parent], None
            elif parent == "call_events":
                part, replaced = raw.where(touched.rows(F.col("day"))), touched
            else:
                replaced = (changed[parent] or set()) | pending
                part = store.read(parent, replaced, frames[parent].schema)
            rows = node.build(part, *parents)
            changed[node.name] = store.replace_days(node.name, rows, node, replaced)
            frames[node.name] = store.read(node.name, None, rows.schema)
            if pending:
                store.note(f"pending/{node.name}", [])
        report.nodes[node.name] = "BUILT"
        ready = [c for c in waiting if set(c.on) <= set(frames)]
        waiting = [c for c in waiting if c not in ready]
        found = {r.check: (r.status, r.failures) for r in counted(ready, frames).collect()} if ready else {}  # one job, a row per check
        report.checks |= found
        for check in ready:
            if found[check.name][1]:
                broken |= set(check.on) - {"call_events"}
    for check in waiting:
        report.checks[check.name] = ("SKIPPED", 0)
    store.note("as_of", [as_of.astimezone(UTC).isoformat()])
    return report
