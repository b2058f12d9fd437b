"""Loading raw events: whole days overwritten, or appended from a high-water mark.

Validation comes before the cursor: a row dated in the future is stored, but
never moves the mark.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from switchyard.functions import as_of_column, utc_naive
from switchyard.schemas import RAW_TABLE
from switchyard.sources.catalogue import GeneratorConfig
from switchyard.sources.generator import events

DEFAULT_START, DEFAULT_DAYS = date(2026, 3, 1), 7


@dataclass(frozen=True)
class Destination:
    """Where raw rows land.  ``kind`` is parquet (a folder) or postgres (JDBC)."""

    kind: str
    root: str
    pipeline: str

    @property
    def raw(self) -> str:
        return f"{self.root}/raw/call_events"

    @property
    def state(self) -> str:
        return f"{self.root}/state/{self.pipeline}"


def destination(kind: str = "parquet", root: str = "warehouse") -> Destination:
    if kind not in ("parquet", "postgres"):
        raise ValueError(f"unknown destination {kind!r}: parquet or postgres")
    if kind == "postgres":
        postgres_options()  # fails at once, not after a load
    return Destination(kind, root.rstrip("/"), f"calls_{kind}")


def postgres_options() -> dict[str, str]:
    """JDBC options from the environment; a password has no default."""
    if not os.environ.get("POSTGRES_PASSWORD"):
        raise RuntimeError("POSTGRES_PASSWORD is not set")
    env = os.environ.get
    return {
        "url": f"jdbc:postgresql://{env('POSTGRES_HOST', 'localhost')}:{env('POSTGRES_PORT', '55432')}/{env('POSTGRES_DB', 'calls')}",
        "user": env("POSTGRES_USER", "calls"),
        "password": os.environ["POSTGRES_PASSWORD"],
        "driver": "org.postgresql.Driver",
    }


def with_day(rows: DataFrame) -> DataFrame:
    return rows.withColumn("day", utc_naive("occurred_at").cast("date"))


def read_raw(spark: SparkSession, where: Destination) -> DataFrame:
    """The raw table; over JDBC one task a UTC day, so that no connection carries all rows."""
    if where.kind != "postgres":
        return spark.read.schema(RAW_TABLE).parquet(where.raw)
    days = spark.read.format("jdbc").options(**postgres_options(), query=f"select distinct day from {TABLE}").load()
    o = postgres_options()
    return spark.read.jdbc(o.pop("url"), TABLE, predicates=day_predicates([r.day for r in days.collect()]), properties=o)  # a row a day


def day_predicates(days: list[date | None]) -> list[str]:
    """One condition for each day; together they cover every row once, undated rows and days that come meanwhile included."""
    known = sorted(d for d in days if d is not None)
    each = [f"day = date '{d.isoformat()}'" for d in known]
    others = " and ".join(f"day <> date '{d.isoformat()}'" for d in known)
    return [*each, f"day is null or ({others})" if known else "true"]


TABLE, INCOMING = "raw.call_events", "raw.call_events_incoming"


def jdbc_write(rows: DataFrame, table: str, mode: str) -> None:
    rows.write.format("jdbc").options(**postgres_options(), dbtable=table).mode(mode).save()


def jdbc_execute(spark: SparkSession, statements: list[str]) -> None:
    """All statements in one transaction, through the driver's own JDBC connection."""
    o = postgres_options()
    spark._jvm.java.lang.Class.forName(o["driver"])
    link = spark._jvm.java.sql.DriverManager.getConnection(o["url"], o["user"], o["password"])
    try:
        link.setAutoCommit(False)
        for sql in statements:
            link.createStatement().execute(sql)
        link.commit()
    finally:
        link.close()


def overwrite_days(rows: DataFrame, where: Destination) -> None:
    """Each UTC day in ``rows`` replaces that day: any past day can be run again.

    Over JDBC the rows land beside the table first; one transaction then takes
    the days they hold out of it and puts them in.
    """
    if where.kind == "postgres":
        jdbc_write(with_day(rows), INCOMING, "overwrite")
        columns = ", ".join(f'"{f.name}"' for f in RAW_TABLE.fields)
        jdbc_execute(
            rows.sparkSession,
            [
                f"create table if not exists {TABLE} (like {INCOMING})",
                f"delete from {TABLE} t where exists (select 1 from {INCOMING} i where i.day is not distinct from t.day)",
                f"insert into {TABLE} ({columns}) select {columns} from {INCOMING}",
                f"drop table {INCOMING}",
            ],
        )
        return
    with_day(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(where.raw)


def high_water_mark(spark: SparkSession, where: Destination) -> int | None:
    """Largest mark recorded for this pipeline and destination, in microseconds since 1970 UTC."""
    path = spark._jvm.org.apache.hadoop.fs.Path(where.state)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema("mark_us long").parquet(where.state).agg(F.max("mark_us").alias("m")).first().m


def append_new(rows: DataFrame, where: Destination, as_of: datetime | None = None) -> None:
    """Append rows at or after the mark (closed boundary: at least once), then move it.

    A row without a date can't be placed before or after the mark: it is kept.
    The new mark is observed on the rows as they are written, so it is that of
    what was stored and the rows are read once; a row in the future is not
    observed.  A failure between the two steps repeats rows, and loses none.
    """
    spark = rows.sparkSession
    mark = high_water_mark(spark, where)
    fresh = rows if mark is None else rows.where(F.col("occurred_at").isNull() | (F.unix_micros("occurred_at") >= F.lit(mark)))
    seen = Observation()
    watched = with_day(fresh).observe(seen, F.max(F.when(F.col("occurred_at") <= as_of_column(as_of), F.unix_micros("occurred_at"))).alias("mark_us"))
    if where.kind == "postgres":
        jdbc_write(watched, TABLE, "append")
    else:
        watched.write.mode("append").partitionBy("day").parquet(where.raw)
    if (reached := seen.get["mark_us"]) is not None:
        spark.createDataFrame([(reached,)], "mark_us long").coalesce(1).write.mode("append").parquet(where.state)  # one row


#: Rows of a number of days from a first one.
Source = Callable[[SparkSession, date, int], DataFrame]


def load(spark: SparkSession, start: date = DEFAULT_START, n_days: int = DEFAULT_DAYS, where: Destination | None = None, config: GeneratorConfig | None = None, mode: str = "overwrite", load_id: str | None = None, as_of: datetime | None = None, source: Source | None = None) -> Destination:
    """Load a range of days from ``source``; without one, made-up events."""
    where = where or destination()
    rows = source(spark, start, n_days) if source else events(spark, start, n_days, config, load_id or start.isoformat())
    if mode == "overwrite":
        overwrite_days(rows, where)
    elif mode == "append":
        append_new(rows, where, as_of)
    else:
        raise ValueError(f"unknown mode {mode!r}: overwrite or append")
    return where
