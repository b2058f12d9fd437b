"""Column expressions shared by the models; all run inside whole-stage codegen."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["as_of_column", "instant", "interval_bucket", "micro", "quarantine_reason", "rounded", "share", "surrogate_key", "utc_naive"]


def as_of_column(as_of: datetime | None = None) -> Column:
    """The instant a run believes in; only where none is given, now."""
    if as_of is None:
        return F.current_timestamp()
    if as_of.tzinfo is None:
        as_of = as_of.replace(tzinfo=UTC)
    return F.timestamp_micros(F.lit(int(as_of.timestamp() * 1_000_000)))


def quarantine_reason(as_of: Column) -> Column:
    """Why a delivery is unreadable, first reason first; null for admissible rows."""
    return (
        F.when(F.col("event_id").isNull(), "missing_event_id")
        .when(F.col("billable_seconds") < 0, "negative_billable_seconds")
        .when(F.col("occurred_at") > as_of, "occurred_in_the_future")
    )


def utc_naive(instant: str) -> Column:
    """UTC wall clock of a timestamp column, whatever the session's time zone."""
    return F.expr(f"timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(unix_micros({instant}) / 1000000.0BD as decimal(18, 6)))")


def instant(ts: Column) -> Column:
    """The instant that a naive timestamp names in UTC, whatever the session's time zone."""
    whole = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return F.timestamp_micros(whole * 1_000_000 + (F.extract(F.lit("second"), ts) * 1_000_000).cast("long"))


def interval_bucket(ts: Column, minutes: int = 15) -> Column:
    """Start of the ``minutes``-wide bucket of a naive timestamp, counted from 2000-01-01 00:00; null stays null.

    Widths that divide a day fall on the clock whatever the origin; for others
    the origin is part of the result.
    """
    if minutes < 1:
        raise ValueError(f"a bucket of {minutes} minutes holds nothing")
    passed = F.hour(ts) * 60 + F.minute(ts)
    if 1440 % minutes:
        passed = F.datediff(ts.cast("date"), F.lit("2000-01-01").cast("date")) * 1440 + passed
    past = F.make_dt_interval(F.lit(0), F.lit(0), F.pmod(passed, F.lit(minutes)), F.extract(F.lit("second"), ts))
    return ts - past


def surrogate_key(natural: str | Column) -> Column:
    return F.md5((F.col(natural) if isinstance(natural, str) else natural).cast("binary"))


def share(part: Column, whole: Column) -> Column:
    """part / whole as double; null where whole is 0."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def micro(rate: str) -> Column:
    """A rate in whole millionths, so that sums are exact.  Rates have six decimals; a finer one raises, as its money would be wrong."""
    scaled = F.col(rate) * 1_000_000
    whole = F.round(scaled)
    return F.when(scaled.isNull() | (F.abs(scaled - whole) < 0.01), whole).otherwise(F.raise_error(F.concat(F.lit(f"{rate} is finer than a millionth: "), F.col(rate).cast("string")))).cast("long")


def rounded(value: Column, digits: int) -> Column:
    return F.round(value.cast("decimal(18,6)"), digits).cast("double")
