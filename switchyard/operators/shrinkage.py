"""Rates of thin slots, drawn towards those of their route, group and network.

Empirical Bayes by moments.  A level's members have y successes of n; around
their common mean m they vary by chance, m (1 - m) / n each, and beyond it.  What
varies beyond chance is estimated from the weighted squares (never below 0) and
says how many attempts the mean is worth: strength s = m (1 - m) / variance - 1,
at most ``MOST``.  A member's rate is then (y + s prior) / (n + s), where the prior
is its parent's rate, drawn towards its own parent's in the same way: a slot to
its route, a route to its group, a group to the whole.  The strength comes from
members of one parent where those can tell (two of them at least), else ``MOST``.

Every level is an aggregate of the one below, so attempts are read once; sums of
squares are decimals, so that any order of summation gives the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 10_000.0
GROUP = ["destination_code", "origin_cc", "service_tier"]
LEVELS = [[*GROUP, "carrier_code", "interval_start_utc"], [*GROUP, "carrier_code"], GROUP, []]


def _exact(value: Column) -> Column:
    return value.cast("decimal(28,10)")


def strengths(members: DataFrame, parent: list[str]) -> DataFrame:
    """Per parent of ``members`` (..., y, n): y, n, and the strength of their common mean."""
    sums = members.groupBy(*parent).agg(
        F.sum("y").alias("y"),
        F.sum("n").alias("n"),
        F.count("*").alias("k"),
        F.sum(_exact(F.col("y").cast("double") * F.col("y") / F.col("n"))).cast("double").alias("yy"),
        F.sum(F.col("n").cast("decimal(28,0)") * F.col("n")).cast("double").alias("nn"),
    )
    m = F.col("y") / F.col("n")
    chance = m * (1 - m)
    beyond = (F.col("yy") - m * F.col("y") - (F.col("k") - 1) * chance) / F.nullif(F.col("n") - F.col("nn") / F.col("n"), F.lit(0.0))
    strength = F.when((F.col("k") > 1) & (beyond > 0), F.greatest(F.least(chance / beyond - 1, F.lit(MOST)), F.lit(0.0))).otherwise(F.lit(MOST))
    return sums.select(*parent, "y", "n", strength.alias("strength"))


def shrunk(slots: DataFrame, successes: str, attempts: str = "attempts") -> DataFrame:
    """Per slot: its levels' keys, y, n, its own rate and ``rate``, drawn towards its parents'."""
    levels = [slots.select(*LEVELS[0], F.col(successes).alias("y"), F.col(attempts).alias("n")).where("n > 0")]
    for parent in LEVELS[1:]:
        levels.append(strengths(levels[-1].select(*LEVELS[len(levels) - 1], "y", "n"), parent))
    above = levels[-1].select((F.col("y") / F.col("n")).alias("prior"), "strength")
    out = None
    for keys, parent, level in reversed(list(zip(LEVELS, LEVELS[1:], levels, strict=False))):
        met = level.withColumnRenamed("strength", "own").join(above, parent) if parent else level.withColumnRenamed("strength", "own").crossJoin(above)  # by one row
        out = met.withColumn("rate", (F.col("y") + F.col("strength") * F.col("prior")) / (F.col("n") + F.col("strength")))
        if "own" in out.columns:
            above = out.select(*keys, F.col("rate").alias("prior"), F.col("own").alias("strength"))
    return out.select(*LEVELS[0], "y", "n", (F.col("y") / F.col("n")).alias("raw_rate"), "rate", "prior", "strength")
