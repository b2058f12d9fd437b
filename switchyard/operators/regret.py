"""What better routing would be worth, and where the traffic can tell.

A policy names one carrier for each group; it is learned on some days and
valued on the others, so that no luck of the days it was learned on counts.
Value is by inverse propensity: an attempt that went to the named carrier
stands for 1 / p attempts, p being that carrier's share of its group on the days
of learning.  Only groups of the decidable perimeter are valued: two carriers at
least, each with a share of at least ``floor``, so that no attempt stands for
more than 1 / ``floor``, and traffic on both kinds of days.  A group of one
carrier has no other choice to compare with.

The lower bound is the empirical Bernstein bound: value less
sqrt(2 variance ln(3 / delta) / n) less 3 ln(3 / delta) / (p n).  All of it is
sums over routes, of which there are few; attempts are read once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from switchyard.functions import share

GROUP = ["destination_code", "origin_cc", "service_tier"]
FLOOR, DELTA = 0.05, 0.05


def by_route(stg: DataFrame, learn: Column, success: str = "is_human_answered") -> DataFrame:
    """Attempts and successes of every route on the days of learning and of valuing."""
    part = F.when(learn, "l").otherwise("v")
    counts = []
    for k in ("l", "v"):
        counts += [F.count_if(part == k).alias(f"n_{k}"), F.count_if((part == k) & F.col(success)).alias(f"y_{k}")]
    return stg.groupBy(*GROUP, "carrier_code").agg(*counts)


def valued(routes: DataFrame, floor: float = FLOOR, delta: float = DELTA) -> DataFrame:
    """One row a group: whether it is decidable, the carrier named, logged and policy value, error, bound and regret."""
    eligible = F.when(F.col("n_l") > 0, F.col("n_l"))
    totals = routes.groupBy(*GROUP).agg(F.sum("n_l").alias("learned"), F.sum("n_v").alias("attempts"), F.sum("y_v").alias("successes"), F.count(eligible).alias("carriers"))
    met = routes.where("n_l > 0").join(totals, GROUP).withColumn("p", share(F.col("n_l"), F.col("learned"))).where(F.col("p") >= floor)
    # best rate of the learning days, then the most attempts, then the least code
    best = F.struct((-share(F.col("y_l"), F.col("n_l"))).alias("r"), (-F.col("n_l")).alias("n"), "carrier_code")
    named = met.groupBy(*GROUP).agg(F.count("*").alias("choices"), F.min_by(F.struct("carrier_code", "p", "y_v"), best).alias("b"))
    out = totals.join(named, GROUP, "left")
    n, p, y = F.col("attempts"), F.col("b.p"), F.col("b.y_v")
    decidable = F.coalesce((F.col("choices") >= 2) & (n > 0), F.lit(False))
    value = y / p / n
    variance = F.greatest(y / (p * p) / n - value * value, F.lit(0.0))
    log = math.log(3 / delta)
    logged = share(F.col("successes"), n)
    only = lambda c: F.when(F.col("decidable"), c)
    return out.withColumn("decidable", decidable).select(
        *GROUP,
        "attempts",
        "carriers",
        "decidable",
        only(F.col("b.carrier_code")).alias("named"),
        only(p).alias("propensity"),
        logged.alias("logged_value"),
        only(value).alias("policy_value"),
        only(F.sqrt(variance / n)).alias("std_error"),
        only(value - F.sqrt(2 * variance * log / n) - 3 * log / (p * n)).alias("lower_bound"),
        only(value - logged).alias("regret"),
    )


def perimeter(groups: DataFrame) -> DataFrame:
    """One row: how much traffic is decidable, and its regret in answers an attempt."""
    inside = F.col("decidable")
    lost = F.sum(F.when(inside, (F.col("regret") * F.col("attempts")).cast("decimal(28,10)"))).cast("double")
    return groups.agg(
        F.count("*").alias("groups"),
        F.count_if(inside).alias("decidable_groups"),
        F.sum("attempts").alias("attempts"),
        F.sum(F.when(inside, F.col("attempts")).otherwise(0)).alias("decidable_attempts"),
        (lost / F.sum(F.when(inside, F.col("attempts")))).alias("regret"),
    )
