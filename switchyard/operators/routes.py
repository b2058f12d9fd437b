"""The routing catalogue as the traffic shows it: groups, the carriers that serve them, and how skewed both are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from switchyard.functions import share

GROUP = ["destination_code", "origin_cc", "service_tier"]
ROUTE = ["carrier_code", *GROUP]


def catalogue(calls: DataFrame) -> DataFrame:
    """One row a route: its attempts, its group's, and its share of them.

    Attempts are summed before the groups are joined: routes, not calls, meet them.
    """
    routes = calls.groupBy(*ROUTE).agg(F.count("*").alias("attempts"))
    groups = routes.groupBy(*GROUP).agg(F.sum("attempts").alias("group_attempts"), F.count("*").alias("carriers"))
    return routes.join(groups, GROUP).select(*ROUTE, "attempts", "group_attempts", "carriers", share(F.col("attempts"), F.col("group_attempts")).alias("share"))


def shape(routes: DataFrame) -> DataFrame:
    """One row: how many groups there are, the share of them with one carrier, and the mean number of carriers."""
    groups = routes.groupBy(*GROUP).agg(F.count("*").alias("carriers"))
    return groups.agg(F.count("*").alias("groups"), share(F.count_if(F.col("carriers") == 1), F.count("*")).alias("mono_carrier_share"), F.avg("carriers").alias("mean_carriers"))


def zipf(rank: Column, alpha: float) -> Column:
    """The weight of a rank under a power law, before it is divided by the sum of all."""
    return F.pow(rank.cast("double"), F.lit(-alpha))


def ineligible(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """Attempts over carriers that ``routes`` does not let serve their group, by anti-join of routes with routes."""
    return calls.groupBy(*ROUTE).agg(F.count("*").alias("deliveries")).join(routes.select(*ROUTE), ROUTE, "left_anti")
