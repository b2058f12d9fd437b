"""Data-quality checks: each is a query whose rows are failures."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from switchyard.functions import share
from switchyard.schemas import DISPOSITIONS, GRAIN, REASONS, TIERS


@dataclass(frozen=True)
class Check:
    """``failing`` maps the nodes in ``on`` to the failing rows.

    ``bad`` is set where a failure is a row of the one node: such checks are
    counted together in one pass over it.  ``failures`` counts in a cheaper way
    than through the rows themselves, where there is one.
    """

    name: str
    on: tuple[str, ...]
    failing: Callable[..., DataFrame]
    bad: Callable[[], Column] | None = None
    failures: Callable[..., DataFrame] | None = None

    def counted(self, *frames: DataFrame) -> DataFrame:
        """One row: ``failures``."""
        return self.failures(*frames) if self.failures else self.failing(*frames).agg(F.count("*").alias("failures"))


def rows_where(name: str, node: str, bad: Callable[[], Column]) -> Check:
    return Check(name, (node,), lambda df: df.where(bad()), bad)


def not_null(node: str, column: str) -> Check:
    return rows_where(f"not_null_{node}_{column}", node, lambda: F.col(column).isNull())


def unique(node: str, *columns: str) -> Check:
    def failing(df: DataFrame) -> DataFrame:
        there = df
        for c in columns:
            there = there.where(F.col(c).isNotNull())
        return there.groupBy(*columns).count().where("count > 1")

    return Check(f"unique_{node}_{'_'.join(columns)}", (node,), failing)


def accepted_values(node: str, column: str, values: tuple[str, ...]) -> Check:
    return rows_where(f"accepted_values_{node}_{column}", node, lambda: ~F.col(column).isin(*values))


def relationship(child: str, column: str, parent: str, key: str) -> Check:
    """Child rows without a parent; for their number the keys are counted first, so no child row is shuffled."""

    def orphans(rows: DataFrame, p: DataFrame) -> DataFrame:
        return rows.where(F.col(column).isNotNull()).join(p.select(F.col(key).alias(column)), column, "left_anti")

    def failures(c: DataFrame, p: DataFrame) -> DataFrame:
        return orphans(c.groupBy(column).agg(F.count("*").alias("n")), p).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("failures"))

    return Check(f"relationship_{child}_{column}", (child, parent), lambda c, p: orphans(c.select(column), p), None, failures)


def coverage_below(threshold: float = 0.85) -> Check:
    def failing(fact: DataFrame) -> DataFrame:
        return fact.agg(F.count("*").alias("attempts"), F.count_if("has_buy_rate").alias("with_buy_rate"), share(F.count_if("has_buy_rate"), F.count("*")).alias("coverage")).where(F.col("coverage") < threshold)

    return Check("assert_buy_rate_coverage_above_threshold", ("fct_call_attempt",), failing)


def quarantine_volume(most: float = 0.01) -> Check:
    def failing(quarantine: DataFrame, raw: DataFrame) -> DataFrame:
        held = quarantine.agg(F.count("*").alias("quarantined"))
        both = held.crossJoin(raw.agg(F.count("*").alias("delivered")))  # one row by one row
        return both.withColumn("quarantined_share", share(F.col("quarantined"), F.col("delivered"))).where((F.col("quarantined_share") > most) | (F.col("quarantined") == 0))

    return Check("assert_quarantine_volume_below_threshold", ("stg_call_events_quarantine", "call_events"), failing)


def _rates_out_of_bounds() -> Column:
    out = F.col("human_answer_rate") > F.col("answer_rate")
    for rate in ("answer_rate", "human_answer_rate", "buy_rate_coverage"):
        out = out | ~F.col(rate).between(0, 1)
    return out


SINGULAR = [
    coverage_below(),
    quarantine_volume(),
    rows_where("assert_human_answer_implies_answer", "fct_call_attempt", lambda: F.expr("is_human_answered and not is_answered")),
    rows_where("assert_no_billing_without_answer", "fct_call_attempt", lambda: F.expr("not is_answered and billable_seconds > 0")),
    rows_where("assert_purchase_rate_below_sale", "fct_call_attempt", lambda: F.expr("has_buy_rate and buy_rate_eur_per_min >= sell_rate_eur_per_min")),
    rows_where("assert_rates_are_within_bounds", "agg_routing_interval", _rates_out_of_bounds),
    Check("assert_routing_interval_grain_is_unique", ("agg_routing_interval",), lambda m: m.groupBy(*GRAIN).agg(F.count("*").alias("rows_in_slot")).where("rows_in_slot > 1")),
    Check("assert_density_summary_is_one_row", ("dq_interval_density",), lambda d: d.agg(F.count("*").alias("rows_in_summary")).where("rows_in_summary <> 1")),
]

# Which columns of which node must hold a value; which must be unique.
_NOT_NULL = {
    "stg_call_events": ["event_id", "occurred_at_utc", "interval_start_utc", "carrier_code", "destination_code", "origin_cc", "service_tier", "disposition", "billable_seconds", "sell_rate_eur_per_min"],
    "stg_call_events_quarantine": ["quarantine_reason", "_load_id"],
    "dim_carrier": ["carrier_key", "carrier_code"],
    "dim_destination": ["destination_key", "destination_code", "network_type"],
    "dim_service_tier": ["service_tier_key", "service_tier", "tier_rank"],
    "fct_call_attempt": ["call_attempt_key", "carrier_key", "destination_key", "service_tier_key", "interval_start_utc"],
    "agg_routing_interval": ["interval_start_utc", "attempts", "answer_rate", "human_answer_rate", "buy_rate_coverage"],
    "dq_interval_density": ["slots", "mean_attempts_per_slot", "median_attempts_per_slot", "share_at_or_above_30"],
}
_UNIQUE = {"stg_call_events": ["event_id"], "dim_carrier": ["carrier_key", "carrier_code"], "dim_destination": ["destination_key", "destination_code"], "dim_service_tier": ["service_tier_key", "service_tier"], "fct_call_attempt": ["call_attempt_key"]}

CHECKS: list[Check] = [
    *(not_null(n, c) for n, cs in _NOT_NULL.items() for c in cs),
    *(unique(n, c) for n, cs in _UNIQUE.items() for c in cs),
    accepted_values("stg_call_events", "service_tier", TIERS),
    accepted_values("stg_call_events", "disposition", DISPOSITIONS),
    accepted_values("stg_call_events_quarantine", "quarantine_reason", REASONS),
    accepted_values("dim_destination", "network_type", ("FIX", "MOB")),
    *(relationship("fct_call_attempt", f"{d}_key", f"dim_{d}", f"{d}_key") for d in ("carrier", "destination", "service_tier")),
    *SINGULAR,
]


def report(checks: list[Check], nodes: Mapping[str, DataFrame]) -> DataFrame:
    """One row per check: its name, number of failing rows and status.

    All row checks of a node are one aggregate over it, turned into rows after;
    the others are counted by the engine one by one.
    """
    parts = []
    by_node: dict[str, list[Check]] = {}
    for c in checks:
        if c.bad is not None:
            by_node.setdefault(c.on[0], []).append(c)
        else:
            parts.append(c.counted(*(nodes[n] for n in c.on)).select(F.lit(c.name).alias("check"), "failures"))
    for node, own in by_node.items():
        wide = nodes[node].agg(*[F.count_if(c.bad()).alias(f"_{k}") for k, c in enumerate(own)])
        parts.append(wide.select(F.inline(F.array(*[F.struct(F.lit(c.name).alias("check"), F.col(f"_{k}").alias("failures")) for k, c in enumerate(own)]))))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.withColumn("status", F.when(F.col("failures") == 0, "PASS").otherwise("FAIL"))
