"""Nodes broken on purpose, so that every check is seen to fail; the same in Spark and in DuckDB SQL.

Per node: columns replaced (SQL that both engines read), then the conditions of
rows that come once more.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _null(column: str, when: str, otherwise: str | None = None) -> str:
    return f"case when {when} then null {otherwise or ''} else {column} end"


def _digit(key: str, place: int, below: str | None = None) -> str:
    """About a sixteenth of the rows, by one hexadecimal digit of their key (or those below a digit)."""
    digit = f"substr({key}, {place}, 1)"
    return f"{digit} < '{below}'" if below else f"{digit} = '7'"


def _stg() -> tuple[dict[str, str], list[str]]:
    d = lambda n: _digit("event_id", n)
    columns = ["event_id", "occurred_at_utc", "interval_start_utc", "carrier_code", "destination_code", "origin_cc", "billable_seconds", "sell_rate_eur_per_min"]
    out = {c: _null(c, d(k)) for k, c in enumerate(columns, 1)}
    out["service_tier"] = _null("service_tier", d(9), f"when {d(11)} then 'gold'")
    out["disposition"] = _null("disposition", d(10), f"when {d(12)} then 'lost'")
    return out, [d(13)]


def _fact() -> tuple[dict[str, str], list[str]]:
    d = lambda n: _digit("call_attempt_key", n)
    out = {"call_attempt_key": _null("call_attempt_key", d(1)), "interval_start_utc": _null("interval_start_utc", d(8))}
    for k, c in enumerate(("carrier_key", "destination_key", "service_tier_key")):
        out[c] = _null(c, d(2 + 2 * k), f"when {d(3 + 2 * k)} then 'nobody'")
    out["is_human_answered"] = f"{d(9)} or is_human_answered"
    out["billable_seconds"] = f"case when {d(10)} then 5 else billable_seconds end"
    out["buy_rate_eur_per_min"] = f"case when {d(11)} then sell_rate_eur_per_min else buy_rate_eur_per_min end"
    out["has_buy_rate"] = f"has_buy_rate and not {_digit('call_attempt_key', 12, '4')}"
    return out, [d(13)]


def _quarantine() -> tuple[dict[str, str], list[str]]:
    d = lambda n: _digit("_row_id", n, "4")
    return {"quarantine_reason": _null("quarantine_reason", d(1), f"when {d(2)} then 'other'"), "_load_id": _null("_load_id", d(3))}, ["true", "true"]


def _mart() -> tuple[dict[str, str], list[str]]:
    columns = ["interval_start_utc", "attempts", "human_answer_rate", "buy_rate_coverage"]
    out = {c: _null(c, f"carrier_code = 'CR-0{k}'") for k, c in enumerate(columns, 1)}
    out["answer_rate"] = _null("answer_rate", "carrier_code = 'CR-05'", "when carrier_code = 'CR-06' then 1.5e0")
    return out, ["carrier_code = 'CR-07'"]


DAMAGE: dict[str, tuple[dict[str, str], list[str]]] = {
    "stg_call_events": _stg(),
    "stg_call_events_quarantine": _quarantine(),
    "dim_carrier": ({"carrier_key": _null("carrier_key", "carrier_code = 'CR-03'"), "carrier_code": _null("carrier_code", "carrier_code = 'CR-04'")}, ["carrier_code = 'CR-05'"]),
    "dim_destination": (
        {
            "destination_key": _null("destination_key", "destination_code = 'DST-01-MOB'"),
            "destination_code": _null("destination_code", "destination_code = 'DST-02-FIX'"),
            "network_type": _null("network_type", "destination_code = 'DST-03-FIX'", "when destination_code = 'DST-04-MOB' then 'SAT'"),
        },
        ["destination_code = 'DST-05-FIX'"],
    ),
    "dim_service_tier": (
        {
            "service_tier_key": _null("service_tier_key", "service_tier = 'economy'"),
            "service_tier": _null("service_tier", "service_tier = 'standard'"),
            "tier_rank": _null("tier_rank", "service_tier = 'premium'"),
        },
        ["service_tier = 'critical'"],
    ),
    "fct_call_attempt": _fact(),
    "agg_routing_interval": _mart(),
    "dq_interval_density": ({c: _null(c, "true") for c in ("slots", "mean_attempts_per_slot", "median_attempts_per_slot", "share_at_or_above_30")}, ["true"]),
}


def damaged(node: str, df: DataFrame) -> DataFrame:
    if node not in DAMAGE:
        return df
    columns, again = DAMAGE[node]
    out = df.withColumns({c: F.expr(e) for c, e in columns.items()})
    for condition in again:
        out = out.unionByName(df.where(condition))
    return out


def sql_ctes(names: dict[str, str]) -> str:
    """Further CTEs, ``<name>_damaged`` for each node's CTE ``name``."""
    out = ""
    for node, (columns, again) in DAMAGE.items():
        of = names[node]
        replaced = ", ".join(f"{e} as {c}" for c, e in columns.items())
        out += f", {of}_damaged as (select * replace ({replaced}) from {of}" + "".join(f" union all select * from {of} where {condition}" for condition in again) + ")"
    return out


def renamed(selects: dict[str, str], names: dict[str, str]) -> dict[str, str]:
    """The checks' SQL on the damaged CTEs."""
    tables = "|".join(sorted(set(names.values()), key=len, reverse=True))
    return {k: re.sub(rf"\b(from|join) ({tables})\b", lambda m: f"{m[1]} {m[2]}_damaged {m[2] if m[2] == 'fct' else ''}", v) for k, v in selects.items()}
