"""The sparse routing catalogue: which carriers serve which decision group.

Every draw is a function of the seed and a name: the MD5 of both, cut in four
32-bit fractions.  Spark, DuckDB and Python share it, so a catalogue (a few
hundred rows at most, built on the driver) can be rebuilt in SQL.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate, count

from pyspark.sql import DataFrame, SparkSession

from switchyard.schemas import CARRIERS, DESTINATIONS, ORIGINS, TIERS


@dataclass(frozen=True)
class GeneratorConfig:
    # Defaults of the source.
    events_per_day: int = 120_000
    n_groups: int = 24
    missing_buy_rate_share: float = 0.08
    duplicate_share: float = 0.004
    malformed_share: float = 0.002
    seed: int = 41


# Power-law exponents and the cumulative shares of one, two and three eligible carriers.
ALPHA_DESTINATION, ALPHA_ORIGIN, ALPHA_TIER, ALPHA_GROUP = 1.6, 1.2, 0.8, 1.1
ELIGIBLE = (0.39, 0.69, 0.86)
CARRIER_POWER = 2.0
# A route's answer rate, human share and selling rate, each a floor and a span.
ANSWER, HUMAN, SELL = (0.12, 0.48), (0.35, 0.55), (0.0040, 0.0180)


def fractions(*name) -> tuple[float, ...]:
    """Four uniform draws in [0, 1) that belong to this name."""
    digest = hashlib.md5("|".join(map(str, name)).encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) / 2**32 for k in range(0, 32, 8))


class Wheel:
    """A weighted choice: one uniform draw picks the first option whose cumulative share exceeds it."""

    def __init__(self, weights: list[float]):
        total = sum(weights)
        self.shares = tuple(w / total for w in weights)
        self.bounds = list(accumulate(self.shares))

    def at(self, u: float) -> int:
        return min(bisect_right(self.bounds, u), len(self.bounds) - 1)


def power_law(n: int, alpha: float) -> Wheel:
    """Shares proportional to rank to the power ``-alpha``."""
    return Wheel([rank**-alpha for rank in range(1, n + 1)])


def random_powers(names: list[tuple], power: float) -> Wheel:
    """Shares proportional to a draw of each name to ``power``; never zero."""
    return Wheel([(1 - fractions(*name)[0]) ** power for name in names])


@dataclass(frozen=True)
class Route:
    """A decision group: where its calls go and who may carry them."""

    destination: str
    origin: str
    tier: str
    carriers: tuple[str, ...]
    wheel: Wheel


@dataclass(frozen=True)
class Catalogue:
    seed: int
    routes: tuple[Route, ...]
    wheel: Wheel

    def mono_carrier_share(self) -> float:
        return sum(len(r.carriers) == 1 for r in self.routes) / len(self.routes)

    def mean_carriers_per_group(self) -> float:
        return sum(len(r.carriers) for r in self.routes) / len(self.routes)

    def quality(self, carrier: str, destination: str) -> tuple[float, float, int]:
        """Answer rate, human share and selling rate (millionths) of a carrier on a destination, on any day."""
        a, h, s, _ = fractions(self.seed, "quality", carrier, destination)
        return ANSWER[0] + ANSWER[1] * a, HUMAN[0] + HUMAN[1] * h, int((SELL[0] + SELL[1] * s) * 1e6 + 0.5)

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row per route and carrier: the interval of draws that picks it, and its quality."""
        rows = []
        for g, r in enumerate(self.routes):
            ends = [0.0, *r.wheel.bounds[:-1], 2.0]  # the last option also takes what rounding leaves
            for k, carrier in enumerate(r.carriers):
                rows.append((g, ends[k], ends[k + 1], carrier, r.destination, r.origin, r.tier, r.wheel.shares[k], *self.quality(carrier, r.destination)))
        return spark.createDataFrame(rows, "grp int, lo double, hi double, carrier_code string, destination_code string, origin_cc string, service_tier string, share double, answers double, humans double, sell_micro long")


def build(config: GeneratorConfig) -> Catalogue:
    """The same for a seed on every day: routes in the order in which they are first drawn."""
    most = len(DESTINATIONS) * len(ORIGINS) * len(TIERS)
    if config.n_groups > most:
        raise ValueError(f"{config.n_groups} groups exceeds the {most} there can be")
    places, origins, tiers = power_law(len(DESTINATIONS), ALPHA_DESTINATION), power_law(len(ORIGINS), ALPHA_ORIGIN), power_law(len(TIERS), ALPHA_TIER)
    keys: list[tuple[str, str, str]] = []
    for n in count():
        if len(keys) == config.n_groups:
            break
        p, o, t, _ = fractions(config.seed, "group", n)
        key = DESTINATIONS[places.at(p)], ORIGINS[origins.at(o)], TIERS[tiers.at(t)]
        if key not in keys:
            keys.append(key)
    routes = []
    for g, key in enumerate(keys):
        size = 1 + bisect_right(ELIGIBLE, fractions(config.seed, "eligible", g)[0])
        dealt = sorted(CARRIERS, key=lambda c, g=g: hashlib.md5(f"{config.seed}|deck|{g}|{c}".encode()).hexdigest())[:size]
        routes.append(Route(*key, tuple(dealt), random_powers([(config.seed, "weight", g, c) for c in dealt], CARRIER_POWER)))
    return Catalogue(config.seed, tuple(routes), power_law(len(routes), ALPHA_GROUP))
