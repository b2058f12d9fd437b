"""Exact quantiles by counting, mergeable distinct counts, gates drilled down, bursts, and typed properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from switchyard.functions import share

BINS = 1024


def exact_quantiles(rows: DataFrame, column: str, quantiles: list[float], bins: int = BINS) -> list[float | None]:
    """Interpolated quantiles of a numeric column, as ``percentile`` gives them, without gathering its values.

    A rank is sought by counting passes: the range that holds it is cut in
    ``bins`` equal parts, which are counted (one row a part and task); the part
    that holds the rank is the next range.  All ranks share a pass.  A range ends
    when it is one value; its width falls by ``bins`` each pass, so doubles
    of usual spread take two or three and none more than eight.  Null and NaN are
    left out; without values there is no quantile.
    """
    values = rows.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    n, least, most = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return [None] * len(quantiles)
    places = [(n - 1) * q for q in quantiles]
    wanted = sorted({r for p in places for r in (int(p), min(int(p) + 1, n - 1))})
    found: dict[int, float] = {}
    open_: dict[tuple[float, float], tuple[int, list[int]]] = {(least, most): (0, wanted)}  # range -> values below it, ranks in it
    while open_:
        ends = {r: v for (lo, hi), (_, ranks) in open_.items() if lo == hi for r, v in ((r, lo) for r in ranks)}
        found |= ends
        open_ = {k: v for k, v in open_.items() if k[0] < k[1]}
        if not open_:
            break
        where = part = None
        for i, (lo, hi) in enumerate(open_):  # as many as there are ranks at most
            inside = F.col("v").between(lo, hi)
            place = F.least(F.floor((F.col("v") - lo) / (hi - lo) * bins), F.lit(bins - 1)) + i * bins
            part = (F if part is None else part).when(inside, place)
            where = inside if where is None else where | inside
        counted = values.where(where).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()  # at most bins rows a range
        parts = {r.part: r for r in counted}
        after: dict[tuple[float, float], tuple[int, list[int]]] = {}
        for i, (below, ranks) in enumerate(open_.values()):
            for b in range(i * bins, (i + 1) * bins):
                if b in parts:
                    here = [r for r in ranks if below <= r < below + parts[b].n]
                    if here:
                        after[parts[b].lo, parts[b].hi] = (below, here)
                    below += parts[b].n
        open_ = after
    return [found[int(p)] + (found[min(int(p) + 1, n - 1)] - found[int(p)]) * (p - int(p)) for p in places]


def distinct_sketches(rows: DataFrame, by: list[str], column: str, lg_k: int = 14) -> DataFrame:
    """One mergeable sketch a group: what later days add is merged, what is stored is not read again."""
    return rows.groupBy(*by).agg(F.hll_sketch_agg(column, F.lit(lg_k)).alias("sketch"))


def distinct_counts(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Distinct values over merged sketches; within 4 deviations of 1.04 / sqrt(2^lg_k) but for one group in 10,000."""
    merged = F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate")
    return sketches.groupBy(*by).agg(merged) if by else sketches.agg(merged)


def drill_down(fact: DataFrame, dimensions: list[str], part: Column, below: float) -> DataFrame:
    """A share over all combinations of ``dimensions`` (cube), and which of them fall below the gate's threshold.

    ``level`` is the grouping id: a set bit is a dimension that is summed over.
    """
    counted = fact.cube(*dimensions).agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("attempts"), F.count_if(part).alias("covered"))
    rate = share(F.col("covered"), F.col("attempts"))
    return counted.withColumn("coverage", rate).withColumn("failing", F.col("coverage") < below)


def bursts(events: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """Runs of a key's events with at most ``gap`` between neighbours: sessions, merged in part before the shuffle."""
    runs = events.where(F.col(at).isNotNull()).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("attempts"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    return runs.drop("w")


def typed_props(events: DataFrame, props: str = "props") -> DataFrame:
    """``events`` with ``k`` read as a number from JSON, and why it could not be: null for good rows."""
    parsed = F.try_parse_json(props)
    k = F.try_variant_get(parsed, "$.k", "bigint")
    there = F.try_variant_get(parsed, "$.k", "string")
    reason = F.when(F.col(props).isNull(), "missing_props").when(parsed.isNull(), "malformed_props").when(there.isNull(), "missing_k").when(k.isNull(), "k_is_no_number")
    return events.withColumn("k", k).withColumn("reason", reason)
