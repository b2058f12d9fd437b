"""Connected components over an edge table, without collecting it.

Alternating large-star and small-star rounds (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014): each vertex links its larger
neighbours, then its smaller ones, to the least vertex it knows.  Stars are
built by grouped minima and joins, so a vertex with a huge neighbourhood costs
a partial aggregate, never a gathered list, and its edges are dealt over tasks.  Every round is written to the
shared folder; a lost executor re-reads, never replays, earlier rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchyard.llm import _common as C


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    linked = C.spread_join(both, least.select("a", "m"), "a", "b", counts=least.select("a", "n"))
    least = least.select("a", "m")
    if large:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(vertex, component) for every vertex of ``edges`` (a, b); the component is its least vertex.

    Self-loops and repeated edges are allowed; vertices without another vertex
    in their component are absent from the result.  Raises if ``max_rounds``
    alternations (far beyond the logarithmic need) do not converge.
    """
    edges = C.materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if edges.isEmpty():
        return edges.toDF("vertex", "component")
    before = None
    for _ in range(max_rounds):
        now = C.materialize(_star(_star(edges, True), False), "edges")
        # a fixed point is a forest of stars: same edges before and after
        mark = tuple(now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        edges = now
        if mark == before:
            return edges.select(F.col("a").alias("vertex"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
        before = mark
    raise RuntimeError("connected components did not converge")
