"""Mixing sources to target weights: capped water-filling, then seeded repetition.

1. Sizes: words per document, summed per source (partial aggregates first, so a
   hot source is never gathered).
2. Water-filling over one row per source: the free sources share what is left
   in proportion to their weights; any source above ``max_epochs`` times its
   size is clamped there; repeat until none is above.  Each round is one small
   distributed aggregate; only its three sums reach the driver.
3. Repetition: a source's target / size gives whole repetitions of every
   document and a fraction.  The fraction is met by one further repetition of
   those documents that come first in a seeded hash order, up to the fraction
   of the source's words.  The order hashes doc_id and text, so rows without an
   id, or of one id, spread like others; only equal rows share a place in it.  It is cut in two steps: word counts of 4,096
   hash bins per source locate the bin that holds the cut, and only that bin's
   documents are ordered.  So no source is ever sorted or gathered whole, and
   each source's words land within half a document of its target.

Defined results: a null text has size 0 and takes 0; null sources form one
source, ranked last; an empty table gives an empty result; a source without
words has target 0.  Rows that repeat a doc_id with other texts are documents of
their own; equal rows count each on its own in ``mix`` and are emitted together
in ``repeat_documents``, as often as they take in all; ties in the order are
equal rows.  Texts count whole, however long.  Other columns, whatever their
names, pass through ``repeat_documents`` and are not read by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from switchyard.llm import _common as C

SEED = "mix-1"
CYCLE = (1, 2, 3)
MAX_EPOCHS = 3


def word_count(text: Column) -> Column:
    """Number of runs of bytes other than space and tab to carriage return."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def cycle_weights(sources: DataFrame, cycle=CYCLE) -> DataFrame:
    """Adds ``weight``: the cycle dealt over sources by code point, null last.

    Ranks come from range partitions with per-partition offsets, so no task
    sorts all sources.
    """
    spark = sources.sparkSession
    sources = sources.repartitionByRange(F.col("source").asc_nulls_last())
    placed = C.materialize(sources.withColumn("_part", F.spark_partition_id()), "sources")
    counts = sorted((r._part, r["count"]) for r in placed.groupBy("_part").count().collect())  # one row per partition
    offsets, at = [], 0
    for part, n in counts:
        offsets.append((part, at))
        at += n
    local = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last()))
    offset = spark.createDataFrame(offsets, "_part int, _at long")
    ranked = placed.join(F.broadcast(offset), "_part").withColumn("_rank", F.col("_at") + local - 1)
    return ranked.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in cycle]), (F.col("_rank") % len(cycle) + 1).cast("int")).cast("long")).drop("_part", "_at", "_rank")


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` to rows of (source, source_size, weight)."""
    state = sources.withColumn("_cap", F.col("source_size") * max_epochs).withColumn("_clamped", F.col("source_size") == 0)
    state = C.materialize(state, "mix")
    total = state.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t")).first().t
    while True:
        s = state.agg(
            F.coalesce(F.sum(F.when(F.col("_clamped"), F.col("_cap"))), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~F.col("_clamped"), F.col("weight"))), F.lit(0)).alias("free"),
        ).first()
        left, free = int(total - s.held), int(s.free)
        # exact: cap < left * weight / free, without a division
        above = ~F.col("_clamped") & (F.col("_cap").cast("decimal(38,0)") * free < F.col("weight").cast("decimal(38,0)") * left)
        if not free or not state.where(above).limit(1).count():
            break
        state = C.materialize(state.withColumn("_clamped", F.col("_clamped") | above), "mix")
    share = (F.col("weight") * F.lit(left)).cast("double") / F.lit(float(free or 1))
    return state.withColumn("target", F.when(F.col("_clamped"), F.col("_cap").cast("double")).otherwise(share)).drop("_cap", "_clamped")


def _place(seed: str) -> Column:
    """A document's place in the seeded order."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.md5(F.concat(F.lit(f"{seed}|"), said("doc_id"), F.lit("|"), said("text")).cast("binary"))


def mix(docs: DataFrame, weights: DataFrame | None = None, max_epochs: int = MAX_EPOCHS, cycle=CYCLE, seed: str = SEED) -> DataFrame:
    """Per row of (doc_id, source, text): doc_id, source, size, source_size, target, repeats.

    ``weights`` optionally gives (source, weight) instead of the cycle.
    """
    return _planned(docs, weights, max_epochs, cycle, seed).drop("_h")


def _planned(docs: DataFrame, weights: DataFrame | None, max_epochs: int, cycle, seed: str) -> DataFrame:
    """``mix`` with ``_h``, each document's place."""
    sized = C.materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _place(seed).alias("_h")), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    if weights is None:
        sources = cycle_weights(sources, cycle)
    else:
        w = weights.select(F.col("source").alias("_ws"), F.col("weight").cast("long"))
        sources = sources.join(w, F.col("source").eqNullSafe(F.col("_ws")), "left").drop("_ws").fillna(0, ["weight"])
    targets = water_fill(sources, max_epochs)
    ratio = F.col("target") / F.greatest(F.col("source_size"), F.lit(1))
    targets = targets.withColumn("_whole", F.floor(ratio)).withColumn("_twice", 2 * (F.col("target") - F.col("_whole") * F.col("source_size")))
    bins = sized.groupBy("source", F.substring("_h", 1, 3).alias("_bin")).agg(F.sum("size").alias("_n"))
    ends = bins.withColumn("_end", F.sum("_n").over(Window.partitionBy("source").orderBy("_bin")))
    t = targets.withColumnRenamed("source", "_s")
    # state of every bin (at most 4,096 a source): all of it again, none, or the cut inside
    cut = ends.join(t, F.col("source").eqNullSafe(F.col("_s"))).select(
        F.col("source").alias("_s"),
        F.col("_bin").alias("_b"),
        "source_size",
        "target",
        "_whole",
        "_twice",
        (F.col("_end") - F.col("_n")).alias("_before"),
        F.when(2 * F.col("_end") <= F.col("_twice"), 1).when(2 * (F.col("_end") - F.col("_n")) > F.col("_twice"), 0).otherwise(-1).alias("_state"),
    )
    rows = sized.withColumn("_bin", F.substring("_h", 1, 3)).join(cut, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bin") == F.col("_b"))).drop("_s", "_b")
    settled = rows.where("_state >= 0").withColumn("_more", F.col("_state"))
    order = Window.partitionBy("source", "_bin").orderBy("_h", "size").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.col("_before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    split = rows.where("_state < 0").withColumn("_more", (2 * upto + F.col("size") <= F.col("_twice")).cast("int"))
    return settled.unionByName(split).select("_h", "doc_id", "source", "size", "source_size", "target", F.least(F.col("_whole") + F.col("_more"), F.lit(max_epochs)).cast("int").alias("repeats"))


def repeat_documents(docs: DataFrame, weights: DataFrame | None = None, max_epochs: int = MAX_EPOCHS, cycle=CYCLE, seed: str = SEED) -> DataFrame:
    """``docs`` with every row as often as the mix takes it; columns unchanged.

    Rows equal in id, source and text share a place: each comes as often as the
    least of them takes, and one of them makes up what they take beyond that.
    """
    h, s, least, more, k = C.unused(docs, "_place", "_source", "_least", "_more", "_k")
    plan = _planned(docs, weights, max_epochs, cycle, seed).groupBy("_h", "source").agg(F.min("repeats").alias("r"), (F.sum("repeats") - F.min("repeats") * F.count("*")).alias("m")).where("r > 0 or m > 0")
    plan = C.materialize(plan.toDF(h, s, least, more), "plan")
    own = F.col(h) == _place(seed)
    met = docs.join(plan, own & F.col("source").eqNullSafe(F.col(s)))
    each = met.where(F.col(least) > 0).withColumn(k, F.explode(F.sequence(F.lit(1), F.col(least)))).select(*docs.columns)
    extra = docs.join(plan.where(F.col(more) > 0), own & F.col("source").eqNullSafe(F.col(s)))
    one = extra.groupBy(h, s).agg(F.first(F.struct(*docs.columns, F.col(more))).alias(k))
    rest = one.select(f"{k}.*").withColumn(k, F.explode(F.sequence(F.lit(1).cast("long"), F.col(more)))).select(*docs.columns)
    return each.unionByName(rest)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("repeats") * F.col("size")).cast("long").alias("taken"))


def mixing_sql(documents: str = "documents", select: str = "doc_id, size, source_size, target, taken") -> str:
    """The same mix in DuckDB SQL: closed-form water-filling by sorted cap/weight."""
    return f"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
         md5('{SEED}|' || coalesce(doc_id::varchar, '') || '|' || coalesce(text, '')) as h
  from {documents}
), per_source as (
  select source, sum(size)::bigint as source_size from sized group by source
), weighted as (
  select *, [1, 2, 3][(row_number() over (order by source nulls last) - 1) % 3 + 1]::bigint as weight from per_source
), ordered as (
  select *, (3 * source_size)::hugeint as cap,
         coalesce(sum(3 * source_size) over w, 0)::hugeint as held,
         (sum(weight) over () - coalesce(sum(weight) over w, 0))::hugeint as free,
         (sum(source_size) over ())::hugeint as total
  from weighted
  window w as (order by source_size::double / weight, source nulls last rows between unbounded preceding and 1 preceding)
), level as (
  select arg_min(total - held, held) as remaining, arg_min(free, held) as free
  from ordered where source_size > 0 and cap * free >= weight * (total - held)
), targets as (
  select o.source, source_size,
         case when source_size = 0 or cap * l.free < weight * l.remaining then cap::double
              else (weight * l.remaining)::double / l.free::double end as target
  from ordered o cross join level l
), parts as (
  select *, floor(target / greatest(source_size, 1)) as whole from targets
), walked as (
  select s.doc_id, s.source, size, source_size, target, whole, 2 * (target - whole * source_size) as twice,
         2 * (coalesce(sum(size) over (partition by s.source order by h, size rows between unbounded preceding and 1 preceding), 0)) + size as mid
  from sized s join parts p on s.source is not distinct from p.source
)
select {select} from (
  select doc_id, source, size, source_size, target, least(whole + case when mid <= twice then 1 else 0 end, 3)::bigint as repeats,
         (least(whole + case when mid <= twice then 1 else 0 end, 3) * size)::bigint as taken
  from walked)
"""
