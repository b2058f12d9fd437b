"""Token counts: additive rollups kept up to date by signed deltas.

A batch holds changes: inserts (an after image), deletes (a before image) and
revisions (both).  Each becomes signed rows (+1 document and its tokens, or
minus those), which are summed by source, language and tokenizer version before
they are stored, so a batch adds at most one row per group and a hot source is
absorbed by partial aggregation.  Totals are sums over committed batches.

A batch is committed by the writer's success mark in its own folder.  The same
batch id again is ignored once committed; an attempt that died before the mark
is overwritten.  A batch id belongs to one writer at a time: two that commit the
same id at once are not kept apart (both would write the same folder), so ids
must be handed out by whoever schedules the batches.

``compact`` sums all committed batches into one more, which from then on stands
for them; their ids stay known as committed.

Defined results: null source or lang is a group of its own; a null count is 0;
groups whose documents and tokens are both zero are left out of the totals; an
empty batch commits nothing but its id; a rollup without batches has no totals;
texts are counted whole, however long; of the changes' columns only op, before
and after are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.llm import _common as C
from switchyard.llm.mixing import word_count

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def signed(changes: DataFrame) -> DataFrame:
    """Signed, pre-summed deltas of changes (op, before, after).

    ``before`` and ``after`` are structs of source, lang, tokenizer, n_tokens;
    op is insert, delete or revise.
    """
    bad = F.raise_error(F.concat(F.lit("unknown op "), F.coalesce(F.col("op"), F.lit("null"))))

    def sides(gone: Column, come: Column) -> Column:
        return F.when(F.col("op") == "insert", F.array(come)).when(F.col("op") == "delete", F.array(gone)).when(F.col("op") == "revise", F.array(gone, come)).otherwise(bad)

    def side(name: str, sign: int) -> Column:
        return F.struct(*[F.col(f"{name}.{k}").alias(k) for k in KEYS], F.lit(sign).cast("long").alias("n_docs"), (F.coalesce(F.col(f"{name}.n_tokens"), F.lit(0)) * sign).cast("long").alias("n_tokens"))

    rows = changes.select(F.inline(sides(side("before", -1), side("after", 1))))
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class Rollup:
    """A rollup table at ``root``, a folder in a store all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _folder(self, batch: str) -> str:
        if not batch or "/" in batch or batch.startswith(("_", ".")):
            raise ValueError(f"bad batch id {batch!r}")
        return f"{self.root}/{batch}"

    def committed(self, batch: str) -> bool:
        return self._fs.exists(self._path(f"{self._folder(batch)}/_SUCCESS"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Store a batch of changes; False if that id was committed before."""
        if self.committed(batch):
            return False
        signed(changes).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(self._folder(batch))
        return True

    def _compactions(self) -> list[str]:
        """Complete compactions, oldest first; each holds its batches' sums and their ids."""
        home = self._path(f"{self.root}/_compact")
        if not self._fs.exists(home):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(home))
        return [n for n in names if self._fs.exists(self._path(f"{self.root}/_compact/{n}/ids/_SUCCESS"))]

    def _compacted(self) -> list[str]:
        done = self._compactions()
        return sorted(r.batch for r in self.spark.read.schema("batch string").parquet(f"{self.root}/_compact/{done[-1]}/ids").collect()) if done else []

    def batches(self) -> list[str]:
        """Ids of all committed batches."""
        if not self._fs.exists(self._path(self.root)):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)))
        return [n for n in names if n[0] not in "_." and self.committed(n)]

    def compact(self) -> None:
        """Sum the committed batches into a new compaction.  It counts once its list of ids, written last, is complete."""
        now = self.batches()
        old = self._compactions()
        to = f"{self.root}/_compact/{int(old[-1]) + 1 if old else 0:08d}"
        self._rows().groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).write.mode("overwrite").parquet(f"{to}/sums")
        self.spark.createDataFrame([(b,) for b in now], "batch string").coalesce(1).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{to}/ids")  # one name per batch

    def _rows(self) -> DataFrame:
        """The newest compaction and the batches it does not hold."""
        done, held = self._compactions(), set(self._compacted())
        folders = [self._folder(b) for b in self.batches() if b not in held] + [f"{self.root}/_compact/{d}/sums" for d in done[-1:]]
        return self.spark.read.schema(SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], SCHEMA)

    def totals(self) -> DataFrame:
        sums = self._rows().groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through four batches: inserts under two tokenizers, the same batch again,
    every word count revised to a newer version, and the deletion of exact copies."""
    docs = C.table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = C.materialize(
        docs.select(
            "doc_id",
            "source",
            "lang",
            word_count(F.col("text")).alias("words"),
            F.regexp_count(text, F.lit(r"[A-Za-z0-9]+|[^\x00-\x7F]+")).cast("long").alias("runs"),
            F.ceil(F.octet_length(text) / F.lit(4.0)).cast("long").alias("quads"),
            F.sha2(text.cast("binary"), 256).alias("digest"),
        ),
        "counts",
    )

    def image(tokenizer: str, count: str) -> Column:
        return F.struct("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.col(count).alias("n_tokens"))

    nothing = F.lit(None).cast("struct<source:string,lang:string,tokenizer:string,n_tokens:bigint>")

    def changes(rows: DataFrame, op: str, images) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(op).alias("op"), b.alias("before"), a.alias("after")) for b, a in images])).alias("c")
        return rows.select(each).select("c.*")

    words1, words2, quads = image("words-v1", "words"), image("words-v2", "runs"), image("quads-v1", "quads")
    first = counted.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = C.spread_join(counted, first, "digest", "doc_id").where("doc_id > first")  # one text may be that of very many rows
    rollup = Rollup(spark, C.new_path(spark, "rollup"))
    inserts = changes(counted, "insert", [(nothing, words1), (nothing, quads)])
    rollup.commit("batch-1", inserts)
    rollup.commit("batch-1", inserts)  # a replay changes nothing
    rollup.commit("batch-2", changes(counted, "revise", [(words1, words2)]))
    rollup.commit("batch-3", changes(copies, "delete", [(words2, nothing), (quads, nothing)]))
    return rollup.totals()


OP3_SQL = r"""
with counted as (
  select doc_id, source, lang, coalesce(text, '') as t,
         len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[^\x00-\x7F]+')) as runs,
         ceil(strlen(coalesce(text, '')) / 4.0) as quads
  from documents
), kept as (
  select * from (select *, min(doc_id) over (partition by t) as first from counted) where doc_id is null or first is null or doc_id <= first
), each as (
  select source, lang, 'words-v2' as tokenizer, runs::bigint as n from kept
  union all select source, lang, 'quads-v1', quads::bigint from kept
)
select source, lang, tokenizer, count(*)::bigint as n_docs, sum(n)::bigint as n_tokens from each group by all
"""
