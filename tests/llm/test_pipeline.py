"""Stages, SQL and brute force on the smallest tables."""

import os
import zlib

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from switchyard.llm import _common as C
from switchyard.llm import mixing, near_copies, simhash
from switchyard.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_registered():
    assert set(QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.execute(ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda v: None if pd.isna(v) else float(v) if isinstance(v, int | float) else v
    rows = lambda df: sorted(str([plain(v) for v in r]) for r in df[columns].astype(object).itertuples(index=False, name=None))
    assert rows(got) == rows(want)


def test_stages(spark):
    docs = C.table(spark, SF, "documents")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        after = C.materialize(stage(spark, before, SF), name)
        ids = {r.doc_id for r in before.select("doc_id").collect()}
        kept = {r.doc_id for r in after.select("doc_id").collect()}
        assert kept <= ids and kept
        if name == "packing":
            assert kept == ids
        else:
            assert after.columns == columns
        if name == "simhash_near_dedup":
            members = {r.doc_id: r.component_id for r in simhash.near_duplicates(before).collect()}
            assert kept <= set(members.values()) and after.count() == len(kept)
            assert kept == {r.doc_id for r in near_copies.keep_first(before.where(F.col("doc_id").isin(list(set(members.values()))))).collect()}
        if name == "mixing":
            plan = {r.doc_id: r.repeats for r in mixing.mix(before).collect()}
            counts = {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()}
            assert counts == {i: n for i, n in plan.items() if n}
        before = after


COLUMNS = {
    "op1_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op3_token_counts": "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint",
    "op4_media": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op5_licenses": "doc_id bigint, template_id int, license string",
    "op6_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op7_embedding_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op8_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op9_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op11_prefix_trie": "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string",
    "op12_conversation_repair": "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string",
    "op13_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
}
FOLDS = {"op1_quality": (4, 2), "op2_language_id": (4, 2), "op9_toxicity": (3, 1)}


def _odd_tables(spark, folder):
    """The smallest tables with odd rows added and columns whose names clash, and the same tables empty."""
    read = lambda n: spark.read.parquet(f"{SF}/{n}.parquet")
    docs = read("documents")
    like = docs.limit(1).withColumn("lang", F.lit(None).cast("string"))
    texts = [(9001, None), (9002, ""), (9003, " \t\n"), (9004, "!!! 12"), (9005, "a"), (9006, "word " * 40_000), (9007, "again and again"), (9007, "again and again"), (9007, "something else"), (None, "without an id")]
    odd = spark.createDataFrame(texts, "i long, t string").crossJoin(like).withColumn("doc_id", F.col("i")).withColumn("text", F.col("t")).select(*docs.columns)
    odd = odd.withColumn("source", F.when(F.col("doc_id") % 2 == 0, F.col("source")))
    clash = lambda df: df.select("*", *[F.lit(7).alias(c) for c in ("score", "fp", "size", "_key", "_n", "h", "repeats", "component")])
    vectors = read("embeddings")
    first = vectors.limit(1)
    bad = first.withColumn("vec_id", F.lit(9001).cast("long")).withColumn("embedding", F.lit(None).cast("array<float>")).unionByName(first.withColumn("vec_id", F.lit(9002).cast("long")).withColumn("label", F.lit(None).cast(vectors.schema["label"].dataType))).unionByName(first)
    tables = {"documents": clash(docs.unionByName(odd)), "embeddings": clash(vectors.unionByName(bad)), "labels": clash(read("labels").unionByName(read("labels").limit(2)).unionByName(read("labels").limit(1).withColumn("doc_id", F.lit(None).cast("long"))))}
    said = read("conversations")
    turns = [(9001, 1, None, None), (9001, None, "user", "Hello."), (9001, None, "user", "Hello."), (9002, 3, "", ""), (9003, -5, "tool", "word " * 40_000), (None, 1, "user", "No id.")]
    tables["conversations"] = clash(said.unionByName(spark.createDataFrame(turns, said.schema)))
    for n, df in tables.items():
        df.write.parquet(f"{folder}/odd/{n}.parquet")
        read(n).limit(0).write.parquet(f"{folder}/empty/{n}.parquet")
    return f"{folder}/odd", f"{folder}/empty"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return _odd_tables(spark, str(tmp_path_factory.mktemp("tables")))


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_entry(spark, odd, name):
    """Columns and types of every query, one row a document where that is asked, on odd rows and on nothing."""
    tables, nothing = odd
    want = [tuple(c.split()) for c in COLUMNS[name].split(", ")]
    none = QUERIES[name](spark, nothing)
    assert none.dtypes[: len(want)] == want or dict(none.dtypes).items() >= dict(want).items()
    assert none.count() == 0
    out = QUERIES[name](spark, tables)
    assert dict(out.dtypes).items() >= dict(want).items()
    got = out.toPandas()
    if name in ("op11_prefix_trie", "op12_conversation_repair"):
        convs = {r.conv_id for r in C.table(spark, tables, "conversations").select("conv_id").distinct().collect()}
        ids = {None if i != i else int(i) for i in got.conv_id.astype(float)}
        if name == "op12_conversation_repair":
            assert ids == convs and len(got) == len(convs)
        else:
            assert ids <= convs - {None} and got[got.depth == 0].n_convs.tolist() == [len(convs) - 1]
        return
    table = "embeddings" if name == "op7_embedding_dedup" else "documents"
    key = got.columns[0] if name != "op3_token_counts" else None
    rows = C.table(spark, tables, table)
    if name not in ("op3_token_counts", "op5_licenses", "op8_packing"):
        assert len(got) == rows.count()
    elif name == "op8_packing":
        assert len(got.query("piece == 0")) == rows.count() and (got.groupby("sequence_id").length.sum() <= 2048).all()
    if name in FOLDS:
        parts, held = FOLDS[name]
        told = got.dropna(subset=[key])
        assert (told.held_out == [zlib.crc32(str(int(i)).encode()) % parts == held for i in told[key]]).all() and got.score.between(0, 1).all()
        if "predicted" in got:
            assert (got.predicted == (got.score >= 0.7).astype(int)).all()
        else:
            assert set(got[got.doc_id.isin([9001, 9002, 9003, 9004])].lang_pred) == {"und"}
    if name == "op6_simhash":
        assert (got.fingerprint.str.fullmatch("[0-9a-f]{16}")).all() and got[got.doc_id.isin([9001, 9002, 9003])].component_id.nunique() == 1


def test_pipeline_on_odd_rows_and_on_nothing(spark, odd):
    tables, nothing = odd
    assert corpus_pipeline.run(spark, nothing).count() == 0
    docs = C.table(spark, tables, "documents")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = C.materialize(stage(spark, before, tables), f"odd-{name}")
        if name != "packing":
            assert after.columns == docs.columns
        if name == "simhash_near_dedup":
            again = after.where("doc_id = 9007").count()
            assert again == before.where("doc_id = 9007").select("text").distinct().count()
        before = after
    assert before.count() > 0
