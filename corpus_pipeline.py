"""The corpus pipeline: documents -> clean -> good -> distinct -> mixed -> packed sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame over all rows
its predecessor kept; ``run`` writes each as Parquet and reads it again.

Defined results: a null text is an empty one to every stage, and scored as such;
a row without doc_id passes the near-duplicate stage, as it can't be told from
others, and is packed under a null id; rows that repeat a doc_id with other texts
are documents of their own, equal rows are one after the near-duplicate stage;
ties go to the least doc_id; very long texts are scored, compared and packed
whole; an empty table gives an empty result; without labels of both classes a
filter keeps all rows or none, as the one class says (none labelled: nothing is
toxic, nothing is good).  Columns beyond those of ``documents``, whatever their
names, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from switchyard.llm import _common as C
from switchyard.llm import mixing, near_copies, packing, quality, simhash, toxicity


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored toxic go."""
    return toxicity.keep_clean(docs, C.table(spark, sf_dir, "labels"))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored below the quality threshold go."""
    return quality.keep_good(docs, C.table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group stays; of those, rows at five-word Jaccard 0.8 to a lesser one go.

    Fingerprints of 64 bits can't carry the second rule: texts at Jaccard 0.8
    differ in about ten bits, where pigeonhole blocks no longer select.  So they
    settle exact copies and the closest ones, and shingles the rest.
    """
    one = C.materialize(simhash.keep_one(docs), "one-each")
    return near_copies.keep_first(one)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeat as often as their source's target asks."""
    return mixing.repeat_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2,048 tokens, each with its sequence and place.

    Python workers still hold what earlier stages left them, so the word cache
    is smaller than the operator's default.
    """
    return packing.pack(docs, cache_words=250_000)


STAGES = [
    ("toxicity", toxicity_filter),
    ("quality", quality_filter),
    ("simhash_near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained scores and tokenizer ids can't be expressed in SQL; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
