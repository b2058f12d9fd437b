"""Toxicity: subword-bag embeddings averaged into a linear softmax.

Bucket vectors of character n-grams and the softmax are trained jointly, so an
unseen misspelling shares most of its n-gram vectors with the word it bends.
The fit uses a bounded sample of labelled rows (``per_class``, ``total``
rows, ``max_chars`` characters a class), reweighted to the true class shares and
then part of the way back (``balance``).  The model is fitted on four fifths of it
and its temperature set on the last.  Settings were compared by cross-validation
among the training rows.  Scoring covers every whole text.

Defined results: null and empty texts, and texts without letters, score as the
model's bias (the clean prior); without labelled rows of both classes every
score is the share of label 1 (0 if there is none); an id with several labels
counts as toxic if one of them is; repeated rows score alike; rows of equal hash
enter the sample by doc_id; an empty table
gives an empty result; extra columns, whatever their names, are never read and
``keep_clean`` passes them through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.llm import _common as C
from switchyard.llm.subword import SubwordModel, WordRows

THRESHOLD = 0.7


def fit(docs: DataFrame, labels: DataFrame, column: str, parts: int, held: int, per_class: int = 2000, total: int = 4000, max_chars: int = 15_000_000, balance: float = 0.5, **model) -> SubwordModel:
    """Fit on labelled documents outside the held-out fold.

    A class's loss is scaled by its share to the power ``-balance``: 0 keeps the
    true shares, 1 gives both classes the same say.
    """
    labelled = labels.select("doc_id", F.col(column).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~C.fold(F.col("doc_id"), parts, held))
    labelled = labelled.groupBy("doc_id").agg(F.max("y").alias("y"))
    labelled = labelled.join(docs.select("doc_id"), "doc_id", "left_semi")
    texts, classes, y, weights = C.training_set(docs, labelled, per_class, total, max_chars)
    if len(classes) < 2:
        share = float(classes[0]) if classes else 0.0
        flat = SubwordModel([0, 1], **model)
        flat.bias = np.log(np.array([1 - share, share]) + 1e-9)
        flat.folded = np.zeros((1 << flat.bits, 2), np.float32)
        return flat
    weights = weights * (np.bincount(y, weights) / weights.sum())[y] ** -balance
    weights /= weights.mean()
    order = np.random.default_rng(11).permutation(len(texts))
    cut = max(1, len(texts) // 5)
    tune, train = order[:cut], order[cut:]
    fitted = SubwordModel(classes, **model)
    bags = fitted.bags([texts[i] for i in train])
    fitted.learn(bags, np.arange(len(train)), y[train], weights[train])
    fitted.calibrate(fitted.logits((texts[i] for i in tune), WordRows(fitted.rows, 50_000)), y[tune], weights[tune])
    del bags, texts
    C.give_back()
    return fitted


def scorer(spark: SparkSession, model: SubwordModel):
    """An iterator pandas UDF: text -> probability of label 1."""
    shared = spark.sparkContext.broadcast(model)  # 2^bits x 2 floats: fixed size

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        cache = WordRows(m.rows)
        for texts in batches:
            yield pd.Series(m.proba(m.logits(texts, cache))[:, 1], dtype="float64")
        del cache
        C.give_back()  # the worker lives on

    return score


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **fit_args) -> DataFrame:
    """``docs`` without the rows scored toxic at ``threshold`` or above; columns unchanged."""
    score = scorer(docs.sparkSession, fit(docs, labels, "toxic", 3, 1, **fit_args))
    return docs.where(score(F.col("text")) < threshold)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    score = scorer(spark, fit(docs, C.table(spark, sf_dir, "labels"), "toxic", 3, 1))
    return docs.select("doc_id", C.fold(F.col("doc_id"), 3, 1).alias("held_out"), score("text").alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
