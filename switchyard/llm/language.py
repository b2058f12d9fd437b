"""Language ID: averaged hashed subword embeddings with a linear softmax.

Trained by stochastic gradient descent in numpy on a bounded sample with equal
room for each language (``per_class``, ``total`` rows, ``max_chars`` characters
a language; with more than ``total`` languages the largest are learned).  A fifth of
the sample sets the temperature and the rejection level: the lowest
probability at or above which at least ``precision`` of the tuning rows are
right.  Rejection is reported in ``accepted``; ``lang_pred`` always names the
likeliest learned language, and is ``und`` only for texts that are null or hold
no letter (score 0).

Defined results: with no labelled row every text is ``und``; repeated rows
agree; an id with several languages is learned as the least; an empty table gives
an empty result; of equally likely languages the least name is taken; texts
count whole, however long; extra columns, whatever their names, are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.llm import _common as C
from switchyard.llm.subword import SubwordModel, WordRows

LETTER = re.compile(r"[^\W\d_]")  # also numerals such as ² and Ⅷ, which has_letter sorts out

def has_letter(text: str | None) -> bool:
    """Whether any character is a letter (Unicode L*); digits of any kind and numerals are not."""
    return bool(text) and any(m.group().isalpha() for m in LETTER.finditer(text))


@dataclass
class LanguageModel:
    model: SubwordModel | None
    reject_below: float = 0.5


def fit(docs: DataFrame, parts: int = 4, held: int = 2, per_class: int = 1500, total: int = 6000, max_chars: int = 8_000_000, precision: float = 0.99, **model) -> LanguageModel:
    labelled = docs.where(F.col("lang").isNotNull() & ~C.fold(F.col("doc_id"), parts, held)).select("doc_id", F.col("lang").alias("y"))
    texts, classes, y, weights = C.training_set(docs, labelled, per_class, total, max_chars)
    if not classes:
        return LanguageModel(None)
    order = np.random.default_rng(13).permutation(len(texts))
    cut = len(texts) // 5
    tune, train = order[:cut], order[cut:]
    args = {"sizes": (1, 2, 3), "bits": 16, "dim": 16, "epochs": 4, "steps": 400, "rate": 0.5, "smooth": 100.0, "min_docs": 1, "shrink": 0.0} | model
    fitted = SubwordModel(classes, **args).fit([texts[i] for i in train], y[train], weights[train])
    if not cut:
        return LanguageModel(fitted)
    z = fitted.logits((texts[i] for i in tune), WordRows(fitted.rows, 50_000))
    fitted.calibrate(z, y[tune], weights[tune])
    p = fitted.proba(z)
    top, right = p.max(1), p.argmax(1) == y[tune]
    down = np.argsort(-top, kind="stable")
    good = np.cumsum(right[down]) / np.arange(1, cut + 1) >= precision
    return LanguageModel(fitted, float(top[down][np.nonzero(good)[0][-1]]) if good.any() else 1.0)


def detector(spark: SparkSession, fitted: LanguageModel):
    """An iterator pandas UDF: text -> (lang_pred, score, accepted)."""
    shared = spark.sparkContext.broadcast(fitted)  # 2^16 x languages floats

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def detect(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value.model
        cache = WordRows(m.rows) if m else None
        for texts in batches:
            if m is None:
                yield pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": 0.0, "accepted": False})
                continue
            p = m.proba(m.logits(texts, cache))
            known = np.array([has_letter(t) for t in texts], dtype=bool)
            top = np.where(known, p.max(1), 0.0)
            yield pd.DataFrame({"lang_pred": np.where(known, np.array(m.classes, dtype=object)[p.argmax(1)], "und"), "score": top, "accepted": known & (top >= shared.value.reject_below)})

    return detect


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    detect = detector(spark, fit(docs))
    return docs.select("doc_id", C.fold(F.col("doc_id"), 4, 2).alias("held_out"), detect("text").alias("d")).select("doc_id", "held_out", "d.lang_pred", "d.score", "d.accepted")
