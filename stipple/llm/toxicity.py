"""Toxicity by non-negative positive-unlabelled learning.

Features are the words of the whole text and their beginnings of 4 to 6 letters,
by presence. Of these, those are kept that confirmed toxic documents hold more
often than the harmless part of unlabelled text, beyond chance; on them a linear model is trained with the
class-prior-corrected risk estimator of ``learn.non_negative_pu``. Text without a
confirmed label, labelled harmless or not, is unlabelled text. Both samples are
bounded (``POSITIVES``, ``UNLABELLED`` different documents), chosen by a hash of id
and text; equal texts in a sample count once.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .learn import bounded_sample, fold, hashed, non_negative_pu, sigmoid
from .store import table

POSITIVES, UNLABELLED, KEPT = 3000, 6000, 2000
PRIOR = 0.1  # where nothing tells the share of toxic documents
_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 300_000


def word_features(word: str) -> list[int]:
    """Hashes of a word and of its beginnings of 4 to 6 letters (32 bits)."""
    return [zlib.crc32(f"={word}".encode())] + [zlib.crc32(word[:n].encode()) for n in (4, 5, 6) if len(word) >= n]


def doc_features(text: str | None) -> np.ndarray:
    words = set(_WORD.findall((text or "").lower()))
    return np.unique(np.fromiter(chain.from_iterable(map(word_features, words)), np.uint32))


class Model:
    """Weights of the kept features and the bias."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.at = {int(f): k for k, f in enumerate(features)}
        self.weights, self.bias = weights, bias
        self.cache: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    def _of(self, word: str) -> tuple[int, ...]:
        out = self.cache.get(word)
        if out is None:
            if len(self.cache) >= _CACHE:
                self.cache.clear()
            out = self.cache[word] = tuple(self.at[f] for f in word_features(word) if f in self.at)
        return out

    def score(self, text: str | None) -> float:
        hits = set(chain.from_iterable(map(self._of, set(_WORD.findall((text or "").lower())))))
        return float(sigmoid(self.bias + self.weights[sorted(hits)].sum())) if hits else float(sigmoid(self.bias))


def _vectors(docs: DataFrame, bound: int, source: DataFrame | None = None) -> list[np.ndarray]:
    """Features of at most ``bound`` different documents (doc_id, text, hashed), those of equal texts once; ``source`` as for ``bounded_sample``."""
    @F.pandas_udf("binary")
    def vector(text: pd.Series) -> pd.Series:
        return text.map(lambda t: doc_features(t).astype("<u4").tobytes())

    rows = bounded_sample(docs, bound, [F.xxhash64("text").alias("h"), vector("text").alias("x")], source).collect()
    return [np.frombuffer(x, "<u4") for x in {r["h"]: r["x"] for r in sorted(rows, key=lambda r: r["h"])}.values()]


def fit(confirmed: DataFrame, unlabelled: DataFrame, prior: float | None, positives: int = POSITIVES, others: int = UNLABELLED) -> Model:
    """``confirmed`` toxic and ``unlabelled`` documents, as ``learn.hashed`` by id and text; ``prior``: the share of toxic ones among the unlabelled.

    ``positives`` and ``others`` bound how many different documents, by id and text, of
    each kind are learned from. Confirmed documents are among the unlabelled ones.
    """
    pos, unl = _vectors(confirmed, positives, unlabelled), _vectors(unlabelled, others)
    prior = min(max(prior if prior is not None else PRIOR, 1e-3), 0.5)
    if not pos or not unl:
        return Model(np.empty(0, np.uint32), np.empty(0), float(np.log(prior / (1 - prior))))
    f, n = np.unique(np.concatenate(pos), return_counts=True)
    g, m = np.unique(np.concatenate(unl), return_counts=True)
    at = np.minimum(np.searchsorted(g, f), len(g) - 1)
    there = np.where(g[at] == f, m[at], 0)
    p, u = n / len(pos), (there + 1.0) / (len(unl) + 2.0)
    # the unlabelled hold a share ``prior`` of toxic documents, whose features are not held against them
    clean = np.clip((u - prior * p) / (1 - prior), 1 / (len(unl) + 2.0), 1.0)
    stray = (u * (1 - u) / len(unl) + prior**2 * p * (1 - p) / len(pos)) / (1 - prior) ** 2
    z = (p - clean) / np.sqrt(clean * (1 - clean) / len(pos) + stray + 1e-12)
    good = np.flatnonzero((n >= 3) & (z >= 5))
    good = good[np.argsort(-z[good], kind="stable")][:KEPT]
    kept = np.sort(f[good])

    def matrix(docs: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(docs), len(kept)), np.float32)
        for k, d in enumerate(docs):
            out[k, np.flatnonzero(np.isin(kept, d))] = 1
        return out

    w = non_negative_pu(matrix(pos), matrix(unl), prior)
    return Model(kept, w[:-1], float(w[-1]))


def toxicity(model: Model, text: Column) -> Column:
    """Probability of being toxic, 0 to 1; null counts as empty."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(model.score, na_action=None).astype("float64")

    return score(F.coalesce(text.cast("string"), F.lit("")))


def score_documents(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """``docs`` with held_out, score and predicted; labels (doc_id, toxic) of held-out rows are not looked at.

    Several labels of one id count as toxic if any does; null labels are none. Every
    row comes back once, empty and null texts too; without confirmed rows all get the
    prior. An empty table gives an empty table.
    """
    kept = labels.where(F.col("toxic").isNotNull() & ~F.coalesce(held_out, F.lit(False)))
    marks = kept.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    toxic = marks.where("toxic = 1").select("doc_id")
    rows = hashed(docs.select("doc_id", "text"), ["doc_id", "text"], "toxicity").where(~F.coalesce(held_out, F.lit(False)))
    # of the labelled texts, each once, as the samples hold them
    texts = rows.select("doc_id", F.xxhash64("text").alias("h")).join(marks, "doc_id").groupBy("h").agg(F.max("toxic").alias("toxic"))
    share = texts.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    model = fit(rows.join(toxic, "doc_id", "left_semi"), rows, share)
    return docs.withColumn("held_out", F.coalesce(held_out, F.lit(False))).withColumn("score", toxicity(model, F.col("text"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of all of ``documents``, learned from ``labels`` outside fold 0 of 5."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return score_documents(docs, labels, fold("doc_id", 5) == 0).select("doc_id", "held_out", "score", "predicted")
