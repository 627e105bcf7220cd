"""Document quality by hierarchical empirical Bayes.

A logistic classifier turns shape features of the whole text into evidence, a
log-likelihood ratio. Its soft counts, summed for each host and for each path of
a host, give posteriors: a path's mean is shrunk towards its host's and a host's
towards the mean of all, by a strength that is estimated from how much sites
differ beyond the spread of soft counts within them. A document's posterior adds
its evidence to the log odds of its path, from which its own contribution is taken
out first. Texts are read once for evidence, which is written before sites are added up.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .learn import bounded_sample, hashed, logistic, sigmoid
from .store import cut, table

LABELLED = 20000
REJECT_BELOW = 0.5
_MARKS = b"!#$%&*|+=<>{}[]\\^~@_"
_EPS = 1e-6


def features(text: str | None) -> list[float]:
    """Shares of marks, digits, capitals, blanks, repeated and distinct words, word and line lengths."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(len(raw), 1)
    words = text.split()
    m = max(len(words), 1)
    upper = sum(map(str.isupper, words)) / m
    marks = [raw.count(c) for c in _MARKS]
    same = sum(a == b for a, b in zip(words, words[1:], strict=False)) / m
    lines = text.split("\n")
    distinct = len(set(words))
    return [
        *[np.sqrt(x / m) for x in marks], np.sqrt(sum(marks) / m), upper, same, distinct / m, np.log1p(m / max(distinct, 1)), np.log1p(m),
        len(text) / m, sum(map(text.count, "0123456789")) / n, text.count(",") / m, text.count(".") / m, m / len(lines), len(set(lines)) / len(lines), float(not words),
    ]


class Classifier:
    """Standardised features and a ridge logistic regression; ``evidence`` leaves the base rate of the labels out."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.base = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        self.mean = x.mean(axis=0) if len(x) else 0.0
        self.sd = np.maximum(x.std(axis=0), 1e-3) if len(x) else 1.0
        both = len(y) and 0 < y.sum() < len(y)
        self.w = logistic(self._scaled(x), y, 1.0) if both else None

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.sd, -8, 8)

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        if self.w is None or not len(texts):
            return np.zeros(len(texts))
        x = self._scaled(np.array([features(t) for t in texts], dtype=np.float64))
        return np.clip(x @ self.w[:-1] + self.w[-1], -20, 20) - np.log(self.base / (1 - self.base))


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Classifier:
    """From at most ``labelled`` different labelled documents by id and text, chosen by a hash of them; several labels of an id: the lowest counts.

    Ids are thinned first, then their documents, so an id that many rows share sends no
    more of them to the driver than others do; documents without an id have no label.
    """
    marks = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    some = bounded_sample(hashed(marks, ["doc_id"], "quality"), labelled, ["doc_id", "_quality"])

    @F.pandas_udf("array<double>")
    def shape(texts: pd.Series) -> pd.Series:
        return texts.map(features, na_action=None)

    met = hashed(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), ["doc_id", "text"], "quality-rows").join(some, "doc_id")
    rows = bounded_sample(met, labelled, [shape("text").alias("x"), "_quality"]).toPandas()
    x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(len(rows), len(features("")))
    return Classifier(x, rows["_quality"].to_numpy(dtype=np.float64))


def evidence(model: Classifier, text: Column) -> Column:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.evidence(texts.tolist()))

    return score(F.coalesce(text.cast("string"), F.lit("")))


def _strength(groups: DataFrame, n: str, mean: str, parent: str, within: float) -> float:
    """Pseudo-count of a Beta prior by moments: how much group means differ beyond the noise ``within`` groups."""
    m = F.col(parent)
    row = groups.where(F.col(n) >= 2).agg(
        F.sum(F.col(n) * (F.col(mean) - m) ** 2).alias("between"), F.count("*").alias("k"), F.sum(n).alias("n"), F.avg(m * (1 - m)).alias("whole"), F.sum(F.col(n) ** 2).alias("n2")
    ).first()
    if not row["k"] or row["k"] < 2 or not row["whole"]:
        return 10.0
    spread = (row["between"] - row["k"] * within) / max(row["n"] - row["n2"] / row["n"], 1.0)
    return float(np.clip(row["whole"] / max(spread, 1e-6) - 1, 1.0, 1e4))


def site_posteriors(soft: DataFrame) -> DataFrame:
    """(_host, _path, _p) to one row for each path: n, s (sum of _p), host_mean, path_mean, path_strength."""
    paths = cut(soft.groupBy("_host", "_path").agg(F.count("*").alias("n"), F.sum("_p").alias("s"), F.sum(F.col("_p") * F.col("_p")).alias("q")), "quality-paths")
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("within"), F.sum(F.col("n") - 1).alias("free")).first()
    top = (total["s"] / total["n"]) if total["n"] else 0.5
    within = max(total["within"], 0.0) / total["free"] if total["free"] else 0.0
    hosts = cut(hosts.withColumn("m", F.col("hs") / F.col("hn")).withColumn("top", F.lit(float(top))), "quality-hosts")
    strength = _strength(hosts, "hn", "m", "top", within)
    hosts = hosts.select("_host", ((F.col("hs") + strength * top) / (F.col("hn") + strength)).alias("host_mean"))
    joined = cut(paths.drop("q").join(hosts, "_host").withColumn("m", F.col("s") / F.col("n")), "quality-sites")
    inner = _strength(joined, "n", "m", "host_mean", within)
    return cut(joined.select("_host", "_path", "n", "s", "host_mean", ((F.col("s") + inner * F.col("host_mean")) / (F.col("n") + inner)).alias("path_mean"), F.lit(inner).alias("path_strength")), "quality-posteriors")


def assess(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", without: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with evidence, host_mean, path_mean, posterior and keep.

    ``path_col`` names a section of a host. Null hosts and paths are sites of their
    own; null texts count as empty. keep: the posterior is ``REJECT_BELOW`` or more.
    Without labels of both kinds the evidence is 0 and all is kept. Every row comes
    back once, repeated ones too; texts of any length are read whole; an empty table
    gives an empty table. Columns of these names in ``docs`` are replaced. ``without``:
    columns that the result need not have, such as the text.
    """
    model = fit(docs, labels)
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    prob = lambda e: 1 / (1 + F.exp(-(e + F.lit(float(np.log(model.base / (1 - model.base)))))))
    marked = docs.withColumns({"_host": name(host_col), "_path": name(path_col), "evidence": evidence(model, F.col("text"))}).withColumn("_p", prob(F.col("evidence")))
    marked = cut(marked.drop(*without), "quality-evidence")
    sites = site_posteriors(marked.select("_host", "_path", "_p"))
    others = (F.col("_s") - F.col("_p") + F.col("_strength") * F.col("host_mean")) / (F.col("_n") - 1 + F.col("_strength"))
    odds = F.least(F.greatest(others, F.lit(_EPS)), F.lit(1 - _EPS))
    out = marked.drop("host_mean", "path_mean").join(sites.select("_host", "_path", F.col("n").alias("_n"), F.col("s").alias("_s"), "host_mean", "path_mean", F.col("path_strength").alias("_strength")), ["_host", "_path"], "left")
    posterior = 1 / (1 + F.exp(-(F.col("evidence") + F.log(odds / (1 - odds)))))
    return out.withColumn("posterior", posterior).withColumn("keep", F.col("posterior") >= REJECT_BELOW).drop("_host", "_path", "_p", "_n", "_s", "_strength")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of all of ``documents`` with source as host and language as section."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    out = assess(docs, table(spark, sf_dir, "labels"), without=("text", "source", "lang"))
    return out.select("doc_id", "evidence", "host_mean", "path_mean", "posterior", "keep")
