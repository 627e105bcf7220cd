"""Language identification in two steps: the family, then one-versus-one support vector machines within it.

Features are hashed byte 1-, 2- and 3-grams of the lower-cased whole text, with
all ASCII characters that are no letters as blanks; square roots of the counts,
scaled to unit length. Families are found from the data: languages are merged by
the likeness of their mean features until about the square root of their number
is left. Everything is fitted on a bounded sample (``PER_LANG`` documents for a
language, ``MAX_DOCS`` in all, ``MAX_LANGS`` languages), chosen by a hash of id and text.

The machines always name one of the learned languages. Whether a text is in it at
all is told by its mean log likelihood under the mean feature shares of that
language, with a floor set on the learned rows.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .learn import fold, hashed, linear_svm, platt, share_of, sigmoid
from .store import table

DIM = 4096
PER_LANG = 600
MAX_DOCS = 6000
MAX_LANGS = 200
EVEN = 0.05  # weight of even shares, for features that a language has not shown
_BLANK = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_LETTER = re.compile(r"[^\W\d_]")
_RUNS = re.compile(rb" +")


def has_letter(text: str | None) -> bool:
    if not text or not (m := _LETTER.search(text)):
        return False
    return m[0].isalpha() or any(map(str.isalpha, text))


def _bytes(text: str) -> bytes:
    return _RUNS.sub(b" ", b" " + text.lower().encode("utf-8", "surrogatepass").translate(_BLANK) + b" ")


def features(text: str) -> np.ndarray:
    raw = _bytes(text)
    counts = np.zeros(DIM)
    for at in range(0, len(raw), 1 << 20):  # long texts in blocks that overlap by two bytes
        b = np.frombuffer(raw[at : at + (1 << 20) + 2], np.uint8).astype(np.uint32)
        two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA6B)
        three = two[:-1] * np.uint32(0x27D4EB2F) + b[2:] * np.uint32(0x165667B1)
        for h in (b[: 1 << 20] * np.uint32(0xC2B2AE35), two[: 1 << 20], three[: 1 << 20]):
            counts += np.bincount(h >> np.uint32(20), minlength=DIM)
    counts = np.sqrt(counts)
    return (counts / max(np.linalg.norm(counts), 1e-9)).astype(np.float32)


class Model:
    """``langs`` sorted; ``families`` lists of their positions."""

    def __init__(self, x: np.ndarray, lang: np.ndarray) -> None:
        self.langs = sorted(set(lang))
        y = np.array([self.langs.index(v) for v in lang], dtype=int) if len(lang) else np.empty(0, int)
        mean = np.array([x[y == k].mean(axis=0) for k in range(len(self.langs))])
        self.families = [[k] for k in range(len(self.langs))]
        if len(self.langs):
            mean = mean - mean.mean(axis=0)
            unit = mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9)
            like = unit @ unit.T
            while len(self.families) > max(1, round(np.sqrt(len(self.langs)))):
                a, b = max(combinations(range(len(self.families)), 2), key=lambda p: like[np.ix_(self.families[p[0]], self.families[p[1]])].mean())
                self.families[a] += self.families.pop(b)
        of = {k: f for f, ks in enumerate(self.families) for k in ks}
        fam = np.array([of[k] for k in y], dtype=int)
        self.rows: list[np.ndarray] = []
        self.scale: list[tuple[float, float]] = []
        self.first = [self._fit(x, np.where(fam == f, 1.0, -1.0)) if len(self.families) > 1 else None for f in range(len(self.families))]
        self.pairs = {
            (i, j): self._fit(x[(y == i) | (y == j)], np.where(y[(y == i) | (y == j)] == i, 1.0, -1.0))
            for ks in self.families for i, j in combinations(sorted(ks), 2)
        }
        self.w = np.array(self.rows, dtype=np.float32).reshape(len(self.rows), DIM + 1)
        self.rows = []
        self._learn_floors(x, y)

    def _learn_floors(self, x: np.ndarray, y: np.ndarray) -> None:
        """For each language the log shares of the features, their spread, and the least mean log likelihood of a long text in it.

        The likelihood of a learned row is taken without its own part in the shares. The
        floor is two thirds of the way from their median to the nearest other language or
        to 0.6 of the way to even shares, whichever is nearer, but not above all but 1 in
        200 of the learned rows. A language of one learned row has no floor.
        """
        even = lambda share: np.log((share + EVEN / DIM) / (1 + EVEN))
        share = np.array([(x[y == k] ** 2).mean(axis=0) for k in range(len(self.langs))], dtype=np.float64).reshape(-1, DIM)
        self.log_share = even(share).astype(np.float32)
        self.spread = np.sqrt(np.maximum((share * self.log_share**2).sum(axis=1) - (share * self.log_share).sum(axis=1) ** 2, 0))
        level = share @ self.log_share.T.astype(np.float64)  # of the rows' language under the columns'
        self.floor = np.full(len(self.langs), -np.inf)
        for k in range(len(self.langs)):
            at = np.flatnonzero(y == k)
            if len(at) < 2:
                continue
            p = [x[i].astype(np.float64) ** 2 for i in at]
            own = np.array([v @ even(np.maximum(share[k] * len(at) - v, 0) / (len(at) - 1)) for v in p])
            middle = np.median(own)
            gap = min([0.6 * (middle - self.log_share[k].mean()), *(middle - np.delete(level[:, k], k))])
            self.floor[k] = min(middle - 2 / 3 * max(gap, 0), np.quantile(own, 0.005))

    def _fit(self, x: np.ndarray, y: np.ndarray) -> int:
        w = linear_svm(x, y.astype(np.float32))
        self.rows.append(w)
        self.scale.append(platt(x @ w[:-1] + w[-1], y))
        return len(self.rows) - 1

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.recognise(text)[:2]

    def recognise(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, and whether the text is in that language rather than in none that was learned."""
        if not self.langs or not has_letter(text):
            return "und", 0.0, False
        x = features(text)
        z = self.w[:, :-1] @ x + self.w[:, -1] if len(self.w) else np.empty(0)
        prob = lambda k: float(sigmoid(self.scale[k][0] * z[k] + self.scale[k][1]))
        fams = np.array([1.0 if k is None else prob(k) for k in self.first])
        fams /= max(fams.sum(), 1e-12)
        f = int(fams.argmax())
        within = {k: 0.0 for k in self.families[f]}
        votes = dict(within)
        for i, j in combinations(sorted(self.families[f]), 2):
            p = prob(self.pairs[i, j])
            within[i] += p
            within[j] += 1 - p
            votes[i if p >= 0.5 else j] += 1
        best = max(sorted(within), key=lambda k: (votes[k], within[k]))
        share = within[best] / (len(within) - 1) if len(within) > 1 else 1.0
        short = self.floor[best] - float((x * x) @ self.log_share[best])
        # the mean over a short text strays by the spread over the root of its length
        known = short <= 0 or short <= 2 * self.spread[best] / np.sqrt(len(_bytes(text)))
        return self.langs[best], float(fams[f] * share), bool(known)


def fit(docs: DataFrame, per_lang: int = PER_LANG, max_docs: int = MAX_DOCS, max_langs: int = MAX_LANGS) -> Model:
    """``docs`` (doc_id, text, lang): rows without a language or a letter are left out.

    At most ``max_docs`` labelled rows reach the driver: the same number for each of the
    ``max_langs`` most frequent languages, ``per_lang`` at most, of its different rows by id
    and text, so neither rows that share an id nor repeated ones are taken or left as a
    whole. A pair of languages within a family has a machine of its own, so languages are
    to be few.
    """
    known = docs.where("lang is not null and text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text", F.col("lang").cast("string").alias("lang"))
    known = hashed(known, ["id", "text"], "langid")
    count = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("_g", 0.02).alias("n")).orderBy(F.col("n").desc(), "lang").limit(max_langs).collect()}
    bound = max(1, min(per_lang, max_docs // max(1, len(count))))
    share = F.create_map(*[F.lit(v) for lang, n in count.items() for v in (lang, share_of(bound, n))]) if count else F.create_map().cast("map<string,int>")

    @F.pandas_udf(T.BinaryType())
    def vector(text: pd.Series) -> pd.Series:
        return text.map(lambda t: features(t).astype(np.float16).tobytes())

    lettered = F.pandas_udf(lambda text: text.map(has_letter).astype(bool), T.BooleanType())
    some = known.where(F.col("_h") < share[F.col("lang")]).dropDuplicates(["lang", "_h", "_g"]).where(lettered("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_h", "_g"))
    some = some.withColumn("k", place).where(F.col("k") <= bound).select("lang", "_h", "k", vector("text").alias("x")).toPandas()
    some = some.sort_values(["_h", "lang", "k"])
    x = np.array([np.frombuffer(v, np.float16) for v in some["x"]], dtype=np.float32).reshape(len(some), DIM)
    return Model(x, some["lang"].to_numpy())


def language(model: Model, text: Column) -> Column:
    """struct(lang, score, known) of a text; lang is ``und`` and score 0 for texts that are null or have no letter.

    ``known`` is false for these and for texts that are unlike the learned rows of lang.
    """

    @F.pandas_udf("lang string, score double, known boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.recognise(t) for t in texts], columns=["lang", "score", "known"])

    return predict(text.cast("string"))


def identify(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score from a model fitted on ``train``.

    Every row comes back once with all its columns, repeated rows and those without an
    id too, but for columns of these two names, which are replaced; without training
    rows all are ``und``. An empty table gives an empty table.
    """
    model = fit(train)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]).alias("_row"), language(model, F.col(text_col)).alias("_lang"))
    return rows.select("_row.*", F.col("_lang.lang").alias("lang_pred"), F.col("_lang.score").alias("score"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all of ``documents``, learned from those outside fold 2 of 4."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", fold("doc_id", 4) == 2)
    train = docs.where(~F.coalesce("held_out", F.lit(False)))
    return identify(docs.drop("lang"), train).select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "lang_pred", "score")
