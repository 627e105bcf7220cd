"""Quality rules judged by host.

Each text is measured once. A document fails the base rule by itself, if it is too
short or repeats itself too much. Every further rule is judged by host: failures are
added up by host, a beta prior for the rate of each rule is fitted to all hosts by
moments, each host's rate is shrunk towards it, and a host that fails a rule more
often than not, all but surely, is rejected with all its documents. So a host of few
documents is not rejected for one bad page, and a large one not for its share of junk.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import dealt_left_join
from .store import cut, table

LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: A host goes where the rate of a rule is above this by ``SURE`` deviations of its posterior.
REJECT_RATE, SURE = 0.5, 2.0
_SYMBOLS, _BLANKS = "#*$%&|<>", "\t\n\x0b\x0c\r "
_FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    at = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    if len(ids) == len(words):
        return 0
    n = len(ids)
    two = at[:-1] * n + at[1:]
    if n >= 1 << 20:  # three digits in base n would not fit, a pair's number and one more do
        two = np.unique(two, return_inverse=True)[1]
    _, where, count = np.unique(two[:-1] * n + at[2:], return_inverse=True, return_counts=True)
    begins = np.flatnonzero(count[where] > 1)
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[begins + k] = True
    return int(inside.sum())


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; null has none of any."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # at ASCII white space
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return len(words), len(text) - sum(map(text.count, _BLANKS)), sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``m`` of the measures of each whole text."""

    @F.pandas_udf(_FIELDS)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([measure(t) for t in texts], columns=[f.split()[0] for f in _FIELDS.split(", ")])

    return docs.withColumn("m", of(F.col(text_col).cast("string")))


def base_failed(m: str = "m") -> Column:
    return (F.col(f"{m}.n_words") < LEAST_WORDS) | (100 * F.col(f"{m}.n_repeat_words") > MOST_REPEATED_PERCENT * F.col(f"{m}.n_words"))


def rules(m: str = "m") -> dict[str, Column]:
    """The rules that hosts are judged by; each is true where a document fails."""
    n = F.greatest(F.col(f"{m}.n_words"), F.lit(1))
    chars = F.col(f"{m}.word_chars")
    return {
        "base": base_failed(m),
        "word_length": (chars < 3 * n) | (chars > 12 * n),
        "symbols": 10 * F.col(f"{m}.n_symbols") > n,
        "lines": 10 * F.col(f"{m}.n_dup_lines") > n,
    }


def host_rates(rows: DataFrame, names: list[str]) -> DataFrame:
    """(host, ``names`` as booleans) to (host, n_docs, X_rate and X_sure for each rule X).

    The prior of a rule is beta(s p, s (1 - p)) with p the mean rate of the hosts and s
    from the spread of their rates beyond that of chance; X_rate is a host's posterior
    mean and X_sure its distance above ``REJECT_RATE`` in posterior deviations. Rows of a
    host are added up before any exchange; the driver gets one row of totals.
    """
    counts = cut(rows.groupBy("host").agg(F.count("*").alias("n_docs"), *[F.count_if(F.col(c)).alias(c) for c in names]), "host-counts")
    rate = lambda c: F.col(c) / F.col("n_docs")
    means = counts.agg(F.count("*").alias("k"), F.avg(1.0 / F.col("n_docs")).alias("thin"), *[f(rate(c)).alias(f"{c}_{a}") for c in names for a, f in (("mean", F.avg), ("var", F.var_samp))]).first()
    out = {}
    for c in names:
        p = min(max(means[f"{c}_mean"] or 0.0, 1e-4), 1 - 1e-4)
        noise = p * (1 - p) * (means["thin"] or 0.0)
        spread = max((means[f"{c}_var"] or 0.0) - noise, 1e-6)
        s = min(max(p * (1 - p) / spread - 1, 1.0), 1e4)
        mean = (F.col(c) + s * p) / (F.col("n_docs") + s)
        out[f"{c}_rate"] = mean
        out[f"{c}_sure"] = (mean - REJECT_RATE) / F.sqrt(mean * (1 - mean) / (F.col("n_docs") + s + 1))
    return counts.select("host", "n_docs", *[v.alias(k) for k, v in out.items()])


def judge(docs: DataFrame, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rejected, kept), one row for each row of ``docs``.

    kept: the base rule holds and the host is not rejected. A null host is a host of its
    own, a null text has no words; repeated rows count each; texts of any length are read
    whole. An empty table gives an empty table. Other columns are not read.
    """
    host = F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit(""))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), host.alias("host"), F.col(text_col).alias("text"))
    seen = cut(measured(narrow).drop("text"), "host-measures")
    names = list(rules())
    hosts = host_rates(seen.select("host", *[v.alias(k) for k, v in rules().items()]), names)
    bad = hosts.where(reduce(Column.__or__, [F.col(f"{c}_sure") > SURE for c in names])).select("host", F.lit(True).alias("bad"))
    out = dealt_left_join(seen, bad, ["host"], F.col("doc_id")).withColumns({"base_failed": base_failed(), "host_rejected": F.coalesce("bad", F.lit(False))})
    return out.select("doc_id", F.when(F.col("host") != "", F.substring("host", 2, 1 << 30)).alias("host"), "m.*", "base_failed", "host_rejected", (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"))


def op13_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures and verdicts of all of ``documents``, with source as host."""
    return judge(table(spark, sf_dir, "documents")).drop("host")


_RULES_SQL = {"base": "n_words < 50 OR 100 * n_repeat_words > 50 * n_words", "word_length": "word_chars NOT BETWEEN 3 * greatest(n_words, 1) AND 12 * greatest(n_words, 1)", "symbols": "10 * n_symbols > greatest(n_words, 1)", "lines": "10 * n_dup_lines > greatest(n_words, 1)"}
OP13_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS pos FROM docs),
tri AS (SELECT k, pos, w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY k ORDER BY pos)),
twice AS (SELECT k, pos FROM tri WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY k, a, b, c) > 1),
again AS (SELECT k, count(DISTINCT pos + d) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS d) GROUP BY 1),
lines AS (SELECT k, count(*) - count(DISTINCT l) AS n FROM (SELECT k, unnest(string_split(text, chr(10))) AS l FROM docs) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
m AS (SELECT docs.k, doc_id, coalesce('=' || source, '') AS host, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(again.n, 0)::BIGINT AS n_repeat_words
  FROM docs LEFT JOIN lines USING (k) LEFT JOIN again USING (k)),
rates AS (SELECT host, count(*) AS n, {", ".join(f"count(*) FILTER ({v}) AS {k}" for k, v in _RULES_SQL.items())} FROM m GROUP BY 1),
flat AS (UNPIVOT rates ON {", ".join(_RULES_SQL)} INTO NAME rule VALUE f),
prior AS (SELECT rule, least(greatest(avg(f / n), 1e-4), 1 - 1e-4) AS p, avg(1 / n) AS thin, coalesce(var_samp(f / n), 0) AS v FROM flat GROUP BY 1),
fit AS (SELECT rule, p, least(greatest(p * (1 - p) / greatest(v - p * (1 - p) * thin, 1e-6) - 1, 1.0), 1e4) AS s FROM prior),
post AS (SELECT host, (f + s * p) / (n + s) AS r, n + s + 1 AS size FROM flat JOIN fit USING (rule)),
bad AS (SELECT host FROM post GROUP BY 1 HAVING max((r - {REJECT_RATE}) / sqrt(r * (1 - r) / size)) > {SURE})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({_RULES_SQL["base"]}) AS base_failed, host IN (SELECT host FROM bad) AS host_rejected,
  NOT ({_RULES_SQL["base"]}) AND host NOT IN (SELECT host FROM bad) AS kept FROM m
"""
