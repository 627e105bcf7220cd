"""How filters interact: what each keeps, removes and repeats in every order, from one count of failure masks.

A row's mask has one bit for each filter that it fails. Rows are counted once for
each part and mask. The zeta transform over subsets turns the counts of a part into
the survivors of every set of filters (those whose mask is within the complement);
a step of an order is then the difference of two neighbouring sets, for all rows
as for those with a label, and a filter's sum over all orders weighs each
neighbouring pair by the number of orders that pass through it.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import dealt_left_join
from .store import cut, table

LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
_CAPITALS = bytes(range(65, 91))
_MARKS = b"#$%&*|"


def subset_sums(values: list[Column]) -> list[Column]:
    """Zeta transform: entry T of the result is the sum of the entries m of ``values`` with m a subset of T, one bit at a time."""
    out, bit = list(values), 1
    while bit < len(out):
        out = [v + out[m ^ bit] if m & bit else v for m, v in enumerate(out)]
        bit *= 2
    return out


def audit(rows: DataFrame, filters: str, labels: list[str]) -> DataFrame:
    """(part, mask, n, ``labels``) to one row for each part, order of ``filters`` and step.

    ``mask``: bit i is set where filter i fails; ``n`` counts rows and each of
    ``labels`` those of them that have it, and a part's mask may come in several rows.
    Out come part, filter_order, step (from 1), kept, removed, redundant (failing this
    filter but gone before it), unique_fails (failing this filter alone), ``X_lost`` for
    each label X, and shapley (what the filter removes, summed over all orders). All
    orders of k filters are k! k rows a part, so k is small. No rows give no rows.
    """
    k = len(filters)
    whole = (1 << k) - 1
    counts = ["n", *labels]
    few = rows.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in counts])
    wide = few.groupBy("part").agg(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)).alias(f"{c}_{m}") for c in counts for m in range(whole + 1)])
    below = {c: subset_sums([F.col(f"{c}_{m}") for m in range(whole + 1)]) for c in counts}
    wide = wide.select("part", F.array(*[F.col(f"n_{1 << i}") for i in range(k)]).alias("alone"), *[F.array(*[below[c][whole ^ s] for s in range(whole + 1)]).alias(f"left_{c}") for c in counts])
    left = lambda c, s: F.get(f"left_{c}", s)
    through = [factorial(s.bit_count()) * factorial(k - 1 - s.bit_count()) if s < whole else 0 for s in range(whole + 1)]
    share = [sum(((left("n", F.lit(s)) - left("n", F.lit(s | 1 << i))) * through[s] for s in range(whole + 1) if not s >> i & 1), F.lit(0)) for i in range(k)]
    steps = []
    for order in permutations(range(k)):
        before = 0
        for at, i in enumerate(order):
            steps.append({"o": "".join(filters[j] for j in order), "t": at + 1, "i": i, "b": before, "a": before | 1 << i})
            before |= 1 << i
    every = F.from_json(F.lit(json.dumps(steps)), "array<struct<o string, t int, i int, b int, a int>>")
    each = wide.withColumn("share", F.array(*share)).withColumn("s", F.explode(every))
    removed = left("n", F.col("s.b")) - left("n", F.col("s.a"))
    failing = left("n", F.lit(0)) - left("n", F.element_at(F.array(*[F.lit(1 << i) for i in range(k)]), F.col("s.i") + 1))
    return each.select(
        "part", F.col("s.o").alias("filter_order"), F.col("s.t").alias("step"), left("n", F.col("s.a")).alias("kept"), removed.alias("removed"), (failing - removed).alias("redundant"),
        F.get("alone", F.col("s.i")).alias("unique_fails"), *[(left(c, F.col("s.b")) - left(c, F.col("s.a"))).alias(f"{c}_lost") for c in labels], F.get("share", F.col("s.i")).alias("shapley"),
    )


def text_mask(text: str) -> int:
    """Bits 0 to 3: too few words, too few distinct ones, too many capitals, a mark."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # at ASCII white space, as in the rule
    short = len(words) < LEAST_WORDS
    dull = 100 * len(set(words)) < DISTINCT_PERCENT * len(words)
    loud = 100 * (len(raw) - len(raw.translate(None, _CAPITALS))) > CAPITAL_PERCENT * len(text)
    marked = len(raw) != len(raw.translate(None, _MARKS))
    return short | dull << 1 | loud << 2 | marked << 3


def document_masks(docs: DataFrame, labels: DataFrame, part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic) of documents under five filters: the four of ``text_mask`` and copies of a smaller id's text.

    A copy is a row whose whole text equals that of some row with a smaller doc_id,
    whatever became of that row (texts are compared by SHA-256); rows without an id are
    neither smaller nor copies, and of rows that share id and text none is the other's
    copy. Null texts are empty, a null part is the empty string. ``good`` and ``toxic``
    count rows whose id has a label row with quality 1 or toxic 1; a repeated id gives
    its labels to each of its rows. Texts of any length are read whole, once; an empty
    table gives an empty table; other columns are not read.
    """

    @F.pandas_udf("int")
    def mask(texts: pd.Series) -> pd.Series:
        return texts.map(text_mask).astype("int32")

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    seen = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), mask(text).alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")), "audit-masks")
    again = seen.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    full = dealt_left_join(seen, again, ["digest"], F.col("doc_id")).select("doc_id", "part", F.when(F.col("doc_id") > F.col("first"), F.col("mask") + 16).otherwise(F.col("mask")).alias("mask"))
    # rows of one id, or of none, come down to one for each part and mask before they meet their labels
    counted = full.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("g"), F.max((F.col("toxic") == 1).cast("int")).alias("t")).where("g = 1 or t = 1")
    share = lambda c: (F.coalesce(c, F.lit(0)) * F.col("n")).alias("good" if c == "g" else "toxic")
    return counted.join(marks, "doc_id", "left").select("part", "mask", "n", share("g"), share("t"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 120 orders of five filters over all of ``documents``, by source."""
    masks = document_masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit(masks, "ABCDE", ["good", "toxic"])


OP11_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
words AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
lab AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1),
fails AS (SELECT part, doc_id, ['A', 'B', 'C', 'D', 'E'] AS f, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text),
  regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS b FROM words),
seen AS (SELECT part, [f[i] FOR i IN range(1, 6) IF b[i]] AS bad, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM fails LEFT JOIN lab USING (doc_id)),
few AS (SELECT part, bad, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS t FROM seen GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, CAST(s AS INTEGER) AS s, string_split(o[1:s - 1], '') AS before, o[s] AS f FROM orders, (SELECT unnest(range(1, 6)) AS s)),
out AS (SELECT part, o AS filter_order, s AS step, any_value(f) AS f,
  coalesce(sum(n) FILTER (NOT list_has_any(bad, before) AND NOT list_contains(bad, f)), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT list_has_any(bad, before) AND list_contains(bad, f)), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (list_has_any(bad, before) AND list_contains(bad, f)), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (bad = [f]), 0)::BIGINT AS unique_fails,
  coalesce(sum(g) FILTER (NOT list_has_any(bad, before) AND list_contains(bad, f)), 0)::BIGINT AS good_lost, coalesce(sum(t) FILTER (NOT list_has_any(bad, before) AND list_contains(bad, f)), 0)::BIGINT AS toxic_lost
  FROM few, steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM out
"""
