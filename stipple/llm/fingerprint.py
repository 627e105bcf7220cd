"""Canonical exact digests of documents, with DataFrame functions only.

Canonical text: NFKC, full case folding, NFKC again, then each run of white
space as one space and none at the ends (for ASCII text that is lower-casing).
The digest is four 64-bit xxhashes of the canonical text, each seeded
differently, and its length in bytes. Documents are grouped by that digest, and
inside a group of equal digests the canonical bytes are compared: a text that
differs from the smallest one of its group gets its rank in the group behind
its digest, so fingerprints are equal exactly where canonical texts are.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .store import cut, parts, table

MAX_RANGES = 4096


def _icu(kind: str, text: Column) -> Column:
    if kind == "nfkc":
        return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), text, F.lit(True))


def canonical(text: Column) -> Column:
    """Canonical form of a non-null string."""
    folded = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(_icu("nfkc", _icu("fold", _icu("nfkc", text))))
    return F.trim(F.regexp_replace(folded, r"(?U)[\s\p{Z}]+", " "))


def digest(canon: Column) -> Column:
    """72 hex digits: four seeded xxhash64 values and the length in bytes."""
    lanes = [F.lower(F.lpad(F.hex(F.xxhash64(F.lit(seed), canon)), 16, "0")) for seed in range(4)]
    return F.concat(*lanes, F.lower(F.lpad(F.hex(F.octet_length(canon).cast("long")), 8, "0")))


def _ranges(ids: DataFrame, n: int) -> tuple[list[tuple[int, int]], int]:
    """At most ``n`` ids that cut the table into ranges of nearly equal size, rising, each with the number of ranges that it fills by itself; and that number for null ids."""
    wanted = [i / n for i in range(1, n)] + [1.0]
    row = ids.agg(F.percentile_approx("doc_id", wanted, max(10000, 8 * n)).alias("at"), F.max("doc_id").alias("top"), F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("none")).first()
    times = Counter(row["at"] or [])
    times[row["top"]] += 0
    return sorted((e, max(1, k)) for e, k in times.items() if e is not None), max(1, round(n * row["none"] / max(row["n"], 1)))


def in_ranges(docs: DataFrame) -> DataFrame:
    """(doc_id, text, r, h): the range ``r`` of each row; ranges rise as ids fall, with null ids last.

    An id that fills several ranges by itself, and null ids, are dealt over ranges of
    their own by the hash ``h`` of their texts. In the order (doc_id falling, h, text)
    no range holds rows of another between its own. Rows that repeat both are in one range.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ends, none = _ranges(rows.select("doc_id"), min(MAX_RANGES, 8 * parts(docs.sparkSession)))
    most = max([none, *(k for _, k in ends)])
    cuts = F.array(*[F.lit(e).cast("long") for e, _ in ends]) if ends else F.array().cast("array<bigint>")
    many = F.array(*[F.lit(k) for _, k in ends]) if ends else F.array().cast("array<int>")
    below = F.size(F.filter(cuts, lambda e: e < F.col("doc_id")))
    share = F.col("h").cast("double") / F.lit(2.0**64) + 0.5
    dealt = lambda k: F.least(F.floor(share * k), k - 1)
    at_end = F.col("doc_id") == F.try_element_at(cuts, F.col("below") + 1)
    within = F.when(at_end, dealt(F.try_element_at(many, F.col("below") + 1))).otherwise(F.lit(most))
    r = F.when(F.col("doc_id").isNull(), F.lit((len(ends) + 1) * (most + 1)) + dealt(F.lit(none))).otherwise((F.lit(len(ends)) - F.col("below")) * (most + 1) + within)
    return rows.withColumn("below", below).select("doc_id", "text", r.cast("int").alias("r"), "h")


def edited_text(text: Column, other: Column) -> Column:
    """The last floor(n/3) of n code points replaced by as many first ones of ``other``, or all it has."""
    tail = F.floor(F.char_length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - tail), F.substring(other, F.lit(1), tail))


def ranks_in_digest(texts: DataFrame) -> DataFrame | None:
    """(digest, canon) to (digest, canon, rank) for those distinct texts that are not the smallest of their digest; None if all digests have one text."""
    distinct = texts.select("digest", "canon").distinct()
    pairs = cut(distinct.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "digest-pairs")
    if pairs.isEmpty():
        return None
    order = W.Window.partitionBy("digest").orderBy(F.col("canon").cast("binary"))
    ranked = distinct.join(pairs, "digest", "left_semi").withColumn("rank", F.row_number().over(order) - 1)
    return cut(ranked.where("rank > 0"), "digest-ranks")


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _described(rows: DataFrame, digest, *more: str) -> DataFrame:
    """(doc_id, text, own, next_id, next_text, next) to digests, sizes and likenesses without the texts; and ``more`` columns."""
    after = F.coalesce("next_text", F.lit(""))  # null where the successor isn't known yet
    rows = rows.withColumn("edited", edited_text(F.col("text"), after)).withColumn("edited_own", digest(canonical(F.col("edited"))))
    same = lambda a, b, x, y: F.when(F.col(a) == F.col(b), (canonical(F.col(x)) == canonical(y)).cast("double")).otherwise(F.lit(0.0))
    return rows.select(
        "doc_id",
        "next_id",
        F.char_length("text").cast("long").alias("n_chars"),
        _sha(F.col("text")).alias("text_sha256"),
        _sha(F.col("next_text")).alias("next_sha256"),
        _sha(F.col("edited")).alias("edited_sha256"),
        "own",
        "edited_own",
        same("own", "edited_own", "text", F.col("edited")).alias("near_edited"),
        same("own", "next", "text", after).alias("near_next"),
        *more,
    )


def _wanted(raw: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, sha, text): one row for each of ``keys`` (doc_id, sha) that ``raw`` (doc_id, text) holds."""
    texts = raw.withColumn("sha", _sha(F.col("text"))).alias("t")
    k = keys.alias("k")
    return texts.join(k, F.col("t.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("t.sha") == F.col("k.sha")), "left_semi").dropDuplicates(["doc_id", "sha"])


def _pairs_of_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (doc_id, text_sha256, next_id, next_sha256) with text and next_text; ``texts`` has each (doc_id, sha) once."""
    a, b = texts.alias("a"), texts.alias("b")
    return (
        pairs.alias("p").join(a, F.col("p.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("p.text_sha256") == F.col("a.sha")))
        .join(b, F.col("p.next_id").eqNullSafe(F.col("b.doc_id")) & (F.col("p.next_sha256") == F.col("b.sha")))
        .select("p.*", F.col("a.text").alias("text"), F.col("b.text").alias("next_text"))
    )


def described(docs: DataFrame, digest=digest) -> DataFrame:
    """Each row with its successor in descending doc_id (after the last comes the first), as ``_described`` has it.

    Ranges are sorted each by itself; a range's last row finds its successor, the first
    row of the next range, by a second look at ``docs`` for those few texts alone (two
    for each range at most). Ties are in the order of a hash of their texts.
    """
    order = W.Window.partitionBy("r").orderBy(F.col("doc_id").desc_nulls_last(), "h", "text")
    rows = in_ranges(docs).withColumn("own", digest(canonical(F.col("text")))).withColumns({"next": F.lead(F.struct("doc_id", "text", "own")).over(order), "at": F.row_number().over(order)})
    rows = rows.select("doc_id", "text", "own", "r", "at", F.col("next.doc_id").alias("next_id"), F.col("next.text").alias("next_text"), F.col("next.own").alias("next"))
    found = cut(_described(rows, digest, "r", "at"), "fingerprints")
    last = found.where("next_sha256 is null").select("r", "doc_id", "text_sha256")
    first = found.where("at = 1").select("r", F.col("doc_id").alias("next_id"), F.col("text_sha256").alias("next_sha256"))
    ends = {r["r"]: r for r in first.collect()}  # a row for each range
    after = sorted(ends)
    turn = dict(zip(after, [*after[1:], *after[:1]], strict=True))
    spark = docs.sparkSession
    steps = spark.createDataFrame([(r, ends[n]["next_id"], ends[n]["next_sha256"]) for r, n in turn.items()], "r int, next_id long, next_sha256 string")
    tails = cut(last.join(F.broadcast(steps), "r"), "range-ends")
    keys = tails.select("doc_id", F.col("text_sha256").alias("sha")).unionAll(tails.select("next_id", "next_sha256")).distinct()
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    joined = _pairs_of_texts(tails, cut(_wanted(raw, keys), "range-texts"))
    joined = joined.select("doc_id", "text", digest(canonical(F.col("text"))).alias("own"), "next_id", "next_text", digest(canonical(F.col("next_text"))).alias("next"))
    return found.where("next_sha256 is not null").drop("r", "at").unionByName(cut(_described(joined, digest), "range-rows"))


def fingerprints(docs: DataFrame, digest=digest) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The likeness of two exact digests is 1 where the canonical texts are equal and
    0 elsewhere; where digests are equal the bytes are compared. Null texts count as
    empty; texts of any length are read whole. Repeated rows each come back. A table
    of one row is its own successor; an empty one gives an empty table; other columns
    are ignored.
    """
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    narrow = described(docs, digest)
    # Edited texts whose digest another text has, too: one of each content is built again, from the two texts it is made of.
    counts = narrow.select(F.col("own").alias("digest")).unionAll(narrow.where("near_edited = 0").select(F.col("edited_own").alias("digest"))).groupBy("digest").count()
    shared = cut(counts.where("count > 1").select("digest"), "digest-shared")
    again = narrow.where("near_edited = 0").join(shared, narrow["edited_own"] == shared["digest"], "left_semi")
    again = again.groupBy("text_sha256", "next_sha256").agg(F.min(F.struct("doc_id", "next_id")).alias("ids")).select("ids.doc_id", "text_sha256", "ids.next_id", "next_sha256")
    again = cut(again, "edited-again")
    made_of = again.select("doc_id", F.col("text_sha256").alias("sha")).unionAll(again.select("next_id", "next_sha256")).distinct()
    rebuilt = _pairs_of_texts(again, cut(_wanted(raw, cut(made_of, "edited-need")), "edited-texts"))
    every = raw.select(F.col("text").alias("raw")).unionAll(rebuilt.select(edited_text(F.col("text"), F.col("next_text")).alias("raw")))
    every = every.select("raw", canonical(F.col("raw")).alias("canon")).select("raw", "canon", digest(F.col("canon")).alias("digest"))
    ranks = ranks_in_digest(every)
    names = {"fingerprint": ("own", "text_sha256"), "edited_fingerprint": ("edited_own", "edited_sha256")}
    if ranks is None:
        named = narrow.withColumns({new: F.col(own) for new, (own, _) in names.items()})
    else:
        of = cut(every.join(ranks, ["digest", "canon"]).select("digest", _sha(F.col("raw")).alias("sha"), "rank").distinct(), "digest-ranks")
        named = narrow
        for new, (own, sha) in names.items():
            one = of.select(F.col("digest").alias(own), F.col("sha").alias(sha), F.col("rank").alias("k"))
            named = named.join(one, [own, sha], "left").withColumn(new, F.concat(F.col(own), F.when(F.col("k").isNotNull(), F.concat(F.lit("-"), F.col("k"))).otherwise(""))).drop("k")
    return named.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digests of all of ``documents`` and of their edited texts."""
    return fingerprints(table(spark, sf_dir, "documents"))
