"""Documents to packed training windows: language ID, quality, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept,
and its result is written as Parquet and read again as the next one's ``docs``.
All but the last return the columns of ``documents``, and further columns of any
name with them. In every stage a null text counts as empty, texts of any length are
read whole, a null doc_id keeps its row, and an empty table gives an empty table;
what each makes of empty, tied and repeated rows is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stipple.llm import langid, packing, quality, simhash
from stipple.llm.learn import fold
from stipple.llm.store import cut, drop, made, small_batches, table

#: Small, since the packing stage runs in workers that the other stages have used.
CACHE_WORDS = 120_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that have no letter (null, empty and blank texts among them) or no recognisable language.

    Each row is judged by its own text, so repeated rows stay or go together; a null
    lang is no label. Without any labelled row no language is known and all go.
    """
    small_batches(spark)
    train = docs.select("doc_id", "text", "lang").where(~F.coalesce(fold("doc_id", 4) == 2, F.lit(False)))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
    found = rows.select("_row", langid.language(langid.fit(train), F.col("text")).alias("_lang"))
    return found.where("_lang.known").select("_row.*")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are more likely of low quality than not.

    Null sources and languages are sites of their own; a posterior of just one half
    stays; repeated rows stay or go together, and each counts in its site. Without
    labels of both kinds all stay.
    """
    small_batches(spark)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text", "source", "lang")
    found = quality.assess(rows, table(spark, sf_dir, "labels"), without=("doc_id", "text", "source", "lang"))
    return found.where("keep").select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group: five-word shingles, a likeness of 0.8 or more.

    Of likes the smallest doc_id stays, null ids last; of rows that repeat id and text
    one stays, and so does one of all empty and blank texts.
    """
    small_batches(spark)
    return simhash.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left, one row per piece with its ids.

    An empty text is its end id alone; repeated rows are packed each by itself; other
    columns than doc_id and text are not read.
    """
    small_batches(spark)
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), cache_words=CACHE_WORDS)


STAGES = [
    ("language_id", identify_language),
    ("quality", keep_good),
    ("simhash", drop_near_duplicates),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage made on its way, and the table before it, goes when its own table is written."""
    docs, before = table(spark, sf_dir, "documents"), len(made(spark))
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop(spark, made(spark)[before:-1])
    return docs
