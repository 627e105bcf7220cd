import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline


def test_stages_keep_columns_and_good_documents(spark, tmp_path):
    src = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{src}/documents.parquet").withColumn("more", F.lit(1))
    names = docs.columns
    left = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, src)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 3:
            assert docs.columns == names
            left.append(docs.count())
    assert left[0] >= left[1] > left[2] > left[3] > 0.6 * left[0]
    assert docs.where("length <= 0 or length > 1024").count() == 0


def test_unknown_languages_go(spark):
    src = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{src}/documents.parquet")
    rng = np.random.default_rng(0)
    letters = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz     "), 400)) for _ in range(10)]
    clean = docs.where("lang <> 'de'")
    other = docs.where("lang = 'de' and length(text) > 300").withColumn("lang", F.lit(None).cast("string"))
    noise = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(letters)], "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("x"), "n_chars": F.lit(400).cast("long")})
    out = corpus_pipeline.identify_language(spark, clean.unionByName(other).unionByName(noise.select(docs.columns)), src).cache()
    assert other.count() > 10 and out.where("doc_id >= 1000000000").count() == 0
    assert out.where("lang is null").count() < 0.1 * other.count() and out.where("lang is not null").count() > 0.98 * clean.count()


def test_empty_table_passes_through(spark):
    src = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{src}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, src)
        assert out.count() == 0


def test_stages_take_odd_rows_and_clashing_columns(spark):
    src = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{src}/documents.parquet").limit(150)
    names = ("_lang", "_row", "_id", "_hash", "_text", "keep", "evidence", "score", "id", "component", "none")
    clash = {c: F.lit(k) for k, c in enumerate(names)}
    long = "plain words of a long text " * 3000
    odd = [(None, None), (None, None), (-1, ""), (-2, " \n"), (-3, long), (-3, long), (-4, "12 34"), (-5, "same words here and there"), (-5, "same words here and there")]
    more = spark.createDataFrame([(i, t, None, None, 0) for i, t in odd], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(more.select(*[F.col(c).cast(t).alias(c) for c, t in docs.dtypes])).withColumns(clash)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, src).cache()
        if name == "packing":
            assert out.groupBy("doc_id", "start").count().where("doc_id = -4").count() >= 1 and out.where("length < 1").count() == 0
            continue
        assert out.columns == docs.columns
        assert all(tuple(r[c] for c in names) == tuple(range(len(names))) for r in out.limit(20).collect())
        if name == "language_id":
            assert out.where("text is null or trim(text) = '' or doc_id = -4").count() == 0
        if name == "simhash":
            assert out.where("doc_id in (-3)").count() == 1 and out.where("doc_id = -5").count() == 1
            assert out.where("trim(coalesce(text, '')) rlike '^\\\\s*$'").count() == 1


def test_run_leaves_one_table(spark):
    from pathlib import Path

    from stipple.llm.store import made, shared_dir

    there = lambda: {p.name for p in Path(shared_dir(spark).removeprefix("file://")).glob("stipple-*")}
    before, n = there(), len(made(spark))
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100 and len(there() - before) == 1 == len(made(spark)) - n
