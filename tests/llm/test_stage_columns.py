"""Stages of the pipeline with columns of any name beside, and samples where many rows share an id."""

import random

import pytest
from facetlake.llm import langid, toxicity
from pyspark.sql import functions as F

MORE = ("id", "label", "key", "lang2", "__id", "__row", "__hash", "row", "part", "mark", "doc_key", "n", "place", "found", "taken", "whole", "rest", "node", "text_hash")


@pytest.fixture(scope="module")
def wide(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    return docs.select("*", *[F.col("doc_id").cast("double").alias(c) if i % 2 else F.lit(f"{c}!").alias(c) for i, c in enumerate(MORE)])


@pytest.mark.parametrize("stage", ["language", "toxicity", "near_duplicates", "mixture"])
def test_a_stage_carries_columns_of_any_name(spark, sf, wide, stage):
    import corpus_pipeline

    run = dict(corpus_pipeline.STAGES)[stage]
    plain = run(spark, wide.select("doc_id", "text", "lang", "source", "n_chars"), sf).collect()
    got = run(spark, wide, sf)
    assert got.columns == wide.columns
    rows = got.collect()
    assert sorted((r.doc_id, r.text) for r in rows) == sorted((r.doc_id, r.text) for r in plain) and rows
    assert all(r["id"] == "id!" and r["label"] == float(r["doc_id"]) and r["__id"] == "__id!" and r["__row"] == float(r["doc_id"]) for r in rows)


def test_packing_ignores_other_columns(spark, sf, wide):
    import corpus_pipeline

    run = dict(corpus_pipeline.STAGES)["packing"]
    assert sorted(map(tuple, run(spark, wide, sf).select("doc_id", "size", "piece_size").collect())) == sorted(map(tuple, run(spark, wide.select("doc_id", "text"), sf).select("doc_id", "size", "piece_size").collect()))


def sentences(n, words, seed):
    rnd = random.Random(seed)
    return [" ".join(rnd.choice(words) for _ in range(20)) for _ in range(n)]


def test_rows_of_one_id_or_none_teach_languages_up_to_the_bound(spark):
    rows = [(7, t, "en") for t in sentences(900, "the cat sat under old tree".split(), 1)] + [(None, t, "de") for t in sentences(40, "der hund lief schnell nach hause".split(), 2)] + [(7, "the same again", "en")] * 300
    got = langid.training_stretches(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang", docs_per_lang=100, stretches_per_doc=1)
    n = {lang: sum(x == lang for x, _ in got) for lang in ("en", "de")}
    assert 90 <= n["en"] <= 100 and n["de"] == 40


def test_rows_of_one_id_teach_toxicity_up_to_the_bound(spark):
    rows = [(7, t) for t in sentences(400, "you are all so very stupid".split(), 3)] + [(i, t) for i, t in enumerate(sentences(30, "a quiet walk by the river".split(), 4), 100)] + [(8, "again")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit("x"))
    labels = spark.createDataFrame([(7, 1), (8, 0), *((i, 0) for i in range(100, 130))], "doc_id long, toxic int")
    got = toxicity._sample(docs, labels, "doc_id", "text", "toxic", 100).collect()
    assert sum(r.label == 1 for r in got) == 100 and sum(r.label == 0 for r in got) == 31
