"""A training corpus from ``documents``: language, toxicity, near-duplicates, mixture, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is
written as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetlake.llm import langid, minhash, mixing, packing, toxicity
from facetlake.storage import shared_dir

#: A document goes when no language holds this share of its words, or when it has no word at all.
LEAST_LANGUAGE = 0.4
#: A document goes at this toxicity.
MOST_TOXIC = 0.5
#: Jaccard similarity of five-word shingles from which documents are near duplicates.
LEAST_ALIKE = 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a clear language.

    The tagger learns from the labelled rows of ``docs``. Null texts and texts without a letter have no
    language and go; without a labelled row every document goes. Ids and all other columns have no part
    in it: null ids and repeated rows stay as they came. An empty table stays empty.
    """
    tag = langid.tagger_of(spark, langid.train(docs))
    found = tag(F.col("text"))
    return docs.where((found["lang_pred"] != langid.UNKNOWN) & (found["score"] >= LEAST_LANGUAGE))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents below the toxicity bound, learned from the labels of the documents that are left.

    Null and empty texts hold no toxic word and stay, as do null ids and repeated rows; without labels
    every document stays. An empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = toxicity.scorer_of(spark, toxicity.train(docs, labels))
    return docs.where(score(F.col("text")) < MOST_TOXIC)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that a five-word Jaccard similarity of 0.8 links, the one with the smallest id.

    The SimHash trie join proposes pairs; MinHash bands add those beyond its radius; whole shingle sets
    decide. Null and blank texts are one group; null ids all stay; different texts under one id are
    documents of their own; of equal rows one stays. An empty table stays empty.
    """
    return minhash.keep_one(docs, shingle_words=5, least=LEAST_ALIKE)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them, the last of a source cut at its budget.

    Null and blank texts have no words and are in no mixture; a null source is one more source; null
    ids and repeated rows each have their share. An empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of all documents in training sequences.

    Rows without words have a piece of size 0 and no bin; null ids and repeated rows are packed each. An
    empty table gives an empty table.
    """
    return packing.pack_documents(docs)


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("mixture", mixture), ("packing", pack)]

#: The learned stages and the packing have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents`` in ``sf_dir``; each stage's result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
