"""Registered queries of the training-text operators, each over its whole table."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetlake.llm import embdedup, langid, licenses, merkle, mixing, packing, periodic, quality, simhash, sketches, tokencounts, tokenfiles, toxicity
from facetlake.storage import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(modulus: int, rest: int):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) == rest, F.lit(False))


def op1_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), docs.where(~_held_out(4, 2)), docs_per_lang=500, stretches_per_doc=6)
    return found.select("doc_id", _held_out(4, 2).alias("held_out"), "lang_pred", "score", "n_words", "n_stretches")


def op2_embedding_int8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), capacities=packing.CAPACITIES)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_dir(spark, "tokens")
    docs = _table(spark, sf_dir, "documents")
    tokenfiles.write_shards(docs, path, public_tokenizers.path("byte_bpe_50k.json"), vocabulary=50_257, end_id=2)
    return tokenfiles.read_shards(spark, path)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents")
    scores = tokencounts.train_scores(docs, tokencounts.load_pieces(public_tokenizers.path("byte_bpe_50k.tiktoken")), rounds=2)
    return tokencounts.count_tokens(docs, scores)


def op6_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "kept")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(_table(spark, sf_dir, "documents"), weights=(3.0, 1.0, 2.0), total_factor=1.5, max_epochs=2.0)
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op9_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.edited_likeness(_table(spark, sf_dir, "documents"), k=128, shingle_words=5)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    found = toxicity.score(docs.select("doc_id", "text"), docs.select("doc_id", "text"), labels.where(~_held_out(5, 0)), docs_per_class=2500)
    return found.select("doc_id", _held_out(5, 0).alias("held_out"), "score", "predicted")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    found = merkle.manifest(docs, changed=F.when(_held_out(5, 0), lower))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    found = quality.score(docs.select("doc_id", "text"), labels.where(~_held_out(3, 1)))
    return found.select("doc_id", _held_out(3, 1).alias("held_out"), "score", "predicted")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    h = F.crc32(F.col("doc_id").cast("string"))
    text = F.when(F.pmod(h, F.lit(10)) == 0, periodic.repeated_from(F.col("text"), F.floor(h / 10))).otherwise(F.col("text"))
    return periodic.digests(periodic.find_runs(docs.select("doc_id", text.alias("text")))).drop("n_words")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_language_crf, op2_embedding_int8, op3_packing, op4_token_files, op5_token_counts, op6_simhash_trie, op7_mixing, op8_licenses, op9_bottom_k, op10_toxicity, op11_merkle_manifest, op12_quality_discriminant, op13_periodic_runs)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op7_mixing": mixing.MIX_SQL, "op11_merkle_manifest": merkle.MANIFEST_SQL}
