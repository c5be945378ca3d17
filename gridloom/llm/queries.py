"""The thin opN_ queries over the input tables, and their SQL."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, license_scan, minhash, mixing, nn_descent, pii, quality_knn, quality_rules, toxicity, warc
from .common import table


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=2)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(warc.resolve_revisits(warc.page_records(table(spark, sf_dir, "pages"))))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_knn.score_quality(docs, quality_knn.labelled_rows(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(mod=5, rest=0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def vocabulary_path() -> str:
    """The vocabulary file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_digests(encoded: DataFrame) -> DataFrame:
    """Counts and digests of encoded documents."""
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return encoded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary_path()))


def toxicity_scores(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Scores of ``docs`` by models of the labelled documents table."""
    counted, calibration = toxicity.training_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, counted, calibration)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity_scores(spark, table(spark, sf_dir, "documents"), sf_dir)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_rules.score_quality(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


def pii_key(spark: SparkSession) -> str:
    """The secret of the surrogates: the session's ``spark.gridloom.pii.key``.

    Without one each call draws a secret of its own, so nobody can tell what
    stands behind its surrogates, and other calls give other ones.
    """
    return spark.conf.get("spark.gridloom.pii.key", None) or secrets.token_hex(32)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))


def op10_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_minhash, op2_warc, op3_mixing, op4_quality_knn, op5_bpe, op6_toxicity, op7_license_scan, op8_quality_rules, op9_pii, op10_nn_descent)}

ORACLE_SQL: dict[str, str] = {"op1_minhash": minhash.oracle_sql(2, 80, 100), "op2_warc": warc.ORACLE_SQL, "op7_license_scan": license_scan.ORACLE_SQL}
