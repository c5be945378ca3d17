"""The corpus pipeline: documents in, token digests out.

Stages, in order: toxic documents go; one document of each group of near
duplicates stays; personal data gets surrogates; sources are mixed to target
weights; what is left is encoded and decoded.  Each stage takes what the one
before kept, as Parquet, and all but the last give the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, minhash, mixing, pii, queries
from gridloom.llm.common import checkpoint, delete_folder, joinable, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose probability of being toxic reaches this go.
TOXIC_AT = 0.7
#: Bytes, about, of a generation of the encoder's cache and of a batch of texts, a quarter and half of its own: by the last stage an executor's heap has grown.
ENCODER_CACHE, ENCODER_BATCH = 12 << 20, 1 << 19


def row_id() -> Column:
    """What tells rows apart: ids may repeat or be null."""
    return F.xxhash64("doc_id", "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below TOXIC_AT; each row is judged by its own text, whatever its id."""
    scores = queries.toxicity_scores(spark, docs.select(row_id().alias("doc_id"), "text"), sf_dir)
    rejected = joinable(scores.where(F.col("score") >= TOXIC_AT).select(F.col("doc_id").alias("__key")).distinct())
    return docs.withColumn("__key", row_id()).join(rejected, "__key", "left_anti").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with five-word shingles of similarity 0.8 or more, that of the least id; rows of one id and text are one document.

    Rows that share an id but not the text are judged each by its own text.
    Texts without words are in no group.
    """
    keyed = docs.select(*COLUMNS, row_id().alias("__key"))
    found = minhash.near_duplicates(keyed, "__key", k=5, num=80, den=100)
    classes = found.groupBy(F.col("doc_id").alias("__key")).agg(F.min("component_id").alias("class"))
    ids = keyed.groupBy("__key").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))
    known = checkpoint(classes.join(ids, "__key"))
    groups = known.groupBy("class").agg(F.count("*").alias("keys"), F.min_by("__key", F.struct(F.col("id").isNull(), "id", "__key")).alias("best")).where("keys > 1")
    dropped = joinable(known.join(joinable(groups.select("class", "best")), "class").where("__key != best").select("__key"))
    again = joinable(known.where("n > 1").select("__key"))
    kept = keyed.join(dropped, "__key", "left_anti")
    repeated = kept.join(again, "__key", "left_semi").groupBy("__key").agg(F.min(F.struct(COLUMNS)).alias("row")).select("row.*")
    return kept.join(again, "__key", "left_anti").select(COLUMNS).union(repeated)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars counts the new text."""
    return _measured(pii.replace_pii(docs, queries.pii_key(spark)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: repeated, whole or in part, as their blocks are taken."""
    return _measured(mixing.mixed_documents(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix."""
    return queries.token_digests(bpe.encode_documents(docs, queries.vocabulary_path(), cache=ENCODER_CACHE, batch_bytes=ENCODER_BATCH))


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("pii", replace_private),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can't express the models, sketches and draws; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents table; what a stage gives is written to the shared folder and read again.

    Null and empty texts, null and repeated ids go through all stages as these
    say; the mix takes no documents without words.  An empty table gives an
    empty result.  The result reads what the last stage but one has written, so
    that folder stays; those before it are deleted.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
        if i:
            delete_folder(spark, f"{folder}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
