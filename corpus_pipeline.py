"""The corpus pipeline: quality rules, near-dedup, personal data, mixing and tokenising, each over what the last kept."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.bpe import encode_decode
from tidemill.llm.mixing import mix
from tidemill.llm.near_dedup import near_duplicates
from tidemill.llm.pii import personal_data
from tidemill.llm.quality import quality
from tidemill.plans.stored import shared_dir, small_side, stored, table, temporary

ORACLE_SQL = None  # the stages in Python can't be written in SQL; tests hold them against brute force


def _counted(docs: DataFrame, text: str) -> DataFrame:
    """The columns of documents with another text and its length."""
    return docs.withColumn("text", F.col(text)).withColumn("n_chars", F.length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that too many documents of their host share; a host's first such document keeps them,
    as else no member of a large group of copies would be left for near-dedup to keep."""
    return _counted(quality(docs, spare_first=True).filter("kept"), "kept_text").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8): the smallest id."""
    gone = stored(near_duplicates(docs).filter("not kept").select("doc_id").distinct(), "gone")
    return docs.join(small_side(gone, 24), "doc_id", "left_anti").select(docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind."""
    return _counted(personal_data(docs), "redacted").select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources uses it, in the order of training."""
    return mix(docs).orderBy("copy", "turn", "place").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, and the text that they decode to."""
    return encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("personal data", redact), ("mixing", mixture), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a written table, and the tables of a stage go once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        with temporary(spark):
            result = stage(spark, docs, sf_dir)
            result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
    return docs
