"""A corpus pipeline: quality, exact copies, near copies, secrets, packing.

Each stage takes the documents that its predecessor left. All but the last return the columns of
``documents``; the last returns the packed pieces. SQL can express neither the classifier nor the
fingerprints, so ``ORACLE_SQL`` is None and tests compare the stages with plain versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import SPACE, materialise, table
from textloom.llm.exact_dedup import exact_groups
from textloom.llm.packing import packed_documents, tokenizer_path
from textloom.llm.quality import keep_quality
from textloom.llm.secrets import redact
from textloom.llm.simhash_dedup import near_keepers

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def _key(id_col: str, digest: Column) -> Column:
    return F.struct(F.col(id_col).cast("long").alias("id"), digest.alias("digest"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, whether or not ids are null or repeated."""
    named = exact_groups(docs).where(F.col("id").eqNullSafe(F.col("keep_id")))
    kept = materialise(named.groupBy("digest", "keep_id").agg(F.count(F.lit(1)).alias("n")).select(_key("keep_id", F.col("digest")).alias("key"), "n"))
    text = F.coalesce("text", F.lit(""))
    return _one_each(docs, kept, F.unhex(F.sha2(F.regexp_replace(text, SPACE, ""), 256)), F.struct(F.length(text), F.sha2(text, 256)))


def _one_each(docs: DataFrame, kept: DataFrame, digest: Column, order: Column) -> DataFrame:
    """A row of ``docs`` for each row of ``kept(key, n)``, whose key is (doc_id, digest): the only one with both, or the last of n such in ``order``."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), _key("doc_id", digest).alias("place"), order.alias("rank"))
    same = F.col("place").eqNullSafe(F.col("key"))
    only = rows.join(kept.where("n = 1"), same, "left_semi").select("row.*")
    several = rows.join(kept.where("n > 1"), same, "left_semi").groupBy("place").agg(F.max_by("row", "rank").alias("row"))
    return only.union(several.select("row.*"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id, whether or not ids are null or repeated."""
    kept = materialise(near_keepers(docs).select(_key("id", F.col("sha")).alias("key"), "n"))
    return _one_each(docs, kept, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), F.coalesce("n_chars", F.lit(-1)))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by a mark and n_chars brought up to date."""
    return redact(docs).withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.coalesce(F.length("text").cast("long"), "n_chars")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as pieces placed in sequences of 2048 tokens."""
    return packed_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("simhash near-dedup", near), ("secret scan", secrets), ("best-fit packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; each stage's result is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
