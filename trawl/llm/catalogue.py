"""The queries of this subpackage and the SQL for those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm import bpe, exact_dedup, lm, packing, passages, pii, quality, repair, simhash, vector_graph
from trawl.shipping import ship

#: The id that ends a document in packed and written ids.
END_ID = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Model:
    """Fitted on the labels: grade 0 is low quality, 1 toxic, 2 neither."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    ratings = _table(spark, sf_dir, "labels").select("doc_id", grade.alias("grade"))
    return quality.fit(_table(spark, sf_dir, "documents"), ratings, top=2)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.cluster(_table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeats(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), END_ID)


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.link(_table(spark, sf_dir, "embeddings"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.resolve(_table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_table(spark, sf_dir, "documents"))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.read(repair.write(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), END_ID))


OP8_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_lm_scores": op2_lm_scores,
    "op3_simhash": op3_simhash,
    "op4_bpe": op4_bpe,
    "op5_passages": op5_passages,
    "op6_packing": op6_packing,
    "op7_embeddings": op7_embeddings,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_pii": op9_pii,
    "op10_token_ids": op10_token_ids,
}

SQL: dict[str, str] = {
    "op8_exact_dedup": OP8_SQL,
}
