"""The corpus pipeline: documents in, packed sequences out.

Each stage applies one operator of ``trawl.llm`` to all that its predecessor
kept, and all but the last return the columns of ``documents``. ``run`` writes
what a stage returns as Parquet to the shared folder and rereads it. When a
stage begins, the tables that its predecessor staged on the way have served,
and the driver gives back the memory that it has freed.

Edge cases: a null text is empty for every stage (and may be packed as its end
id alone); equal texts, nulls among them, are one document; a null ``doc_id``
goes along; ties and repeated rows are as each operator says; an empty table
gives an empty result; other columns, whatever they are called, pass through
all stages but the last; very long texts are never cut before they are packed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm import catalogue, exact_dedup, near, packing, pii, quality
from trawl.staging import forget, give_back, made, staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[str] = []


def _tidy(stage: Stage) -> Stage:
    """``stage``, before which what the stage before it staged goes."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        forget(spark, _left, docs)
        give_back(spark)
        before = len(made)
        out = stage(spark, docs, sf_dir)
        _left[:] = made[before:]
        return out

    return run


@_tidy
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier selects."""
    return quality.select(docs, catalogue.quality_model(spark, sf_dir))


@_tidy
def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id."""
    return exact_dedup.deduplicate(docs)


@_tidy
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of SimHash links and near copies (five words, Jaccard 0.8) the document with the smallest doc_id."""
    return near.deduplicate(docs)


@_tidy
def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data generalised or removed; n_chars counts the new text."""
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@_tidy
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their places in sequences."""
    return packing.pack(docs, catalogue.tokenizer("byte_bpe_50k.json"), catalogue.END_ID)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", near_stage),
    ("PII", pii_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can't express the classifier, the shingles' hashes or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
