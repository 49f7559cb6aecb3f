"""Operators from run to run: dedup, rerank, fuse. A run is (domain, query_id, rank, doc_id, score)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions.text import content_key

LIST = ["domain", "query_id"]
COLUMNS = [*LIST, "rank", "doc_id", "score"]


def ranked(rows: DataFrame, *order: Column | str, depth: int | None = None) -> DataFrame:
    """``rows`` with new ranks in the given order, cut to ``depth``."""
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*LIST).orderBy(*order)))
    return (out.where(F.col("rank") <= depth) if depth else out).select(*COLUMNS)


def cut(run: DataFrame, depth: int | None) -> DataFrame:
    return run.where(F.col("rank") <= depth) if depth else run


def duplicate_groups(corpus: DataFrame, position: str = "doc_id") -> DataFrame:
    """domain, doc_id, canonical_id of documents with a twin; the first in corpus order stands for its text."""
    keyed = corpus.select("domain", "doc_id", F.col(position).alias("_at"), content_key(F.col("text")).alias("key"))
    groups = keyed.groupBy("domain", "key").agg(F.min_by("doc_id", "_at").alias("canonical_id"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(groups, ["domain", "key"]).select("domain", "doc_id", "canonical_id")


def with_canonical(run: DataFrame, groups: DataFrame) -> DataFrame:
    return run.join(groups, ["domain", "doc_id"], "left").withColumn("canonical_id", F.coalesce("canonical_id", "doc_id"))


def dedup(run: DataFrame, groups: DataFrame, expand: int = 1, limit: int | None = None) -> DataFrame:
    """The first document of each text in rank order, each followed by its next ``expand`` - 1 twins of the list."""
    group = Window.partitionBy(*LIST, "canonical_id")
    marked = with_canonical(run, groups).withColumn("_head", F.min("rank").over(group)).withColumn("_twin", F.row_number().over(group.orderBy("rank")))
    return ranked(marked.where(F.col("_twin") <= max(1, expand)), "_head", "_twin", depth=limit)


def rerank(run: DataFrame, scores: DataFrame, depth: int | None = None) -> DataFrame:
    """Externally scored documents first, by score; the rest of the list after them as it was; lists without scores stay."""
    own = scores.join(run.select(*LIST).distinct(), LIST, "left_semi").select(*LIST, "doc_id", "score", F.lit(0).alias("_block"), F.lit(0).alias("_at"))
    rest = run.join(own.select(*LIST, "doc_id"), [*LIST, "doc_id"], "left_anti").select(*LIST, "doc_id", "score", F.lit(1).alias("_block"), F.col("rank").alias("_at"))
    order = [F.col("_block"), F.when(F.col("_block") == 0, -F.col("score")), F.when(F.col("_block") == 1, F.col("_at")), F.col("doc_id")]
    return ranked(own.union(rest), *order, depth=depth)


def from_scores(scores: DataFrame, depth: int | None = None) -> DataFrame:
    """An external list as a run: by its rank if it has one, else by score."""
    order = ["rank"] if "rank" in scores.columns else [F.col("score").desc(), F.col("doc_id")]
    return ranked(scores, *order, depth=depth)


def rrf(runs: list[DataFrame], k: int = 60, depth: int | None = None) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (k + rank) over the lists."""
    votes = reduce(DataFrame.union, [r.select(*LIST, "doc_id", (1 / (k + F.col("rank"))).alias("score")) for r in runs])
    total = votes.groupBy(*LIST, "doc_id").agg(F.sum("score").alias("score"))
    return ranked(total, F.round("score", 12).desc(), F.col("doc_id"), depth=depth)


def fuse(run: DataFrame, sources: list[DataFrame], k: int = 60, depth: int | None = None) -> DataFrame:
    """Fusion as a stage: only the incoming queries, and the score rewritten from the new rank."""
    asked = run.select(*LIST).distinct()
    out = rrf([run, *[s.join(asked, LIST, "left_semi") for s in sources]], k, depth)
    return out.withColumn("score", 1 / (k + F.col("rank")))


def union(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two lists one after the other, each document where it comes first."""
    both = first.withColumn("_source", F.lit(0)).union(second.withColumn("_source", F.lit(1)))
    once = both.withColumn("_k", F.row_number().over(Window.partitionBy(*LIST, "doc_id").orderBy("_source", "rank"))).where("_k = 1")
    return ranked(once, "_source", F.col("rank"))


def rename_ranks(run: DataFrame) -> DataFrame:
    """Scores that fall with the rank, for readers that sort by score."""
    return run.withColumn("score", 1 / F.col("rank"))
