"""Exact dedup with a heavy-hitter split, in DataFrame operations only.

Texts are equal when they are identical after lower-casing A-Z. Each text
becomes a SHA-256 digest. A Misra-Gries summary finds the digests that may be
frequent (Spark's frequent-items sketch, which is Misra-Gries with a median
decrement: each task fills one of fixed size, ``FAN`` groups of tasks merge
theirs, then the groups merge). A second look counts these few exactly and
picks their winners; the winners, at most ``TRACKED`` rows however large the
input is, are broadcast, and the rows of frequent digests are settled on the
map side. The other digests, each with few rows, go through an ordinary shuffle.

Edge cases: a null text counts as empty; an empty table gives an empty result;
a null ``doc_id`` loses against any other and is kept only if it is alone; of
rows that are equal in digest and ``doc_id`` exactly one is kept; columns of
other names pass through ``deduplicate`` whatever they are called; a very long
text is one digest like any other.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.staging import staged

#: Counters of a summary: the most winners that are ever broadcast.
TRACKED = 10_000
#: Groups of tasks that merge their summaries before the last merge.
FAN = 64
#: A digest is frequent from this share of all rows on.
SHARE = 5e-4


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z in lower case and nothing else changed; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, in lower-case hexadecimal."""
    return F.sha2(lower_ascii(text), 256)


def frequent(keyed: DataFrame, key: str, share: float = SHARE, tracked: int = TRACKED) -> DataFrame:
    """Values of ``key`` that may have at least ``share`` of the rows: no more than ``tracked``."""
    name = f"`{key}`"
    parts = keyed.groupBy((F.spark_partition_id() % FAN).alias("_group")).agg(F.expr(f"approx_top_k_accumulate({name}, {tracked})").alias("_sketch"), F.count("*").alias("_rows"))
    # by a key that all share, as a merge without a key fails in a partition without rows
    one = parts.groupBy((F.col("_group") < 0).alias("_all")).agg(F.expr(f"approx_top_k_combine(_sketch, {tracked})").alias("_sketch"), F.sum("_rows").alias("_rows"))
    # there is no sketch to ask where no task saw a row
    top = one.select(F.explode(F.expr(f"approx_top_k_estimate(_sketch, {tracked})")).alias("_top"), "_rows")
    return top.where(F.col("_top.count") >= F.greatest(F.lit(2.0), share / 2 * F.col("_rows"))).select(F.col("_top.item").alias(key))


def resolve(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    base = docs.select("doc_id", digest(F.col("text")).alias("text_sha256"), F.monotonically_increasing_id().alias("_row"))
    base = staged(base, "digests")
    best = F.max(F.struct("doc_id", "_row")).alias("_best")
    may_be = frequent(base, "text_sha256", share)
    heavy = staged(base.join(F.broadcast(may_be), "text_sha256", "left_semi").groupBy("text_sha256").agg(best, F.count("*").alias("group_size")).where("group_size > 1"), "winners")
    settled = base.join(F.broadcast(heavy), "text_sha256")
    rest = base.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti")
    # summed on the map side: a digest just under the share is no large group in any task
    rest = rest.join(rest.groupBy("text_sha256").agg(best, F.count("*").alias("group_size")), "text_sha256")
    out = settled.unionByName(rest)
    return out.select("doc_id", F.col("_best.doc_id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_best._row")).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` that stay, one per text, with their columns as they were."""
    names = docs.columns
    row = docs.select(F.struct(*[docs[f"`{n}`"] for n in names]).alias("_doc"), digest(F.col("text")).alias("_digest"))
    keys = staged(row.select("_digest", F.col("_doc.doc_id").alias("doc_id")), "digests")
    may_be = frequent(keys, "_digest", share)
    heavy = staged(keys.join(F.broadcast(may_be), "_digest", "left_semi").groupBy("_digest").agg(F.max("doc_id").alias("_best"), F.count("*").alias("_size")).where("_size > 1"), "winners")
    first = F.max_by("_doc", F.struct("_doc.doc_id")).alias("_doc")
    # of the frequent texts only the winners' rows leave the map side
    winners = row.join(F.broadcast(heavy), "_digest").where(F.col("_doc.doc_id").eqNullSafe(F.col("_best"))).groupBy("_digest").agg(first)
    rest = row.join(F.broadcast(heavy.select("_digest")), "_digest", "left_anti").groupBy("_digest").agg(first)
    return winners.unionByName(rest).select("_doc.*")
