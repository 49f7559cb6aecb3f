"""Metrics of runs against judgements, per query, per domain and macro-averaged.

Queries that aren't in the run are left out of means, not counted as zero:
``n_topics`` always stands beside them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIST = ["domain", "query_id"]
METRICS = ["ndcg", "precision", "recall", "recall_at_cut", "f1", "map", "ceiling"]


def _ideal(n) -> F.Column:
    """The discounted gain of ``n`` relevant documents on top."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda s, i: s + F.when(i <= n, 1 / F.log2(i + 1)).otherwise(0.0))


def per_query(run: DataFrame, gold: DataFrame, k: int = 10, recall_k: int = 100) -> DataFrame:
    """For each query of the run that has gold documents: all metrics, and counts."""
    right = gold.select(*LIST, "doc_id").distinct()
    judged = run.join(right.withColumn("_rel", F.lit(1)), [*LIST, "doc_id"], "left").withColumn("rel", F.coalesce("_rel", F.lit(0)))
    seen = F.sum("rel").over(Window.partitionBy(*LIST).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    judged = judged.withColumn("seen", seen)
    at = lambda depth: F.sum(F.when(F.col("rank") <= depth, F.col("rel")).otherwise(0))
    measured = judged.groupBy(*LIST).agg(
        F.count("*").alias("n_returned"), F.sum("rel").alias("found"), at(k).alias("hits"), at(recall_k).alias("deep_hits"),
        F.sum(F.when((F.col("rank") <= k) & (F.col("rel") == 1), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("rel") == 1, F.col("seen") / F.col("rank")).otherwise(0.0)).alias("sum_precision"),
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("best_rank"),
    )
    counts = right.groupBy(*LIST).agg(F.count("*").cast("int").alias("n_gold"))
    both = measured.join(counts, LIST)
    precision, recall_at_cut = F.col("hits") / F.least(F.lit(k), F.col("n_returned")), F.col("hits") / F.col("n_gold")
    ideal = _ideal(F.least(F.col("n_gold"), F.lit(k)))
    f1 = F.when(F.col("hits") > 0, 2 * precision * recall_at_cut / (precision + recall_at_cut)).otherwise(0.0)
    return both.select(
        *LIST, "n_gold", "n_returned", "found", "best_rank", (F.col("dcg") / ideal).alias("ndcg"), precision.alias("precision"), (F.col("deep_hits") / F.col("n_gold")).alias("recall"), recall_at_cut.alias("recall_at_cut"),
        f1.alias("f1"), (F.col("sum_precision") / F.col("n_gold")).alias("map"), (_ideal(F.least(F.col("found").cast("int"), F.lit(k))) / ideal).alias("ceiling"),
    )


def by_domain(scores: DataFrame, gold: DataFrame, run: DataFrame) -> DataFrame:
    """Means of every domain that has a list, with n_topics answered and n_gold_queries."""
    asked = gold.select(*LIST).distinct().groupBy("domain").agg(F.count("*").alias("n_gold_queries"))
    means = scores.groupBy("domain").agg(F.count("*").alias("n_topics"), *[F.avg(m).alias(m) for m in METRICS])
    zero = {m: 0.0 for m in METRICS} | {"n_topics": 0, "n_gold_queries": 0}
    return run.select("domain").distinct().join(means, "domain", "left").join(asked, "domain", "left").fillna(zero)


def macro(domains: DataFrame) -> DataFrame:
    """One row: each metric's mean over domains of equal weight."""
    return domains.agg(F.count("*").alias("n_domains"), F.sum("n_topics").alias("n_topics"), *[F.avg(m).alias(m) for m in METRICS])


def restrict(scores: DataFrame, split: DataFrame, part: str) -> DataFrame:
    """Per domain the means of nDCG and recall over the part's queries; a domain without any counts as zero."""
    mine = scores.join(split.where(F.col("part") == part), LIST).groupBy("domain").agg(F.count("*").alias("n_topics"), F.avg("ndcg").alias("ndcg"), F.avg("recall").alias("recall"))
    return split.select("domain").distinct().join(mine, "domain", "left").fillna({"n_topics": 0, "ndcg": 0.0, "recall": 0.0})


def honest(domains: DataFrame) -> DataFrame:
    """The macro nDCG as reported, and with unanswered queries as zero."""
    whole = F.col("ndcg") * F.col("n_topics") / F.col("n_gold_queries")
    return domains.where("n_gold_queries > 0").agg(F.avg("ndcg").alias("reported"), F.avg(whole).alias("honest"))


def breakdown(scores: DataFrame) -> DataFrame:
    """Queries by outcome: scored, recoverable (gold in the list, none in the cut), unreachable."""
    outcome = F.when(F.col("ndcg") > 0, "scored").when(F.col("found") > 0, "recoverable").otherwise("unreachable")
    return scores.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("queries"))


def depth_curve(run: DataFrame, gold: DataFrame, depths: list[int], k: int = 10) -> DataFrame:
    """Macro ceiling and recall if the run were cut at each depth."""
    right = gold.select(*LIST, "doc_id").distinct().withColumn("rel", F.lit(1))
    judged = run.join(right, [*LIST, "doc_id"], "left").select(*LIST, "rank", F.coalesce("rel", F.lit(0)).alias("rel"))
    cells = judged.groupBy(*LIST).agg(*[F.sum(F.when(F.col("rank") <= d, F.col("rel")).otherwise(0)).cast("int").alias(f"d{d}") for d in depths])
    counts = right.groupBy(*LIST).agg(F.count("*").cast("int").alias("n_gold"))
    long = cells.join(counts, LIST).select(*LIST, "n_gold", F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.col(f"d{d}").alias("found")) for d in depths])).alias("x"))
    ceiling = _ideal(F.least(F.col("x.found"), F.lit(k))) / _ideal(F.least(F.col("n_gold"), F.lit(k)))
    means = long.groupBy("domain", F.col("x.depth").alias("depth")).agg(F.avg(ceiling).alias("ceiling"), F.avg(F.col("x.found") / F.col("n_gold")).alias("recall"))
    return means.groupBy("depth").agg(F.avg("ceiling").alias("ceiling"), F.avg("recall").alias("recall"))


def cases(scores: DataFrame, n: int = 5, metric: str = "ndcg") -> DataFrame:
    """The n best and n worst queries, ties by query_id."""
    columns = ["domain", "query_id", metric]
    order = [F.col("query_id"), F.col("domain")]
    best = scores.select(*columns, F.lit("best").alias("side")).orderBy(F.round(metric, 9).desc(), *order).limit(n)
    worst = scores.select(*columns, F.lit("worst").alias("side")).orderBy(F.round(metric, 9), *order).limit(n)
    return best.union(worst)
