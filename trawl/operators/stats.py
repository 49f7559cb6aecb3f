"""Splits, bootstraps, and comparisons of systems."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions.text import id_shape

LIST = ["domain", "query_id"]


def hash_number(*parts) -> F.Column:
    """A whole number of 32 bits from the MD5 of the parts, joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts]).cast("binary")), 1, 8), 16, 10).cast("long")


def split_by_hash(queries: DataFrame, share: float = 0.8) -> DataFrame:
    """domain, query_id, part: a stratified split in the order of a hash, with at least one query on either side."""
    domain = Window.partitionBy("domain")
    numbered = queries.select(*LIST).distinct().withColumn("n", F.count("*").over(domain)).withColumn("k", F.row_number().over(domain.orderBy(hash_number("domain", "query_id"), "query_id")))
    size = F.greatest(F.lit(1), F.bround(F.col("n") * share).cast("int"))
    size = F.when(F.col("n") > 1, F.least(size, (F.col("n") - 1).cast("int"))).otherwise(F.col("n").cast("int"))
    return numbered.select(*LIST, F.when(F.col("k") <= size, "fit").otherwise("check").alias("part"))


def split_by_generator(queries: dict[str, list], share: float = 0.8, seed: int = 0) -> dict[str, dict[str, list]]:
    """The same by numpy's generator: one for all domains in their order, ids sorted first."""
    draw, out = np.random.default_rng(seed), {}
    for domain, ids in queries.items():
        names = np.array(sorted(ids), dtype=object)
        mixed = names[draw.permutation(len(names))]
        size = min(max(1, round(len(names) * share)), max(len(names) - 1, 1))
        size = len(names) if len(names) <= 1 else size
        out[domain] = {"fit": sorted(mixed[:size]), "check": sorted(mixed[size:])}
    return out


def paired(a: DataFrame, b: DataFrame, metric: str = "ndcg") -> DataFrame:
    """domain, query_id, diff of the queries that both have."""
    return a.select(*LIST, F.col(metric).alias("_a")).join(b.select(*LIST, F.col(metric).alias("_b")), LIST).select(*LIST, (F.col("_a") - F.col("_b")).alias("diff")).where("diff IS NOT NULL")


def bootstrap_by_hash(diffs: DataFrame, resamples: int = 1000) -> DataFrame:
    """Point, low, high, significant of the macro mean difference, resampled within domains by hashed draws.

    Every resample draws as many queries of a domain as it has. The draws are
    rows of a distributed table; none of them meets the driver.
    """
    spark = diffs.sparkSession
    place = Window.partitionBy("domain")
    numbered = diffs.select("domain", "diff", (F.row_number().over(place.orderBy("query_id")) - 1).alias("k"), F.count("*").over(place).alias("n"))
    draws = numbered.select("domain", "k", "n").join(F.broadcast(spark.range(resamples).withColumnRenamed("id", "draw")))
    picked = draws.select("draw", "domain", F.pmod(hash_number("draw", "domain", "k"), F.col("n")).alias("k"))
    means = picked.join(numbered.select("domain", "k", "diff"), ["domain", "k"]).groupBy("draw", "domain").agg(F.avg("diff").alias("m")).groupBy("draw").agg(F.avg("m").alias("m"))
    bounds = means.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("p"))
    point = diffs.groupBy("domain").agg(F.avg("diff").alias("m")).agg(F.avg("m").alias("point"))
    low, high = F.coalesce(F.col("p")[0], F.lit(0.0)), F.coalesce(F.col("p")[1], F.lit(0.0))
    return point.join(bounds).select(F.coalesce("point", F.lit(0.0)).alias("point"), low.alias("low"), high.alias("high"), ((low > 0) | (high < 0)).alias("significant"))


def bootstrap_by_generator(diffs: dict[str, np.ndarray], resamples: int = 10_000, seed: int = 0) -> tuple[float, float, float, bool]:
    """The same by numpy's generator, domain after domain, for the few thousand differences of an evaluation."""
    draw = np.random.default_rng(seed)
    some = [np.asarray(d, dtype=float) for d in diffs.values() if len(d)]
    if not some:
        return 0.0, 0.0, 0.0, False
    means = np.mean([draw.choice(d, size=(resamples, d.size)).mean(axis=1) for d in some], axis=0)
    low, high = np.percentile(means, [2.5, 97.5]).tolist()
    return float(np.mean([d.mean() for d in some])), low, high, low > 0 or high < 0


def headroom(before: float, after: float, ceiling: float) -> float:
    """The share of what reranking could gain that it did gain."""
    return (after - before) / (ceiling - before)


def projections(before: float, ceiling: float, shares: tuple[float, ...] = (0.2, 0.3, 0.4)) -> dict[float, float]:
    """The score at which reranking would have gained each of these shares of what it could."""
    return {s: before + s * (ceiling - before) for s in shares}


def gold_counts(gold: DataFrame) -> DataFrame:
    """median, mean, least and most judged documents of a query."""
    counts = gold.groupBy(*LIST).agg(F.count_distinct("doc_id").alias("n"))
    return counts.agg(F.percentile("n", F.lit(0.5)).alias("median"), F.avg("n").alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"))


def short_id_shares(corpus: DataFrame, gold: DataFrame) -> DataFrame:
    """domain, in_corpus, in_gold, n_gold: shares of short ids, in percent, over documents and over different judged ones."""

    def share(rows: DataFrame, name: str) -> DataFrame:
        short = F.avg(F.when(id_shape(F.col("doc_id")) == "short", 100.0).otherwise(0.0))
        return rows.groupBy("domain").agg(short.alias(name), F.count("*").alias(f"n_{name}"))

    judged = share(gold.select("domain", "doc_id").distinct(), "in_gold")
    both = share(corpus.select("domain", "doc_id"), "in_corpus").join(judged, "domain", "left")
    return both.select("domain", "in_corpus", F.coalesce("in_gold", F.lit(0.0)).alias("in_gold"), F.coalesce("n_in_gold", F.lit(0)).alias("n_gold"))
