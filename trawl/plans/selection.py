"""Rules that choose among systems, over their score records (a row for each system)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.operators import stats
from trawl.plans.pipeline import Context, record, score


def smallest_expand(base: DataFrame, records: dict[int, DataFrame], tolerance: float = 0.002) -> tuple[int, list[int]]:
    """The smallest expand that loses no more recall than ``tolerance`` against the record without dedup, and all that lose none.

    Where all lose more it is the largest, and the list is empty.
    """
    least = base.first()["recall"] - tolerance
    safe = sorted(e for e, r in records.items() if r.first()["recall"] >= least)
    return (safe[0] if safe else max(records)), safe


def best_parameter(records: dict[float, DataFrame], by: str = "fit_ndcg") -> tuple[float, bool]:
    """The value with the highest score (the smaller of equals), and whether it lies at an edge of those that were tried."""
    scores = {v: r.first()[by] for v, r in records.items()}
    best = min(scores, key=lambda v: (-scores[v], v))
    return best, best in (min(scores), max(scores))


def ladder(context: Context, configs: list[dict], gold: DataFrame, split: DataFrame, part: str = "fit", resamples: int = 10_000) -> tuple[DataFrame, str]:
    """Systems from simple to deep: place, name, score on the part, complete, gain over the one below, beats; and the name chosen.

    It is the deepest that is complete and significantly better than the one
    below it; the first if there is none. Ties go to the simpler one.
    """
    spark, rows, below = context.spark, [], None
    mine = split.where(F.col("part") == part).select(*stats.LIST)
    chosen = configs[0]["name"]
    for place, config in enumerate(configs):
        known = record(context, config, gold, split).first()
        scores = score(context, config, gold)[0].join(mine, stats.LIST, "left_semi")
        complete, gain, beats = known["n_topics"] == known["n_gold_queries"], None, None
        if below is not None:
            result = stats.bootstrap_by_hash(stats.paired(scores, below), resamples).first()
            gain, beats = result["point"], result["significant"] and result["point"] > 0
            chosen = config["name"] if beats and complete else chosen
        rows.append((place, config["name"], known[f"{part}_ndcg"], complete, gain, beats))
        below = scores
    return spark.createDataFrame(rows, f"place int, name string, {part}_ndcg double, complete boolean, gain double, beats boolean"), chosen


def submission(table: DataFrame, part: str = "fit") -> str | None:
    """The name of the complete system that is best on the part (of equals the first by name); None if none is complete."""
    row = table.where("NOT incomplete").orderBy(F.round(f"{part}_ndcg", 9).desc(), "name").first()
    return row["name"] if row else None
