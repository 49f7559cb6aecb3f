"""Appends that can be resumed domain by domain."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException


def finished(spark: SparkSession, path: str) -> DataFrame | None:
    """The domains that a table has, or none if there is no table yet."""
    try:
        return spark.read.parquet(path).select("domain").distinct()
    except AnalysisException:
        return None


def append(rows: DataFrame, path: str, make: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Append ``make(rows)`` by domain, without the domains that are there already.

    A domain's rows appear when the whole write is committed, so an
    interrupted one leaves no domain half done.
    """
    done = finished(rows.sparkSession, path)
    left = rows if done is None else rows.join(done, "domain", "left_anti")
    make(left).write.mode("append").partitionBy("domain").parquet(path)
