"""Readers. A data folder has one folder per domain with documents, queries and judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawl import schema

SPLITS = {"train": ("examples_train.jsonl", "qrels_train.txt"), "dev": ("examples_dev.jsonl", "qrels_dev.txt")}
_LIST = ["domain", "query_id"]


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("domain", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))


def domains(spark: SparkSession, folder: str) -> list[str]:
    """Names of the domains' folders, sorted, by Hadoop's file system, whichever holds them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(f.getPath().getName() for f in found if f.isDirectory())


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """domain, doc_id, text, pos: ``pos`` rises in file order within a domain."""
    rows = _named(spark.read.schema(schema.CORPUS).json(f"{folder}/*/documents.jsonl")).where("id IS NOT NULL")
    return rows.select("domain", F.col("id").alias("doc_id"), F.coalesce("content", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("pos"))


def queries(spark: SparkSession, folder: str, split: str = "train") -> DataFrame:
    """domain, query_id, text, gold_ids; texts verbatim."""
    rows = _named(spark.read.schema(schema.QUERIES).json(f"{folder}/*/{SPLITS[split][0]}")).where("id IS NOT NULL")
    return rows.select("domain", F.col("id").alias("query_id"), F.col("query").alias("text"), "gold_ids")


def qrels(spark: SparkSession, folder: str, split: str = "train") -> DataFrame:
    """domain, query_id, doc_id of positive judgements, each once."""
    lines = _named(spark.read.text(f"{folder}/*/{SPLITS[split][1]}")).withColumn("f", F.split(F.trim("value"), r"\s+"))
    rows = lines.where("size(f) >= 4 AND CAST(f[3] AS INT) > 0")
    return rows.select("domain", F.col("f")[0].alias("query_id"), F.col("f")[2].alias("doc_id")).distinct()


def guidance(spark: SparkSession, folder: str) -> DataFrame:
    rows = _named(spark.read.schema(schema.GUIDANCE).json(f"{folder}/*/guidance_train.jsonl")).where("id IS NOT NULL")
    return rows.select("domain", F.col("id").alias("query_id"), "query_guidance.*")


def gold_consistency(asked: DataFrame, judged: DataFrame) -> DataFrame:
    """Queries whose gold_ids differ from their judgements."""
    sets = judged.groupBy(*_LIST).agg(F.array_sort(F.collect_set("doc_id")).alias("judged"))
    return asked.join(sets, _LIST, "full").where(~F.array_sort(F.array_distinct(F.coalesce("gold_ids", F.array()))).eqNullSafe(F.coalesce("judged", F.array().cast("array<string>")))).select(*_LIST)


def prefix(rows: DataFrame, n: int = 5000) -> DataFrame:
    """The first ``n`` documents of each domain: a sampling operator."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy("domain").orderBy("pos"))).where(F.col("_k") <= n).drop("_k")


def run_file(spark: SparkSession, path: str) -> DataFrame:
    """A run from JSON lines, one list each."""
    rows = spark.read.schema(schema.RUN_FILE).json(path)
    return rows.select(F.col("d").alias("domain"), F.col("q").alias("query_id"), F.posexplode(F.arrays_zip("i", "s"))).select(*_LIST, (F.col("pos") + 1).alias("rank"), F.col("col.i").alias("doc_id"), F.col("col.s").alias("score"))


def scores(spark: SparkSession, path: str, job_id: str | None = None) -> DataFrame:
    """External scores of a job: domain, query_id, rank, doc_id, score; the last line of a query counts."""
    rows = spark.read.schema(schema.SCORES).json(path).withColumn("_line", F.monotonically_increasing_id())
    if job_id is not None:
        rows = rows.where(F.col("job_id") == job_id)
    last = rows.groupBy("d", "q").agg(F.max_by(F.struct("i", "s"), "_line").alias("x"))
    return last.select(F.col("d").alias("domain"), F.col("q").alias("query_id"), F.posexplode(F.arrays_zip("x.i", "x.s"))).select(*_LIST, (F.col("pos") + 1).alias("rank"), F.col("col.i").alias("doc_id"), F.col("col.s").alias("score"))


def job(spark: SparkSession, folder: str) -> tuple[dict, DataFrame, DataFrame]:
    """A job's manifest, candidates and queries."""
    manifest = spark.read.schema(schema.JOB).json(f"{folder}/job.json", multiLine=True).first().asDict()
    candidates = spark.read.schema(schema.CANDIDATES).json(f"{folder}/candidates.jsonl")
    return manifest, candidates, spark.read.schema(schema.JOB_QUERIES).json(f"{folder}/queries.jsonl")


def job_documents(spark: SparkSession, folder: str, texts: DataFrame | None = None) -> DataFrame:
    """domain, doc_id, text that a job's candidates need: shipped with it, else from ``texts``."""
    manifest, candidates, _ = job(spark, folder)
    if manifest["with_text"]:
        return spark.read.schema(schema.JOB_DOCUMENTS).json(f"{folder}/documents.jsonl").toDF("domain", "doc_id", "text")
    if texts is None:
        raise ValueError("the job was exported without its texts: give the corpus")
    wanted = candidates.select(F.col("d").alias("domain"), F.explode("i").alias("doc_id")).distinct()
    return texts.join(wanted, ["domain", "doc_id"], "left_semi").select("domain", "doc_id", "text")
