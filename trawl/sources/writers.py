"""Writers of runs, jobs, submissions and term lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.functions.text import stripped

_LIST = ["domain", "query_id"]


def nested(run: DataFrame) -> DataFrame:
    """A run as lists: d, q, i, s with scores of six decimals."""
    rows = run.groupBy(*_LIST).agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", F.round("score", 6).alias("score")))).alias("x"))
    return rows.select(F.col("domain").alias("d"), F.col("query_id").alias("q"), F.col("x.doc_id").alias("i"), F.col("x.score").alias("s"))


def run_file(run: DataFrame, path: str) -> None:
    nested(run).write.mode("overwrite").json(path)


def trec_lines(run: DataFrame, tag: str) -> DataFrame:
    """``qid Q0 doc rank score tag`` with the run's own scores, to six decimals."""
    line = F.format_string("%s Q0 %s %d %.6f %s", F.col("query_id").cast("string"), F.col("doc_id").cast("string"), F.col("rank"), F.round("score", 6), F.lit(tag))
    return run.select(*_LIST, "rank", line.alias("line"))


def check_submission(run: DataFrame, top_k: int) -> list[str]:
    """What is wrong with a run as a submission: ranks that don't count from 1, repeated documents, long lists."""
    lists = run.groupBy(*_LIST).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"), F.min("rank").alias("low"), F.max("rank").alias("high"))
    row = lists.agg(F.count_if(F.expr("low <> 1 OR high <> n")), F.count_if(F.expr("docs <> n")), F.count_if(F.col("n") > top_k), F.count("*")).first()
    faults = ["ranks that don't count from 1", "documents listed twice", f"more than {top_k} documents"]
    return [f"{n} lists with {what}" for n, what in zip(row, faults, strict=False) if n] + ([] if row[3] else ["no list at all"])


def submission(run: DataFrame, path: str, tag: str, top_k: int = 10) -> DataFrame:
    """Check and write a submission; nothing is left where a check fails."""
    lists = run.where(F.col("rank") <= top_k)
    if faults := check_submission(lists, top_k):
        raise ValueError("; ".join(faults))
    lines = trec_lines(lists, tag).orderBy(*_LIST, "rank")
    lines.select("line").write.mode("overwrite").text(path)
    return lines


def job(run: DataFrame, queries: DataFrame, folder: str, job_id: str, task: str, split: str, from_hash: str, depth: int | None = None, corpus: DataFrame | None = None, model: str | None = None) -> int:
    """Write a job: candidates cut to ``depth``, their queries, their texts if a corpus is given, a manifest. Returns the pairs."""
    lists = run.where(F.col("rank") <= depth) if depth else run
    candidates = lists.groupBy(*_LIST).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("i"))
    candidates.select(F.col("domain").alias("d"), F.col("query_id").alias("q"), "i").write.mode("overwrite").json(f"{folder}/candidates.jsonl")
    asked = queries.join(lists.select(*_LIST).distinct(), _LIST, "left_semi")
    asked.select(F.col("domain").alias("d"), F.col("query_id").alias("q"), stripped(F.col("text")).alias("t")).write.mode("overwrite").json(f"{folder}/queries.jsonl")
    if corpus is not None:
        needed = corpus.join(lists.select("domain", "doc_id").distinct(), ["domain", "doc_id"], "left_semi")
        needed.select(F.col("domain").alias("d"), F.col("doc_id").alias("i"), F.col("text").alias("t")).write.mode("overwrite").json(f"{folder}/documents.jsonl")
    facts = lists.agg(F.count("*").alias("pairs"), F.array_sort(F.collect_set("domain")).alias("domains"))
    names = {"job_id": job_id, "task": task, "split": split, "from_hash": from_hash, "depth": depth, "model": model, "with_text": corpus is not None}
    manifest = facts.select(*[F.lit(v).alias(k) for k, v in names.items()], "pairs", "domains")
    manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/job.json")
    return facts.first()["pairs"]


def term_list(counts: DataFrame, path: str) -> None:
    """term and collection frequency, most frequent first, as tab-separated text."""
    counts.groupBy("term").agg(F.sum("cf").cast("long").alias("cf")).orderBy(F.col("cf").desc(), "term").write.mode("overwrite").csv(path, sep="\t")
