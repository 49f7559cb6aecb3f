"""Systems: four optional stages, fingerprints, and runs cached by fingerprint."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawl.operators import evaluate, runs, stats
from trawl.operators.index import Index, build
from trawl.operators.search import Weighting, search
from trawl.staging import staged

STAGES = ("retrieve", "dedup", "rerank", "fuse")
Stage = Callable[["Context", DataFrame | None, dict], DataFrame]
_stages: dict[tuple[str, str], Stage] = {}


@dataclass
class Context:
    """What stages work on. ``cache``: a folder for runs; ``jobs``: external scores by job id."""

    spark: SparkSession
    corpus: DataFrame
    queries: DataFrame
    split: str = "train"
    cache: str | None = None
    jobs: dict[str, DataFrame] = field(default_factory=dict)
    registry: dict[str, dict] = field(default_factory=dict)
    indexes: dict[str, Index] = field(default_factory=dict)

    def __post_init__(self) -> None:
        """A registry that an earlier program left in the cache goes on."""
        if self.cache and not self.registry and _there(self.spark, f"{self.cache}/registry"):
            self.registry = json.loads(self.spark.read.text(f"{self.cache}/registry", wholetext=True).first()[0])

    def index(self, tokenizer: str) -> Index:
        """One stored index for each tokenizer, whatever is asked of it."""
        if tokenizer not in self.indexes:
            self.indexes[tokenizer] = build(self.corpus, tokenizer).stored()
        return self.indexes[tokenizer]


def register(stage: str, kind: str) -> Callable[[Stage], Stage]:
    """Make a function (context, incoming run, config) -> run known as a stage's kind."""
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage!r}")

    def keep(function: Stage) -> Stage:
        _stages[stage, kind] = function
        return function

    return keep


def system(config: dict | str | Path, name: str | None = None) -> dict:
    """A system from a dict, JSON text or the path of a JSON file (whose stem names it), with all stages; other keys are an error."""
    if isinstance(config, Path):
        name, config = name or config.stem, config.read_text(encoding="utf-8")
    name = name or "system"
    given = dict(json.loads(config) if isinstance(config, str) else config)
    if other := sorted(given.keys() - {*STAGES, "name", "note"}):
        raise ValueError(f"unknown keys: {', '.join(other)}")
    return {"name": name, **dict.fromkeys(STAGES), **given}


def fingerprint(config: dict, upto: str = STAGES[-1], split: str = "train") -> str:
    """Twelve hexadecimal digits for the stages up to one; stages that are null don't count."""
    # fixed format: these names and separators are part of the digest
    used = [[s, config[s]] for s in STAGES[: STAGES.index(upto) + 1] if config.get(s)]
    return hashlib.sha1(json.dumps({"split": split, "stages": used}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]


def run(context: Context, config: dict, force: bool = False) -> DataFrame:
    """The run of a system. Stages whose fingerprint is in the cache are read from there."""
    config = system(config)
    active = [s for s in STAGES if config[s]]
    if not active:
        raise ValueError("the system has no active stage")
    out = None
    for stage in active:
        key = fingerprint(config, stage, context.split)
        path = f"{context.cache}/{key}" if context.cache else None
        kept = None if force or path is None else _cached(context.spark, path)
        if kept is None:
            if (stage, config[stage]["kind"]) not in _stages:
                raise KeyError(f"{stage} has no kind {config[stage]['kind']!r}")
            kept = _stages[stage, config[stage]["kind"]](context, out, config[stage])
            if path:
                kept.write.mode("overwrite").partitionBy("domain").parquet(path)
                kept = context.spark.read.schema(kept.schema).parquet(path).select(*runs.COLUMNS)
        out = kept
        if stage == active[-1]:
            note(context, key, config)
    return out


def _there(spark: SparkSession, path: str) -> bool:
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def _cached(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path).select(*runs.COLUMNS) if _there(spark, path) else None


def note(context: Context, key: str, config: dict) -> None:
    """Enter a run in the registry: its first name stays, others become aliases."""
    entry = context.registry.setdefault(key, {"name": config["name"], "split": context.split, "system": config, "aliases": []})
    if config["name"] not in (entry["name"], *entry["aliases"]):
        entry["aliases"].append(config["name"])
    entry["when"] = datetime.now(UTC).isoformat(timespec="seconds")
    if context.cache:  # a line for all runs, by the driver alone
        context.spark.createDataFrame([(json.dumps(context.registry),)], "value string").coalesce(1).write.mode("overwrite").text(f"{context.cache}/registry")


def score(context: Context, config: dict, gold: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per query, per domain, macro. The run is written once, as each of them reads it."""
    lists = staged(run(context, config), "run")
    scores = evaluate.per_query(lists, gold)
    domains = evaluate.by_domain(scores, gold, lists)
    return scores, domains, evaluate.macro(domains)


#: Goes up when what a record holds changes, so that older ones are computed anew.
SCORE_VERSION = 1
PARTS = ("fit", "check")


def record(context: Context, config: dict, gold: DataFrame, split: DataFrame | None = None, force: bool = False) -> DataFrame:
    """One row of a system's scores: hash, split, name, topics, macro metrics, and nDCG, recall and topics of the parts of ``split``.

    With a cache it is kept by fingerprint and ``SCORE_VERSION``, and read from there.
    """
    config = system(config)
    key = fingerprint(config, split=context.split)
    path = f"{context.cache}/scores-{SCORE_VERSION}/{key}{'' if split is None else '-parts'}" if context.cache else None
    if path and not force and _there(context.spark, path):
        return context.spark.read.parquet(path)
    scores, domains, _ = score(context, config, gold)
    parts = {}
    for part in PARTS if split is not None else ():
        mine = evaluate.restrict(scores, split, part).agg(*[F.avg(m).alias(f"{part}_{m}") for m in ("ndcg", "recall")], F.sum("n_topics").alias(f"{part}_n_topics"))
        parts |= mine.first().asDict()  # three numbers
    row = domains.agg(F.count("*").alias("n_domains"), F.sum("n_topics").alias("n_topics"), F.sum("n_gold_queries").alias("n_gold_queries"), *[F.avg(m).alias(m) for m in evaluate.METRICS])
    row = row.select("*", *[F.lit(v).alias(k) for k, v in parts.items()])
    row = row.select(F.lit(key).alias("hash"), F.lit(context.split).alias("split"), F.lit(SCORE_VERSION).alias("score_version"), F.lit(config["name"]).alias("name"), "*")
    if path is None:
        return row
    row.coalesce(1).write.mode("overwrite").parquet(path)
    return context.spark.read.parquet(path)


def table(context: Context, configs: list[dict], gold: DataFrame, split: DataFrame | None = None, part: str | None = None) -> DataFrame:
    """A row for each system, best first by nDCG (of a part, if one is named), with all metrics; ``incomplete`` where topics have no list."""
    rows = None
    for config in configs:
        one = record(context, config, gold, split)
        rows = one if rows is None else rows.unionByName(one)
    by = f"{part}_ndcg" if part else "ndcg"
    place = F.row_number().over(Window.orderBy(F.round(by, 9).desc(), "name"))  # a row for each system
    return rows.select("*", (F.col("n_topics") < F.col("n_gold_queries")).alias("incomplete"), place.cast("long").alias("place"))


def listing(context: Context) -> DataFrame:
    """The registry (hash, name, aliases, split, when) with the metrics of the runs that have a record."""
    entries = [(k, e["name"], e["aliases"], e["split"], e["when"]) for k, e in sorted(context.registry.items())]
    known = context.spark.createDataFrame(entries, "hash string, name string, aliases array<string>, split string, when string")
    folder = f"{context.cache}/scores-{SCORE_VERSION}"
    paths = [f"{folder}/{k}{x}" for k in context.registry for x in ("", "-parts") if context.cache and _there(context.spark, f"{folder}/{k}{x}")]
    if not paths:
        return known.select("*", *[F.lit(None).cast("double").alias(m) for m in evaluate.METRICS])
    return known.join(context.spark.read.parquet(*paths).select("hash", *evaluate.METRICS).dropDuplicates(["hash"]), "hash", "left")


def differences(a: dict, b: dict, path: str = "") -> list[str]:
    """Dotted paths of the leaves in which two systems differ, names aside."""
    out: list[str] = []
    for key in sorted({*(a or {}), *(b or {})} - {"name", "note"}):
        x, y = (a or {}).get(key), (b or {}).get(key)
        if isinstance(x, dict) or isinstance(y, dict):
            out += differences(x if isinstance(x, dict) else {}, y if isinstance(y, dict) else {}, f"{path}{key}.")
        elif x != y:
            out.append(path + key)
    return out


def compare(context: Context, a: dict, b: dict, gold: DataFrame, split: DataFrame | None = None, part: str = "fit", resamples: int = 1000) -> tuple[DataFrame, list[str]]:
    """Bootstrap of the nDCG difference on one part, and the leaves that changed."""
    scores = [score(context, s, gold)[0] for s in (a, b)]
    if split is not None:
        mine = split.where(F.col("part") == part).select("domain", "query_id")
        scores = [s.join(mine, ["domain", "query_id"], "left_semi") for s in scores]
    return stats.bootstrap_by_hash(stats.paired(*scores), resamples), differences(system(a), system(b))


def describe(config: dict) -> list[str]:
    """One line for each active stage."""
    config = system(config)
    return [f"{s}: {config[s]['kind']}" + "".join(f", {k}={v}" for k, v in sorted(config[s].items()) if k != "kind") for s in STAGES if config[s]]


@register("retrieve", "sparse")
def _sparse(context: Context, _: DataFrame | None, c: dict) -> DataFrame:
    tokens = c.get("tokenizer", "nohtml_stop")
    how = Weighting(c.get("model", "bm25"), c.get("k1", 0.9), c.get("b", 0.4), c.get("mu", 2000.0), c.get("use_idf", True))
    return search(context.index(tokens), context.queries, how, c.get("depth", 100), tokens, c.get("query_form", "title_weighted"))


@register("retrieve", "gpu_job")
def _external(context: Context, _: DataFrame | None, c: dict) -> DataFrame:
    return runs.from_scores(context.jobs[c["job"]], c.get("depth"))


def _groups(context: Context) -> DataFrame:
    return runs.duplicate_groups(context.corpus, "pos" if "pos" in context.corpus.columns else "doc_id")


def store_groups(context: Context, force: bool = False) -> DataFrame:
    """Write the duplicate map to the cache, unless it is there, and return domain, in_groups, groups."""
    path = f"{context.cache}/groups"
    if force or not _there(context.spark, path):
        _groups(context).write.mode("overwrite").partitionBy("domain").parquet(path)
    return stored_groups(context).groupBy("domain").agg(F.count("*").alias("in_groups"), F.count_distinct("canonical_id").alias("groups"))


def stored_groups(context: Context) -> DataFrame:
    """The duplicate map (domain, doc_id, canonical_id) from the cache; an error where it was not stored."""
    path = f"{context.cache}/groups"
    if not context.cache or not _there(context.spark, path):
        raise FileNotFoundError(f"no duplicate map in {path}: call store_groups(context) first")
    return context.spark.read.schema("doc_id string, canonical_id string, domain string").parquet(path).select("domain", "doc_id", "canonical_id")


@register("dedup", "content_hash")
def _dedup(context: Context, incoming: DataFrame, c: dict) -> DataFrame:
    """With the stored duplicate map if the cache has one."""
    known = context.cache and _there(context.spark, f"{context.cache}/groups")
    return runs.dedup(incoming, stored_groups(context) if known else _groups(context), c.get("expand", 1), c.get("keep"))


@register("rerank", "gpu_job")
def _rerank(context: Context, incoming: DataFrame, c: dict) -> DataFrame:
    return runs.rerank(incoming, context.jobs[c["job"]], c.get("depth"))


@register("fuse", "rrf")
def _fuse(context: Context, incoming: DataFrame, c: dict) -> DataFrame:
    """Sources are systems, or names or fingerprints of runs in the registry."""
    sources = []
    for s in c["sources"]:
        known = s if isinstance(s, dict) else next(e["system"] for k, e in context.registry.items() if s in (k, e["name"], *e["aliases"]))
        sources.append(run(context, known))
    return runs.fuse(incoming, sources, c.get("k", 60), c.get("depth"))


for _stage in ("dedup", "rerank", "fuse"):
    register(_stage, "none")(lambda context, incoming, c: incoming)
