import math

import numpy as np
import pytest

from trawl.operators import evaluate, neural, runs, stats

RUN = "domain string, query_id long, rank int, doc_id string, score double"


def run_of(spark, docs, scores=None, query=1, domain="d"):
    return spark.createDataFrame([(domain, query, k + 1, x, float((scores or range(len(docs), 0, -1))[k])) for k, x in enumerate(docs)], RUN)


def names(run):
    return [r.doc_id for r in run.orderBy("rank").collect()]


def gold_of(spark, docs, query=1, domain="d"):
    return spark.createDataFrame([(domain, query, x) for x in docs], "domain string, query_id long, doc_id string")


def test_dedup(spark):
    run = run_of(spark, ["a1", "b1", "a2", "c1", "a3"])
    twins = spark.createDataFrame([("d", x, "a1") for x in ("a1", "a2", "a3")], "domain string, doc_id string, canonical_id string")
    assert names(runs.dedup(run, twins)) == ["a1", "b1", "c1"]
    assert names(runs.dedup(run, twins, 2)) == ["a1", "a2", "b1", "c1"]
    assert names(runs.dedup(run, twins, 2, 2)) == ["a1", "a2"]
    corpus = spark.createDataFrame([("d", "z", " X y", 0), ("d", "a", "x  Y", 1), ("d", "b", "other", 2)], "domain string, doc_id string, text string, pos long")
    assert {tuple(r) for r in runs.duplicate_groups(corpus, "pos").collect()} == {("d", "z", "z"), ("d", "a", "z")}


def test_rerank_and_fuse(spark):
    run = run_of(spark, ["x", "y", "z"]).union(run_of(spark, ["p", "q"], query=2))
    scores = spark.createDataFrame([("d", 1, "z", 0.5), ("d", 1, "y", 0.9), ("d", 1, "w", 0.9)], "domain string, query_id long, doc_id string, score double")
    out = runs.rerank(run, scores)
    assert names(out.where("query_id = 1")) == ["w", "y", "z", "x"] and names(out.where("query_id = 2")) == ["p", "q"]
    a, b = run_of(spark, ["x", "y"]), run_of(spark, ["y", "z"])
    fused = runs.fuse(a, [b], 60)
    assert names(fused) == ["y", "x", "z"] and [r.score for r in fused.orderBy("rank").collect()] == [1 / 61, 1 / 62, 1 / 63]
    assert runs.rrf([a, b], 60).where("doc_id = 'y'").first().score == pytest.approx(1 / 62 + 1 / 61)
    assert names(runs.union(a, b)) == ["x", "y", "z"]
    other = run_of(spark, ["y"], query=7)
    assert {r.query_id for r in runs.fuse(a, [other]).collect()} == {1}


def test_metric_ladder(spark):
    ideal = sum(1 / math.log2(i + 1) for i in (1, 2, 3))
    for places in ([1, 2, 3], [1, 4, 5], [8, 9, 10], [5], []):
        docs = [f"n{k}" for k in range(1, 11)]
        for name, p in zip("ABC", places, strict=False):
            docs[p - 1] = name
        row = evaluate.per_query(run_of(spark, docs), gold_of(spark, "ABC")).first()
        assert row.ndcg == pytest.approx(sum(1 / math.log2(p + 1) for p in places) / ideal)
        assert row.recall == pytest.approx(len(places) / 3) and row.precision == pytest.approx(len(places) / 10)
        assert row.map == pytest.approx(sum((k + 1) / p for k, p in enumerate(places)) / 3)
    short = evaluate.per_query(run_of(spark, ["A", "x", "B", "y"]), gold_of(spark, "AB")).first()
    assert short.precision == 0.5 and short.ceiling == 1.0


def test_means(spark):
    run = run_of(spark, ["A"]).union(run_of(spark, ["x"], query=2)).union(run_of(spark, ["A"], domain="e")).union(run_of(spark, ["A"], domain="f"))
    gold = gold_of(spark, "A").union(gold_of(spark, "A", 2)).union(gold_of(spark, "A", 3)).union(gold_of(spark, "A", domain="e"))
    domains = evaluate.by_domain(evaluate.per_query(run, gold), gold, run)
    by = {r.domain: (r.ndcg, r.n_topics, r.n_gold_queries) for r in domains.collect()}
    assert by == {"d": (0.5, 2, 3), "e": (1.0, 1, 1), "f": (0.0, 0, 0)}
    assert evaluate.macro(domains).first().ndcg == pytest.approx(0.5)
    honest = evaluate.honest(domains).first()
    assert (honest.reported, honest.honest) == (pytest.approx(0.75), pytest.approx((1 / 3 + 1) / 2))
    split = spark.createDataFrame([("d", 1, "fit"), ("d", 2, "check"), ("e", 1, "fit")], "domain string, query_id long, part string")
    parts = {r.domain: r.ndcg for r in evaluate.restrict(evaluate.per_query(run, gold), split, "check").collect()}
    assert parts == {"d": 0.0, "e": 0.0}
    assert {r.outcome: r.queries for r in evaluate.breakdown(evaluate.per_query(run, gold)).collect()} == {"scored": 2, "unreachable": 1}


def test_splits(spark):
    sizes = {"history": 561, "iota": 7, "bitcoin": 70, "one": 1}
    parts = stats.split_by_generator({d: [f"{d}{i}" for i in range(n)] for d, n in sizes.items()})
    assert {d: (len(p["fit"]), len(p["check"])) for d, p in parts.items()} == {"history": (449, 112), "iota": (6, 1), "bitcoin": (56, 14), "one": (1, 0)}
    rows = spark.createDataFrame([(d, i) for d, n in sizes.items() for i in range(n)], "domain string, query_id long")
    got = {(r.domain, r.part): r["count"] for r in stats.split_by_hash(rows).groupBy("domain", "part").count().collect()}
    assert got == {("history", "fit"): 449, ("history", "check"): 112, ("iota", "fit"): 6, ("iota", "check"): 1, ("bitcoin", "fit"): 56, ("bitcoin", "check"): 14, ("one", "fit"): 1}


def test_bootstrap(spark):
    draw = np.random.default_rng(3)
    diffs = {"a": draw.normal(0.3, 0.1, 30), "b": draw.normal(0.2, 0.1, 5)}
    point, low, high, real = stats.bootstrap_by_generator(diffs, 2000)
    assert low < point < high and real and stats.bootstrap_by_generator({}) == (0.0, 0.0, 0.0, False)
    rows = spark.createDataFrame([(d, i, float(x)) for d, xs in diffs.items() for i, x in enumerate(xs)], "domain string, query_id long, diff double")
    other = stats.bootstrap_by_hash(rows, 400).first()
    assert other.point == pytest.approx(point) and other.low == pytest.approx(low, abs=0.02) and other.high == pytest.approx(high, abs=0.02) and other.significant
    none = stats.bootstrap_by_hash(rows.limit(0), 10).first()
    assert tuple(none) == (0.0, 0.0, 0.0, False)
    assert stats.headroom(0.2, 0.3, 0.6) == pytest.approx(0.25)


def test_scorer_and_encoder(spark):
    corpus = spark.createDataFrame([("d", "x", "red green"), ("d", "y", "blue")], "domain string, doc_id string, text string")
    queries = spark.createDataFrame([("d", 1, "<b>red</b>")], "domain string, query_id long, text string")
    scores = {r.doc_id: r.score for r in neural.score_pairs(run_of(spark, ["x", "y", "gone"]), queries, corpus).collect()}
    assert scores == {"x": 0.5, "y": 0.0}
    vectors = neural.encode(corpus, lambda ts: [[float(len(t))] for t in ts], "doc_id").collect()
    assert {r.doc_id: r.v for r in vectors} == {"x": [9.0], "y": [4.0]}
