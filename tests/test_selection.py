import pytest
from pyspark.sql import functions as F

from tests.test_systems import context, folder  # noqa: F401
from trawl.operators import stats
from trawl.operators.index import build
from trawl.operators.search import Weighting, search
from trawl.plans import pipeline as P
from trawl.plans import selection
from trawl.sources import readers


def test_rules(spark):
    def records(column, values):
        return {k: spark.createDataFrame([(float(v),)], f"{column} double") for k, v in values.items()}

    base = records("recall", {0: 0.9})[0]
    assert selection.smallest_expand(base, records("recall", {3: 0.9, 2: 0.8985, 1: 0.897})) == (2, [2, 3])
    assert selection.smallest_expand(base, records("recall", {1: 0.5, 2: 0.6})) == (2, [])
    assert selection.best_parameter(records("fit_ndcg", {500.0: 0.2, 1000.0: 0.3, 2000.0: 0.3})) == (1000.0, False)
    assert selection.best_parameter(records("fit_ndcg", {500.0: 0.4, 1000.0: 0.3})) == (500.0, True)
    rows = [("a", 0.5, False), ("c", 0.5, False), ("b", 0.9, True)]
    table = spark.createDataFrame(rows, "name string, fit_ndcg double, incomplete boolean")
    assert selection.submission(table) == "a" and selection.submission(table.where("incomplete")) is None


def test_ladder(spark, folder, tmp_path):  # noqa: F811
    gold = readers.qrels(spark, folder)
    split = gold.select("domain", "query_id", F.lit("fit").alias("part")).distinct()
    # scores are reversed in one list: the last document first
    c = context(spark, folder, cache=f"file://{tmp_path}/runs")
    best = P.run(c, {"name": "x", "retrieve": {"kind": "sparse"}})
    c.jobs["worse"] = best.withColumn("score", F.col("rank").cast("double")).drop("rank")
    worse = {"name": "worse", "retrieve": {"kind": "gpu_job", "job": "worse"}}
    good = {"name": "good", "retrieve": {"kind": "sparse"}}
    steps, chosen = selection.ladder(c, [worse, good, {**good, "name": "same", "note": "x"}], gold, split, resamples=50)
    rows = steps.orderBy("place").collect()
    assert [r.beats for r in rows] == [None, True, False] and rows[2].gain == 0.0 and chosen == "good"
    assert selection.ladder(c, [good, worse], gold, split, resamples=50)[1] == "good"


def test_stored_groups(spark, folder, tmp_path):  # noqa: F811
    c = context(spark, folder, cache=f"file://{tmp_path}/runs")
    with pytest.raises(FileNotFoundError, match="store_groups"):
        P.stored_groups(c)
    assert sorted(map(tuple, P.store_groups(c).collect())) == [("d1", 2, 1), ("d2", 2, 1)]
    config = {"name": "a", "retrieve": {"kind": "sparse"}, "dedup": {"kind": "content_hash"}}
    fresh = context(spark, folder)
    assert sorted(P.run(c, config).collect()) == sorted(P.run(fresh, config).collect())
    c.corpus = c.corpus.where("false")
    assert P.store_groups(c).count() == 2 and P.store_groups(c, force=True).count() == 0


def test_functions_as_tokenizer_and_form(spark, folder):  # noqa: F811
    corpus, asked = readers.corpus(spark, folder), readers.queries(spark, folder)

    def words(column):
        return F.split(F.lower(F.coalesce(column, F.lit(""))), r"\s+")

    run = search(build(corpus, words), asked, Weighting("bm25"), 5, words, lambda t: F.concat_ws(" ", t, F.lit("number4")))
    first = run.where("rank = 1").collect()
    assert len(first) == 2 and all(r.doc_id in (f"{r.domain}/4", f"{r.domain}/0") or r.score > 0 for r in first)
    assert run.where("doc_id LIKE '%/4' AND score > 0").count() == 2


def test_statistics(spark):
    gold = spark.createDataFrame([("d", "q1", "d/0123abcd_1.txt"), ("d", "q1", "x"), ("d", "q2", "x"), ("d", "q2", "x")], "domain string, query_id string, doc_id string")
    assert tuple(stats.gold_counts(gold).first()) == (1.5, 1.5, 1, 2)
    corpus = spark.createDataFrame([("d", "d/0123abcd_1.txt"), ("d", "x"), ("d", "y"), ("d", "z"), ("e", "x")], "domain string, doc_id string")
    assert sorted(map(tuple, stats.short_id_shares(corpus, gold).collect())) == [("d", 25.0, 50.0, 2), ("e", 0.0, 0.0, 0)]
    assert stats.projections(0.5, 1.0) == pytest.approx({0.2: 0.6, 0.3: 0.65, 0.4: 0.7})
    assert stats.gold_counts(gold.where("false")).first()["mean"] is None
