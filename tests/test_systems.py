import json
import os
import subprocess
import sys

import pytest

from trawl.plans import pipeline as P
from trawl.sources import readers, writers
from trawl.streaming.append import append, finished

SPARSE = {"kind": "sparse", "query_form": "title_weighted", "tokenizer": "nohtml_stop", "model": "bm25", "k1": 0.9, "b": 0.4, "depth": 100}
TUNED = {**SPARSE, "k1": 2.0, "b": 0.9}


def test_fingerprints():
    # fixed values: fingerprints of known systems
    assert P.fingerprint(P.system({"retrieve": SPARSE})) == "af3eb864b4b2"
    assert P.fingerprint(P.system({"retrieve": TUNED})) == "f326339da67a"
    for expand, want in ((1, "81353d99b661"), (2, "9bfc734c9e7c"), (3, "c4c9b2577b4a")):
        deduped = P.system({"retrieve": TUNED, "dedup": {"kind": "content_hash", "expand": expand}, "rerank": None})
        assert P.fingerprint(deduped) == want and P.fingerprint(deduped, "retrieve") == "f326339da67a"
    assert P.fingerprint(P.system({"retrieve": SPARSE, "fuse": {"kind": "none"}})) != "af3eb864b4b2"
    assert P.fingerprint(P.system({"retrieve": SPARSE}), split="dev") != "af3eb864b4b2"


def test_configs():
    with pytest.raises(ValueError):
        P.system({"retrieve": SPARSE, "other": 1})
    with pytest.raises(ValueError):
        P.register("other", "kind")
    assert P.differences(P.system({"retrieve": SPARSE}), P.system({"retrieve": TUNED})) == ["retrieve.b", "retrieve.k1"]
    assert P.describe({"retrieve": {"kind": "sparse", "b": 1}}) == ["retrieve: sparse, b=1"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    for d in ("d1", "d2"):
        (root / d).mkdir()
        docs = [{"id": f"{d}/{i}", "content": None if i == 7 else f"text number{i} {'apple' if i % 3 == 0 else 'pear'}"} for i in range(9)] + [{"id": f"{d}/twin", "content": f"Text  number0 apple"}]
        (root / d / "documents.jsonl").write_text("\n".join(map(json.dumps, docs)) + "\n\n")
        (root / d / "examples_train.jsonl").write_text(json.dumps({"id": f"{d}q", "query": "number0 <p>apple</p>", "gold_ids": [f"{d}/0"]}) + "\n")
        (root / d / "qrels_train.txt").write_text(f"{d}q 0 {d}/0 1\n{d}q 0 {d}/0 2\n{d}q\t0  {d}/3 0\n")
        (root / d / "guidance_train.jsonl").write_text(json.dumps({"id": f"{d}q", "query_guidance": {"expected_granularity": "day", "is_temporal_query": True, "key_time_anchors": ["1999"]}}) + "\n")
    return f"file://{root}"


def context(spark, folder, **more):
    return P.Context(spark, readers.corpus(spark, folder), readers.queries(spark, folder).drop("gold_ids"), **more)


def test_readers(spark, folder):
    assert readers.domains(spark, folder) == ["d1", "d2"]
    corpus = readers.corpus(spark, folder)
    assert corpus.count() == 20 and corpus.where("text = ''").count() == 2
    assert [r.doc_id for r in corpus.where("domain = 'd1'").orderBy("pos").limit(3).collect()] == ["d1/0", "d1/1", "d1/2"]
    gold = readers.qrels(spark, folder)
    assert {tuple(r) for r in gold.collect()} == {("d1", "d1q", "d1/0"), ("d2", "d2q", "d2/0")}
    assert readers.gold_consistency(readers.queries(spark, folder), gold).count() == 0
    assert readers.guidance(spark, folder).where("is_temporal_query").count() == 2
    assert readers.prefix(corpus, 2).count() == 4


def test_records_and_tables(spark, folder, tmp_path):
    cache, gold = f"file://{tmp_path}/runs", readers.qrels(spark, folder)
    split = spark.createDataFrame([("d1", "d1q", "fit"), ("d2", "d2q", "check")], "domain string, query_id string, part string")
    c = context(spark, folder, cache=cache)
    configs = [{"name": "bm25", "retrieve": {"kind": "sparse"}}, {"name": "and", "retrieve": {"kind": "sparse", "model": "boolean_and"}}]
    first = P.record(c, configs[0], gold, split).first()
    _, _, macro = P.score(c, configs[0], gold)
    assert first.ndcg == macro.first().ndcg and (first.fit_n_topics, first.check_n_topics, first.n_gold_queries) == (1, 1, 2)
    assert (first.fit_ndcg + first.check_ndcg) == pytest.approx(first.ndcg) and first.score_version == P.SCORE_VERSION
    none = spark.createDataFrame([], gold.schema)
    assert P.record(c, configs[0], none, split).first() == first  # from the cache
    assert P.record(c, configs[0], none, split, force=True).first().n_gold_queries == 0
    P.record(c, configs[0], gold, split, force=True)
    rows = P.table(c, configs, gold, split, "fit").orderBy("place").collect()
    assert [r.place for r in rows] == [1, 2] and not any(r.incomplete for r in rows) and rows[0].fit_ndcg >= rows[1].fit_ndcg
    later = context(spark, folder, cache=cache)
    assert later.registry == c.registry and {r.name: r.ndcg is not None for r in P.listing(later).collect()} == {"bm25": True, "and": True}
    assert P.listing(context(spark, folder)).count() == 0
    path = tmp_path / "mine.json"
    path.write_text(json.dumps({"retrieve": {"kind": "sparse"}}))
    assert P.system(path)["name"] == "mine" and P.system({"name": "x"})["name"] == "x" and P.system({})["name"] == "system"


def test_run_cache_and_score(spark, folder, tmp_path):
    cache = f"file://{tmp_path}/runs"
    config = {"name": "a", "retrieve": {"kind": "sparse"}, "dedup": {"kind": "content_hash"}}
    c = context(spark, folder, cache=cache)
    first = P.run(c, config).orderBy("domain", "query_id", "rank").collect()
    again = context(spark, folder, cache=cache)
    assert P.run(again, {**config, "name": "b"}).orderBy("domain", "query_id", "rank").collect() == first and not again.indexes
    P.run(c, {**config, "name": "b"})
    assert [e["aliases"] for e in c.registry.values()] == [["b"]]
    assert [r.doc_id for r in first if r.domain == "d1"][0] == "d1/0" and not [r for r in first if r.doc_id.endswith("twin")]
    _, domains, macro = P.score(c, config, readers.qrels(spark, folder))
    assert domains.count() == 2 and macro.first().ndcg == 1.0
    result, changed = P.compare(c, config, {"retrieve": {"kind": "sparse", "b": 0.9}}, readers.qrels(spark, folder), resamples=20)
    assert changed == ["dedup.kind", "retrieve.b"] and result.first().point == 0.0
    with pytest.raises(ValueError):
        P.run(c, {"name": "none"})
    with pytest.raises(KeyError):
        P.run(c, {"retrieve": {"kind": "unknown"}})
    fused = P.run(c, {"retrieve": {"kind": "sparse", "model": "tf"}, "rerank": {"kind": "none"}, "fuse": {"kind": "rrf", "sources": ["a"]}})
    assert fused.where("rank = 1").count() == 2


def test_jobs_and_files(spark, folder, tmp_path):
    c = context(spark, folder)
    run = P.run(c, {"retrieve": {"kind": "sparse"}})
    path = f"file://{tmp_path}"
    writers.run_file(run, f"{path}/run")
    back = readers.run_file(spark, f"{path}/run")
    assert back.count() == run.count() and back.join(run, ["domain", "query_id", "rank", "doc_id"]).count() == run.count()
    pairs = writers.job(run, c.queries, f"{path}/job", "j1", "rerank", "train", "hash", depth=3, corpus=c.corpus)
    manifest, candidates, queries = readers.job(spark, f"{path}/job")
    assert pairs == 6 == manifest["pairs"] and candidates.count() == 2 and queries.first().t == "number0 apple"
    assert readers.job_documents(spark, f"{path}/job").count() == 6
    lines = [{"job_id": "j1", "d": "d1", "q": "d1q", "i": ["d1/1"], "s": [0.1]}, {"job_id": "j1", "d": "d1", "q": "d1q", "i": ["d1/3", "d1/1"], "s": [0.9, 0.8]}, {"job_id": "j2", "d": "d1", "q": "d1q", "i": ["d1/2"], "s": [1.0]}]
    (tmp_path / "scores.jsonl").write_text("\n".join(map(json.dumps, lines)))
    scores = readers.scores(spark, f"{path}/scores.jsonl", "j1")
    assert [r.doc_id for r in scores.orderBy("rank").collect()] == ["d1/3", "d1/1"]
    c.jobs["j1"] = scores
    reranked = P.run(c, {"retrieve": {"kind": "sparse"}, "rerank": {"kind": "gpu_job", "job": "j1"}})
    assert [r.doc_id for r in reranked.where("domain = 'd1'").orderBy("rank").limit(2).collect()] == ["d1/3", "d1/1"]
    assert P.run(c, {"retrieve": {"kind": "gpu_job", "job": "j1", "depth": 1}}).count() == 1
    writers.submission(run, f"{path}/trec", "tag", 5)
    assert spark.read.text(f"{path}/trec").count() == 10 and spark.read.text(f"{path}/trec").first()[0].split(" ")[1] == "Q0"
    scores = {(r.query_id, r.doc_id): f"{r.score:.6f}" for r in run.collect()}
    assert all(scores[x[0].split(" ")[0], x[0].split(" ")[2]] == x[0].split(" ")[4] for x in spark.read.text(f"{path}/trec").collect())
    with pytest.raises(ValueError):
        writers.submission(run.withColumn("rank", run["rank"] + 1), f"{path}/bad", "tag", 5)
    assert not os.path.exists(tmp_path / "bad")
    writers.term_list(c.index("nohtml_stop").lexicon(), f"{path}/terms")
    assert spark.read.csv(f"{path}/terms", sep="\t").count() > 5


def test_resumed_append(spark, tmp_path):
    path = f"file://{tmp_path}/sink"
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "domain string, x int")
    assert finished(spark, path) is None
    append(rows.where("domain = 'a'"), path)
    append(rows, path)
    append(rows, path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("domain", "x").collect()) == [("a", 1), ("b", 2)]


def test_entry(spark):
    import __spark_entry__ as E

    names = E.queries()
    assert E.oracle_sql().keys() <= names.keys() and len(names) > 80
    assert E.entry(spark).limit(5).count() == 5


def test_works_without_the_optional_subpackage():
    code = "import sys; sys.modules['trawl.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 60 and not [q for q in e.queries() if q.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(__file__)))
