import math

import random

import numpy as np
import pyarrow as pa

from trawl.llm import quality as Q

SCHEMA = "doc_id long, text string, selected string, c0 int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def made(n, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        grade = r.choice([0, 1, 2, 2, 2])
        words = [r.choice(WORDS) for _ in range(r.randint(5, 60))]
        if grade == 0:
            words = [w.upper() + "!!" for w in words]
        if grade == 1:
            words.insert(r.randrange(len(words)), "vile")
        out.append((i, " ".join(words), grade))
    return out


def test_features():
    same = set(Q.features("same words, here!")) & set(Q.features("Same words, here!"))
    assert len(same) > 5
    long = ("word other " * 150_000) + "vile"  # in parts, to its end
    assert set(Q.features("vile")[:0]) == set() and len(set(Q.features(long)) & set(Q._mixed(Q._runs(np.frombuffer(b"vile", np.uint8))[0], Q.DIM))) == 1
    h1, _ = Q._runs(np.frombuffer(b"xx vile", np.uint8))
    h2, _ = Q._runs(np.frombuffer(b"vile", np.uint8))
    assert h1[1] == h2[0] and len(Q.features(None)) and (Q.features(None) == Q.features("")).all()
    assert len(Q.features("x" * (Q.PART * 2 + 5)))


def test_held_out_accuracy_and_order():
    rows = made(1500)
    x, g = [Q.features(t) for _, t, _ in rows], np.array([y for *_, y in rows])
    m = Q.train(x[:1000], g[:1000], 2)
    p = m.tails(x[1000:])
    assert (p[:, 0] >= p[:, 1] - 1e-12).all() and (np.diff(m.thresholds) >= 0).all()
    assert ((p > 0.5).sum(axis=1) == g[1000:]).mean() > 0.97


def test_tables(spark):
    rows = made(400)
    docs = spark.createDataFrame([(i, t, "keep", 7) for i, t, _ in rows] + [(None, None, None, None), (9000, "", None, None), (9000, "", None, None)], SCHEMA)
    ratings = spark.createDataFrame([(i, g) for i, _, g in rows if i % 2] + [(None, 1), (3, None), (99_999, 0)], "doc_id long, grade int")
    model = Q.fit(docs, ratings, 2)
    got = Q.score(docs, model).collect()
    assert len(got) == docs.count()
    chosen = {r.doc_id for r in got if r.selected}
    right = [(g == 2) == (i in chosen) for i, _, g in rows if not i % 2]
    assert sum(right) / len(right) > 0.9
    assert all(abs(r.expected_grade - r.p_ge_1 - r.p_ge_2) < 1e-9 for r in got)
    kept = Q.select(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == chosen
    assert {r.selected for r in kept.collect()} <= {"keep", None}


def test_without_ratings_or_rows(spark):
    docs = spark.createDataFrame([(1, "a", None, 1)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, grade int")
    model = Q.fit(docs, none, 2)
    assert Q.select(docs, model).count() == 1 and Q.score(docs.limit(0), model).count() == 0


def test_repeated_rows_of_a_rated_document(spark):
    """What is fitted on is one row for each rating, however often its document is there."""
    rows = [(i, f"good words here {i % 7}" if i % 2 else f"junk junk {i % 5}") for i in range(200)]
    ratings = spark.createDataFrame([(i, 2 if i % 2 else 0) for i in range(200)], "doc_id long, grade int")
    once = Q.fit(spark.createDataFrame(rows, "doc_id long, text string"), ratings, 2)
    many = Q.fit(spark.createDataFrame(rows + rows[:50] * 40, "doc_id long, text string"), ratings, 2)
    assert (once.weights == many.weights).all() and once.cut == many.cut and (once.thresholds == many.thresholds).all()


def brute_scores(model, texts):
    """Expected grade and selection, document by document, from features counted one by one."""
    out = []
    for t in texts:
        score = sum(float(model.weights[k]) for k in Q.features(t, len(model.weights)))
        tails = [1 / (1 + math.exp(-(score - x))) for x in model.thresholds]
        out.append((sum(tails), tails[-1] >= model.cut))
    return out


def test_scores_against_brute_force(spark):
    rows = [(i, f"good words here {i}" if i % 2 else f"junk junk {i % 5}" if i % 3 else None) for i in range(200)] + [(200, ""), (None, "good words " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = Q.fit(docs, spark.createDataFrame([(i, 2 if i % 2 else i % 4 // 2) for i in range(200)], "doc_id long, grade int"), 2)
    got = {r.doc_id: (r.expected_grade, r.selected) for r in Q.score(docs, model).collect()}
    for (i, _), (grade, chosen) in zip(rows, brute_scores(model, [t for _, t in rows]), strict=True):
        assert abs(got[i][0] - grade) < 1e-4 and got[i][1] == chosen


def test_the_driver_meets_only_the_model(spark, monkeypatch):
    """The rated documents' features go to the task that fits, which finds what fitting them here finds."""
    rows = made(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    ratings = spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, grade int")
    here = Q._fitted(pa.table([[i for i, *_ in rows], [g for *_, g in rows], [Q.features(t) for _, t, _ in rows]], schema=Q._ON), 2, Q.KEEP, Q.DIM)
    fitted = []
    monkeypatch.setattr(Q, "train", lambda rows, *a, **b: fitted.append(len(rows)))
    monkeypatch.setattr(type(docs), "toArrow", lambda self: fitted.append(-1))
    model = Q.fit(docs, ratings, 2)
    assert fitted == []
    assert (model.weights == here.weights).all() and (model.thresholds == here.thresholds).all() and model.cut == here.cut
