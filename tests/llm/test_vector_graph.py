import numpy as np

from trawl.llm import vector_graph as V

SCHEMA = "v string, vec_id long, embedding array<float>, gid int"


def made(seed=0, n=600, d=16):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    centres = r.normal(size=(5, d))
    near = np.concatenate([c + r.normal(size=(40, d)) * s for c, s in zip(centres, (0.01, 0.1, 0.2, 0.3, 0.02), strict=True)])
    return np.concatenate([x, near, x[:30] * 3, x[:10]]).astype(np.float32)


def brute(x, cosine=0.9):
    u = V.unit(x)
    link = u @ u.T >= cosine
    np.fill_diagonal(link, False)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(link, label[None, :], len(x)).min(axis=1))
        if (new == label).all():
            return link, label
        label = new


def table(spark, rows):
    return spark.createDataFrame([("x", i, v, 7) for i, v in rows], SCHEMA)


def test_graph_reaches_all_and_search_finds():
    x = V.unit(made(1))
    lists = V.build(x)
    a, b = V.search(x, lists, np.arange(len(x)), 0.9)
    link, _ = brute(made(1))
    got = np.zeros_like(link)
    got[a, b] = True
    assert not (got & ~link).any() and (got | got.T)[link].mean() > 0.99


def test_against_brute_force(spark):
    x = made(2)
    t = table(spark, [(i + 100, v.tolist()) for i, v in enumerate(x)]).repartition(4)
    link, label = brute(x)
    for how in ({}, {"hot": 300, "block": 150}):
        got = {r.vec_id: r for r in V.link(t, **how).collect()}
        n = np.array([got[i + 100].n_links for i in range(len(x))])
        assert (n <= link.sum(axis=1)).all() and n.sum() >= 0.97 * link.sum()
        same = np.mean([got[i + 100].component_id == label[i] + 100 for i in range(len(x))])
        assert same > 0.97 and all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    share, links = V.audit(t, V.link(t), 200)
    assert share > 0.97 and links > 100


def test_odd_vectors(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [float("inf"), 1.0]), (7, [1.0, 1.0]), (8, [2.0, 2.0]), (9, [1.0, 1.0, 0.0]), (7, [1.0, 1.0]), (None, [1.0, 1.0]), (10, [-0.0, 1e30]), (11, [0.0, 1e30])]
    got = sorted(((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in V.link(table(spark, rows)).collect()))
    single = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 9)]
    assert got == sorted([*single, (7, 3, 7, True), (7, 3, 7, True), (-1, 3, 7, False), (8, 3, 7, False), (10, 1, 10, True), (11, 1, 10, False)])
    assert V.link(table(spark, [])).count() == 0


def test_doubles(spark):
    rows = [(1, [1e300, 0.0]), (2, [1e300, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1e-300]), (5, [float("inf"), 0.0])]
    got = {r.vec_id: r.n_links for r in V.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: 2, 2: 2, 3: 2, 4: 0, 5: 0}
    alone = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert V.audit(alone, V.link(alone)) == (1.0, 0)
