import random

import numpy as np
import xxhash

from trawl.llm import simhash as S
from trawl.llm.components import components


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in low).split(" ") if w]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, codes, distance):
    parent = list(range(len(codes)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= distance:
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(d, least.get(root(i), d))
    return [least[root(i)] for i in range(len(codes))]


def test_fingerprint():
    for t in ["", " \t", "a", "One two", "a b c d", "a b c d e", "A\x0bB  c\nd É é e f " * 9, "x" * 50_000, "w w v u t\x1cs r q"]:
        assert S.fingerprint(t) == brute_print(t)


def balls(r, centres, each):
    out = []
    for _ in range(centres):
        c = r.getrandbits(64)
        for _ in range(each):
            x = c
            for _ in range(r.randint(0, 5)):
                x ^= 1 << r.randrange(64)
            out.append(x)
    return out


def test_index_finds_every_link():
    r = random.Random(3)
    codes = np.array(sorted(set(balls(r, 20, 30))), dtype=np.uint64)
    route = np.array([i % 3 for i in range(len(codes))])
    order = np.lexsort((S.gray_rank(codes), route))
    codes, route = codes[order], route[order]
    index = S.GrayIndex(codes, route)
    a, b = index.links(np.arange(len(codes)), route)
    want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if route[i] == route[j] and int(codes[i] ^ codes[j]).bit_count() <= 4}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want and len(want) > 100


def test_components_of_fingerprints(spark):
    r = random.Random(5)
    codes = balls(r, 12, 40)
    ids = list(range(1000, 1000 + len(codes)))
    want = brute_components(ids, codes, 4)
    table = spark.createDataFrame([(d, c - (1 << 64) if c >> 63 else c) for d, c in zip(ids, codes, strict=True)], "doc_id long, _fp long")
    got = {r_.doc_id: r_.component_id for r_ in table.join(S.label(table), "_fp").collect()}
    assert [got[d] for d in ids] == want
    few = S.edges(table.select("_fp").distinct(), hot=20, block=10)  # dealt as pairs of blocks
    got = {x.node: x.component for x in components(few).collect()}
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    by = {}
    for c, w in zip(signed, want, strict=True):
        by.setdefault(w, set()).add(got.get(c, c))
    assert all(len(x) == 1 for x in by.values()) and len(set.union(*by.values())) == len(by)


def test_tables(spark):
    schema = "_fp string, doc_id long, text string, component_id int"
    rows = [("x", 5, "a b c d e f", 1), (None, 3, "A b c d e f", 2), ("y", None, "a b c d e f", 3), ("z", 8, None, 4), ("z", 9, " ", 5), ("z", 9, " ", 5), ("q", None, "other words here now ok", 6)]
    t = spark.createDataFrame(rows, schema)
    got = {(r.doc_id, r.fingerprint): r.component_id for r in S.cluster(t).collect()}
    same = f"{brute_print('a b c d e f'):016x}"
    assert got[(5, same)] == got[(3, same)] == got[(None, same)] == 3 and got[(8, "0" * 16)] == got[(9, "0" * 16)] == 8
    kept = sorted((r._fp or "", r.doc_id or -1) for r in S.deduplicate(t).collect())
    assert kept == [("", 3), ("q", -1), ("z", 8)] and S.deduplicate(t).columns == t.columns
    empty = spark.createDataFrame([], schema)
    assert S.cluster(empty).count() == 0 and S.deduplicate(empty).count() == 0


def test_components_of_a_path(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(path).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
