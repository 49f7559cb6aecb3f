import random

import numpy as np

from trawl.llm import passages as P

SCHEMA = "h int, doc_id long, text string, _row string"


def sentence(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n)).capitalize() + "."


def text(r, n=12):
    return " ".join(sentence(r, r.randint(3, 18)) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(1, i, t, "x") for i, t in rows], SCHEMA).repartition(3)


def jaccard(a, b):
    a, b = P.shingles(a), P.shingles(b)
    return len(a & b) / len(a | b)


def test_planted_passages(spark):
    r = random.Random(1)
    passage = " ".join(sentence(r, 12) for _ in range(5))
    near = passage.split(" ")
    near[40] = "changed"
    rows = [(i, text(r)) for i in range(60)]
    short = sentence(r, 10)
    for k, i in enumerate((3, 8, 21)):
        words = rows[i][1].split(" ")
        words[20 + k : 20 + k] = [passage.upper() if k == 1 else " ".join(near) if k == 2 else passage]
        rows[i] = (i, " ".join(words))
    for i in (30, 31, 32):
        rows[i] = (i, rows[i][1] + " " + short)  # too short to be a passage
    rows += [(100, rows[5][1]), (101, rows[5][1] + " More at the end of this."), (None, rows[6][1]), (102, None), (103, ""), (104, rows[7][1]), (104, rows[7][1])]
    got = P.repeats(table(spark, rows)).collect()
    ids = sorted({r_.doc_id for r_ in got if r_.doc_id is not None})
    assert ids == [3, 5, 6, 7, 8, 21, 100, 101, 104]
    by = {r_.doc_id: r_ for r_ in got}
    assert by[3].component_id == 3 and not by[3].removed and by[8].removed and by[21].component_id == 3 and by[None].component_id == 6 and by[None].removed
    whole = {i: t for i, t in rows}
    assert passage.lower().endswith(whole[8][by[8].start : by[8].end].lower()[-60:]) or whole[8][by[8].start : by[8].end].lower() in passage.lower() or by[8].n_words >= 40
    again = P.repeats(table(spark, rows), hot=1, block=1).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert P.repeats(table(spark, [])).count() == 0


def test_places():
    r = random.Random(2)
    texts = ["Éin Wort. " + text(r, 4), "", text(r, 3).replace(" ", "\n", 9), "no"]
    import pyarrow as pa

    batch = pa.record_batch([pa.array([0, 1, 2, 3]), pa.array([10, 11, 12, None], pa.int64()), pa.array(texts)], names=["_row", "doc_id", "text"])
    out = [x for b in P._unit_batches(iter([batch]), 5) for x in b.to_pylist()]
    words = {x["h"]: x["words"] for x in out if not x["is_window"]}
    keys = [x for b in P._key_batches(iter([batch]), 5) for x in b.to_pylist()]
    assert {k["h"] for k in keys if k["b0"] is not None} == set(words) == {u["h"] for u in out if not u["is_window"]}
    plain = [u for u in out if not u["is_window"]]
    for u in plain:
        piece = texts[u["_row"]][u["start"] : u["end"]]
        assert piece.encode() == words[u["h"]]
    assert all(u["n_words"] >= P.SHINGLE for u in plain)
    short = [u for u in plain if u["n_words"] < P.LEAST]
    for u in short:  # only before a longer sentence, or words that are too few for a paragraph, or at the end of a text
        after = texts[u["_row"]][u["end"] :].lstrip(".!? \n")
        assert len(after.split(".")[0].split()) + u["n_words"] >= P.LEAST or len(after.split()) < P.LEAST


def brute(rows):
    """Words that go, words that stay in clusters, and the clusters, from all pairs of paragraphs; rows in order of doc_id."""
    import pyarrow as pa

    batch = pa.record_batch([pa.array(range(len(rows))), pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows])], names=["_row", "doc_id", "text"])
    units = [x for b in P._unit_batches(iter([batch]), 5) for x in b.to_pylist()]
    words = {x["h"]: P.shingles(x["words"]) for x in units if not x["is_window"]}
    label = {h: h for h in words}
    find = lambda h: h if label[h] == h else find(label[h])
    hs = sorted(words)
    for k, x in enumerate(hs):
        for y in hs[:k]:
            if len(words[x] & words[y]) >= 0.8 * len(words[x] | words[y]):
                label[find(x)] = find(y)
    clusters = {}
    for u in units:
        clusters.setdefault((u["is_window"], u["h"] if u["is_window"] else find(u["h"])), []).append(u)
    clusters = {k: sorted(v, key=lambda u: (u["doc_id"], u["place"])) for k, v in clusters.items() if len({u["doc_id"] for u in v}) > 1}
    span = lambda u: {(u["doc_id"], w) for w in range(u["place"], u["place"] + u["n_words"])}
    stay = set().union(*[span(v[0]) for v in clusters.values()])
    go = set().union(*[span(u) for v in clusters.values() for u in v]) - stay
    return go, stay, clusters


def test_against_brute_force(spark):
    """Each cluster keeps its first occurrence whole, the others go, and nothing else does."""
    r = random.Random(6)
    parts = [sentence(r, r.randint(3, 30)) for _ in range(60)]
    rows = []
    for i in range(50):
        some = [r.choice(parts) if r.random() < 0.5 else sentence(r, r.randint(3, 20)) for _ in range(r.randint(1, 12))]
        for k, x in enumerate(some):
            if r.random() < 0.2 and len(w := x.split(" ")) > 6:
                w[r.randrange(len(w))] = "edited"
                some[k] = " ".join(w)
        rows.append((i, " ".join(some)))
    go, stay, clusters = brute(rows)
    assert go and stay
    got, kept = set(), set()
    for x in P.repeats(table(spark, rows), passage=1).collect():
        first = len(rows[x.doc_id][1][: x.start].split())
        (got if x.removed else kept).update((x.doc_id, w) for w in range(first, first + x.n_words))
    assert got == go and kept == stay
    for v in clusters.values():
        assert not any((v[0]["doc_id"], w) in got for w in range(v[0]["place"], v[0]["place"] + v[0]["n_words"]))


def test_decided_by_paragraph(spark):
    r = random.Random(7)
    p1, p2 = sentence(r, 30), sentence(r, 30)
    got = P.repeats(table(spark, [(1, p1), (2, p1 + " " + p2), (3, p2)])).collect()
    assert sorted((x.doc_id, x.removed, x.n_words, x.component_id) for x in got) == [(1, False, 30, 1), (2, False, 30, 2), (2, True, 30, 1), (3, True, 30, 2)]
    own = " ".join(sentence(r, 9) for _ in range(4))
    rows = [(1, p1 + " " + own + " " + p2), (2, p1 + " " + sentence(r, 3) + " " + p2), (3, "")]
    gone = [(x.doc_id, x.n_words) for x in P.repeats(table(spark, rows)).collect() if x.removed]
    assert sorted(gone) == [(2, 30), (2, 30)]


def test_sieve(spark):
    r = np.random.default_rng(0)
    values = np.unique(r.integers(-(2**63), 2**63 - 1, 3000))
    frame = spark.createDataFrame([(int(v),) for v in values], "v long")
    for most in (P.SIEVE, 64, 1 << 12):
        s = P.sieve(frame, most).value
        assert s.passes(values).all() and s.bits <= max(most, 64)
    assert P.sieve(frame).value.passes(r.integers(-(2**63), 2**63 - 1, 3000)).mean() < 0.2
    assert not P.sieve(frame.where("v IS NULL")).value.passes(values).any()


def test_windows():
    r = np.random.default_rng(1)
    hashes, text = r.integers(0, 2**63, 900).astype(np.uint64), np.sort(r.integers(0, 5, 900))
    whole = P.run_hashes(hashes, P.PASSAGE)
    want = set()
    for s in range(len(whole) - P.CHOICE + 1):
        if text[s] == text[s + P.PASSAGE + P.CHOICE - 2]:
            want.add(s + int(whole[s : s + P.CHOICE].argmin()))
    assert P._windows(hashes, text)[0].tolist() == sorted(want)
    assert len(P._windows(hashes[:20], text[:20])[0]) == 0


def test_tuning():
    for s in (0.5, 0.8, 0.9):
        for rows in (1, 2, 3):
            n = P.tuned(s, rows, 0.99)
            assert 1 - (1 - s**rows) ** n >= 0.99 > 1 - (1 - s**rows) ** (n - 1)


def test_very_long_text(spark):
    r = random.Random(8)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(5000)]
    long = " ".join(r.choice(words) + ("." if k % 17 == 0 else "") for k in range(400_000))
    got = P.repeats(table(spark, [(1, long), (2, long[:1000]), (3, long + " end")])).collect()
    by = {(x.doc_id, x.removed) for x in got}
    assert (1, False) in by and (3, True) in by and (2, True) in by and (1, True) not in by
    assert sum(x.n_words for x in got if x.doc_id == 3 and x.removed) > 390_000


def test_exact_jaccard_in_both_forms():
    r = random.Random(3)
    base = [sentence(r, 30).lower().split(" ") for _ in range(6)]
    many = []
    for k in range(90):
        w = list(base[k % 6])
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = "zz"
        many.append(" ".join(w).encode())
    sets = [P.shingles(m) for m in many]
    link = np.array([[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets])
    label = np.arange(len(sets))
    for _ in sets:
        label = np.where(link, label[None, :], len(sets)).min(axis=1)
    assert (P.similar(sets, 0.8) == label).all()
    for at in range(0, 90, 9):
        part = slice(at, at + 9)
        want = np.arange(9)
        for _ in range(9):
            want = np.where(link[part, part], want[None, :], 9).min(axis=1)
        assert (P.similar(sets[part], 0.8) == want).all()


def test_recall_of_exact_repeats(spark):
    """Against brute force: every word-for-word repeat of over 50 words meets a reported passage in both texts."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    line = lambda n: [word() for _ in range(n)]
    docs = [line(r.randint(60, 400)) for _ in range(40)]  # lines without a full stop
    kinds = []
    for k in range(0, 40, 2):
        passage = line(51 + k % 5)
        if k % 4 == 0:
            passage = [w + "." * (i % 4 == 3) for i, w in enumerate(passage)]  # sentences of four words
        kinds.append(passage)
        for d in (docs[k], docs[k + 1]):
            at = r.randint(0, len(d))
            d[at:at] = passage
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    # brute force: all runs of 51 words that two documents have
    where = {}
    for i, d in enumerate(docs):
        plain = [w.strip(".") for w in d]
        for at in range(len(plain) - 50):
            where.setdefault(" ".join(plain[at : at + 51]), []).append((i, at))
    want = [x for v in where.values() if len({i for i, _ in v}) > 1 for x in v]
    assert len(want) >= 40
    got = {}
    for x in P.repeats(table(spark, rows)).collect():
        text = rows[x.doc_id][1]
        first = len(text[: x.start].split())
        got.setdefault(x.doc_id, []).append((first, first + x.n_words))
        assert len(text[x.start : x.end].split()) == x.n_words
    assert all(any(a < at + 51 and b > at for a, b in got.get(i, [])) for i, at in want)
    assert set(got) == set(range(40))
