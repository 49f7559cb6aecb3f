import random
import zlib
from collections import defaultdict

import corpus_pipeline as C
import numpy as np
import public_tokenizers as P
from test_pii import brute
from test_quality import WORDS
from test_simhash import brute_components, brute_print
from tokenizers import Tokenizer

from trawl.llm import catalogue
from trawl.llm import quality as Q

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def made(n=260):
    r = random.Random(11)
    out = []
    for i in range(n):
        grade = r.choice([0, 1, 2, 2, 2, 2])
        words = [r.choice(WORDS) + r.choice(["", "", "s", str(r.randint(0, 400))]) for _ in range(r.randint(20, 60))]
        if grade == 0:
            words = [w.upper() + "!!" for w in words]
        if grade == 1:
            words.insert(3, "vile")
        if i % 9 == 0:
            words.insert(5, f"mail{i}@host.org or +49 30 {1000000 + i}")
        out.append([i, " ".join(words), grade])
    for i in range(0, 60, 4):
        out.append([n + i, out[i][1].upper() if out[i][2] else out[i][1], out[i][2]])  # exact copies but for case
        out.append([n + i + 1, out[i + 1][1] + " ", out[i + 1][2]])
    return out


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_against_brute_force(spark, tmp_path):
    rows = made()
    folder = f"file://{tmp_path}"
    docs = [(i, t, "en", "s", len(t)) for i, t, _ in rows] + [(9000, None, None, None, None), (9001, "", "en", None, 0)]
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(g > 0), int(g == 1)) for i, _, g in rows if i % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    got = C.run(spark, folder).collect()

    model = catalogue.quality_model(spark, folder)
    kept = [(d[0], d[1]) for d, p in zip(docs, model.tails([Q.features(d[1]) for d in docs])[:, -1], strict=True) if p >= model.cut]
    assert 0 < len(kept) < len(docs)
    groups = defaultdict(list)
    for i, t in kept:
        groups[lower(t)].append((i, t))
    kept = [max(g) if len(g) > 1 else g[0] for g in ([(i, t or "") for i, t in g] for g in groups.values())]
    kept.sort()
    label = brute_components([i for i, _ in kept], [brute_print(t) for _, t in kept], 4)
    kept = [k for k, c in zip(kept, label, strict=True) if k[0] == c]
    clean = {}
    for (i, t), spans in zip(kept, brute([(i, t) for i, t in kept]), strict=True):
        out, at = "", 0
        for a, b, k in sorted((s[1], s[2], s[0]) for s in spans):
            if b > at:
                out += t[at : max(a, at)] + ("" if k == "term" or a < at else f"[{k.upper()}]")
                at = b
        clean[i] = out + t[at:]
    assert any("[EMAIL]" in t for t in clean.values())
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for i, t in clean.items():
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert len(ids) <= 1024
        want.append((i, 0, 0, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    fill = defaultdict(int)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill[r.sequence_id]
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024


def test_columns_and_empty_input(spark):
    empty = spark.createDataFrame([], DOCS)
    for _, stage in C.STAGES[1:4]:
        assert stage(spark, empty, "").columns == empty.columns and stage(spark, empty, "").count() == 0
    assert C.STAGES[4][1](spark, empty, "").count() == 0
    assert len(C.STAGES) == 5 and C.ORACLE_SQL is None


def test_near_stage_drops_near_copies(spark):
    """Against brute force: no two kept texts have Jaccard similarity 0.8 or more over five words."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    texts = [[word() for _ in range(r.randint(60, 200))] for _ in range(40)]
    for k in range(30):
        copy = list(texts[k])
        for _ in range(1 + k % 6):
            copy[r.randrange(len(copy))] = word()
        texts.append(copy)
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(100, "Two words."), (101, "two, words"), (102, None), (103, "words two")]
    grams = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in ([w.strip(".,") for w in lower(x).split()] for _, x in docs)]
    prints = [brute_print(t) for _, t in docs]
    parent = list(range(len(docs)))
    root = lambda x: x if parent[x] == x else root(parent[x])
    missed = 0
    for j in range(len(docs)):
        for i in range(j):
            close, alike = (prints[i] ^ prints[j]).bit_count() <= 4, docs[i][1] and docs[j][1] and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])
            missed += bool(alike and not close)
            if close or alike:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert missed > 5
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], DOCS).repartition(3)
    got = C.near_stage(spark, table, "")
    assert got.columns == table.columns and sorted(x.doc_id for x in got.collect()) == [d[0] for k, d in enumerate(docs) if root(k) == k]
