import math
import re
from collections import Counter, defaultdict
from hashlib import sha256

import regex

from trawl.llm import pii

SCHEMA = "doc_id long, text string, _text string, _row int"
RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub(r"[ -]", "", m)) <= 19 and luhn(re.sub(r"[ -]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub(r"[^0-9]", "", m)) <= 15),
]


def luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, digits[::-1]))) % 10 == 0


def base(text):
    return [(k, m.start(), m.end(), m[0]) for k, rx, ok in RULES for m in re.finditer(rx, text or "") if ok(m[0])]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in spans)


def classes(kind, match):
    digits = re.sub(r"[^0-9]", "", match)
    near = {"email": "@" + match.split("@")[-1].lower(), "ip": "/" + ".".join(match.split(".")[:2]), "card": "/" + digits[:6], "phone": "/" + digits[:5]}[kind]
    return {kind, kind + near, f"{kind}:{digits if kind in ('card', 'phone') else match.lower()}"}


def brute(rows, disclosure=pii.DISCLOSURE, strength=pii.STRENGTH, context=pii.CONTEXT):
    """All spans of each row, by the definition."""
    term = regex.compile(r"[\p{L}\p{N}]+")
    texts = [r[1] or "" for r in rows]
    found = [base(t) for t in texts]
    free = []
    for t, s in zip(texts, found, strict=True):
        for _, a, b, _ in s:
            t = t[:a] + " " * (b - a) + t[b:]
        free.append([(m.start(), m.end(), m[0].lower()) for m in term.finditer(t)])
    of = [set().union(*[classes(k, m) for k, _, _, m in s]) for s in found]
    n, ng, nt, ntg, kinds = len(rows), Counter(g for c in of for g in c), Counter(), Counter(), defaultdict(set)
    for t, s, f in zip(texts, found, free, strict=True):
        nt.update({m[0].lower() for m in term.finditer(t)})
        beside = {(g, w) for k, a, b, m in s for x, y, w in f if y > a - context and x < b + context for g in classes(k, m)}
        ntg.update(beside)
        for x in beside:
            kinds[x].add(t)
    risky = set()
    for (g, w), c in ntg.items():
        p, m = ng[g] / n, len(kinds[g, w])
        if nt[w] and math.log2((m * min(1, c / nt[w]) + strength * p) / (m + strength) / p) >= -disclosure * math.log2(p):
            risky.add((g, w))
    return [s + [("term", a, b) for a, b, w in f if any((g, w) in risky for g in c)] for s, f, c in zip(found, free, of, strict=True)]


TEXTS = [
    "mail a.b@c.de now, a@b.co@d.com a@b.c_d@e.f x@y z@q.r. ümläut+q@h-i.j", "ip 1.2.3.4.5.6.7.8 and 256.1.1.1 0255.001.2.3 1.2.3 10.0.0.1", "card 4111 1111 1111 1111 or 4111-1111-1111-1112 5 4111111111111111",
    "call +1 (555) 123-4567 or +49 30 1234 5678. +1 2 +++1 234567890123456 +12345678", "", None, "日本 a@b.cd 日本 10.1.1.1😀 +1 555 123 4567", "a" * 20_000, "1 " * 20_000, "1.2.3.4 " * 3_000, "x@" * 5_000,
]


def check(spark, rows, **how):
    got = pii.detect(spark.createDataFrame(rows, SCHEMA), **how).collect()
    want = brute(rows, **how)
    counts = lambda s: tuple(sum(x[0] == k for x in s) for k, *_ in RULES)
    assert sorted((r.doc_id or -1, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in got) == sorted(
        (r[0] or -1, *counts(s), sha256(joined([x for x in s if x[0] != "term"]).encode()).hexdigest(), joined(s)) for r, s in zip(rows, want, strict=True)
    )
    return want


def test_base_spans(spark):
    check(spark, [(i, t, None, None) for i, t in enumerate(TEXTS)])


def test_disclosing_terms(spark):
    rows = [(i, f"common words here number{'abcdefghij'[i % 10] * 3} end", None, None) for i in range(60)]
    rows += [(100 + i, f"the agent Falcon wrote common words {'xyz'[i % 3] * (3 + i)} me@secret.org", None, None) for i in range(6)]
    rows += [(200, "falcon flies", None, None), (None, "rare@one.org hapax words", None, None), (201, "rare@one.org hapax words", None, None), (201, "rare@one.org hapax words", None, None)]
    spans = [x for s in check(spark, rows) for x in s if x[0] == "term"]
    assert spans
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert clean[200] == "falcon flies" and clean[201] == "[EMAIL] hapax words"
    assert "Falcon" not in clean[100] and "agent" not in clean[100] and clean[100].endswith("xxx [EMAIL]") and "common words" in clean[100]


def test_entities_of_one_kind_keep_company(spark):
    """No entity or neighbourhood occurs twice, but what stands beside all of a kind gives the kind away; what is far from them doesn't."""
    filler = lambda i: " ".join(f"word{(i * 7 + k * 3) % 41}" for k in range(60))
    rows = [(i, filler(i), None, None) for i in range(150)]
    rows += [(500 + i, f"{filler(i)} Kontakt unter +{10 + i} 555 {1000000 + i} {filler(i + 1)}", None, None) for i in range(9)]
    rows += [(600, "Kontaktlinsen, \u0130stanbul", None, None), (601, "a k47 me@one.org \u0130zmir", None, None)]
    want = check(spark, rows)
    taken = {rows[i][1][x[1] : x[2]] for i, s in enumerate(want) for x in s if x[0] == "term"}
    assert {"Kontakt", "unter", "k47", "\u0130zmir"} <= taken and not any(t.startswith("word") for t in taken)
    check(spark, rows, disclosure=0.5)
    check(spark, rows, strength=5.0)


def test_many_entities_and_very_long_text(spark):
    text = " ".join(f"name{i} user{i}@host{i % 7}.org said {'x' * (i % 9)}" for i in range(3000))
    rows = [(1, text, None, None), (2, "name5 said " * 9000, None, None), *[(10 + i, "said nothing", None, None) for i in range(150)]]
    got = {r.doc_id: r for r in pii.detect(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].n_email == 3000 and "term:" in got[1].spans and got[2].spans == "" and got[10].spans == ""


def test_overlaps_empty_table_and_columns(spark):
    t = spark.createDataFrame([(1, "+4111 1111 1111 1111 x 1.1.1.1", "keep", 7), (2, None, None, None)], SCHEMA)
    out = pii.sanitise(t)
    assert out.columns == t.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1]["_text"] == "keep" and rows[1]["_row"] == 7 and "1111" not in rows[1].text and rows[1].text.endswith("x [IP]") and rows[2].text is None
    empty = spark.createDataFrame([], SCHEMA)
    assert pii.detect(empty).count() == 0 and pii.sanitise(empty).count() == 0
