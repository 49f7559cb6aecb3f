from collections import defaultdict
from hashlib import sha256

from trawl.llm import exact_dedup as E

SCHEMA = "doc_id long, text string, lang string, _best string"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_against_brute_force(spark):
    rows = [(i, ["Hot", "hOT", "", None, f"T{i}", f"t{i - 1}", "É", "é"][i % 8], "en", None) for i in range(400)]
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[lower(t)].append(i)
    want = {(i, max(g), len(g), i == max(g), sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    for share in (0.9, 1e-2, 1e-6):
        got = [tuple(r) for r in E.resolve(table(spark, rows), share).collect()]
        assert len(got) == len(rows) and set(got) == want
        kept = [r.doc_id for r in E.deduplicate(table(spark, rows), share).collect()]
        assert sorted(kept) == sorted(max(g) for g in groups.values())


def test_empty_table_and_columns(spark):
    empty = table(spark, [])
    assert E.resolve(empty).count() == 0 and E.deduplicate(empty).count() == 0
    assert E.deduplicate(empty).columns == empty.columns


def test_nulls_and_repeated_rows(spark):
    rows = [(None, "a", None, "x"), (3, "a", None, "y"), (3, "A", None, "y"), (None, "b", None, None), (None, "b", None, None)]
    for share in (0.1, 0.99):
        got = E.resolve(table(spark, rows), share).collect()
        assert sum(r.kept for r in got) == 2 and {(r.keep_id, r.group_size) for r in got} == {(3, 3), (None, 2)}
        kept = E.deduplicate(table(spark, rows), share).collect()
        assert sorted((r.doc_id or -1) for r in kept) == [-1, 3]


def test_very_long_texts(spark):
    long = "Long text " * 200_000
    rows = [(1, long), (2, long.upper()), (3, long + "x")]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in E.resolve(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (2, 2, False), 2: (2, 2, True), 3: (3, 1, True)}
