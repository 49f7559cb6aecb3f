import gc
import math
import random
import sys
import tracemalloc
import zlib
from hashlib import sha256

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from trawl.llm import bpe, chunks, packing, repair
from trawl.llm.bpe_fst import Decoder, Encoder, read_ranks

SCHEMA = "ids int, doc_id long, text string, _task string"
ALPHABET = [*"aAbe12 _.,!'\n\t\x01", "th", "ing", "é", "ß", "日本", "😀", "  ", "\n\n", " \n", "\n ", "'s", "\xa0", "\x1c", "\x85", "　", "² ", ". ", ", ", ".\n", "...", "._", "А", "​", "<|endoftext|>"]


def texts(n, seed=0):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 30))) for _ in range(n)] + ["", "x" * 70_000, "the end. " * 9_000, "\n", " ", "\nfoo\n", "foo. ", "a\t \tb", "a\n\xa0\xa0b"]


def library():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k", "byte_bpe_50k"])
def test_transducer_is_the_library(name):
    ranks = read_ranks(P.path(f"{name}.tiktoken"))
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder, decoder = Encoder(ranks, P.PATTERN), Decoder(ranks)
    r = random.Random(1)
    more = ["".join(r.choice("abcdefghetaoin") for _ in range(40)) for _ in range(500)] + ["".join(chr(r.randint(1, 0x2FFF)) for _ in range(9)) for _ in range(2000)]
    for t in texts(3000) + more:
        ids = encoder.encode(t)
        assert ids == want.encode_ordinary(t)
        assert decoder.decode(ids) == t and "".join(decoder.stream(ids)) == t


def test_streaming_decoder_on_broken_bytes():
    decoder = Decoder({bytes((b,)): b for b in range(256)})
    r = random.Random(2)
    for _ in range(3000):
        raw = bytes(r.choice([0x41, 0x80, 0xBF, 0xC2, 0xC0, 0xE0, 0xA0, 0xED, 0xF0, 0x90, 0xF4, 0x8F, 0xFF]) for _ in range(8))
        assert "".join(decoder.stream(raw)) == raw.decode("utf-8", "replace")


def test_chunks_are_the_library():
    want = library()
    own = chunks.library_encoder(P.path("byte_bpe_50k.json"))
    many = texts(6000, 3)
    for at in range(0, len(many), 100):
        some = many[at : at + 100]
        assert own.encode(some) == [np.array(x.ids, "<u4").tobytes() for x in want.encode_batch(some, add_special_tokens=False)]


def test_new_words_are_encoded_together():
    """Words that a worker meets for the first time don't cost a call of the library each."""
    own = chunks.library_encoder.__wrapped__(P.path("byte_bpe_50k.json"))
    r = random.Random(7)
    words = ["".join(r.choice("abcdeéłß") for _ in range(r.randint(1, 12))) for _ in range(3000)] + ["x" * 5000]
    calls = []
    sys.setprofile(lambda f, event, arg: calls.append(1) if event == "c_call" and arg.__name__ in ("tokenize", "encode_batch_fast") else None)
    try:
        got = own.encode([" ".join(words)])
    finally:
        sys.setprofile(None)
    assert got == [np.array(library().encode(" ".join(words), add_special_tokens=False).ids, "<u4").tobytes()]
    assert len(calls) < len(set(words)) / 100


def test_new_words_are_no_objects_of_python():
    """Neither a call nor a string of Python for each word that a worker meets for the first time; the ids are the library's."""
    own = chunks.library_encoder.__wrapped__(P.path("byte_bpe_50k.json"))
    r = random.Random(9)
    words = list({"".join(r.choice("abcdeéłßÿɏ") for _ in range(r.randint(1, 12))) for _ in range(2 * chunks.AT_ONCE + 7)})
    calls = []
    sys.setprofile(lambda f, event, arg: calls.append(1) if event in ("call", "c_call") else None)
    try:
        got = own.encode([" ".join(words)])
    finally:
        sys.setprofile(None)
    assert got == [np.array(library().encode(" ".join(words), add_special_tokens=False).ids, "<u4").tobytes()]
    assert len(calls) < len(words) / 4


def test_places_of_keys():
    r = random.Random(10)
    for few, many in ((0, 5), (5, 0), (3, 40), (40, 3), (30, 30)):
        keys, among = ([f"k{x}" for x in r.sample(range(60), n)] for n in (few, many))
        assert chunks._places(pa.array(keys, pa.string()), pa.array(among, pa.string())).tolist() == [among.index(k) if k in among else -1 for k in keys]


def test_remembered_chunks_are_small(monkeypatch):
    """In Python's own objects a remembered chunk took over 100 bytes; and what is forgotten is encoded again."""
    own = chunks.library_encoder.__wrapped__(P.path("byte_bpe_50k.json"))
    r = random.Random(8)
    words = list({"".join(r.choice("abcdefgh") for _ in range(7)) for _ in range(20_000)})
    own.encode(["warm up"])
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    own.encode([" ".join(words)])
    gc.collect()
    kept = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert kept < 64 * len(words)
    monkeypatch.setattr(chunks, "REMEMBERED", 50)
    want = library()
    for k in range(40):
        some = [" ".join(r.choice(words[:200]) for _ in range(30)) for _ in range(3)]
        assert own.encode(some) == [np.array(x.ids, "<u4").tobytes() for x in want.encode_batch(some, add_special_tokens=False)], k


def frame(spark, rows):
    return spark.createDataFrame([(7, i, t, "clash") for i, t in rows], SCHEMA).repartition(3)


def rows_of(n):
    some = texts(n, 5)
    return [(i, t) for i, t in enumerate(some)] + [(len(some), None), (len(some) + 1, "twin"), (len(some) + 1, "twin")]


def test_bpe_tables(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    rows = rows_of(300)
    docs = frame(spark, rows)
    out = []
    for i, t in rows:
        ids = want.encode_ordinary(t or "")
        out.append((i, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256((t or "").encode()).hexdigest()))
    assert sorted(tuple(r) for r in bpe.round_trip(docs, path, P.PATTERN).collect()) == sorted(out)
    back = bpe.decode(bpe.encode(docs, path, P.PATTERN), path)
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((i, t or "") for i, t in rows)
    assert bpe.round_trip(frame(spark, []), path, P.PATTERN).count() == 0


def packed(ids, capacity):
    first = len(ids) % capacity or capacity
    return [(0, first)] + [(a, capacity) for a in range(first, len(ids), capacity)] if len(ids) > capacity else [(0, len(ids))]


@pytest.mark.parametrize("how", [{}, {"rule": "dot"}, {"capacity": 64, "max_docs": 3}, {"capacity": 64, "max_cost": 64 * 64 + 100}])
def test_packing(spark, how):
    want, rows = library(), rows_of(300)
    capacity = how.get("capacity", 1024)
    got = packing.pack(frame(spark, rows), P.path("byte_bpe_50k.json"), 2, **how).collect()
    ids = {i: np.array([*want.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in rows}
    expected = [(i, k, a, n, zlib.crc32(ids[i][a : a + n].tobytes())) for i, _ in rows for k, (a, n) in enumerate(packed(ids[i], capacity))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(expected)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity and len(b) <= how.get("max_docs", capacity) and sum(n * n for _, n in b) <= how.get("max_cost", capacity**2)
    if not how:
        assert len(bins) <= -(-sum(map(len, ids.values())) // capacity) * 1.02 + 1
    assert packing.pack(frame(spark, []), P.path("byte_bpe_50k.json"), 2).count() == 0


def naive_plan(lengths, capacity, max_docs, tile, weights):
    """Piece by piece into the bin with the smallest weighted residual norm; the bins' lengths."""
    ask = lambda n: (n, 1, math.ceil(n / tile) ** 2)
    limits = (capacity, max_docs, math.ceil(capacity / tile) ** 2)
    bins = []
    for n in sorted(lengths, reverse=True):
        ok = [b for b in bins if all(r >= a for r, a in zip(b[0], ask(n), strict=True))]
        norm = lambda b: sum(w * ((r - a) / c) ** 2 for w, a, r, c in zip(weights, ask(n), b[0], limits, strict=True))  # noqa: B023, E731
        best = min(ok, key=lambda b: (norm(b), b[0]), default=None)
        if best is None:
            bins.append(best := [limits, []])
        t, d, c = (r - a for r, a in zip(best[0], ask(n), strict=True))
        best[0] = (t, min(d, t), min(c, max(t, (t + tile - 1) ** 2 // tile**2) + t))  # more can't be used
        best[1].append(n)
    return sorted(sorted(x) for _, x in bins)


def planned(rules):
    bins = {}
    for length, _, n, each, first, _ in rules:
        for k in range(n):
            bins.setdefault(first + k // each, []).append(length)
    return sorted(sorted(x) for x in bins.values())


def test_plan_is_vector_best_fit():
    r = random.Random(4)
    differs = 0
    for _ in range(40):
        top = r.choice([10, 40, 100])
        lengths = [min(100, r.randint(1, top) + r.choice([0, 0, 80])) for _ in range(r.randint(1, 300))]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        docs, tile, weights = r.choice([4, 8, 16]), r.choice([4, 10]), r.choice([packing.WEIGHTS, (1.0, 1.0, 1.0)])
        bins = planned(packing.plan(histogram, 100, docs, None, tile, "norm", weights))
        # bins in the same state may hold other pieces
        assert sorted(map(sum, bins)) == sorted(map(sum, naive_plan(lengths, 100, docs, tile, weights)))
        assert all(len(b) <= docs and sum(math.ceil(n / tile) ** 2 for n in b) <= math.ceil(100 / tile) ** 2 for b in bins)
        differs += bins != planned(packing.plan(histogram, 100, 100, 100**2, 1, "norm", (1.0, 0.0, 0.0)))
    assert differs > 10  # the capacities bind


    with pytest.raises(ValueError):
        packing.plan({10: 1}, 100, 100, 50, 1)


def test_repair_round_trip():
    r = random.Random(6)
    for n in (1, 2, 50, 3000):
        docs = [[r.choice([5, 6, 7, 7, 7, 2, 9]) for _ in range(r.randint(0, 40))] + [2] for _ in range(n)]
        ids = np.array([x for d in docs for x in d], np.uint32)
        payload = repair.compress(ids, list(range(n)), [len(d) for d in docs], 2, frequent=3)
        shard = repair.Shard(payload)
        assert (shard.expand(shard.symbols) == ids).all() and (n < 50 or len(shard.symbols) < len(ids) * 0.7)
        for k in range(0, n, 7):
            assert shard.document(k).tolist() == docs[k]
            a = r.randrange(len(docs[k]))
            b = r.randint(a + 1, len(docs[k]))
            assert shard.span(k, a, b).tolist() == docs[k][a:b]
    with pytest.raises(ValueError):
        repair.Shard(b"something else")


def test_token_id_tables(spark):
    want, rows = library(), rows_of(300)
    got = sorted((tuple(r) for r in repair.read(repair.write(frame(spark, rows), P.path("byte_bpe_50k.json"), 2, size=500)).collect()), key=lambda x: (x[0], x[1]))
    at, expected = 0, []
    for i, t in sorted(rows, key=lambda x: x[0]):
        ids = np.array([*want.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        expected.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == expected
    null = repair.read(repair.write(spark.createDataFrame([(7, None, "a", "x"), (7, 4, "b", "x")], SCHEMA), P.path("byte_bpe_50k.json"), 2)).collect()
    assert sorted((r.start, r.doc_id) for r in null) == [(0, None), (2, 4)]
    assert repair.read(repair.write(frame(spark, []), P.path("byte_bpe_50k.json"), 2)).count() == 0
