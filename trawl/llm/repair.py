"""Token ids in Re-Pair compressed shards, with random access.

Documents go in ascending ``doc_id`` order. A shard holds whole documents, at
least ``SHARD`` ids of them (the last of a task fewer). Within a shard frequent
pairs of ids are replaced by nonterminals, again and again: each round counts
the pairs, gives the frequent ones a rule, and replaces their occurrences from
left to right. By default rounds end when they save little (``ROUNDS``,
``LEAST_SAVING``, ``FREQUENT``), as this is a trade of time for size; ``rounds``
None goes on until no frequent pair is left. No rule spans two documents. A shard is one row of a Parquet
table, whose commit protocol covers lost executors; its ``payload`` is

    8 bytes   b"REPAIR01"
    6 x u64   first rule's symbol, rules, symbols, documents, ids, bytes per symbol
    u32 each  left symbols, right symbols and expansion lengths of the rules
    u64 each  where each document's symbols begin, and their number
    i64 each  doc_id of each document
    u64 each  ids before each document in the shard, and their number
    symbols   little-endian, with so many bytes each

Edge cases: a null or empty text is its end id alone; rows with equal doc_id
are ordered by text; a null ``doc_id`` comes first; an empty table gives none;
a document longer than ``SHARD`` is a shard of its own, in memory that its own
length sets; columns of other names than ``doc_id`` and ``text`` are not looked
at.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.chunks import groups, library_encoder
from trawl.llm.worker import begin
from trawl.staging import staged

MAGIC = b"REPAIR01"
SHARD = 1 << 20
#: A pair gets a rule from so many occurrences on; so many new rules a round; rounds end when one saves less than this share.
FREQUENT = 24
NEW_RULES = 4096
ROUNDS = 8
LEAST_SAVING = 0.02
_BITS = 20
#: Stands for a null doc_id in a shard.
_NULL = -(2**63)
_SHARDS = "_task int, _before long, n_ids long, payload binary"
_ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _round(seq: np.ndarray, closes: np.ndarray, frequent: int, most: int, first: int, exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Replace frequent pairs, the i-th by ``first`` + i: their left and right symbols, the new sequence, and which positions stay.

    With ``exact`` each pair is counted on its own; otherwise in a table of 2**20 places.
    """
    left, right = seq[:-1], seq[1:]
    if exact:
        at = np.flatnonzero(~closes[left])
        one, place = np.unique(left[at].astype(np.uint64) << np.uint64(32) | right[at], return_inverse=True)
        return _replaced(seq, at, place, one, frequent, most, first)
    place = ((left * np.uint32(0x9E3779B1) ^ right * np.uint32(0x85EBCA77)) >> np.uint32(32 - _BITS)).astype(np.intp)
    counts = np.bincount(place, minlength=1 << _BITS)
    # what falls in a rarely hit place of the small table can't be frequent; of pairs that share a place one is looked at
    at = np.flatnonzero((counts >= frequent)[place] & ~closes[left])
    place, key = place[at], left[at].astype(np.uint64) << np.uint64(32) | right[at]
    one = np.zeros(1 << _BITS, np.uint64)
    one[place] = key
    own = one[place] == key
    return _replaced(seq, at[own], place[own], one, frequent, most, first)


def _replaced(seq: np.ndarray, at: np.ndarray, place: np.ndarray, one: np.ndarray, frequent: int, most: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``_round`` for pairs that begin at ``at`` and are numbered ``place`` in ``one``."""
    counts = np.bincount(place, minlength=len(one))
    hit = np.flatnonzero(counts >= frequent)
    best = hit[np.argsort(-counts[hit], kind="stable")[:most]]
    rule = np.full(len(one), -1, np.int32)
    rule[best] = np.arange(len(best))
    mine = rule[place]
    some = np.flatnonzero(mine >= 0)
    at, mine = at[some], mine[some]
    # of pairs that overlap in a run, every other one
    opens = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    odd = np.arange(len(at), dtype=np.uint8) & 1
    some = np.flatnonzero(odd == np.repeat(odd[opens], np.diff(opens, append=len(at))))
    at, mine = at[some], mine[some]
    out, stays = seq.copy(), np.ones(len(seq), dtype=bool)
    out[at] = (first + mine).astype(np.uint32)
    stays[at + 1] = False
    pairs = one[best]
    return (pairs >> np.uint64(32)).astype(np.uint32), (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32), out[stays], stays


def compress(ids: np.ndarray, doc_ids: list[int], sizes: list[int], end_id: int, frequent: int = FREQUENT, rounds: int | None = ROUNDS) -> bytes:
    """A shard's payload. ``ids``: the documents' ids, each document with its end id last.

    ``rounds`` None goes on until no pair that may have a rule occurs ``frequent`` times (2 at least), by exact counts.
    """
    seq = ids.astype(np.uint32)
    first = base = int(seq.max()) + 1
    closes = np.zeros(base, dtype=bool)
    closes[end_id] = True
    begins = np.zeros(len(seq), dtype=bool)
    begins[np.cumsum([0, *sizes[:-1]])] = True
    # an end id may also be a text's own; no pair spans documents all the same
    left, right, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)], np.ones(base, dtype=np.uint32)
    for _ in count() if rounds is None else range(rounds):
        if len(seq) < 2:
            break
        before = len(seq)
        a, b, seq, stays = _round(seq, closes, max(2, frequent), NEW_RULES, first, rounds is None)
        if not len(a):
            break
        begins = begins[stays]
        closes, lengths = np.r_[closes, closes[b]], np.r_[lengths, lengths[a] + lengths[b]]
        left, right, first = [*left, a], [*right, b], first + len(a)
        if rounds is not None and len(seq) > before * (1 - LEAST_SAVING):
            break
    a, b = np.concatenate(left), np.concatenate(right)
    width = 2 if first <= 1 << 16 else 3 if first <= 1 << 24 else 4
    symbols = np.ascontiguousarray(seq.astype("<u4")).view(np.uint8).reshape(-1, 4)[:, :width].tobytes()
    parts = [MAGIC, struct.pack("<6Q", base, len(a), len(seq), len(sizes), len(ids), width)]
    parts += [x.astype("<u4").tobytes() for x in (a, b, lengths[base:])]
    parts += [np.append(np.flatnonzero(begins), len(seq)).astype("<u8").tobytes(), np.array(doc_ids, dtype="<i8").tobytes()]
    return b"".join([*parts, np.cumsum([0, *sizes]).astype("<u8").tobytes(), symbols])


class Shard:
    """Reads a payload."""

    def __init__(self, payload: bytes):
        if payload[:8] != MAGIC:
            raise ValueError("this is no shard")
        self.base, rules, symbols, docs, self.n_ids, width = struct.unpack_from("<6Q", payload, 8)
        at = 56

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        self.left, self.right, self.lengths = (take("<u4", rules) for _ in range(3))
        self.begins, self.doc_ids, self.before = take("<u8", docs + 1), take("<i8", docs), take("<u8", docs + 1)
        raw = np.zeros((symbols, 4), np.uint8)
        raw[:, :width] = take("u1", symbols * width).reshape(-1, width)
        self.symbols = raw.view("<u4").ravel()
        self._flat: np.ndarray | None = None

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """All rules' expansions in one array, and where each begins."""
        if self._flat is None:
            self._at = np.cumsum([0, *self.lengths.tolist()])
            flat = np.empty(int(self._at[-1]), np.uint32)
            at, n = self._at.tolist(), self.lengths.tolist()
            for k, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist(), strict=True)):
                put = at[k]
                for s in (a, b):
                    if s < self.base:
                        flat[put] = s
                        put += 1
                    else:
                        k2 = s - self.base
                        flat[put : put + n[k2]] = flat[at[k2] : at[k2] + n[k2]]
                        put += n[k2]
            self._flat = flat
        return self._flat, self._at

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that these symbols stand for."""
        flat, at = self._expansions()
        rule = symbols >= self.base
        which = np.where(rule, symbols, self.base).astype(np.int64) - self.base
        sizes = np.where(rule, np.append(self.lengths, 1)[which], 1).astype(np.int64)
        ends = np.cumsum(sizes)
        out = np.repeat(symbols, sizes)
        inside = np.repeat(rule, sizes)
        place = np.arange(len(out)) + np.repeat(at[which] - ends + sizes, sizes)
        out[inside] = flat[place[inside]]
        return out

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document, with its end id."""
        return self.expand(self.symbols[int(self.begins[k]) : int(self.begins[k + 1])])

    def span(self, k: int, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the k-th document, expanding only the symbols that hold them."""
        symbols = self.symbols[int(self.begins[k]) : int(self.begins[k + 1])]
        sizes = np.append(np.ones(self.base, np.uint32), self.lengths)[symbols]
        ends = np.cumsum(sizes)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        begin = int(ends[a - 1]) if a else 0
        return self.expand(symbols[a:b])[start - begin : stop - begin]


def shard_batches(batches: Iterator[pa.RecordBatch], tokenizer_path: str, end_id: int, size: int, frequent: int = FREQUENT, rounds: int | None = ROUNDS) -> Iterator[pa.RecordBatch]:
    """Ordered (doc_id, text) to shards."""
    from pyspark import TaskContext

    begin("tokens", library_encoder.cache_clear)
    tokenizer, before = library_encoder(tokenizer_path), 0
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n = 0

    def close() -> pa.RecordBatch:
        ids, docs, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        row = [TaskContext.get().partitionId(), before, n, compress(ids, docs.tolist(), sizes.tolist(), end_id, frequent, rounds)]
        return pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["_task", "_before", "n_ids", "payload"])

    for few in groups(batches):
        ids, at = tokenizer.flat(few[1])
        ids, docs = np.insert(ids, at[1:], end_id), few[0].fill_null(_NULL).to_numpy()
        ends = at[1:] + np.arange(1, len(at))
        k = 0
        while k < len(docs):
            begins = int(ends[k - 1]) if k else 0
            to = min(len(docs), int(np.searchsorted(ends, begins + size - n)) + 1)
            held.append((ids[begins : ends[to - 1]], docs[k:to], np.diff(ends[k:to], prepend=begins)))
            n += len(held[-1][0])
            k = to
            if n >= size:
                yield close()
                held, n, before = [], 0, before + n
    if held:
        yield close()


def write(docs: DataFrame, tokenizer_path: str, end_id: int, size: int = SHARD, frequent: int = FREQUENT, rounds: int | None = ROUNDS) -> DataFrame:
    """The shards of ``docs`` as a written table: _task, _before (ids before it in the task), n_ids, payload."""
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return staged(ordered.mapInArrow(lambda b: shard_batches(b, tokenizer_path, end_id, size, frequent, rounds), _SHARDS), "shards")


def read(shards: DataFrame) -> DataFrame:
    """Per document of the shards: doc_id, start, n_tokens and ids_crc32, from its expanded ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for before, payload in zip(batch[0].to_pylist(), batch[1], strict=True):
                shard = Shard(payload.as_buffer().to_pybytes())
                rows = []
                ids = shard.expand(shard.symbols).astype("<u4").tobytes()
                at = shard.before.tolist()
                for k, doc_id in enumerate(shard.doc_ids.tolist()):
                    rows.append((None if doc_id == _NULL else doc_id, before + at[k], at[k + 1] - at[k], zlib.crc32(ids[4 * at[k] : 4 * at[k + 1]])))
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    total, tasks = 0, []
    for r in shards.groupBy("_task").agg(F.sum("n_ids").alias("n")).orderBy("_task").collect():  # a row for each task that wrote
        tasks.append((r["_task"], total))
        total += r["n"]
    bases = shards.sparkSession.createDataFrame(tasks, "_task int, _base long")
    whole = shards.join(F.broadcast(bases), "_task")
    return whole.select((F.col("_base") + F.col("_before")).alias("_before"), "payload").mapInArrow(run, _ROWS)
