"""Vector best-fit packing of documents into sequences.

A piece asks for its tokens, one document slot, and its attention cost: the
``TILE`` x ``TILE`` tiles of its own attention square. A sequence has a
capacity for each: ``CAPACITY`` tokens, ``MAX_DOCS`` documents, and as many
tiles as one full piece has. (All three bind: many short documents run out of
slots, and a piece that ends just within its last tile leaves no tile for
another.) Pieces go in order of decreasing length, each into the open sequence
that fits best: the one whose weighted residual norm after placing is smallest
(``norm``), or whose residual has the largest weighted dot product with the
piece (``dot``), among those where no capacity is exceeded. Of equal worth, the
smallest residual goes first.

Pieces of one length are alike. So the placing runs over a histogram of at
most ``capacity`` lengths, and sequences in the same state are placed into
together; what it costs does not grow with the input. The result is a small
table of rules (bounded by lengths times states; some thousands): the pieces
of length L ranked a to b go to these sequences at that offset. Every piece has
a rank among those of its length, from counts by task, and looks up its rule in
a broadcast of that size.

Edge cases: a null or empty text is its end id alone; a document longer than
the capacity is cut so that only its first piece may be shorter; an empty
table gives an empty result; repeated rows are packed each; a very long text is
encoded alone, in memory that its own length sets; columns of other names than
``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.chunks import groups, library_encoder
from trawl.llm.worker import begin
from trawl.staging import staged

CAPACITY = 1024
MAX_DOCS = 64
#: Tokens on a side of an attention tile.
TILE = 16
#: What the norms and products weigh tokens, documents and cost with.
WEIGHTS = (1.0, 0.1, 0.1)
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, _task int, _rank long"
_RULES = "_length long, _from long, _count long, _each long, _sequence long, _offset long"


def cost(length: int, tile: int = TILE) -> int:
    """Tiles of attention that a piece of ``length`` tokens asks for."""
    return (-(-length // tile)) ** 2


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """Starts and lengths of the pieces of a document of ``total`` ids."""
    first = total % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, total, capacity)] if total > capacity else [(0, total)]


def cut_batches(batches: Iterator[pa.RecordBatch], tokenizer_path: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to pieces, each ranked among the task's pieces of its length."""
    from pyspark import TaskContext

    begin("tokens", library_encoder.cache_clear)
    task, tokenizer, end = TaskContext.get().partitionId(), library_encoder(tokenizer_path), np.uint32(end_id).tobytes()
    ranks = np.zeros(capacity + 1, np.int64)
    names = [x.split(" ")[0] for x in _PIECES.split(", ")]
    for few in groups(batches):
        ids, at = tokenizer.flat(few[1])
        raw, edges = memoryview(ids).cast("B"), (4 * at).tolist()
        total = np.diff(at) + 1
        number = -(-total // capacity)
        doc = np.repeat(np.arange(len(total)), number)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
        first = np.where(number > 1, (total - 1) % capacity + 1, total)
        start = np.where(piece > 0, first[doc] + (piece - 1) * capacity, 0)
        length = np.where(piece > 0, capacity, first[doc])
        crc = np.zeros(len(doc), np.int64)
        for k, (i, j, n) in enumerate(zip((4 * (at[doc] + start)).tolist(), (4 * (at[doc] + start + length)).tolist(), doc.tolist(), strict=True)):
            crc[k] = zlib.crc32(raw[i:j]) if j <= edges[n + 1] else zlib.crc32(end, zlib.crc32(raw[i : edges[n + 1]]))
        order = np.argsort(length, kind="stable")
        on, opens, times = np.unique(length[order], return_index=True, return_counts=True)
        rank = np.empty(len(doc), np.int64)
        rank[order] = np.arange(len(doc)) - np.repeat(opens, times) + np.repeat(ranks[on], times)
        ranks[on] += times
        yield pa.record_batch([few[0].take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc), pa.array(np.full(len(doc), task), pa.int32()), pa.array(rank)], names=names)


def plan(
    histogram: dict[int, int], capacity: int = CAPACITY, max_docs: int = MAX_DOCS, max_cost: int | None = None, tile: int = TILE, rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS
) -> list[tuple[int, int, int, int, int, int]]:
    """Rules (length, first rank, count, pieces per sequence, first sequence, offset) for a histogram of lengths.

    ``max_cost`` is that of one full piece if it isn't given.
    """
    limits = (capacity, max_docs, max_cost or cost(capacity, tile))
    #: sequences by residual, as ranges of their numbers; what can't matter is clipped, so that few residuals differ
    open_: dict[tuple[int, int, int], list[list[int]]] = defaultdict(list)
    rules: list[tuple[int, int, int, int, int, int]] = []
    made = 0

    def after(residual: tuple[int, int, int], length: int, n: int) -> tuple[int, int, int]:
        t = residual[0] - n * length
        # pieces of t tokens together have at most so many documents and tiles
        return t, min(residual[1] - n, t), min(residual[2] - n * cost(length, tile), max(t, (t + tile - 1) ** 2 // tile**2) + t)

    def fits(residual: tuple[int, int, int], length: int) -> int:
        return min(residual[0] // length, residual[1], residual[2] // cost(length, tile))

    def worth(residual: tuple[int, int, int], length: int) -> float:
        asked = (length, 1, cost(length, tile))
        if rule == "dot":
            return -sum(w * a * r / c / c for w, a, r, c in zip(weights, asked, residual, limits, strict=True))
        return sum(w * ((r - a) / c) ** 2 for w, a, r, c in zip(weights, asked, residual, limits, strict=True))

    def place(residual: tuple[int, int, int], length: int, each: int, first: int, n: int, rank: int) -> None:
        """``n`` pieces into sequences from ``first`` on, ``each`` into one; the last may get fewer."""
        rules.append((length, rank, n, each, first, capacity - residual[0]))
        full, rest = divmod(n, each)
        for got, at, count in ((each, first, full), (rest, first + full, 1)):
            left = after(residual, length, got)
            if got and count and min(left) > 0:
                open_[left].append([at, at + count])

    whole = limits
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        if not fits(whole, length):
            raise ValueError(f"a piece of {length} tokens exceeds the capacities of an empty sequence")
        while left:
            best = min((r for r in open_ if fits(r, length)), key=lambda r: (worth(r, length), r), default=None)
            each = fits(best or whole, length) if rule == "norm" or best is None else 1
            if best is None:
                n, first = left, made
                made += -(-n // each)
            else:
                span = open_[best][-1]
                n = min(left, (span[1] - span[0]) * each)
                first = span[0]
                span[0] += -(-n // each)
                if span[0] == span[1]:
                    open_[best].pop()
                    if not open_[best]:
                        del open_[best]
            place(best or whole, length, each, first, n, rank)
            rank, left = rank + n, left - n
    return rules


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents, ranked by task and length, as a staged table."""
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return staged(texts.mapInArrow(lambda b: cut_batches(b, tokenizer_path, end_id, capacity), _PIECES), "pieces")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, max_docs: int = MAX_DOCS, max_cost: int | None = None, tile: int = TILE, rule: str = "norm") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of ``docs``."""
    spark, cuts = docs.sparkSession, pieces(docs, tokenizer_path, end_id, capacity)
    counts = staged(cuts.groupBy("_task", "length").agg(F.count("*").alias("_n")), "lengths")
    histogram = {r["length"]: r["_n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("_n")).collect()}  # at most `capacity` rows
    rules = plan(histogram, capacity, max_docs, max_cost, tile, rule)
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_task", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = cuts.join(bases, ["_task", "length"]).withColumn("_at", F.col("_base") + F.col("_rank"))
    table = spark.createDataFrame(rules, _RULES)
    in_rule = (F.col("length") == F.col("_length")) & (F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_from") + F.col("_count"))
    step = F.col("_at") - F.col("_from")
    return ranked.join(F.broadcast(table), in_rule).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_sequence") + F.floor(step / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + step % F.col("_each") * F.col("length")).alias("offset"),
    )
