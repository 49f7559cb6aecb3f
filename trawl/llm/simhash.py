"""SimHash near-dedup over a Gray-order hierarchical index.

A fingerprint has 64 bits over the word shingles of a text. Fingerprints link
at ``DISTANCE`` or fewer differing bits. Distinct fingerprints are routed by
every choice of two of six bit blocks (four differing bits leave two blocks
untouched), so links are only sought within a route and none is lost. Within
a route the fingerprints lie in the order of their Gray rank, where neighbours
share many bits, under a hierarchy: a node stands for a run of neighbours and
holds the bits they all share as a mask and a pattern; bits shared by a whole
run of nodes move to the node above. A search goes down from the root of the
route, adds up the differences that each node's own bits show, and drops a
whole group as soon as they exceed the distance.

A route with more than ``HOT`` fingerprints is dealt out as pairs of blocks,
so that each task holds two blocks at most. Only a spanning forest of each
task's links goes on to the component search.

Edge cases: a null text is empty; a text without words has fingerprint zero
and links like any other; a null ``doc_id`` takes part but names a component
only as null where there is no other; rows with equal fingerprint are one
node; an empty table gives an empty result; a very long text is hashed alone,
in memory that its own length sets; columns of other names pass through
``deduplicate`` whatever they are called; of equal doc_ids none is preferred.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.chunks import groups
from trawl.llm.components import components
from trawl.llm.worker import begin
from trawl.staging import staged

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: Bit blocks by their lowest bit and width, and the routes: any two of them.
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
ROUTES = list(combinations(range(len(BLOCKS)), 2))
#: Children of a node.
FAN = 8
HOT = 8192
BLOCK = 4096
#: Pairs of a query and a node that are looked at together.
FRONTIER = 2_000_000

_UPPER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str, words_each: int = SHINGLE) -> int:
    """The fingerprint of one text."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").translate(_UPPER).split()  # white space is ASCII's
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= words_each:
        hashes = [xxh64_intdigest(joined, SEED)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[words_each - 1 :].tolist(), strict=False)]
    half, counts = len(hashes), np.zeros(64, np.int64)
    raw = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(raw), 1 << 16):
        counts += np.unpackbits(raw[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > half).tobytes(), "big")


def fingerprints(docs: DataFrame, words_each: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` with their fingerprint as a long column ``_fp``, after the text's column."""
    names = docs.columns
    kept = docs.select(*[docs[f"`{n}`"].alias(f"c{k}") for k, n in enumerate(names)], docs["text"].alias("_text"))
    schema = kept.drop("_text").schema.add("_fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("simhash")
        for few in groups(batches):
            codes = np.array([fingerprint(t or "", words_each) for t in few[-1].to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([*few.columns[:-1], pa.array(codes, pa.int64())], names=schema.names)

    out = kept.mapInArrow(run, schema)
    return out.toDF(*names, "_fp")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Positions of the codes in the reflected Gray order."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """The hierarchy over fingerprints that lie by route, then Gray rank.

    ``route`` numbers the route of each fingerprint, in ascending order. Levels
    are arrays: a node's mask and pattern, and where its children begin.
    """

    def __init__(self, codes: np.ndarray, route: np.ndarray):
        self.codes = codes
        low, high, owner = codes, codes, route
        #: from the bottom: shared mask, pattern, first child of each node (with an end)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while True:
            opens = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.append(opens, len(owner)))
            if self.levels and sizes.max(initial=1) == 1:
                break
            place = np.arange(len(owner)) - np.repeat(opens, sizes)
            first = np.flatnonzero(place % FAN == 0)
            low, high, owner = np.bitwise_and.reduceat(low, first), np.bitwise_or.reduceat(high, first), owner[first]
            self.levels.append((~(low ^ high), low, np.append(first, len(place))))
        self.roots = owner

    def links(self, queries: np.ndarray, root: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
        """For queries (as positions) with their roots: positions of the links, as (query, later position)."""
        q, node, seen = queries, root, np.zeros(len(queries), np.int64)
        above = np.zeros(len(queries), np.uint64)
        for mask, pattern, first in reversed(self.levels):
            own = mask[node] & ~above
            seen = seen + np.bitwise_count((self.codes[q] ^ pattern[node]) & own)
            ok = seen <= distance
            q, node, seen = q[ok], node[ok], seen[ok]
            above, n = mask[node], first[node + 1] - first[node]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            q, above, seen, node = np.repeat(q, n), np.repeat(above, n), np.repeat(seen, n), np.repeat(first[node], n) + inside
        later = node > q
        q, node, seen, above = q[later], node[later], seen[later], above[later]
        ok = seen + np.bitwise_count((self.codes[q] ^ self.codes[node]) & ~above) <= distance
        return q[ok], node[ok]


def forest(codes: np.ndarray, route: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what links within a route: (code, first code of its component)."""
    index = GrayIndex(codes, route)
    label = np.arange(len(codes))
    sizes = np.diff(np.append(np.flatnonzero(np.r_[True, route[1:] != route[:-1]]), len(route)))
    reach = np.repeat(sizes, sizes)  # what a query may meet at most
    root = np.repeat(np.arange(len(sizes)), sizes)
    several = np.flatnonzero(reach > 1)
    cost = np.cumsum(reach[several])
    at = 0
    while at < len(several):
        to = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + FRONTIER)))
        a, b = index.links(several[at:to], root[several[at:to]], distance)
        while len(a):  # labels fall to the least of each component
            a_, b_ = label[a], label[b]
            if (a_ == b_).all():
                break
            small, large = np.minimum(a_, b_), np.maximum(a_, b_)
            np.minimum.at(label, large, small)
            while (label != label[label]).any():
                label = label[label]
        at = to
    moved = np.flatnonzero(label != np.arange(len(label)))
    return codes[moved], codes[label[moved]]


def _forest_batches(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """(route, lo, hi, code), sorted and with whole groups in a task, to edges."""
    begin("simhash")
    held: list[tuple[np.ndarray, ...]] = []
    n = 0

    def solve(parts: list[tuple[np.ndarray, ...]], whole: bool) -> tuple[pa.RecordBatch | None, list]:
        key, lo, hi, code = (np.concatenate(x) for x in zip(*parts, strict=True))
        new = np.r_[True, (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]
        end = len(key) if whole else int(np.flatnonzero(new)[-1])
        rest = [] if end == len(key) else [(key[end:], lo[end:], hi[end:], code[end:])]
        if not end:
            return None, rest
        route = np.cumsum(new[:end]) - 1
        codes = code[:end].view(np.uint64)
        order = np.lexsort((gray_rank(codes), route))
        a, b = forest(codes[order], route[order], distance)
        return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]), rest

    for batch in batches:
        if batch.num_rows:
            held.append(tuple(c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns))
            n += batch.num_rows
        if n > 100_000:
            out, held = solve(held, False)
            n = sum(len(x[0]) for x in held)
            if out is not None:
                yield out
    if held:
        yield solve(held, True)[0]


def edges(codes: DataFrame, distance: int = DISTANCE, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column ``_fp``) that give the same components as all links."""
    keys = []
    for k, (i, j) in enumerate(ROUTES):
        bits = [F.shiftrightunsigned("_fp", BLOCKS[x][0]).bitwiseAND(F.lit((1 << BLOCKS[x][1]) - 1)) for x in (i, j)]
        keys.append(F.lit(k << 22).cast("long") + F.shiftleft(bits[0], 11) + bits[1])
    routed = codes.select("_fp", F.explode(F.array(*keys)).alias("key"))
    big = staged(routed.groupBy("key").count().where(F.col("count") > hot).select("key", F.ceil(F.col("count") / block).alias("_blocks")), "hot-routes")
    dealt = routed.join(big, "key", "left").withColumn("_n", F.coalesce("_blocks", F.lit(1)))
    dealt = dealt.withColumn("_own", F.pmod(F.xxhash64("_fp", "key"), F.col("_n"))).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    dealt = dealt.select("key", F.least("_own", "_other").alias("lo"), F.greatest("_own", "_other").alias("hi"), "_fp")
    together = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return together.mapInArrow(lambda b: _forest_batches(b, distance), "a long, b long")


def label(prints: DataFrame, distance: int = DISTANCE, more: DataFrame | None = None) -> DataFrame:
    """(_fp, component_id) for the distinct fingerprints of (doc_id, _fp); ``more`` has further edges (a, b) between them."""
    codes = staged(prints.groupBy("_fp").agg(F.min("doc_id").alias("_first")), "codes")
    near = edges(codes, distance)
    found = staged(components(staged(near if more is None else near.union(more), "links")), "components")
    named = codes.join(found, codes["_fp"] == found["node"]).groupBy("component").agg(F.min("_first").alias("component_id"))
    linked = found.join(named, "component").select(F.col("node").alias("_fp"), "component_id")
    alone = codes.join(found, codes["_fp"] == found["node"], "left_anti").select("_fp", F.col("_first").alias("component_id"))
    return staged(linked.union(alone), "labels")


def cluster(docs: DataFrame, words_each: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint and component_id of each document."""
    prints = staged(fingerprints(docs.select("doc_id", "text"), words_each).drop("text"), "fingerprints")
    return prints.join(label(prints, distance), "_fp").select("doc_id", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, words_each: int = SHINGLE, distance: int = DISTANCE, more: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The documents that stay: of each component the one with the smallest doc_id, with its columns as they were.

    Rows that agree in doc_id and fingerprint stand or fall together; a row
    whose doc_id is null stays only if its component has no other. ``more``
    makes further edges between fingerprints from (_fp, text).
    """
    names = docs.columns
    whole = staged(fingerprints(docs, words_each).toDF(*[f"c{k}" for k in range(len(names))], "_fp"), "fingerprinted")
    own = F.col(f"c{names.index('doc_id')}")
    prints = whole.select(own.alias("doc_id"), "_fp")
    labels = label(prints, distance, more and more(whole.select("_fp", F.col(f"c{names.index('text')}").alias("text"))))
    out = prints.join(labels, "_fp").where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "_fp").distinct()
    out = staged(out, "dropped").withColumnRenamed("_fp", "_gone")
    stays = whole.join(out, (own.eqNullSafe(out["doc_id"])) & (whole["_fp"] == out["_gone"]), "left_anti")
    return stays.drop("_fp").toDF(*names)
