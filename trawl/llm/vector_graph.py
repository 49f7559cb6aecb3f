"""Embedding near-dedup over robust-pruned flat graphs.

Centroids fitted on a bounded sample split the vectors into clusters; every
vector goes into its ``OVERLAP`` nearest ones. For each of these shards a flat
graph is built: a vector's candidate neighbours are its nearest ones and some
random ones, thinned by robust pruning, with reverse edges, and with an edge
to whatever the medoid couldn't reach. The adjacency lists that a vector has in
its shards are united. Then each member of a shard is searched for in it:
greedily from the medoid with a beam, then the search widens over all
neighbours within the range, plus ``SLACK``, until nothing new is found. What
it finds is verified by cosine in double precision. A pair that lies in
several shards counts in the first of them.

Exact copies of a vector are one node with a weight. A shard with more than
``HOT`` members is dealt out as pairs of blocks of ``BLOCK``, so no task holds
more. A shard returns, per vector, how many it links to, and a spanning forest
of its links: never all pairs. ``audit`` compares with brute force.

Edge cases: a vector that is null, empty, zero or holds null or non-finite
components links with nothing; vectors of different lengths never link; a null
``vec_id`` counts as a vector, and names a component only if there is no other;
repeated rows are copies of each other; vectors of doubles are compared as such,
others as floats, in double precision either way; an empty table gives an empty
result; columns of other names than ``vec_id`` and ``embedding`` are not looked
at.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.components import components
from trawl.llm.worker import begin
from trawl.staging import staged

COSINE = 0.9
#: Vectors that the centroids are fitted on, and centroids, at most; vectors that a shard should have.
SAMPLE = 20_000
CENTROIDS = 1024
MEMBERS = 700
OVERLAP = 2
HOT = 6144
BLOCK = 2048
#: Of the graph: nearest and random candidates, edges kept of each, the pruning factor, the beam, and the range's slack.
NEAR, RANDOM = 32, 24
KEEP_NEAR, KEEP_RANDOM = 16, 8
ALPHA = 1.2
BEAM = 32
SLACK = 0.05
#: Queries that are searched for together.
TOGETHER = 256


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows with norm one, in double precision, also where squares would overflow."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Spherical k-means."""
    x = unit(sample)
    k = min(k, len(x))
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        some = np.abs(sums).max(axis=1) > 0
        centres[some] = unit(sums[some])
    return centres


def _prune(x: np.ndarray, nodes: np.ndarray, pool: np.ndarray, keep: int) -> np.ndarray:
    """Of each node's pool, nearest first, up to ``keep`` neighbours by robust pruning; -1 where there are fewer."""
    out = np.full((len(nodes), keep), -1)
    for at in range(0, len(nodes), TOGETHER):
        p, c = nodes[at : at + TOGETHER], pool[at : at + TOGETHER]
        v = x[c]
        near = np.sqrt(np.maximum(2 - 2 * np.einsum("nd,ncd->nc", x[p], v), 0))
        order = np.argsort(near, axis=1, kind="stable")
        c, near, v = np.take_along_axis(c, order, 1), np.take_along_axis(near, order, 1), np.take_along_axis(v, order[..., None], 1)
        between = np.sqrt(np.maximum(2 - 2 * (v @ v.transpose(0, 2, 1)), 0))
        alive = c != p[:, None]
        rows = np.arange(len(p))
        for k in range(keep):
            first = alive.argmax(axis=1)
            some = alive[rows, first]
            if not some.any():
                break
            out[at + rows[some], k] = c[rows[some], first[some]]
            alive &= ~((ALPHA * between[rows, first] <= near) & some[:, None])
            alive[rows, first] = False
    return out


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(axis=0)).argmax())


def build(x: np.ndarray, seed: int = 0) -> list[np.ndarray]:
    """Adjacency lists of a flat graph in which the medoid reaches every row of ``x`` (unit vectors)."""
    n = len(x)
    if n == 1:
        return [np.zeros(0, np.int64)]
    nodes = np.arange(n)
    near = np.empty((n, min(NEAR, n - 1)), np.int64)
    for at in range(0, n, TOGETHER):
        s = x[at : at + TOGETHER] @ x.T
        s[np.arange(len(s)), nodes[at : at + TOGETHER]] = -2
        near[at : at + TOGETHER] = np.argpartition(-s, near.shape[1] - 1, axis=1)[:, : near.shape[1]]
    far = np.random.default_rng(seed).integers(0, n, (n, min(RANDOM, n)))
    edges = np.hstack([_prune(x, nodes, near, KEEP_NEAR), _prune(x, nodes, far, KEEP_RANDOM)])
    a, b = np.repeat(nodes, edges.shape[1]), edges.ravel()
    a, b = a[b >= 0], b[b >= 0]
    pairs = np.unique(np.concatenate([a * n + b, b * n + a]))
    # reverse edges in full: a node has many only if it is near to many
    lists = np.split(pairs % n, np.searchsorted(pairs // n, nodes[1:]))
    seen, wave = np.zeros(n, bool), np.array([medoid(x)])
    seen[wave] = True
    while True:
        while len(wave):
            wave = np.unique(np.concatenate([lists[i] for i in wave]))
            wave = wave[~seen[wave]]
            seen[wave] = True
        lost = np.flatnonzero(~seen)
        if not len(lost):
            return lists
        reached = np.flatnonzero(seen)
        to = reached[int((x[reached] @ x[lost[0]]).argmax())]
        lists[to], lists[lost[0]] = np.append(lists[to], lost[0]), np.append(lists[lost[0]], to)
        wave = lost[:1]
        seen[wave] = True


def search(x: np.ndarray, lists: list[np.ndarray], queries: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """For rows of ``x`` as queries: (query, row) with cosine of ``least`` or more, as found."""
    sizes = np.array([len(y) for y in lists])
    flat, first = np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64), np.cumsum(sizes) - sizes
    found_q, found_v = [], []

    def neighbours(q: np.ndarray, v: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Neighbours of v for query q that are new to it, with their cosines."""
        n = sizes[v]
        to = flat[np.repeat(first[v] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        key = np.unique(np.repeat(q, n) * len(x) + to)
        q, to = key // len(x), key % len(x)
        new = ~seen[q, to]
        q, to = q[new], to[new]
        seen[q, to] = True
        cos = np.empty(len(q))
        for at in range(0, len(q), 1 << 17):
            part = slice(at, at + (1 << 17))
            cos[part] = np.einsum("ij,ij->i", x[queries_here[q[part]]], x[to[part]])
        return q, to, cos

    start = medoid(x)
    for at in range(0, len(queries), TOGETHER):
        queries_here = queries[at : at + TOGETHER]
        m = len(queries_here)
        rows = np.arange(m)
        seen = np.zeros((m, len(x)), bool)
        seen[:, start] = True
        beam = np.full((m, BEAM), -1)
        value = np.full((m, BEAM), -2.0)
        open_ = np.zeros((m, BEAM), bool)
        beam[:, 0], value[:, 0], open_[:, 0] = start, x[queries_here] @ x[start], True
        hits = [(rows, np.full(m, start), value[:, 0].copy())]
        while True:
            best = np.where(open_, value, -3.0).argmax(axis=1)
            active = np.flatnonzero(open_[rows, best])
            if not len(active):
                break
            open_[active, best[active]] = False
            q, v, cos = neighbours(active, beam[active, best[active]], seen)
            hits.append((q, v, cos))
            # the new ones beside the beam, the best of each stay
            count = np.bincount(q, minlength=m)
            width = int(count.max(initial=0))
            if not width:
                continue
            place = np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count)
            more_v, more_c = np.full((m, width), -1), np.full((m, width), -2.0)
            more_v[q, place], more_c[q, place] = v, cos
            all_c = np.hstack([value, more_c])
            top = np.argpartition(-all_c, BEAM - 1, axis=1)[:, :BEAM]
            value = np.take_along_axis(all_c, top, 1)
            beam = np.take_along_axis(np.hstack([beam, more_v]), top, 1)
            open_ = np.take_along_axis(np.hstack([open_, more_v >= 0]), top, 1)
        # the range widens from what lies in it
        q, v, cos = (np.concatenate(z) for z in zip(*hits, strict=True))
        while len(q):
            inside = cos >= least - SLACK
            q, v, cos = q[inside], v[inside], cos[inside]
            found_q.append(queries_here[q])
            found_v.append(v)
            q, v, cos = neighbours(q, v, seen) if len(q) else (q, v, cos)
    a, b = np.concatenate([*found_q, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*found_v, np.zeros(0, np.int64)]).astype(np.int64)
    ok = np.empty(len(a), bool)
    for at in range(0, len(a), 1 << 17):
        part = slice(at, at + (1 << 17))
        ok[part] = np.einsum("ij,ij->i", x[a[part]], x[b[part]]) >= least
    ok &= a != b
    return a[ok], b[ok]


def _matrix(column: pa.ChunkedArray | pa.ListArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy().reshape(len(column), -1)


def _build_shard(table: pa.Table) -> pa.Table:
    begin("vectors")
    table = table.sort_by("gid")
    gid = table["gid"].to_numpy()
    lists = build(unit(_matrix(table["v"])))
    return pa.table({"gid": gid, "near": pa.array([gid[n] for n in lists], pa.list_(pa.int64()))})


def _search_shard(table: pa.Table, cosine: float) -> pa.Table:
    table = table.sort_by("gid")
    gid, weight, own = (table[c].to_numpy() for c in ("gid", "weight", "own"))
    x = unit(_matrix(table["v"]))
    lists = []
    for near in table["near"]:
        at = np.searchsorted(gid, to := near.values.to_numpy())
        lists.append(at[(at < len(gid)) & (gid[np.minimum(at, len(gid) - 1)] == to)])
    a, b = search(x, lists, np.arange(len(x)), cosine)
    n = np.int64(len(x))
    key = np.unique(np.concatenate([a * n + b, b * n + a]))
    a, b = key // n, key % n
    shard, lo, hi = (table[c][0].as_py() for c in ("shard", "lo", "hi"))
    # counted once: in the first shard that both lie in, and there by their blocks
    shards = _matrix(table["shards"])
    common = np.full(len(a), np.iinfo(np.int64).max)
    for i in range(shards.shape[1]):
        for j in range(shards.shape[1]):
            same = shards[a, i] == shards[b, j]
            common[same] = np.minimum(common[same], shards[a[same], i])
    counted = (common == shard) & ((own[a] != own[b]) if lo != hi else True)
    links = np.bincount(a[counted], weight[b[counted]], len(x)).astype(np.int64)
    label = np.arange(len(x))
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        if (low == high).all():
            break
        np.minimum.at(label, high, low)
        while (label != label[label]).any():
            label = label[label]
    some = np.flatnonzero((links > 0) | (label != np.arange(len(x))))
    return pa.table({"gid": gid[some], "root": gid[label[some]], "n": links[some]})


def _valid(v: str) -> str:
    return f"{v} IS NOT NULL AND size({v}) > 0 AND forall({v}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists({v}, x -> x <> 0)"


def members(nodes: DataFrame, overlap: int = OVERLAP, size: int = MEMBERS, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """Rows of every shard, for (gid, weight, v): with shard, blocks, own block, and all shards of the vector."""
    spark = nodes.sparkSession
    counts = {r["d"]: r["n"] for r in nodes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    sample = nodes.orderBy(F.xxhash64("v"), "gid").limit(SAMPLE).select("v").toArrow()["v"].to_pylist() if counts else []
    centres, base = {}, 0
    for d in sorted(counts):
        own = [v for v in sample if len(v) == d]
        fitted = fit_centroids(np.array(own), min(CENTROIDS, ceil(counts[d] / size))) if own else np.eye(1, d)
        centres[d] = (base, fitted)
        base += len(fitted)
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches):
        for batch in batches:
            vectors = batch.column(2)
            lengths = vectors.value_lengths().to_numpy()
            flat, ends = vectors.flatten().to_numpy(), np.cumsum(lengths)
            for d in np.unique(lengths):
                mine = np.flatnonzero(lengths == d)
                x = unit(flat[(ends[mine] - d)[:, None] + np.arange(d)[None, :]])
                base, fitted = shared.value[int(d)]
                n = min(overlap, len(fitted))
                near = base + np.argsort(-(x @ fitted.T), axis=1, kind="stable")[:, :n]
                rows = batch.take(pa.array(np.repeat(mine, n)))
                kinds = pa.list_(pa.int64())
                yield pa.record_batch([pa.array(near.ravel()), *rows.columns, pa.array([r for r in np.repeat(np.sort(near, axis=1), n, axis=0)], kinds)], names=["shard", "gid", "weight", "v", "shards"])

    kind = nodes.schema["v"].dataType.simpleString()
    placed = staged(nodes.select("gid", "weight", "v").mapInArrow(assign, f"shard long, gid long, weight long, v {kind}, shards array<long>"), "placed")
    big = staged(placed.groupBy("shard").count().where(F.col("count") > hot).select("shard", F.ceil(F.col("count") / block).alias("_blocks")), "hot-shards")
    dealt = placed.join(F.broadcast(big), "shard", "left").withColumn("_n", F.coalesce("_blocks", F.lit(1)))  # no more rows than centroids
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("gid"), F.col("_n"))).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    return dealt.select("shard", F.least("own", "_other").alias("lo"), F.greatest("own", "_other").alias("hi"), "own", "gid", "weight", "shards", "v")


def link(vectors: DataFrame, cosine: float = COSINE, overlap: int = OVERLAP, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors`` (vec_id, embedding)."""
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("v")).withColumn("v", F.expr(f"CASE WHEN {_valid('v')} THEN transform(v, x -> x + {kind}(0)) END"))
    rows = staged(rows, "vectors")
    distinct = rows.where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("weight"), F.min("vec_id").alias("first"))
    nodes = staged(distinct.withColumn("gid", F.monotonically_increasing_id()), "nodes")
    placed = staged(members(nodes, overlap, hot=hot, block=block), "members")
    keys = ["shard", "lo", "hi"]
    graph = placed.groupBy(*keys).applyInArrow(_build_shard, "gid long, near array<long>")
    united = graph.groupBy("gid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    found = placed.join(united, "gid").groupBy(*keys).applyInArrow(lambda t: _search_shard(t, cosine), "gid long, root long, n long")
    found = staged(found, "found")
    grouped = staged(components(found.select(F.col("gid").alias("a"), F.col("root").alias("b"))), "components")
    links = found.groupBy("gid").agg(F.sum("n").alias("_n"))
    named = nodes.select("gid", "first").join(grouped, F.col("gid") == F.col("node")).groupBy("component").agg(F.min("first").alias("_least"))
    named = grouped.join(named, "component").select(F.col("node").alias("gid"), "_least")
    labels = nodes.join(links, "gid", "left").join(named, "gid", "left")
    labels = labels.select("v", (F.coalesce("_n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("_least", "first").alias("component_id"))
    out = rows.where("v IS NOT NULL").join(staged(labels, "labels"), "v").select("vec_id", "n_links", "component_id")
    alone = rows.where("v IS NULL").select("vec_id", F.lit(0).cast("long"), "vec_id")
    return out.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def audit(vectors: DataFrame, linked: DataFrame, queries: int = 500, cosine: float = COSINE) -> tuple[float, int]:
    """Share of brute force's links that ``linked`` has, over the ``queries`` vectors whose vec_id hashes lowest, and how many links those are (without any, the share says nothing)."""
    rows = vectors.select("vec_id", F.expr(f"CASE WHEN {_valid('embedding')} THEN embedding END").alias("v")).where("v IS NOT NULL")
    asked = rows.orderBy(F.xxhash64("vec_id")).limit(queries).toArrow()
    if not asked.num_rows:
        return 1.0, 0
    ids, q = asked["vec_id"].to_numpy(), unit(_matrix(asked["v"]))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = unit(_matrix(batch.column(1)))
                yield pa.record_batch([pa.array(ids), pa.array((q @ x.T >= cosine).sum(axis=1), pa.int64())], names=["vec_id", "n"])

    brute = rows.mapInArrow(run, "vec_id long, n long").groupBy("vec_id").agg((F.sum("n") - 1).alias("n"))
    row = brute.join(linked, "vec_id").agg(F.sum("n"), F.sum("n_links")).first()
    return (row[1] / row[0], row[0]) if row[0] else (1.0, 0)
