"""Substring dedup by paragraph MinHash banding.

A repeated passage rarely begins and ends where lines do, so texts are cut into
small paragraphs: sentences, ended by a full stop, exclamation or question mark
or a line feed, where sentences under ``LEAST`` words go on into the next such
ones until they have as many (``SHINGLE`` words are enough before a longer
sentence and at the end of a text). Paragraphs have
a MinHash signature over shingles of five words (lower-case A-Z, punctuation
aside). Bands have ``ROWS`` values, and there are as many as it takes for a
pair with Jaccard similarity 0.8 to collide with probability ``RECALL``
(``tuned``). Equal paragraphs are one node; colliding ones are joined and
verified by their exact Jaccard similarity; verified links form components.

Paragraphs alone miss repeats within long stretches without full stops, and
those cut at other places. So texts also have windows of ``PASSAGE`` words,
wherever sentences end: of every ``CHOICE`` neighbouring ones that with the
least hash. What is chosen rests on the words alone, so a word-for-word repeat
of PASSAGE + CHOICE - 1 = 51 words or more holds a whole window that both texts
chose. Equal windows are a cluster, like a component of paragraphs.

Of a cluster that several documents have, the first occurrence by doc_id and
place stays and the others are removed, each decided on its own: a word goes if
it lies in an occurrence that is removed and in none that stays. So every
cluster keeps one whole occurrence, and words in no cluster always stay.
Clustered words without others between them make up a stretch; those of
``PASSAGE`` words or more are reported, cut into passages where the decision
changes. (The ends of a longer repeat that lie within a sentence, and before
its first or after its last window, aren't seen.)

Texts are read twice: once to count hashes, and once for the places and words of
what occurs again or collides. A ``sieve`` lets nearly only these through: a
bitmap of at most ``SIEVE`` bits, so that its broadcast is bounded. It saves
shuffling; where it lets others through too, the joins that follow drop them.

A band value that more than ``HOT`` different paragraphs share is dealt out as
pairs of blocks. A task returns a spanning forest of its links.

Edge cases: a null or empty text has no paragraphs; rows with a null doc_id
take part, and theirs come last; repeated rows repeat each other; copies within
one doc_id alone are no repeat across documents; ties go to the smaller place,
then to the row that is read first; a very long text is cut alone, in memory
that its own length sets; columns of other names than ``doc_id`` and ``text``
are not looked at; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.components import components
from trawl.llm.hashing import CLASS, WORD, mixed, run_hashes, span_hashes
from trawl.llm.worker import begin
from trawl.staging import staged

SHINGLE = 5
SIMILARITY = 0.8
ROWS, RECALL = 2, 0.99
LEAST = 8
PASSAGE = 24
#: Neighbouring windows of PASSAGE words of which one is chosen.
CHOICE = 28
HOT = 4096
BLOCK = 2048
#: Bytes of text that are cut together; a longer text goes alone.
TOGETHER = 1 << 20

#: Bits of a sieve: so many for each value, and at most.
SPARSE, SIEVE = 8, 1 << 28
#: Rows whose stretches are made up together, about; a document is never divided.
STRETCHED = 100_000

_UNITS = "_row long, doc_id long, place int, n_words int, start int, end int, h long, is_window boolean, words binary"
_ENDS = np.isin(np.arange(256), list(b".!?\n"))
_UPPER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def tuned(similarity: float, rows: int = ROWS, recall: float = RECALL) -> int:
    """Bands of ``rows`` values with which a pair of this similarity collides with probability ``recall``."""
    return ceil(log(1 - recall) / log(1 - similarity**rows))


def _cut(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
    """Paragraphs of texts that lie one after the other: their text, first word, number of words, and the words' places and hashes."""
    kinds = CLASS[data] == WORD
    # a text's first byte begins a word anew
    edge = np.zeros(len(data) + 1, bool)
    edge[begins] = True
    first = np.flatnonzero(kinds & (np.r_[True, ~kinds[:-1]] | edge[:-1]))
    last = np.flatnonzero(kinds & (np.r_[~kinds[1:], True] | edge[1:])) + 1
    text = np.searchsorted(begins, first, "right") - 1
    part = np.cumsum(_ENDS[data])[first] if len(first) else first
    hashes = span_hashes(data, first, last)
    new = np.r_[True, (part[1:] != part[:-1]) | (text[1:] != text[:-1])] if len(first) else np.zeros(0, bool)
    word = np.flatnonzero(new)
    # short sentences go on into the next short ones
    kept, so_far, before = [], 0, -1
    for k, (n, t) in enumerate(zip(np.diff(np.append(word, len(first))).tolist(), text[word].tolist(), strict=True)):
        if t != before or so_far >= LEAST or n >= LEAST:
            kept.append(k)
            so_far, before = 0, t
        so_far += n
    word = word[kept]
    return text, word, np.diff(np.append(word, len(first))), first, last, hashes


def _signatures(hashes: np.ndarray, word: np.ndarray, n: np.ndarray, n_bands: int, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """For paragraphs of at least SHINGLE words: a hash of the whole, and a value for each band."""
    with np.errstate(over="ignore"):
        shingles = sum(hashes[k : len(hashes) - SHINGLE + 1 + k] * np.uint64(0x9E3779B97F4A7C15 * (2 * k + 3) & (1 << 64) - 1 | 1) for k in range(SHINGLE))
        cuts = np.ravel(np.column_stack([word, word + n - SHINGLE + 1]))
        cuts = np.minimum(cuts, len(shingles))
        padded = np.append(shingles, np.uint64(0))
        bands = []
        for b in range(n_bands):
            value = np.zeros(len(word), np.uint64)
            for r in range(rows):
                value = mixed(value * np.uint64(31) + np.minimum.reduceat(mixed(padded + np.uint64(0xD1B54A32D192ED03 * (b * rows + r + 1) & (1 << 64) - 1)), cuts)[::2])
            bands.append(mixed(value + np.uint64(b)))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(hashes))])
        # the order of words shows in their shingles; both sums together tell paragraphs apart
        deep = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(padded[:-1]))])
        whole = mixed((sums[word + n] - sums[word]) + mixed(deep[np.minimum(word + n - SHINGLE + 1, len(shingles))] - deep[word]) + n.astype(np.uint64))
    return whole, np.column_stack(bands)


def _slid(values: np.ndarray, n: int, best: np.ufunc) -> np.ndarray:
    """The least or greatest of every ``n`` neighbouring values, by doubling."""
    size = 1
    while size < n:
        step = min(size, n - size)
        values, size = best(values[:-step], values[step:]), size + step
    return values


def _windows(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of the chosen windows, and their hashes."""
    whole = run_hashes(hashes, PASSAGE)
    if len(whole) < CHOICE:
        return np.zeros(0, np.int64), whole[:0]
    least = _slid(whole, CHOICE, np.minimum)
    least[text[: len(least)] != text[PASSAGE + CHOICE - 2 :]] = 0  # not within one text
    edge = np.zeros(CHOICE - 1, np.uint64)
    chosen = np.flatnonzero((_slid(np.concatenate([edge, least, edge]), CHOICE, np.maximum) == whole) & (whole > 0))
    return chosen, whole[chosen]


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows of (_row, doc_id, text) in groups of about TOGETHER bytes: the rows' numbers in the batch, bytes, where texts begin, and ``_cut``."""
    texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch[2].to_pylist()]
    at = 0
    while at < len(texts):
        to, size = at + 1, len(texts[at])
        while to < len(texts) and size + len(texts[to]) <= TOGETHER:
            size += len(texts[to])
            to += 1
        raw = b"".join(texts[at:to])
        if raw:
            data, begins = np.frombuffer(raw, np.uint8), np.cumsum([0, *map(len, texts[at : to - 1])])
            yield np.arange(at, to), raw, data, begins, *_cut(data, begins)
        at = to


class Sieve:
    """Which values may be among those it was made of."""

    def __init__(self, bits: int, places: np.ndarray, words: np.ndarray):
        self.bits, self.table = bits, np.zeros(max(1, bits >> 6), np.uint64)
        self.table[places] = words

    def passes(self, values: np.ndarray) -> np.ndarray:
        at = values.astype(np.uint64) & np.uint64(self.bits - 1)
        return (self.table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def sieve(values: DataFrame, most: int = SIEVE) -> Broadcast:
    """A broadcast ``Sieve`` of a long column ``v``: at most ``most`` / 64 rows come to the driver."""
    n = values.count()
    bits = min(most, 1 << max(6, (SPARSE * n).bit_length()))
    at = values.select(F.col("v").bitwiseAND(F.lit(bits - 1)).alias("at"))
    table = at.groupBy(F.shiftright("at", 6).alias("place")).agg(F.expr("bit_or(shiftleft(1L, CAST(at & 63 AS INT)))").alias("word")).toArrow()
    return values.sparkSession.sparkContext.broadcast(Sieve(bits, table["place"].to_numpy(), table["word"].to_numpy().view(np.uint64)))


def _unit_batches(batches: Iterator[pa.RecordBatch], n_bands: int, again: Broadcast | None = None, wanted: Broadcast | None = None) -> Iterator[pa.RecordBatch]:
    """(_row, doc_id, text) to paragraphs and windows with their places, as far as they pass ``again``, with words if they pass ``wanted``."""
    names = [x.split(" ")[0] for x in _UNITS.split(", ")]
    begin("passages")
    for batch in batches:
        rows, ids = batch[0].to_numpy(), batch[1]
        for numbers, raw, data, begins, text, word, n, first, last, hashes in _pieces(batch):
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            opens = np.searchsorted(text, np.arange(len(begins)))  # each text's first word
            chosen, whole = _windows(hashes, text)
            long = np.flatnonzero(n >= SHINGLE)
            parts = [(chosen, np.full(len(chosen), PASSAGE), whole, True)]
            if len(long):
                parts.append((word[long], n[long], _signatures(hashes, word[long], n[long], n_bands)[0], False))
            for at, size, h, is_window in parts:
                if again is not None:
                    some = np.flatnonzero(again.value.passes(h))
                    at, size, h = at[some], size[some], h[some]
                of = text[at]
                base, a, b = points[begins[of]], first[at], last[at + size - 1]
                columns = [at - opens[of], size, points[a] - base, points[b] - base]
                texts = pa.nulls(len(at), pa.binary())
                if not is_window:
                    ok = wanted.value.passes(h).tolist() if wanted is not None else [True] * len(h)
                    texts = pa.array([raw[i:j] if x else None for i, j, x in zip(a.tolist(), b.tolist(), ok, strict=True)], pa.binary())
                yield pa.record_batch(
                    [pa.array(rows[numbers[of]]), ids.take(pa.array(numbers[of])), *[pa.array(c, pa.int32()) for c in columns], pa.array(h.view(np.int64)), pa.array(np.full(len(of), is_window)), texts], names=names,
                )


def _key_batches(batches: Iterator[pa.RecordBatch], n_bands: int) -> Iterator[pa.RecordBatch]:
    """(_row, doc_id, text) to different paragraphs with their bands, and windows without, with their numbers."""
    begin("passages")
    names = ["h", *band_names(n_bands), "n"]
    for batch in batches:
        for _, _, _, _, text, word, n, _, _, hashes in _pieces(batch):
            h, times = np.unique(_windows(hashes, text)[1], return_counts=True)
            yield pa.record_batch([pa.array(h.view(np.int64)), *[pa.nulls(len(h), pa.int64())] * n_bands, pa.array(times, pa.int64())], names=names)
            long = np.flatnonzero(n >= SHINGLE)
            if len(long):
                h, bands = _signatures(hashes, word[long], n[long], n_bands)
                h, at, times = np.unique(h, return_index=True, return_counts=True)
                yield pa.record_batch([*[pa.array(x.view(np.int64)) for x in (h, *np.ascontiguousarray(bands[at].T))], pa.array(times, pa.int64())], names=names)


def _band_batches(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    """(h, bands) to (h, band) of the bands that pass."""
    begin("passages")
    for batch in batches:
        h = batch[0].to_numpy()
        bands = np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1)
        ok = shared.value.passes(bands.ravel()).reshape(bands.shape)
        if len(h):
            ok[:, 1:] &= (bands[:, 1:] != bands[:, :1]).all(axis=1, keepdims=True)  # a text of few words has one value for all
        at, k = np.nonzero(ok)
        yield pa.record_batch([pa.array(h[at]), pa.array(bands[at, k])], names=["h", "band"])


def band_names(n_bands: int) -> list[str]:
    return [f"b{k}" for k in range(n_bands)]


def shingles(words: bytes) -> set[tuple[bytes, ...]]:
    """The five-word shingles of a paragraph's text."""
    data = words.translate(_UPPER)
    raw = np.frombuffer(data, np.uint8)
    kinds = np.r_[False, CLASS[raw] == WORD, False]
    a, b = np.flatnonzero(kinds[1:] & ~kinds[:-1]), np.flatnonzero(kinds[:-1] & ~kinds[1:])
    found = [data[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    return {tuple(found[i : i + SHINGLE]) for i in range(max(1, len(found) - SHINGLE + 1))}


def similar(sets: list[set], similarity: float) -> np.ndarray:
    """For each paragraph the first of its component, linked by exact Jaccard similarity."""
    label = np.arange(len(sets))
    if len(sets) <= 12:
        pairs = [(i, j) for j in range(len(sets)) for i in range(j) if (k := len(sets[i] & sets[j])) >= similarity * (len(sets[i]) + len(sets[j]) - k)]
        a, b = (np.array([p[x] for p in pairs], np.int64) for x in (0, 1))
    else:
        number: dict = {}
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        of = np.array([number.setdefault(x, len(number)) for s in sets for x in s])
        often = np.bincount(of)[of] > 1  # what one paragraph has alone is in no intersection
        owner, of = owner[often], np.unique(of[often], return_inverse=True)[1]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for at in range(0, int(of.max(initial=-1)) + 1, 2048):
            here = (of >= at) & (of < at + 2048)
            m = np.zeros((len(sets), 2048), np.float32)
            m[owner[here], of[here] - at] = 1
            both += m @ m.T
        size = np.array([len(s) for s in sets], np.float32)
        a, b = np.nonzero(np.triu(both >= np.float32(similarity) * (size[:, None] + size[None, :] - both) - 1e-4, 1))
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        if (low == high).all():
            break
        np.minimum.at(label, high, low)
        while (label != label[label]).any():
            label = label[label]
    return label


def _verify_batches(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """(band, lo, hi, h, words), sorted and with whole groups in a task, to edges."""
    begin("passages")
    key, group, edges = None, [], []

    def close() -> None:
        if len(group) > 1:
            for (h, _), k in zip(group, similar([shingles(w) for _, w in group], similarity), strict=True):
                if group[k][0] != h:
                    edges.append((h, group[k][0]))

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array([e[x] for e in edges], pa.int64()) for x in (0, 1)], names=["a", "b"])

    for batch in batches:
        for band, lo, hi, h, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (band, lo, hi) != key:
                close()
                key, group = (band, lo, hi), []
            group.append((h, words))
        if len(edges) > 10_000:
            yield out()
            edges.clear()
    close()
    yield out()


def collisions(keys: DataFrame) -> DataFrame:
    """(h, band, count) of the bands that several paragraphs share, staged. ``keys``: different paragraphs' hashes ``h`` and bands."""
    bands = [n for n in keys.columns if n != "h"]
    banded = keys.select(F.explode(F.array_distinct(F.array(*bands))).alias("band"))
    shared = staged(banded.groupBy("band").count().where("count > 1"), "collisions")
    let = sieve(shared.select(F.col("band").alias("v")))
    near = keys.select("h", *bands).mapInArrow(lambda b: _band_batches(b, let), "h long, band long")
    return staged(near.join(shared, "band"), "colliding")


def links(colliding: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between hashes of different paragraphs that give the same components as all verified links.

    ``texts`` has the hash ``h`` and the words of what collides, and may have others and repeat rows.
    """
    wanted = colliding.select("h").distinct()
    # copies are one on the map side, before the join
    words = staged(texts.groupBy("h").agg(F.first("words").alias("words")).join(wanted, "h", "left_semi"), "texts")
    dealt = colliding.withColumn("_n", F.when(F.col("count") > hot, F.ceil(F.col("count") / block)).otherwise(1))
    dealt = dealt.withColumn("_own", F.pmod(F.xxhash64("h", "band"), F.col("_n"))).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    dealt = dealt.select("h", "band", F.least("_own", "_other").alias("lo"), F.greatest("_own", "_other").alias("hi"))
    together = dealt.join(words, "h").select("band", "lo", "hi", "h", "words").repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi", "h")
    return together.mapInArrow(lambda b: _verify_batches(b, similarity), "a long, b long")


_HIT = ["_row", "doc_id", "place", "n_words", "start", "end", "n", "first_id", "kept"]
_PASSAGES = "doc_id long, start long, end long, n_words long, component_id long, n_documents long, removed boolean"


def stretches(rows: dict[str, np.ndarray], passage: int = PASSAGE) -> dict[str, np.ndarray]:
    """Passages of whole documents from their clustered occurrences (columns ``_HIT``, in order of _row)."""
    place, n = rows["place"].astype(np.int64), rows["n_words"].astype(np.int64)
    # documents one after the other, apart from each other
    new = np.r_[True, rows["_row"][1:] != rows["_row"][:-1]]
    opens = np.flatnonzero(new)
    far = np.maximum.reduceat(place + n, opens) + 1
    a = place + np.repeat(np.cumsum(far) - far, np.diff(np.append(opens, len(new))))
    b = a + n
    # between neighbouring edges nothing changes
    edges, to = np.unique(np.concatenate([a, b]), return_inverse=True)
    lo, hi = to[: len(a)], to[len(a) :]
    cover = np.cumsum(np.bincount(lo, minlength=len(edges)) - np.bincount(hi, minlength=len(edges)))[:-1]
    keep = rows["kept"].astype(np.int64)
    stays = np.cumsum(np.bincount(lo, keep, len(edges)) - np.bincount(hi, keep, len(edges)))[:-1]
    state = np.where(cover == 0, 0, np.where(stays > 0.5, 2, 1))
    # what covers each of these parts
    size = hi - lo
    part = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
    least, most = np.full(len(state), np.iinfo(np.int64).max), np.zeros(len(state), np.int64)
    np.minimum.at(least, part, np.repeat(rows["first_id"], size))
    np.maximum.at(most, part, np.repeat(rows["n"], size))
    # where an edge is in the text, as a beginning and as an end
    starts, ends = np.full(len(edges), -1), np.full(len(edges), -1)
    starts[lo], ends[hi] = rows["start"], rows["end"]
    starts, ends = np.where(starts < 0, ends, starts), np.where(ends < 0, starts, ends)
    owner = np.zeros(len(edges), np.int64)
    owner[lo], owner[hi] = np.arange(len(a)), np.arange(len(a))
    island = np.cumsum(np.r_[True, (state[1:] == 0) != (state[:-1] == 0)]) - 1
    words = np.bincount(island, np.diff(edges))[island]
    first = np.flatnonzero(np.r_[True, state[1:] != state[:-1]])
    after = np.append(first[1:], len(state))
    reported = (state[first] > 0) & (words[first] >= passage)
    least, most = np.minimum.reduceat(least, first)[reported], np.maximum.reduceat(most, first)[reported]
    first, after = first[reported], after[reported]
    return {
        "row": owner[first], "start": starts[first], "end": ends[after], "n_words": edges[after] - edges[first], "component_id": least, "n_documents": most, "removed": state[first] == 1,
    }


def _stretch_batches(batches: Iterator[pa.RecordBatch], passage: int) -> Iterator[pa.RecordBatch]:
    """Occurrences with whole documents in a task, by _row, to passages."""
    begin("passages")
    held: list[pa.RecordBatch] = []
    nobody = np.iinfo(np.int64).max

    def solve(table: pa.Table) -> pa.RecordBatch:
        rows = {n: table[n].to_numpy() for n in table.column_names if n not in ("doc_id", "first_id")}
        rows["first_id"] = table["first_id"].fill_null(nobody).to_numpy()
        out = stretches(rows, passage)
        ids = table["doc_id"].take(pa.array(out["row"])).combine_chunks()
        first = pa.array(out["component_id"], mask=out["component_id"] == nobody)
        return pa.record_batch([ids, *[pa.array(out[n], pa.int64()) for n in ("start", "end", "n_words")], first, pa.array(out["n_documents"], pa.int64()), pa.array(out["removed"])], names=[x.split(" ")[0] for x in _PASSAGES.split(", ")])

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= STRETCHED:
            table = pa.Table.from_batches(held)
            row = table["_row"].to_numpy()
            whole = int(np.searchsorted(row, row[-1]))
            if whole:
                yield solve(table.slice(0, whole))
            held = table.slice(whole).combine_chunks().to_batches()
    if held and (table := pa.Table.from_batches(held)).num_rows:
        yield solve(table)


def repeats(docs: DataFrame, similarity: float = SIMILARITY, passage: int = PASSAGE, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """One row per passage that occurs in other documents too, or part of one.

    doc_id, start and end (code points, end exclusive), n_words, component_id
    (the smallest doc_id that has one of its paragraphs or windows),
    n_documents (most that share one of these), removed (false where it holds
    occurrences to keep).
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_bands = tuned(similarity)
    names = band_names(n_bands)
    keys = rows.mapInArrow(lambda b: _key_batches(b, n_bands), ", ".join(f"{n} long" for n in ["h", *names, "n"]))
    hashes = staged(keys.groupBy("h", *names).agg(F.sum("n").alias("n")), "hashes")
    colliding = collisions(hashes.where("b0 IS NOT NULL").select("h", *names))
    near = staged(colliding.select(F.col("h").alias("v")).distinct(), "wanted")
    again, wanted = sieve(near.union(hashes.where("n > 1").select("h"))), sieve(near)
    units = staged(rows.mapInArrow(lambda b: _unit_batches(b, n_bands, again, wanted), _UNITS), "paragraphs")
    found = staged(components(staged(links(colliding, units.where("words IS NOT NULL").select("h", "words"), similarity, hot, block), "links")), "components")
    units = units.drop("words")
    # clusters that several documents have; copies are counted on the map side
    ranges = [F.min("doc_id").alias("_min"), F.max("doc_id").alias("_max"), F.count("*").alias("_all"), F.count("doc_id").alias("_named")]
    by_hash = units.groupBy("h", "is_window").agg(*ranges)
    named = by_hash.join(found, (by_hash["h"] == found["node"]) & ~by_hash["is_window"], "left").select("h", by_hash["is_window"], F.coalesce("component", "h").alias("c"), "_min", "_max", "_all", "_named")
    named = staged(named, "hashes")
    several = named.groupBy("c", "is_window").agg(F.min("_min").alias("_min"), F.max("_max").alias("_max"), F.sum("_all").alias("_all"), F.sum("_named").alias("_named"))
    several = several.where("_min != _max OR (_named > 0 AND _named < _all)").select("c", "is_window")
    shared = staged(named.select("h", "c", "is_window").join(several, ["c", "is_window"]), "shared")
    named = staged(units.join(shared, ["h", "is_window"]).drop("h"), "named")
    # a document counts once however often it has the paragraph
    keys = ["c", "is_window"]
    by_doc = named.groupBy(*keys, "doc_id").agg(F.min(F.struct("place", "_row")).alias("_at"))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_at"))
    clusters = by_doc.groupBy(*keys).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    clusters = staged(clusters.select(*keys, "n", F.col("_first.doc_id").alias("first_id"), F.col("_first._at._row").alias("first_row"), F.col("_first._at.place").alias("first_place")), "clusters")
    kept = (F.col("_row") == F.col("first_row")) & (F.col("place") == F.col("first_place"))
    hit = named.join(clusters, keys).withColumn("kept", kept).select(*_HIT)
    return hit.repartition("_row").sortWithinPartitions("_row").mapInArrow(lambda b: _stretch_batches(b, passage), _PASSAGES)
