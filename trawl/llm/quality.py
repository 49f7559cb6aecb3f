"""Ordinal quality classifier on graded ratings.

A cumulative-link (proportional odds) model: P(grade >= k) = sigmoid(w.x - t_k)
with one weight vector over hashed text features and ordered thresholds
t_1 <= t_2 <= ... . Features say what occurs in a text: its runs of word
characters and of punctuation (lower-case A-Z), by a hash, and its shape in
steps (shares of capitals, digits, punctuation, spaces; how much repeats; word
and text length). The expected grade is the sum of the tail probabilities; a
document is selected if its probability of the top grade reaches a cut, chosen
on ratings held out from fitting so that ``KEEP`` of the rated top-grade
documents stay.

Fitting uses at most ``SAMPLE`` rated documents, those whose doc_id hashes
lowest; this bound is a parameter, and the only thing here that doesn't look
at all data. One task fits, so that the driver meets no more than the model.
Scoring reads each whole text once, without a shuffle.

Edge cases: a null text is empty; ratings that are null, or of unknown
documents, are left out; several ratings of a document count as the lowest, and
of its rows the text that sorts first; scores that tie at the cut are selected;
without ratings of both the top and a lower grade nothing is rejected; an empty
table gives an empty result; columns of other names pass through ``select``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trawl.llm.worker import begin

#: Rated documents that are fitted on, at most.
SAMPLE = 20_000
DIM = 1 << 18
KEEP = 0.995
EPOCHS = 20
RATE = 0.1
SHRINK = 5e-4
#: A feature gets a weight if so many of the rated documents have it.
COMMON = 5
#: Every FOLD-th rated document is held out for the cut.
FOLD = 5
#: Bytes that are hashed together; a longer text goes in parts that end at white space.
PART = 1 << 20

_MULT = 0x9E3779B97F4A7C15
_SPACE, _PUNCT, _WORD = 0, 1, 2
_CLASS = np.array([_SPACE if b <= 32 or b == 127 else _WORD if chr(b).isalnum() or b >= 128 else _PUNCT for b in range(256)], dtype=np.uint8)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint64)
#: capitals, digits, punctuation, space
_SETS = [np.array([f(b) for b in range(256)], dtype=bool) for f in (lambda b: 65 <= b <= 90, lambda b: 48 <= b <= 57, lambda b: _CLASS[b] == _PUNCT, lambda b: _CLASS[b] == _SPACE)]
_STEPS = np.array([0.002, 0.005, 0.01, 0.02, 0.04, 0.06, 0.08, 0.1, 0.13, 0.16, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97])


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, 0x100000001B3, np.uint64))


_POWER = _powers(PART + 1)
_INVERSE = _powers(1)[0]
with np.errstate(over="ignore"):
    for _ in range(6):  # Newton's steps to the inverse modulo 2**64
        _INVERSE *= np.uint64(2) - _POWER[0] * _INVERSE
    _UNPOWER = np.cumprod(np.full(PART + 1, _INVERSE, np.uint64))


def _runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of word characters and of punctuation, and their lengths."""
    kinds = _CLASS[data]
    starts = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]])
    ends = np.append(starts[1:], len(data))
    ok = kinds[starts] != _SPACE
    starts, ends = starts[ok], ends[ok]
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[data] + np.uint64(1)) * _POWER[: len(data)])])
        return (sums[ends] - sums[starts]) * _UNPOWER[starts], ends - starts


def _mixed(x: np.ndarray, dim: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(31)) * np.uint64(_MULT)
        x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ x >> np.uint64(32)) % np.uint64(dim)).astype(np.int32)


def _parts(data: bytes) -> Iterator[bytes]:
    at = 0
    while len(data) - at > PART:
        cut = max(data.rfind(b" ", at, at + PART), data.rfind(b"\n", at, at + PART)) + 1
        cut = cut if cut > at else at + PART
        yield data[at:cut]
        at = cut
    yield data[at:]


def features(text: str | None, dim: int = DIM) -> np.ndarray:
    """The features of a text that are on, as ascending numbers below ``dim``."""
    data = (text or "").encode("utf-8", "surrogatepass")
    hashes, shape, words = [], np.zeros(4), 0
    for part in _parts(data):
        raw = np.frombuffer(part, np.uint8)
        if len(raw):
            h, _ = _runs(raw)
            hashes.append(h)
            shape += [s[raw].sum() for s in _SETS]
            words += len(h)
    found = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
    n = max(1, len(data))
    shares = [*(shape / n), len(found) / max(1, words)]
    steps = [int(np.searchsorted(_STEPS, s)) for s in shares] + [min(30, n // max(1, words)), int(np.log2(n) * 2)]
    # each measure has the steps that it reaches, so that weights add up
    marks = np.array([1_000_003 * (k + 1) + s for k, top in enumerate(steps) for s in range(top + 1)], dtype=np.uint64)
    return np.unique(np.concatenate([_mixed(found, dim), _mixed(marks << np.uint64(20), dim)]))


@dataclass
class Model:
    """Weights, ordered thresholds of grades 1, 2, ..., and the cut on the top grade's probability."""

    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.0

    def tails(self, rows: list[np.ndarray]) -> np.ndarray:
        """P(grade >= k) for each row and k = 1, 2, ..."""
        if not rows:
            return np.zeros((0, len(self.thresholds)))
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        score = np.bincount(owner, self.weights[np.concatenate(rows)].astype(np.float64), len(rows))
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -500, 500)))


def train(rows: list[np.ndarray], grades: np.ndarray, top: int, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, batch: int = 64, shrink: float = SHRINK, seed: int = 1) -> Model:
    """Fit by AdaGrad on the likelihood, with weights drawn to zero."""
    share = np.array([np.clip((grades >= k).mean() if len(grades) else 0.5, 1e-3, 1 - 1e-3) for k in range(1, top + 1)])
    model = Model(np.zeros(dim, np.float32), -np.log(share / (1 - share)))
    if not len(rows):
        return model
    seen, seen_t, order = np.full(dim, 1e-2), np.full(top, 1.0), np.random.default_rng(seed)
    for _ in range(epochs):
        mixed = order.permutation(len(rows))
        for at in range(0, len(rows), batch):
            few = mixed[at : at + batch]
            own = [rows[i] for i in few]
            p = model.tails(own)
            # of the ordinal likelihood: P(grade) is a difference of two neighbouring tails
            pad = np.hstack([np.ones((len(few), 1)), p, np.zeros((len(few), 1))])
            g = grades[few]
            r = np.arange(len(few))
            hi, lo = pad[r, g], pad[r, g + 1]
            inside = np.maximum(hi - lo, 1e-9)
            d_hi, d_lo = hi * (1 - hi) / inside, -lo * (1 - lo) / inside
            slope = d_hi + d_lo
            d_t = np.zeros(top)
            np.add.at(d_t, np.maximum(g - 1, 0), -d_hi * (g > 0))
            np.add.at(d_t, np.minimum(g, top - 1), -d_lo * (g < top))
            idx = np.concatenate(own)
            grad = np.bincount(idx, np.repeat(slope, [len(o) for o in own]), dim) / len(few)
            on = np.flatnonzero(grad)
            seen[on] += grad[on] ** 2
            step = rate / np.sqrt(seen[on])
            w = model.weights[on] + step * grad[on]
            model.weights[on] = np.sign(w) * np.maximum(np.abs(w) - step * shrink, 0)
            d_t /= len(few)
            seen_t += d_t**2
            model.thresholds = np.sort(model.thresholds + rate * d_t / np.sqrt(seen_t))
    return model


#: What is fitted on.
_ON = pa.schema([("doc_id", pa.int64()), ("grade", pa.int32()), ("on", pa.list_(pa.int32()))])


def _featured(docs: DataFrame, dim: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("quality")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                few = batch.slice(at, 256)
                yield pa.record_batch([few[0], few[1], pa.array([features(t, dim) for t in few[2].to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "grade", "on"])

    return docs.select("doc_id", "grade", "text").mapInArrow(run, "doc_id long, grade int, on array<int>")


def fit(docs: DataFrame, ratings: DataFrame, top: int, sample: int = SAMPLE, keep: float = KEEP, dim: int = DIM) -> Model:
    """Fit on ``ratings`` (doc_id, grade from 0 to ``top``) of ``docs``."""
    rated = ratings.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "grade").agg(F.min("text").alias("text"))  # one row for each rating that is fitted on

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("quality")
        model = _fitted(pa.Table.from_batches(batches, _ON), top, keep, dim)
        yield pa.record_batch([pa.array([x]) for x in (model.weights.tobytes(), model.thresholds.tolist(), model.cut)], names=["weights", "thresholds", "cut"])

    found = _featured(texts, dim).repartition(1).mapInArrow(run, "weights binary, thresholds array<double>, cut double").collect()  # a row at most
    if not found:
        return _fitted(_ON.empty_table(), top, keep, dim)
    return Model(np.frombuffer(found[0]["weights"], np.float32), np.array(found[0]["thresholds"]), found[0]["cut"])


def _fitted(table: pa.Table, top: int, keep: float, dim: int) -> Model:
    """The model of (doc_id, grade, on)."""
    order = np.argsort(table["doc_id"].to_numpy(), kind="stable")
    grades = table["grade"].to_numpy()[order].astype(np.int64)
    on = table["on"].combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32()))
    rows = [on[int(i)].values.to_numpy() for i in order]
    held = np.arange(len(rows)) % FOLD == 0
    if not (0 < (grades == top).sum() < len(grades)):
        return train([], grades, top, dim)
    fitted = [r for r, h in zip(rows, held, strict=True) if not h]
    times = np.zeros(dim, np.int32)
    for r in fitted:  # a row has a feature once
        times[r] += 1
    common = times >= COMMON
    model = train([r[common[r]] for r in fitted], grades[~held], top, dim)
    good = np.sort(model.tails([r for r, h in zip(rows, held & (grades == top), strict=True) if h])[:, -1])
    model.cut = float(good[int(len(good) * (1 - keep))]) if len(good) else 0.0
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected_grade, p_ge_1 ... p_ge_top and selected, for every document."""
    out, _ = _scored(docs.select("doc_id", "text"), model)
    return out.drop("text")


def select(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are selected, with their columns as they were."""
    names = docs.columns
    renamed = docs.select(*[docs[f"`{n}`"].alias(f"c{k}") for k, n in enumerate(names)])
    out, measures = _scored(renamed, model, f"c{names.index('text')}")
    return out.where("selected").drop(*measures).toDF(*names)


def _scored(docs: DataFrame, model: Model, text: str = "text") -> tuple[DataFrame, list[str]]:
    measures = ["expected_grade", *[f"p_ge_{k + 1}" for k in range(len(model.thresholds))], "selected"]
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)
    schema = StructType(list(docs.schema))
    for m in measures:
        schema = schema.add(m, "boolean" if m == "selected" else "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("quality")
        own = shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                few = batch.slice(first, 256)
                p = own.tails([features(t, len(own.weights)) for t in few[at].to_pylist()])
                yield pa.record_batch([*few.columns, pa.array(p.sum(axis=1)), *[pa.array(c) for c in p.T], pa.array(p[:, -1] >= own.cut)], names=schema.names)

    return docs.mapInArrow(run, schema), measures
