"""Near copies by Jaccard similarity, as links between SimHash fingerprints.

Fingerprints at 4 bits or fewer show only the closest copies: at a Jaccard
similarity of 0.8 about ten bits of 64 differ. So texts are also banded by
MinHash over five-word shingles of their words (as ``trawl.llm.passages`` has
them) and what collides is verified by exact Jaccard similarity. With 8 bands
of two values a pair at 0.8 collides with probability 0.9997.

Edge cases: texts of fewer than five words are one shingle, and link when
their words are equal; a null text or one without words has no such link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm import passages, simhash
from trawl.llm.hashing import CLASS, WORD, mixed, span_hashes
from trawl.llm.lm import texts_together
from trawl.llm.worker import begin
from trawl.staging import staged

BANDS, ROWS = 8, 2
SIMILARITY = 0.8

_BANDS = passages.band_names(BANDS)
_TEXTS = ", ".join(["_fp long", "h long", *[f"{b} long" for b in _BANDS], "words binary"])


def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_fp, text) to texts that have words, with the hash of these and their bands."""
    begin("near")
    for batch in batches:
        for start, texts in texts_together(batch, 1):
            data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
            kinds = CLASS[data] == WORD
            first = np.flatnonzero(kinds & np.r_[True, ~kinds[:-1]])
            last = np.flatnonzero(kinds & np.r_[~kinds[1:], True]) + 1
            hashes = span_hashes(data, first, last)
            word = np.searchsorted(first, np.cumsum([0, *[len(t) + 1 for t in texts]]))
            word, n = word[:-1], np.diff(word)
            whole = np.zeros(len(texts), np.uint64)
            with np.errstate(over="ignore"):
                for k in range(passages.SHINGLE - 1):
                    few = np.flatnonzero((n > k) & (n < passages.SHINGLE))
                    whole[few] = mixed(whole[few] * np.uint64(31) + hashes[word[few] + k])
            bands: np.ndarray = np.repeat(whole[:, None], BANDS, axis=1)  # a text of few words meets itself only
            long = np.flatnonzero(n >= passages.SHINGLE)
            if len(long):
                whole[long], bands[long] = passages._signatures(hashes, word[long], n[long], BANDS, ROWS)
            some = np.flatnonzero(n)
            yield pa.record_batch(
                [batch[0].slice(start, len(texts)).take(pa.array(some)), pa.array(whole[some].view(np.int64)), *[pa.array(b) for b in np.ascontiguousarray(bands[some].T).view(np.int64)], pa.array([texts[k] for k in some], pa.binary())],
                names=["_fp", "h", *_BANDS, "words"],
            )


def _passed(batches: Iterator[pa.RecordBatch], let: Broadcast) -> Iterator[pa.RecordBatch]:
    """The rows whose hash passes the sieve."""
    begin("near")
    for batch in batches:
        yield batch.filter(pa.array(let.value.passes(batch[0].to_numpy())))


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) between the fingerprints of (_fp, text) that connect all near copies."""
    texts = staged(prints.select("_fp", "text").mapInArrow(_text_batches, _TEXTS), "texts-by-words")
    named = staged(texts.groupBy("h").agg(F.min("_fp").alias("f"), F.max("_fp").alias("l")), "first-prints")
    same = texts.select("_fp", "h").join(named.where("f != l"), "h").select(F.col("_fp").alias("a"), F.col("f").alias("b"))
    colliding = passages.collisions(texts.select("h", *_BANDS).distinct())
    let = passages.sieve(colliding.select(F.col("h").alias("v")).distinct())
    some = texts.select("h", "words").mapInArrow(lambda b: _passed(b, let), "h long, words binary")
    near = staged(passages.links(colliding, some, SIMILARITY), "near-texts")
    near = near.join(named.select(F.col("h").alias("a"), F.col("f").alias("fa")), "a").join(named.select(F.col("h").alias("b"), F.col("f").alias("fb")), "b")
    return same.union(near.select("fa", "fb")).where("a != b").distinct()


def deduplicate(docs: DataFrame) -> DataFrame:
    """``simhash.deduplicate`` where components are made up of near copies' links as well."""
    return simhash.deduplicate(docs, more=links)
