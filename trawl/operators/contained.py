"""Which of a stated set of texts a document contains, word for word, for all of them in one reading."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from trawl.operators.packed import _raw, _runs

#: Bytes of documents that are looked through together; bits of the sieve of first bytes.
TOGETHER = 4 << 20
SIEVE = 18


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number."""
    two = data[:-1].astype(np.uint64) | data[1:].astype(np.uint64) << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    return four[:-4] | four[4:] << np.uint64(32)


def _slot(eights: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (eights * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SIEVE)


def contained_batches(batches: Iterator[pa.RecordBatch], texts: list[bytes], ids: pa.Array) -> Iterator[pa.RecordBatch]:
    """(domain, doc_id, text) to domain, query_id, doc_id where the text holds ``texts`` at the place of the id.

    A place where the first eight bytes of a text of eight or more begin, and
    where its last eight are where they should be, is compared byte by byte.
    """
    long = sorted((int.from_bytes(t[:8], "little"), k) for k, t in enumerate(texts) if len(t) >= 8)
    heads, which = np.array([h for h, _ in long], np.uint64), np.array([k for _, k in long], np.int64)
    tails, sizes = np.array([int.from_bytes(texts[k][-8:], "little") for k in which], np.uint64), np.array([len(texts[k]) for k in which], np.int64)
    sieve = np.zeros(1 << SIEVE, bool)
    sieve[_slot(heads)] = True
    for batch in batches:
        batch = batch.filter(batch[2].is_valid())
        for start, end in _runs(pc.binary_length(batch[2]).to_numpy(zero_copy_only=False).astype(np.int64), TOGETHER):
            few = batch.slice(start, end - start)
            offsets, data = _raw(few[2])
            raw, found = data.to_pybytes(), set()
            for k, t in enumerate(texts):
                if len(t) < 8:
                    found |= {(i, k) for i in range(len(few)) if t in raw[offsets[i] : offsets[i + 1]]}
            if len(raw) >= 8 and len(heads):
                eights = _eights(np.frombuffer(raw, np.uint8))
                at = np.flatnonzero(sieve[_slot(eights)])
                low, high = (np.searchsorted(heads, eights[at], side) for side in ("left", "right"))
                place, item = np.repeat(at, high - low), np.repeat(low, high - low)
                item = item + np.arange(len(item)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
                row = np.searchsorted(offsets, place, "right") - 1
                inside = place + sizes[item] <= offsets[row + 1]
                place, item, row = place[inside], item[inside], row[inside]
                alike = eights[place + sizes[item] - 8] == tails[item]
                found |= {(i, k) for i, k, p in zip(row[alike].tolist(), which[item[alike]].tolist(), place[alike].tolist(), strict=True) if raw.startswith(texts[k], p)}
            if found:
                rows, items = zip(*sorted(found), strict=True)
                yield pa.record_batch([few[0].take(pa.array(rows)), ids.take(pa.array(items)), few[1].take(pa.array(rows))], names=["domain", "query_id", "doc_id"])
