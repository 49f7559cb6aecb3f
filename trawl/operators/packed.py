"""A document's different terms and their counts as three binary columns.

``terms`` is the terms one after the other, ``sizes`` their lengths in bytes
and ``tfs`` their counts (both little-endian, 32 bits), in one order. So a row
is read, written and sent to Python as three values, whatever it holds, and a
batch of rows is an array of terms without being parsed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text, or tokens, that are counted together.
TOGETHER = 8 << 20
#: Small letters and digits stay, all else parts tokens.
_TABLE = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for b in range(256))
SCHEMA = "len long, terms binary, sizes binary, tfs binary"


def _raw(column: pa.Array) -> tuple[np.ndarray, pa.Buffer]:
    """Offsets and bytes of a column of strings or bytes."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    return offsets - first, data.slice(first, last - first) if data is not None else pa.py_buffer(b"")


def _strings(offsets: np.ndarray, data: pa.Buffer, kind: pa.DataType | None = None) -> pa.Array:
    return pa.Array.from_buffers(kind or pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), data])


def _runs(weights: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most about ``most`` in all."""
    part = (np.cumsum(weights) - weights) // most
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
    yield from zip(starts.tolist(), [*starts[1:].tolist(), len(part)], strict=True)


def pack_batches(batches: Iterator[pa.RecordBatch], stop: list[str] | None) -> Iterator[pa.RecordBatch]:
    """(domain, doc_id, x) to domain, doc_id and ``SCHEMA``. x is the tokens or, if ``stop`` is given, a lower-case text whose runs of letters and digits but those in it are the tokens."""
    drop = pa.array(["", *(stop or [])], pa.string())
    for batch in batches:
        weights = pc.binary_length(batch[2]) if stop is not None else pc.list_value_length(batch[2])
        for start, end in _runs(pc.fill_null(weights, 0).to_numpy(zero_copy_only=False).astype(np.int64), TOGETHER):
            few = batch.slice(start, end - start)
            lists = few[2]
            if stop is not None:
                offsets, data = _raw(lists)
                lists = pc.ascii_split_whitespace(_strings(offsets, pa.py_buffer(data.to_pybytes().translate(_TABLE))))
            coded = lists.flatten().dictionary_encode()
            words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(few)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            if stop is not None:
                kept = ~pc.is_in(words, drop).to_numpy(zero_copy_only=False)[codes]
                row, codes = row[kept], codes[kept]
            key = np.sort(row * max(1, len(words)) + codes)
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            tf = np.diff(np.append(first, len(key)))
            ends = np.searchsorted(key[first], np.arange(len(few) + 1) * max(1, len(words)))
            bytes_to, data = _raw(words.take(pa.array(key[first] % max(1, len(words)))))
            packed = [
                _strings(bytes_to[ends], data, pa.binary()), _strings(4 * ends, pa.py_buffer(np.diff(bytes_to).astype("<u4")), pa.binary()), _strings(4 * ends, pa.py_buffer(tf.astype("<u4")), pa.binary()),
            ]
            yield pa.record_batch([few[0], few[1], pa.array(np.bincount(row, minlength=len(few)).astype(np.int64)), *packed], names=["domain", "doc_id", "len", "terms", "sizes", "tfs"])


def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The row, the term and the count of each posting of a batch."""
    ends, sizes = _raw(batch["sizes"])
    offsets = np.append(0, np.cumsum(np.frombuffer(sizes, "<u4"), dtype=np.int64))
    row = np.repeat(np.arange(batch.num_rows), np.diff(ends) // 4)
    return row, _strings(offsets, _raw(batch["terms"])[1]), np.frombuffer(_raw(batch["tfs"])[1], "<u4").astype(np.float64)


def posting_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(domain, doc_id, len, terms, sizes, tfs) to domain, doc_id, len, term, tf."""
    for batch in batches:
        row, term, tf = unpacked(batch)
        yield pa.record_batch([*[batch[n].take(pa.array(row)) for n in ("domain", "doc_id", "len")], term, pa.array(tf)], names=["domain", "doc_id", "len", "term", "tf"])


def lexicon_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(domain, terms, sizes, tfs) to domain, term, df, cf of each batch."""
    for batch in batches:
        row, term, tf = unpacked(batch)
        coded, domains = term.dictionary_encode(), batch["domain"].dictionary_encode(null_encoding="encode")
        n = max(1, len(coded.dictionary))
        key, to, df = np.unique(domains.indices.to_numpy()[row].astype(np.int64) * n + coded.indices.to_numpy(), return_inverse=True, return_counts=True)
        cf = np.bincount(to, tf, len(key))
        yield pa.record_batch([domains.dictionary.take(pa.array(key // n)), coded.dictionary.take(pa.array(key % n)), pa.array(df.astype(np.int64)), pa.array(cf)], names=["domain", "term", "df", "cf"])


def square_batches(batches: Iterator[pa.RecordBatch], worth: bytes | None) -> Iterator[pa.RecordBatch]:
    """(domain, doc_id, terms, sizes, tfs) to domain, doc_id, s, terms, tfs.

    s is the sum of squared tf-idf weights of the terms whose idf is in
    ``worth``, an Arrow stream of domain, term, idf; the others go along. With
    no ``worth`` each idf is 1.
    """
    terms, domains = None, []
    if worth is not None:
        table = pa.ipc.open_stream(worth).read_all()
        terms, domains = pc.unique(table["term"].combine_chunks()), pc.unique(table["domain"]).to_pylist()
        idf = np.full((len(domains) + 1, len(terms) + 1), np.nan)
        idf[pc.index_in(table["domain"].combine_chunks(), pa.array(domains, table["domain"].type)).to_numpy(), pc.index_in(table["term"].combine_chunks(), terms).to_numpy()] = table["idf"].to_numpy()
        known = pa.array(domains, table["domain"].type)
    for batch in batches:
        row, term, tf = unpacked(batch)
        weight = 1 + np.log(tf)
        if terms is not None:
            at = pc.fill_null(pc.index_in(batch["domain"], known), len(domains)).to_numpy()
            weight = weight * idf[at[row], pc.fill_null(pc.index_in(term, terms), len(terms)).to_numpy()]
        rare = np.isnan(weight)
        s = np.bincount(row[~rare], weight[~rare] * weight[~rare], batch.num_rows)
        ends = pa.array(np.searchsorted(row[rare], np.arange(batch.num_rows + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, x) for x in (term.take(pa.array(np.flatnonzero(rare))), pa.array(tf[rare]))]
        yield pa.record_batch([batch["domain"], batch["doc_id"], pa.array(s), *lists], names=["domain", "doc_id", "s", "terms", "tfs"])
