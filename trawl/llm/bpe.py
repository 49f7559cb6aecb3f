"""Byte-level BPE encoding and decoding of tables.

``encode`` and ``decode`` are the operators; both work batch by batch on the
executors, without a shuffle. The ranks come from a file that every executor
can open. A null text counts as empty and has no ids; other columns than
``doc_id`` and ``text`` are not looked at; repeated rows give repeated results; an empty
table gives an empty result; a very long text is encoded alone, in memory that
its own length sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.bpe_fst import Decoder, Encoder, read_ranks
from trawl.llm.chunks import Chunked, chunk_of, groups
from trawl.llm.worker import begin

Batches = Iterator[pa.RecordBatch]
_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])


@lru_cache(maxsize=2)
def _encoder(ranks_path: str, pattern: str) -> Chunked:
    """A worker keeps it, and the states that texts have visited, from task to task."""
    encoder = Encoder(read_ranks(ranks_path), pattern)
    return Chunked(lambda keys: pa.array([np.array(encoder.encode(chunk_of(k)), dtype="<u4").tobytes() for k in keys.to_numpy(zero_copy_only=False).tolist()], pa.large_binary()))


@lru_cache(maxsize=2)
def _decoder(ranks_path: str) -> Decoder:
    return Decoder(read_ranks(ranks_path))


def _drop() -> None:
    _encoder.cache_clear()
    _decoder.cache_clear()


def encode_batches(batches: Batches, ranks_path: str, pattern: str) -> Batches:
    """(doc_id, text) to (doc_id, ids as little-endian unsigned 32-bit bytes)."""
    begin("bpe", _drop)
    chunked = _encoder(ranks_path, pattern)
    for few in groups(batches):
        flat, at = chunked.flat(few[1])
        raw, at = flat.tobytes(), (4 * at).tolist()
        yield pa.record_batch([few[0], pa.array([raw[i:j] for i, j in zip(at, at[1:], strict=False)], pa.binary())], schema=_ENCODED)


def decode_batches(batches: Batches, ranks_path: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Each batch of encoded rows with its texts."""
    begin("bpe", _drop)
    decoder = _decoder(ranks_path)
    for few in batches:
        yield few, [decoder.decode(np.frombuffer(x, dtype="<u4").tolist()) for x in few[1].to_pylist()]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and ``ids``, the text's token ids as little-endian unsigned 32-bit bytes."""
    return _texts(docs).mapInArrow(lambda b: encode_batches(b, ranks_path, pattern), "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """The texts of what ``encode`` returned."""

    def run(batches: Batches) -> Batches:
        for few, texts in decode_batches(batches, ranks_path):
            yield pa.record_batch([few[0], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode, decode the ids, and return digests: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def sha(data: bytes) -> str:
        return hashlib.sha256(data).hexdigest()

    def run(batches: Batches) -> Batches:
        decimal = [str(i) for i in range(max(read_ranks(ranks_path).values()) + 1)]
        begin("bpe", _drop)
        chunked, decoder = _encoder(ranks_path, pattern), _decoder(ranks_path)
        for few in groups(batches):
            flat, at = chunked.flat(few[1])
            # a document's list of ids lives no longer than its digests
            digests = []
            for i, j in zip(at.tolist(), at.tolist()[1:], strict=False):
                ids = flat[i:j].tolist()
                digests.append((len(ids), sha(",".join(map(decimal.__getitem__, ids)).encode()), sha(decoder.decode(ids).encode())))
            yield pa.record_batch(
                [few[0], *[pa.array(c, k) for c, k in zip(zip(*digests, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
