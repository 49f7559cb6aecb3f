"""Encoding of whole texts by remembered chunks.

The pattern of the byte-level tokenizers never matches across some places: a
space only ever is the first character of a match that has others, so a text
may be cut before a single space; a single line feed is a match by itself; and
so is a full stop or comma between a letter or digit and a space or line feed.
The chunks (mostly words with their space) are encoded once per worker. Where
white space comes in runs, or other than as spaces and line feeds, a text is
cut only before single spaces.
"""

from __future__ import annotations

import re
from array import array
from codecs import charmap_decode
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks in each of the two generations that a worker remembers, and the longest it keeps.
REMEMBERED = 450_000
LONGEST = 48
#: Documents that are taken together, and characters of text, about.
TOGETHER = 4096
CHARACTERS = 1 << 23

_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Marks a key whose chunk is what follows it; the chunk of another key is a space and the key.
_RAW = "\x01"
# white space of Unicode and Python other than space and line feed, and the mark
_OTHER = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\x01]")
_STOP = re.compile("([.,])(?<=[A-Za-z0-9À-ÖØ-öø-ÿ][.,])(?=[ \n])")
# the same for Arrow's matcher, which looks neither back nor ahead; what it takes in never is what the next match begins with
_STOPS = "([A-Za-z0-9À-ÖØ-öø-ÿ])([.,])([ \n])"
#: Latin letters alone, after the mark or not, for Arrow's matcher.
_LETTERS = f"^{_RAW}?[A-Za-zÀ-ÖØ-öø-ɏ]+$"
#: Byte 0, which no letter has, and how byte-level vocabularies write it; so many words are encoded as one with it between them.
_ZERO, _BETWEEN = "\0", "\u0100"
JOINED = 64
#: Words that go to the library in one call, whose results are large.
AT_ONCE = 2048
#: How many bytes are written as their own character.
_PRINTED = 188
#: Where ``keys_of`` has to look closely.
_ODD = "  |\n\n| \n|\n |" + _OTHER.pattern


def keys_of(text: str) -> list[str]:
    """The chunks of a text, as keys."""
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or _OTHER.search(text):
        return [c[1:] if c[0] == " " and _RAW not in c and " " not in c[1:] else _RAW + c for c in _CUT.split(text)] if text else []
    keys = _STOP.sub(" \x01\\1", text).replace("\n", " \x01\n \x01").split(" ")
    keys[0] = _RAW + keys[0]
    return keys


def chunk_of(key: str) -> str:
    return key[1:] if key[:1] == _RAW else " " + key


def _chunks(keys: pa.StringArray) -> pa.StringArray:
    """``chunk_of`` for many at once."""
    return pc.if_else(pc.starts_with(keys, _RAW), pc.utf8_slice_codeunits(keys, 1), pc.binary_join_element_wise(" ", keys, ""))


def _places(keys: pa.StringArray, among: pa.StringArray) -> np.ndarray:
    """Where each of different keys is ``among`` others, which differ too; -1 if it isn't. Only the fewer are hashed into a table."""
    if len(among) <= len(keys):
        return pc.fill_null(pc.index_in(keys, value_set=among), -1).to_numpy().astype(np.int64)
    out, back = np.full(len(keys), -1), pc.fill_null(pc.index_in(among, value_set=keys), -1).to_numpy()
    on = np.flatnonzero(back >= 0)
    out[back[on]] = on
    return out


def _binaries(ids: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """Runs of ids that end before ``ends``, each as bytes."""
    offsets = np.concatenate([[0], 4 * ends.astype(np.int64)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])


def _nothing() -> tuple[pa.StringArray, pa.LargeBinaryArray]:
    return pa.array([], pa.string()), pa.array([], pa.large_binary())


class Chunked:
    """Texts to their ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, encode_keys: Callable[[pa.StringArray], pa.LargeBinaryArray]):
        self.encode_keys = encode_keys
        # keys and their ids, as Arrow has them: Python's strings and bytes take several times as much
        self.seen, self.older = _nothing(), _nothing()

    def values(self, keys: pa.StringArray) -> pa.LargeBinaryArray:
        """The ids of different keys."""
        if len(self.seen[0]) > REMEMBERED:
            self.seen, self.older = _nothing(), self.seen
        place = _places(keys, self.seen[0])
        gaps = np.flatnonzero(place < 0)
        missing = keys.take(pa.array(gaps))
        back = _places(missing, self.older[0])
        is_new = back < 0
        old, new = missing.filter(pa.array(~is_new)), missing.filter(pa.array(is_new))
        old_ids = self.older[1].take(pa.array(back[~is_new]))
        new_ids = self.encode_keys(new) if len(new) else _nothing()[1]
        place[gaps] = len(self.seen[0]) + np.where(is_new, len(old) + np.cumsum(is_new), np.cumsum(~is_new)) - 1
        out = pa.concat_arrays([self.seen[1], old_ids, new_ids]).take(pa.array(place))
        if len(gaps):
            kept = pc.less_equal(pc.utf8_length(new), LONGEST)
            self.seen = pa.concat_arrays([self.seen[0], old, new.filter(kept)]), pa.concat_arrays([self.seen[1], old_ids, new_ids.filter(kept)])
        return out

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin, and their number."""
        texts = texts.fill_null("")
        lists = _cut_lists(texts)
        keys = lists.flatten().dictionary_encode()
        found = self.values(keys.dictionary).take(keys.indices)
        ends = np.frombuffer(found.buffers()[1], "<i8", len(found) + 1, found.offset * 8)
        ids = np.frombuffer(found.buffers()[2] or b"", "<u4", int(ends[-1]) // 4)
        return ids, ends[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])] // 4

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, at = self.flat(pa.array(texts, pa.string()))
        raw, at = ids.tobytes(), (4 * at).tolist()
        return [raw[i:j] for i, j in zip(at, at[1:], strict=False)]


def _cut_lists(texts: pa.Array) -> pa.ListArray:
    """The keys of each text: ``keys_of`` for many at once."""
    odd = pc.match_substring_regex(texts, _ODD)
    whole = pc.replace_substring_regex(pc.if_else(odd, "", texts), _STOPS, "\\1 \x01\\2\\3")
    whole = pc.binary_join_element_wise("\x01", pc.replace_substring(whole, "\n", " \x01\n \x01"), "")
    lists = pc.split_pattern(whole, " ")
    if not pc.any(odd).as_py():
        return lists
    # white space of other kinds: as defined, one by one
    number = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    others = pa.array([keys_of(t) for t in texts.take(pa.array(number)).to_pylist()], lists.type)
    place = np.arange(len(texts))
    place[number] = len(texts) + np.arange(len(number))
    return pa.concat_arrays([lists, others]).take(pa.array(place))


def _byte_order() -> list[int]:
    """Bytes that byte-level vocabularies write as their own character, then the others."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return own + [b for b in range(256) if b not in own]


@lru_cache(maxsize=2)
def library_encoder(path: str) -> Chunked:
    """Ids by the tokenizers library, from its JSON file. A worker keeps it, and what it remembers, from task to task."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    #: how byte-level vocabularies write a byte, at its number
    written = "".join(c for _, c in sorted(zip(_byte_order(), [chr(k) for k in _byte_order()[:_PRINTED]] + [chr(256 + k) for k in range(256 - _PRINTED)], strict=True)))

    # where nothing merges with byte 0, words on either side of it are encoded as they are alone
    model, bare = tokenizer.model, Tokenizer(tokenizer.model)
    between = bare.token_to_id(_BETWEEN)
    apart = between is not None and sum(_BETWEEN in t for t in bare.get_vocab()) == 1 and not model.ignore_merges and model.dropout is None

    def words(some: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks that are one match of the pattern each, by the library's model alone, and where each chunk's end."""
        whole, flat = pc.binary_join_element_wise(some, _ZERO, ""), array("I")
        ends = np.frombuffer(whole.buffers()[1], "<i4", len(whole) + 1)
        raw, at = memoryview(whole.buffers()[2]), [*ends[:-1:JOINED].tolist(), int(ends[-1])]
        joined = list(zip(at, at[1:], strict=False))
        for k in range(0, len(joined), AT_ONCE // JOINED):
            for x in bare.encode_batch_fast([charmap_decode(raw[i:j], "strict", written)[0] for i, j in joined[k : k + AT_ONCE // JOINED]], add_special_tokens=False):
                flat.extend(x.ids)
        ids = np.frombuffer(flat, np.uint32)
        ends = np.flatnonzero(ids == between)
        return ids[ids != between], ends - np.arange(len(ends))

    def others(some: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks by all that the library does, and where each chunk's end."""
        flat, sizes = array("I"), []
        for k in range(0, len(some), AT_ONCE):
            for x in tokenizer.encode_batch_fast(some[k : k + AT_ONCE].to_numpy(zero_copy_only=False).tolist(), add_special_tokens=False):
                flat.extend(own := x.ids)
                sizes.append(len(own))
        return np.frombuffer(flat, np.uint32), np.cumsum(sizes)

    def encode(keys: pa.StringArray) -> pa.LargeBinaryArray:
        chunks = _chunks(keys)
        # Latin letters, with their space if they have one, are one match of the pattern
        alone = pc.match_substring_regex(keys, _LETTERS).to_numpy(zero_copy_only=False) & apart
        order = np.concatenate([np.flatnonzero(alone), np.flatnonzero(~alone)])
        found = [f(some) for f, m in ((words, alone), (others, ~alone)) if len(some := chunks.filter(pa.array(m)))]
        ids = pa.concat_arrays([_binaries(*x) for x in found])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return ids.take(pa.array(place))

    return Chunked(encode)


def groups(batches: Iterable[pa.RecordBatch], size: int = TOGETHER, characters: int = CHARACTERS, text: int = -1) -> Iterator[pa.RecordBatch]:
    """The same rows, a few at a time, by number and by the length of the column ``text``; a longer text goes alone."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)) if batch.num_rows else []
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = min(at + size, max(at + 1, int(np.searchsorted(ends, before + characters, "right"))))
            yield batch.slice(at, to - at)
            at = to
