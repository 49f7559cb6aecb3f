"""Byte-level BPE as a transducer, and a streaming decoder.

``Transducer`` turns the ranks of a byte-level BPE into a finite-state
transducer over bytes that is determinised only as far as texts visit it. A
state is the longest suffix of the input that a token could still extend (the
lookahead, shorter than the longest token), with the last token of the encoding
of the input up to each position inside it. A transition reads a byte and puts
out the last token of what is read then: of the tokens that end there it is the
one that stays next to the last token before it when BPE is run on the two
alone. A token is emitted as soon as the encodings up to all positions of the
lookahead agree on it.

``Decoder`` turns ids back into text piece by piece. Its automaton reads UTF-8
byte by byte; transitions over whole tokens are compiled when first needed. It
holds back at most three bytes of an unfinished character.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import regex

#: States and remembered words before a worker starts anew, which bounds its memory.
STATES = 300_000
WORDS = 200_000
#: Bytes that are held before settled tokens are emitted.
HELD = 256


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a file of base64 tokens."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Transducer:
    """Encodes single matches of the pattern."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.size = {i: len(t) for t, i in ranks.items()}
        self.heads = {t[:k] for t in ranks for k in range(len(t))}
        self.stays: dict[tuple[int, int], bool] = {}
        self._restart()

    def _restart(self) -> None:
        start = (b"", (-1,))
        self.known = {start: 0}
        self.states: list[tuple[bytes, tuple[int, ...]]] = [start]
        self.delta: list[dict[int, tuple[int, int]]] = [{}]

    def merge(self, text: bytes) -> list[int]:
        """The merges as defined, lowest rank first: what the transducer is compiled from."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], len(self.ranks) * 2), i) for i in range(len(parts) - 1))
            if rank >= len(self.ranks) * 2:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def side_by_side(self, a: int, b: int) -> bool:
        """Whether BPE leaves these two tokens as they are next to each other."""
        found = self.stays.get((a, b))
        if found is None:
            if len(self.stays) > 4 * STATES:
                self.stays.clear()
            found = self.stays[a, b] = self.merge(self.token[a] + self.token[b]) == [a, b]
        return found

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        """Compile one transition: the next state, and the last token once ``byte`` is read."""
        window, last = self.states[state]
        grown = window + bytes((byte,))
        n = len(grown)
        token = next(t for k in range(n) if (t := self.ranks.get(grown[k:])) is not None and (last[k] < 0 or self.side_by_side(last[k], t)))
        keep = next(k for k in range(n, -1, -1) if grown[n - k :] in self.heads)
        after = (grown[n - keep :], (*last, token)[n - keep :])
        if (to := self.known.get(after)) is None:
            to = self.known[after] = len(self.states)
            self.states.append(after)
            self.delta.append({})
        arc = self.delta[state][byte] = (to, token)
        return arc

    def encode(self, text: bytes) -> list[int]:
        """Ids of one match of the pattern; a text that is a token is that token."""
        whole = self.ranks.get(text)
        return [whole] if whole is not None else [t for part in self.stream(text) for t in part]

    def stream(self, text: bytes) -> Iterator[list[int]]:
        """Tokens as the lookahead settles them."""
        if len(self.states) > STATES:
            self._restart()
        state, delta, ends = 0, self.delta, []
        for byte in text:
            state, token = delta[state].get(byte) or self._step(state, byte)
            ends.append(token)
            if len(ends) >= HELD:
                # all encodings of the lookahead lead back to one place
                open_ = {len(ends) - k for k in range(len(self.states[state][0]) + 1)}
                while len(open_) > 1:
                    at = max(open_)
                    open_ = open_ - {at} | {at - self.size[ends[at - 1]]}
                settled = open_.pop()
                if settled:
                    yield self._back(ends[:settled])
                    ends = ends[settled:]
        yield self._back(ends)

    def _back(self, ends: list[int]) -> list[int]:
        """The encoding that ends where ``ends`` does."""
        out, at, size = [], len(ends), self.size
        while at:
            out.append(token := ends[at - 1])
            at -= size[token]
        out.reverse()
        return out


class Encoder:
    """Encodes whole texts: each match of ``pattern`` on its own."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.machine = Transducer(ranks)
        self.find = regex.compile(pattern).findall
        self.seen: dict[str, list[int]] = {}

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        seen, encode = self.seen, self.machine.encode
        if len(seen) > WORDS:
            seen.clear()
        for piece in self.find(text):
            ids = seen.get(piece)
            if ids is None:
                ids = encode(piece.encode())
                if len(piece) < 64:
                    seen[piece] = ids
            out += ids
        return out


class Decoder:
    """Incremental decoding; bytes that are no UTF-8 become U+FFFD."""

    def __init__(self, ranks: dict[bytes, int]):
        self.token = {i: t for t, i in ranks.items()}
        #: (held bytes, id) to (held bytes, text)
        self.arcs: dict[tuple[bytes, int], tuple[bytes, str]] = {}
        self.alone: dict[int, str] = {}
        for i, t in self.token.items():
            held, text = self.read(b"", t)
            if not held and "�" not in text:
                self.alone[i] = text

    @staticmethod
    def _needs(held: bytes) -> tuple[int, int, int]:
        """For an unfinished character: bytes still missing, and the range of the next one."""
        lead, have = held[0], len(held)
        size = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80) if have == 1 else 0x80
        high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF) if have == 1 else 0xBF
        return size - have, low, high

    @classmethod
    def read(cls, held: bytes, more: bytes) -> tuple[bytes, str]:
        """Run the automaton: what is held back after ``more``, and the text that is complete."""
        out: list[str] = []
        for byte in more:
            if held:
                missing, low, high = cls._needs(held)
                if low <= byte <= high:
                    held += bytes((byte,))
                    if missing == 1:
                        out.append(held.decode())
                        held = b""
                    continue
                out.append("�")
                held = b""
            if byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xF4:
                held = bytes((byte,))
            else:
                out.append("�")
        return held, "".join(out)

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as it becomes complete."""
        held, arcs = b"", self.arcs
        for i in ids:
            arc = arcs.get((held, i))
            if arc is None:
                arc = arcs[held, i] = self.read(held, self.token[i])
            held = arc[0]
            yield arc[1]
        if held:
            yield "�"

    def decode(self, ids: list[int]) -> str:
        try:
            return "".join(map(self.alone.__getitem__, ids))
        except KeyError:
            return "".join(self.stream(ids))
