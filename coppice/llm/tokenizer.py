"""Encoding with a byte-level BPE vocabulary by a lazily determinised transducer.

BPE output is local: a sequence of tokens is what BPE makes of its bytes exactly when each adjacent pair of tokens is what
BPE makes of the pair's bytes. So the encoding of a text's first i bytes ends in one definite token, the one suffix token
that may follow the encoding of what stands before it. The transducer reads a byte at a time; its state is what the
future may still depend on: the open chain of tokens whose last bytes can be part of a longer token, that is the last
tokens of the prefixes within the longest matching suffix of the vocabulary. Subsets of configurations become states
only when a text reaches them, and their arcs are kept (states are bounded, then forgotten and made again). A token is
emitted as soon as no chain of the state can still replace it, so lookahead is bounded by the longest token.

A pretoken that recurs is one composed arc of the start state. Decoding is a stream: an incremental UTF-8 machine turns
bytes of tokens into characters and holds back what is incomplete.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the pattern that divides a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


class Transducer:
    """Maps the bytes of one pretoken to token ids."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 100_000):
        self.ranks = ranks
        self.names = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.max_states = max_states
        # proper prefixes of tokens: what may still grow into a token
        self.grows = {t[:k] for t in ranks for k in range(1, len(t))}
        self.split: dict[bytes, tuple[bytes, bytes]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        # a state: (window of open bytes, last token of each prefix of the window); arcs: state -> byte -> (state, emitted ids)
        self.start = (b"", ())
        self.states: dict[tuple, int] = {self.start: 0}
        self.content: list[tuple] = [self.start]
        self.arcs: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]

    def parts(self, t: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens that the last merge of a token joins; None for a single byte."""
        if len(t) == 1:
            return None
        got = self.split.get(t)
        if got is None:
            pieces = [t[i : i + 1] for i in range(len(t))]
            limit = self.ranks[t]
            while len(pieces) > 2:
                best, at = limit, -1
                for i in range(len(pieces) - 1):
                    r = self.ranks.get(pieces[i] + pieces[i + 1])
                    if r is not None and r < best:
                        best, at = r, i
                if at < 0:
                    break
                pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
            got = self.split[t] = (pieces[0], b"".join(pieces[1:]))
        return got

    def may_follow(self, a: int, b: int) -> bool:
        """Whether BPE leaves the bytes of tokens a and b as just these two tokens: merges across their seam, tried in order of rank along both sides' merge trees, must all come too late."""
        got = self.fits.get((a, b))
        if got is None:
            got = self.fits[a, b] = self._seam(self.names[a], self.names[b])
        return got

    def _seam(self, a: bytes, b: bytes) -> bool:
        limit = 1 << 62
        while True:
            r = self.ranks.get(a + b)
            if r is not None and r < limit and self.parts(a + b) == (a, b):
                return False
            ra, rb = self.ranks[a], self.ranks[b]
            if len(a) == 1 and len(b) == 1:
                return True
            if ra > rb and len(a) > 1 or len(b) == 1:
                limit, a = ra, self.parts(a)[1]
            else:
                limit, b = rb + 1, self.parts(b)[0]

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        got = self.arcs[state].get(byte)
        return got if got is not None else self._determinise(state, byte)

    def _determinise(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The arc of a state and a byte: the window grows by the byte, gets its last token, and gives up what is settled."""
        window, last = self.content[state]
        window += bytes([byte])
        n = len(window)
        found = -1
        for k in range(n):  # the longest suffix token that may follow
            t = self.ranks.get(window[k:])
            if t is None:
                continue
            if k == 0 or (last[k - 1] >= 0 and self.may_follow(last[k - 1], t)):
                found = t
                break
        last = (*last, found)
        # the earliest byte from which a token may still grow beyond the window
        open_from = next((k for k in range(1, n) if window[k:] in self.grows), n) if window not in self.grows else 0
        emitted: list[int] = []
        if open_from:
            # chains that stay possible: ends of tokens at or after open_from, each leading back to one first cut
            starts = {self._first(window, last, k) for k in range(open_from, n + 1) if k == n or last[k - 1] >= 0}
            while len(starts) == 1 and (cut := next(iter(starts)))[0] and cut[0] <= open_from:
                length, token = cut
                emitted.append(token)
                window, last = window[length:], self._shift(window, last, length)
                open_from -= length
                n = len(window)
                starts = {self._first(window, last, k) for k in range(open_from, n + 1) if n and (k == n or (k and last[k - 1] >= 0) or k == 0)}
                if not n:
                    break
        made = (window, last)
        to = self.states.get(made)
        if to is None:
            to = self.states[made] = len(self.content)
            self.content.append(made)
            self.arcs.append({})
        arc = self.arcs[state][byte] = (to, tuple(emitted))
        return arc

    def _first(self, window: bytes, last: tuple[int, ...], k: int) -> tuple[int, int]:
        """Length and id of the first token of the encoding of window[:k]; (0, -1) for the empty prefix."""
        got = (0, -1)
        while k:
            t = last[k - 1]
            if t < 0:
                return (0, -2)
            k -= len(self.names[t])
            if k == 0:
                got = (len(self.names[t]), t)
        return got

    def _shift(self, window: bytes, last: tuple[int, ...], length: int) -> tuple[int, ...]:
        """Last tokens of the prefixes of window[length:], those that led through the emitted token."""
        out = []
        for k in range(length + 1, len(window) + 1):
            t, at = last[k - 1], k
            while t >= 0 and at > length:
                at -= len(self.names[t])
                t2 = last[at - 1] if at > 0 else -1
                if at <= length:
                    break
                t = t2
            out.append(last[k - 1] if at == length else -1)
        return tuple(out)

    def close(self, state: int) -> tuple[int, ...]:
        window, last = self.content[state]
        out, k = [], len(window)
        while k:
            t = last[k - 1]
            out.append(t)
            k -= len(self.names[t])
        return tuple(reversed(out))

    def encode(self, word: bytes) -> tuple[int, ...]:
        if len(self.content) > self.max_states:
            self.reset()
        whole = self.ranks.get(word)
        if whole is not None and self._reaches(word, whole):
            return (whole,)
        state, out = 0, []
        for b in word:
            state, emitted = self.step(state, b)
            out += emitted
        return (*out, *self.close(state))

    def _reaches(self, word: bytes, token: int) -> bool:
        """Whether BPE builds this token from its own bytes (always so in a vocabulary closed under its merges)."""
        return len(word) == 1 or self.parts(word)[0] in self.ranks and self.parts(word)[1] in self.ranks


class Composed(dict):
    """Composed arcs of the start state by pretoken; forgotten when too many."""

    def __init__(self, transducer: Transducer, most: int):
        super().__init__()
        self.transducer, self.most = transducer, most

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        got = self[word] = self.transducer.encode(word.encode("utf-8", "surrogatepass"))
        return got


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    def __init__(self, path: str = DEFAULT_VOCABULARY, most: int = 300_000):
        self.transducer = Transducer(load_ranks(path))
        self.arcs = Composed(self.transducer, most)
        self.find = regex.compile(PATTERN).findall

    def encode(self, text: str) -> list[int]:
        """Ids of a text; none for the empty text."""
        return list(chain.from_iterable(map(self.arcs.__getitem__, self.find(text))))

    def count(self, text: str) -> int:
        return sum(map(len, map(self.arcs.__getitem__, self.find(text))))

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """The text in parts as the ids come; an incomplete character waits for its bytes, impossible bytes give U+FFFD."""
        machine = Utf8()
        for i in ids:
            if part := machine.feed(self.transducer.names[i]):
                yield part
        if part := machine.end():
            yield part


class Utf8:
    """Incremental UTF-8 decoding: the state is the bytes of the character begun and how many are still due."""

    def __init__(self):
        self.begun, self.due = bytearray(), 0

    def feed(self, data: bytes) -> str:
        out = []
        for b in data:
            if self.due and 0x80 <= b <= 0xBF:
                self.begun.append(b)
                self.due -= 1
                if not self.due:
                    out.append(self.begun.decode("utf-8", "replace"))
                    self.begun.clear()
                continue
            if self.due:
                out.append("�")
                self.begun.clear()
                self.due = 0
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xF4:
                self.begun.append(b)
                self.due = 1 + (b >= 0xE0) + (b >= 0xF0)
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        part = "�" if self.due else ""
        self.begun.clear()
        self.due = 0
        return part


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker: its arcs serve all batches."""
    return Encoder(path)


def encode_udf(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            flat, ends = array("i"), [0]
            for t in b.column(1).to_pylist():
                if t:
                    flat.extend(chain.from_iterable(map(e.arcs.__getitem__, e.find(t))))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["doc_id", "ids"])

    return run


def count_udf(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            n = [e.count(t) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return run


def encode_documents(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, ids ARRAY<INT>) of every row; an empty or null text has the empty array. Repeated rows stay repeated."""
    return df.select(F.col(key).alias("doc_id"), F.col(text).alias("t")).mapInArrow(encode_udf(path), "doc_id bigint, ids array<int>")


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens BIGINT) of every row; 0 for an empty or null text."""
    return df.select(F.col(key).alias("doc_id"), F.col(text).alias("t")).mapInArrow(count_udf(path), "doc_id bigint, n_tokens bigint")
