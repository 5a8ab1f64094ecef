"""Texts of Arrow batches as arrays of words: what the language model counts and scores, without a Python object per word.

Text is lower-cased (A-Z). A word is a run of bytes other than white space; it may be empty, and a white-space byte or the end of
its text stops it. A word of fewer than PIECE bytes is one unit: its bytes and a space, whatever the byte that stops it. A longer
one is cut into units of PIECE bytes, marked by INSIDE from the second on, and a last unit that is stopped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

PIECE = 40
#: Bytes of text that are worked on at a time; a longer text is worked on alone.
SLICE = 1 << 20
#: First bytes of units that no text has: later pieces of a long word, whole long words (counts for the base score), stop counts.
INSIDE, LONG, STOPS = b"\xff", b"\xfe", b"\xfd"
#: Kinds of stops: white-space bytes in the order of their codes, the end of a text.
KINDS = 7
#: A-Z become small, and the bytes of the marks above, which are in no UTF-8 text, another such byte.
_LOWER = bytes(i + 32 if 65 <= i <= 90 else min(i, 0xFC) for i in range(256))
_END = 0xFF
_STOPS = (9, 10, 11, 12, 13, 32, _END)
_KIND = bytes(_STOPS.index(i) + 1 if i in _STOPS else 0 for i in range(256))
_MULTIPLIER = 0x9E3779B97F4A7C15
#: Classes of the last byte of a word: none, a letter or another byte from 128 on, a digit, a full stop, other punctuation.
_SHAPE = np.full(256, 4, np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = 1
_SHAPE[48:58] = 2
_SHAPE[[33, 46, 63]] = 3
SHAPES, SINCE = 5, 8
STOP_CONTEXTS = KINDS * SHAPES * SINCE


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.empty(0, np.uint64)

    def grow(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * SLICE)
            inverse = pow(_MULTIPLIER, -1, 1 << 64)
            self.up = np.cumprod(np.full(n, _MULTIPLIER, np.uint64))
            self.down = np.cumprod(np.full(n, inverse, np.uint64))


_POWERS = _Powers()


def _finish(h: np.ndarray, length: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29)) ^ (length.astype(np.uint64) << np.uint64(56))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def hash_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The hash of each run data[offsets[i]:offsets[i + 1]], as that of words."""
    _POWERS.grow(len(data) + 1)
    sums = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS.up[: len(data)])))
    return _finish((sums[offsets[1:]] - sums[offsets[:-1]]) * _POWERS.down[offsets[:-1]], np.diff(offsets))


@dataclass
class Words:
    """Words of several texts, in order."""

    buffer: np.ndarray
    start: np.ndarray
    length: np.ndarray
    doc: np.ndarray
    #: Place of each text's first word, and the number of words after the last.
    first: np.ndarray
    kind: np.ndarray
    hash: np.ndarray

    def take(self, at: np.ndarray, tail: bytes = b" ") -> tuple[np.ndarray, np.ndarray]:
        """Data and offsets of the words at these places, each with `tail` after it."""
        return gather(self.buffer, self.start[at], self.length[at], tail)

    def long(self) -> np.ndarray:
        return np.flatnonzero(self.length >= PIECE)

    def text(self, i: int) -> bytes:
        return self.buffer[self.start[i] : self.start[i] + self.length[i]].tobytes()

    def digests(self) -> list[bytes]:
        """Of each lower-cased text."""
        end = (self.start + self.length)[self.first[1:] - 1]
        return [xxhash.xxh3_128_digest(self.buffer[a:b]) for a, b in zip(self.start[self.first[:-1]], end, strict=True)]

    def stop_contexts(self) -> np.ndarray:
        """What each stop is predicted by: the stop before it, the end of its word and how long ago there was one but a space."""
        n = len(self.start)
        before = np.concatenate(([0], self.kind[:-1])).astype(np.int64)
        before[self.first[:-1]] = KINDS - 1
        last = np.where(self.length > 0, _SHAPE[self.buffer[np.maximum(self.start + self.length - 1, 0)]], 0)
        other = np.where(before != 5, np.arange(n), 0)
        since = np.arange(n) - np.maximum.accumulate(other)
        bucket = np.minimum(np.log2(since + 1).astype(np.int64), SINCE - 1)
        return (before * SHAPES + last) * SINCE + bucket


def gather(buffer: np.ndarray, start: np.ndarray, length: np.ndarray, tail: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = length + len(tail)
    offsets = np.concatenate(([0], np.cumsum(size)))
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    out = buffer[np.minimum(at, len(buffer) - 1)] if len(at) else np.empty(0, np.uint8)
    for k, byte in enumerate(tail):
        out[offsets[1:] - len(tail) + k] = byte
    return out, offsets


def pieces(word: bytes) -> list[bytes]:
    """The units of a word of PIECE bytes or more."""
    cut = [word[i : i + PIECE] for i in range(0, len(word), PIECE)]
    if len(cut[-1]) == PIECE:
        cut.append(b"")
    return [cut[0], *(INSIDE + c for c in cut[1:-1]), INSIDE + cut[-1] + b" "]


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary array of these runs."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data and offsets of a column of texts; a null one is empty."""
    column = column.fill_null("" if pa.types.is_string(column.type) else b"").cast(pa.binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8), offsets


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, data, offsets) of rows that have about SLICE bytes together."""
    data, offsets = _bytes(column)
    low = 0
    while low < len(column):
        high = max(int(np.searchsorted(offsets, offsets[low] + SLICE, "right")) - 1, low + 1)
        own = offsets[low : high + 1]
        yield low, high, data[own[0] : own[-1]], own - own[0]
        low = high


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(offsets) - 1
    low = data.tobytes().translate(_LOWER)
    raw = b"".join([part for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for part in (low[a:b], b"\xff")])
    buffer = np.frombuffer(raw, np.uint8)
    kind = np.frombuffer(raw.translate(_KIND), np.uint8)
    stop = np.flatnonzero(kind != 0)
    start = np.concatenate(([0], stop[:-1] + 1))
    kind = kind[stop].astype(np.int64) - 1
    last = np.flatnonzero(kind == KINDS - 1)
    first = np.concatenate(([0], last + 1))
    doc = np.repeat(np.arange(n), np.diff(first))
    _POWERS.grow(len(buffer) + 1)
    sums = buffer.astype(np.uint64)
    sums += np.uint64(1)
    sums *= _POWERS.up[: len(buffer)]
    np.cumsum(sums, out=sums)
    before = np.where(start > 0, sums[np.maximum(start, 1) - 1], np.uint64(0))
    through = np.where(stop > 0, sums[np.maximum(stop, 1) - 1], np.uint64(0))
    h = _finish((through - before) * _POWERS.down[start], stop - start)
    return Words(buffer, start, stop - start, doc, first, kind, h)


@dataclass
class Groups:
    """Equal words of several texts: `order` sorts words by hash and place."""

    order: np.ndarray
    #: For each distinct word, its first place; for each word, its distinct one.
    sample: np.ndarray
    of: np.ndarray
    #: How often each word came before in its text.
    before: np.ndarray
    #: Places of the first of equal words in a text, and how many they are.
    once: np.ndarray
    times: np.ndarray


def _by_hash(h: np.ndarray) -> np.ndarray:
    """The places of hashes in their order, equal ones by place."""
    size = np.uint64(max(len(h) - 1, 1).bit_length())
    if size <= 20:
        # The low bits make room for the place, so that plain numbers are sorted.
        key = (h >> size << size) | np.arange(len(h), dtype=np.uint64)
        key.sort()
        order = (key & ((np.uint64(1) << size) - np.uint64(1))).astype(np.int64)
        if not (((key[1:] ^ key[:-1]) >> size == 0) & (h[order[1:]] != h[order[:-1]])).any():
            return order
    return np.argsort(h, kind="stable")


def groups(w: Words) -> Groups:
    order = _by_hash(w.hash)
    h = w.hash[order]
    new = np.concatenate(([True], h[1:] != h[:-1]))
    doc = w.doc[order]
    own = new | np.concatenate(([True], doc[1:] != doc[:-1]))
    place = np.arange(len(order))
    of, before = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    begin = np.flatnonzero(own)
    times = np.diff(np.append(begin, len(order)))
    before[order] = place - np.repeat(begin, times)
    return Groups(order, order[new], of, before, order[begin], times)


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> np.ndarray:
    """For each text, the square roots of the shares of its byte pairs, hashed into 2 ** bits parts."""
    out = np.zeros((len(offsets) - 1, 1 << bits), np.float32)
    low = np.frombuffer(data.tobytes().translate(_LOWER), np.uint8).astype(np.uint16)
    pair = low[:-1] * np.uint16(0x9E37) + low[1:] * np.uint16(0x79B1)
    pair ^= pair >> np.uint16(7)
    pair *= np.uint16(0x2C1B)
    pair >>= np.uint16(16 - bits)
    for row, a, b in zip(out, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b > a + 1:
            row[:] = np.bincount(pair[a : b - 1], minlength=1 << bits)
            row /= b - a - 1
    return np.sqrt(out)
