"""Packing token sequences into bins by vector best-fit.

A piece asks for (tokens, 1 document, tokens^2 of attention cost); a bin has a capacity of each. Pieces go by size, largest
first, into the open bin that holds them under every constraint and whose weighted residual norm after that is smallest (or
whose residual has the largest weighted dot product with the demand); a new bin opens only where none can hold the piece.
Pieces are dealt at random into groups of about GROUP, each packed by itself: a group leaves at most a few bins less full than
one packing of everything would, and groups grow in number, not in size, with the corpus.
"""

from __future__ import annotations

import functools
import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, narrow

GROUP = 16_384
#: Words whose ids a worker keeps.
MEMO = 400_000
#: Bytes of text that are split and coded at once.
PART = 1 << 21
END = 1
#: ASCII punctuation that no contraction begins with.
TAIL = ".,;:!?*#%&$|)"
#: A word of its own that is one token and in next to no text.
MARK = "\0"


class Words:
    """Token ids of white-space-free words as little-endian bytes; what a tokenizer that drops white space does to a whole text.

    Words and ids that a worker keeps are Arrow arrays, the latest used first: tens of bytes a word, where objects take hundreds.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        mark = self._encode(MARK)
        self.mark = mark[0] if len(mark) == 1 else None
        self.parted = {"": False}
        self.known = pa.array([], pa.large_string())
        self.coded = pa.array([], pa.large_binary())

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _new(self, words: pa.Array) -> pa.Array:
        """Ids of words from the tokenizer, which gets many as one text with MARK between them, or one by one where that is in a word."""
        ids, sizes = [np.zeros(0, "<u4")], [np.zeros(1, np.int64)]
        for at in range(0, len(words), 256):
            n = min(256, len(words) - at)
            (text,) = pc.binary_join(pa.ListArray.from_arrays(pa.array([at, at + n], pa.int32()), words), pa.scalar(f" {MARK} ", pa.large_string())).to_pylist()
            got = None if self.mark is None or text.count(MARK) >= n else self._encode(text)
            marks = None if got is None else np.flatnonzero(got == self.mark)
            if marks is None or len(marks) != n - 1:
                each = [self._encode(w) for w in words[at : at + n].to_pylist()]
                ids += each
                sizes.append(np.array([len(e) for e in each]))
            else:
                ids.append(np.delete(got, marks))
                sizes.append(np.diff(marks, prepend=-1, append=len(got)) - 1)
        flat, ends = np.concatenate(ids), 4 * np.cumsum(np.concatenate(sizes), dtype=np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(flat)])

    def _atoms(self, atoms: pa.Array) -> pa.Array:
        """Ids of distinct words, which are then the latest used; those used least lately go where there are more than MEMO."""
        at = pc.index_in(atoms, value_set=self.known)
        new, at = at.is_null().to_numpy(zero_copy_only=False), at.fill_null(0).to_numpy().astype(np.int64)
        at[new] = len(self.known) + np.arange(new.sum())
        out = pa.concat_arrays([self.coded, self._new(atoms.filter(pa.array(new)))]).take(pa.array(at))
        rest = np.ones(len(self.known), bool)
        rest[at[~new]] = False
        rest = pa.array(rest)
        self.known = pa.concat_arrays([atoms, self.known.filter(rest)])[:MEMO]
        self.coded = pa.concat_arrays([out, self.coded.filter(rest)])[:MEMO]
        return out

    def _alone(self, char: str) -> bool:
        """Whether the tokenizer parts this character from punctuation after it; not letters that it turns into a letter and a mark."""
        if char not in self.parted:
            both = self._encode(char + ".").tobytes()
            self.parted[char] = char.isalpha() and both == self._encode(char).tobytes() + self._encode(".").tobytes()
        return self.parted[char]

    def ids(self, words: pa.Array) -> pa.Array:
        """The ids of each of some distinct words (an array that is no slice).

        Punctuation after a letter is a piece of its own to the tokenizer, so a word takes the ids of its core and its tail.
        """
        core = pc.ascii_rtrim(words, TAIL)
        ends = pc.utf8_slice_codeunits(core, -1).dictionary_encode()
        alone = pa.array([self._alone(c) for c in ends.dictionary.to_pylist()], pa.bool_())
        core = pc.if_else(alone.take(ends.indices), core, words)
        size = pc.binary_length(core).to_numpy()
        _, at, data = words.buffers()
        at = np.frombuffer(at, np.int64, len(words) + 1)
        left = np.diff(at) - size
        to = np.concatenate([[0], np.cumsum(left)])
        where = np.repeat(at[:-1] + size - to[:-1], left) + np.arange(to[-1])
        tail = pa.Array.from_buffers(pa.large_string(), len(words), [None, pa.py_buffer(to), pa.py_buffer(np.frombuffer(data or b"", np.uint8)[where])])
        atoms = pa.concat_arrays([core, tail]).dictionary_encode()
        coded = self._atoms(atoms.dictionary)
        first, second = atoms.indices[: len(words)], atoms.indices[len(words) :]
        return pc.binary_join_element_wise(coded.take(first), coded.take(second), pa.scalar(b"", pa.large_binary()))

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """A table with all of the words."""
        own = list(words)
        return dict(zip(own, self.ids(pa.array(own, pa.large_binary()).cast(pa.large_string())).to_pylist(), strict=True))


@functools.cache
def _words(path: str) -> Words:
    return Words(path)


def _split(texts: pa.Array) -> pa.Array:
    """Lists of the words of texts: what white space of ASCII parts, and empty ones at its ends; other white space the tokenizer sees to itself.

    A-Z are lower-cased first, so that fewer words are new, where that cannot matter: the tokenizer lower-cases too, but only
    after it composes accents (U+0300 to U+037F), and its special tokens are in lower case.
    """
    texts = texts.take(pa.array(np.arange(len(texts))))  # a copy, as ascii_lower() gives wrong offsets for a slice
    return pc.ascii_split_whitespace(pc.if_else(pc.match_substring_regex(texts, r"[\x{300}-\x{37f}]|<\|"), texts, pc.ascii_lower(texts)))


def split(text: bytes | None) -> list[bytes]:
    """The words of a text, without empty ones."""
    return [w for w in _split(pa.array([text or b""], pa.large_binary()).cast(pa.large_string())).flatten().cast(pa.large_binary()).to_pylist() if w]


def _parts(batch: pa.RecordBatch):
    """Slices of a batch of PART bytes of text at most, or of one row."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(), dtype=np.int64)
    at = 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART, "right")))
        yield batch.slice(at, end - at)
        at = end


def _pieces(path: str, most: int):
    last = END.to_bytes(4, "little")

    def run(batches):
        words = _words(path)
        for batch in batches:
            for part in _parts(batch):
                lists = _split(part.column(1).cast(pa.large_string()).fill_null(""))
                tokens = lists.flatten().dictionary_encode()
                ids = words.ids(tokens.dictionary).take(tokens.indices)
                _, ends, data = ids.buffers()
                at = np.frombuffer(ends, np.int64)[lists.offsets.to_numpy()].tolist() if len(ids) else [0] * (len(lists) + 1)
                data = memoryview(data or b"")
                out: list[list] = [[], [], [], [], []]
                for doc, low, high in zip(part.column(0).to_pylist(), at[:-1], at[1:], strict=True):
                    n = (high - low) // 4 + 1
                    for piece, start in enumerate(range(0, n, most)):
                        length = min(most, n - start)
                        crc = zlib.crc32(data[low + 4 * start : min(low + 4 * (start + length), high)])
                        if start + length == n:
                            crc = zlib.crc32(last, crc)
                        for column, x in zip(out, (doc, piece, start, length, crc), strict=True):
                            column.append(x)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
                lists = tokens = ids = data = None
            pa.default_memory_pool().release_unused()  # a worker lives on after this stage, and the next ones need the memory

    return run


def tokenize(docs: DataFrame, tokenizer_path: str, max_tokens: int = 4096) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, piece, start, length, ids_crc32): the ids of each whole text and the end id, cut every max_tokens."""
    return narrow(docs, doc_id="long", text="string").mapInArrow(_pieces(tokenizer_path, max_tokens), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(demand: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "norm") -> np.ndarray:
    """The bin of each row of demand (items x resources). A row beyond the capacity gets a bin of its own."""
    scaled = demand / capacity
    order = np.lexsort((np.arange(len(demand)), -(scaled**2 * weights).sum(axis=1)))
    bins = np.empty(len(demand), np.int64)
    left = np.empty((max(64, len(demand)), demand.shape[1]))
    name = np.empty(len(left), np.int64)
    n = opened = 0
    least = scaled.min(axis=0) if len(scaled) else None
    for turn, i in enumerate(order):
        need = scaled[i]
        rest = left[:n] - need
        fits = (rest >= -1e-12).all(axis=1)
        at = np.flatnonzero(fits)
        if len(at):
            score = (weights * rest[at] ** 2).sum(axis=1) if rule == "norm" else -(weights * left[at] * need).sum(axis=1)
            k = at[np.argmin(score)]
            left[k] -= need
        else:
            k, left[n], name[n] = n, 1.0 - need, opened
            n, opened = n + 1, opened + 1
        bins[i] = name[k]
        if (left[k] < least - 1e-12).any():  # no item is small enough for what is left
            n -= 1
            left[k], name[k] = left[n], name[n]
    return bins


def _pack(capacity: tuple[float, ...], weights: tuple[float, ...], rule: str):
    cap, w = np.array(capacity, float), np.array(weights, float)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "piece", "row"], ascending=[False, True, True, True], ignore_index=True)
        n = part["length"].to_numpy(np.float64)
        bins = best_fit(np.stack([n, np.ones_like(n), n * n], axis=1), cap, w, rule)
        part["sequence_id"] = part["group"].astype("int64") * (1 << 33) + bins
        part["offset"] = part.groupby("sequence_id")["length"].cumsum() - part["length"]
        return part[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return run


def pack(pieces: DataFrame, max_tokens: int = 4096, max_documents: int | None = None, max_cost: float | None = None, weights: tuple[float, ...] = (1.0, 0.01, 0.01), rule: str = "norm") -> DataFrame:
    """pieces of tokenize() -> the same with (sequence_id, offset); a row for each input row.

    max_documents and max_cost (sum of squared lengths) default to what max_tokens implies anyway, so that they don't bind. A piece
    as long as a whole sequence has one to itself. Offsets are gapless from 0. Pieces of equal length go by doc_id, piece and
    row. Repeated rows are packed each, null ids too; extra columns are dropped; an empty table gives an empty one.
    """
    capacity = (float(max_tokens), float(max_documents or max_tokens), float(max_cost or max_tokens**2))
    pieces = materialize(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    alone = pieces.where(F.col("length") >= max_tokens)
    rest = pieces.where(F.col("length") < max_tokens)
    groups = max(1, round(rest.count() / GROUP))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    rest = rest.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("long")).groupBy("group").applyInPandas(_pack(capacity, weights, rule), schema)
    return rest.unionByName(alone.select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))


def pack_documents(docs: DataFrame, tokenizer_path: str, max_tokens: int = 4096, **limits) -> DataFrame:
    """tokenize() and pack(). A null or empty text is its end id alone; a null doc_id stays null."""
    return pack(tokenize(docs, tokenizer_path, max_tokens), max_tokens, **limits)
