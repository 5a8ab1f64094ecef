"""Which digests are in a set, by a filter that errs only towards yes, and joins with keys that may be hot."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Filter bits for each digest, four of which are set; at least FEWEST bits and at most MOST (128 MB), in BLOCKS parts.
PER_DIGEST, FEWEST, MOST, BLOCKS = 16, 1 << 16, 1 << 30, 64
#: A key that has this share of all rows or more is frequent; there are 1 / FREQUENT of them at most.
FREQUENT = 1e-4


def _places(digests: list[bytes], bits: int) -> np.ndarray:
    """Four filter bits for each digest of 32 bytes."""
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 4) % np.uint64(bits)


class DigestFilter:
    """contains() is true for every digest that was put in and, at MOST bits or fewer, for about one of 400 others."""

    def __init__(self, marks: np.ndarray) -> None:
        self.marks = marks

    def contains(self, digests: list[bytes]) -> np.ndarray:
        if not digests:
            return np.zeros(0, bool)
        at = _places(digests, 8 * len(self.marks))
        return ((self.marks[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(1)


def digest_filter(digests: DataFrame) -> DigestFilter:
    """A filter of a one-column table of 32-byte digests, sized by their number."""
    bits = min(max(FEWEST, 1 << (PER_DIGEST * digests.count() - 1).bit_length()), MOST)

    def mark(batches):
        marks = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            if len(batch):
                at = _places(batch.column(0).to_pylist(), bits).ravel()
                np.bitwise_or.at(marks, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        for i, block in enumerate(marks.reshape(BLOCKS, -1)):
            if block.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([block.tobytes()], pa.binary())], ["block", "marks"])

    def either(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                b = np.frombuffer(b, np.uint8)
                held[i] = held[i] | b if i in held else b
        for i, b in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([b.tobytes()], pa.binary())], ["block", "marks"])

    schema = "block int, marks binary"
    out = np.zeros((BLOCKS, bits // 8 // BLOCKS), np.uint8)
    for r in digests.mapInArrow(mark, schema).repartition(BLOCKS, "block").mapInArrow(either, schema).toLocalIterator():
        out[r.block] = np.frombuffer(bytes(r.marks), np.uint8)
    return DigestFilter(out.ravel())


def join_by_key(rows: DataFrame, found: DataFrame, key: str, n_rows: int) -> DataFrame:
    """rows left-joined with found(key, n, ...), which has each key once; n: how many rows have it, and isn't in the result.

    Frequent keys are broadcast, all others joined, so that no key brings many rows into one task. `rows` has a column `row` that
    tells them apart; keys are binary.
    """
    least = max(n_rows * FREQUENT, 2)
    names = [c for c in found.columns if c not in (key, "n")]
    hot = F.broadcast(found.where(F.col("n") >= least).select(key, F.lit(True).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in names]))
    cold = found.where(F.col("n") < least).select(F.col(key).alias("_cold"), *names)
    apart = F.concat(F.lit("not to be joined, but apart from others: "), F.col("row")).cast("binary")
    out = rows.join(hot, key, "left").withColumn("_cold", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(apart)).join(cold, "_cold", "left")
    kept = [F.col(c) for c in rows.columns]
    return out.select(*kept, *[F.coalesce(f"_hot_{c}", c).alias(c) for c in names])
