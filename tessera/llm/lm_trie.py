"""Costs of units by logistic mixing of bit predictors, over chunks of the sorted table of all units.

In byte order, the units that begin with the same bits stand together, so the context "the whole unit so far" is a run of rows, and
its counts are differences of running sums: exact, without slots, and as large as the vocabulary. Runs that go beyond a chunk
get what the other chunks have of them from `outside()`. Each node (such a run, one bit on) is predicted by

- hashed tables of how many distinct units follow the last 1, 2, 3 or 4 bytes and the bits of the byte so far (spelling),
- the counts of all training texts at this node,
- the counts of the training texts of one class at this node; each class of texts has its own prediction.

A logistic mixer adds their stretched probabilities with weights picked by a gate, the evidence in the last two. Weights are learned
in passes, not bit by bit: a pass takes a share of all nodes, predicts each occurrence as if it alone had not been counted yet, and moves the
weights of each gate by a Newton step before the next pass. All sums are over nodes, however these are dealt over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from tessera.llm.lm_text import INSIDE

ORDERS = (1, 2, 3, 4)
INPUTS = len(ORDERS) + 2
#: Evidence of a node, in steps: 0, 1, 2, 3, 4 to 7, 8 to 31, 32 to 255, 256 and more.
STEPS = 8
_STEP = np.searchsorted([1, 2, 3, 4, 8, 32, 256], np.arange(257), "right").astype(np.int64)
GATES = STEPS * STEPS
_DELTA, _LIMIT = 0.02, 9.0
_LEAD = np.array([8, *(8 - int(i).bit_length() for i in range(1, 256))])
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def stretched(n1: np.ndarray, n0: np.ndarray) -> np.ndarray:
    return np.clip(np.log((n1 + _DELTA) / (n0 + _DELTA)), -_LIMIT, _LIMIT).astype(np.float32)


def first_weights() -> np.ndarray:
    """(GATES, INPUTS): more weight for the counts of a class, then of all texts, the more evidence they have."""
    own, every = np.divmod(np.arange(GATES), STEPS)
    w = np.zeros((GATES, INPUTS))
    w[:, -1] = 0.9 * own / STEPS
    w[:, -2] = (1 - w[:, -1]) * 0.9 * every / STEPS
    w[:, : len(ORDERS)] = (1 - w[:, -1] - w[:, -2])[:, None] * np.array([0.1, 0.1, 0.2, 0.6])
    return w


@dataclass
class Chunk:
    """Sorted distinct units with counts by class (units, classes), and what stands outside of the runs at both ends."""

    data: np.ndarray
    length: np.ndarray
    n: np.ndarray
    left: np.ndarray | None = None
    right: np.ndarray | None = None

    def __post_init__(self) -> None:
        size = self.length.astype(np.int64)
        offsets = np.concatenate(([0], np.cumsum(size)))
        self.rows = np.zeros((len(size), int(size.max())), np.uint8)
        row = np.repeat(np.arange(len(size)), size)
        self.rows[row, np.arange(offsets[-1]) - offsets[row]] = self.data
        differ = self.rows[1:] ^ self.rows[:-1]
        at = (differ != 0).argmax(1)
        self.shared = np.concatenate(([-1], 8 * at + _LEAD[differ[np.arange(len(at)), at]])).astype(np.int32)
        self.inside = bool(self.rows[0, 0] == INSIDE[0])

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """Counts, and last the number, of the rows that share at least m bits with the first row, and with the last, for each m."""
        n = np.concatenate((self.n, np.ones((len(self.n), 1), np.int64)), 1)
        sums = np.concatenate((np.zeros((1, n.shape[1]), np.int64), np.cumsum(n, 0)))
        low = np.minimum.accumulate(np.concatenate(([1 << 20], self.shared[1:])))
        high = np.minimum.accumulate(np.concatenate(([1 << 20], self.shared[:0:-1])))
        deep = np.arange(8 * self.rows.shape[1] + 1)
        return sums[np.searchsorted(-low, -deep, "right")], sums[-1] - sums[len(low) - np.searchsorted(-high, -deep, "right")]

    def nodes(self, share: int = 0, of: int = 1, least: int = 0, types: bool = False) -> Iterator[Nodes]:
        """The nodes of every bit, by depth; those of one share by their names, if `of` is more than one. least: a unit with fewer
        occurrences may be left out from the byte on where it stands alone. types: without counts, but those of distinct units."""
        k = self.n.shape[1]
        # From which byte on a row shares no bit with another one; the first and the last may have neighbours outside.
        alone = np.maximum(self.shared, np.append(self.shared[1:], -1)) // 8 + 1
        alone[[0, -1]] = 1 << 20
        alone[self.n.sum(1) >= least] = 1 << 20
        total = self.n.sum(1, keepdims=True)
        every = (total > 0).astype(np.int64) if types else np.concatenate((self.n, total, total > 0), 1)
        no = np.zeros((1, k + 1), np.int64)
        left, right = (no if x is None or types else np.concatenate((x[:, :k], x[:, :k].sum(1, keepdims=True)), 1) for x in (self.left, self.right))
        past = np.zeros((len(self.length), len(ORDERS)), np.uint64)
        whole = np.full(len(self.length), 0x2545F4914F6CDD1D, np.uint64)
        for j in range(self.rows.shape[1]):
            alive = np.flatnonzero((self.length > j) & (alone > j))
            if not len(alive):
                break
            column = self.rows[alive, j]
            if not (self.inside and j == 0):
                sums = np.concatenate((np.zeros((1, every.shape[1]), np.int64), np.cumsum(every[alive], 0)))
                context, prefix, shared = past[alive], whole[alive], self.shared[alive]
                for b in range(8):
                    depth = 8 * j + b
                    new = shared < depth
                    new[0] = True
                    start = np.flatnonzero(new)
                    end = np.append(start[1:], len(alive))
                    node = np.full(len(start), 1 << b, np.uint64)
                    if b:
                        node |= column[start] >> np.uint8(8 - b)
                    name = (prefix[start] ^ node) * _M1
                    name ^= name >> np.uint64(33)
                    first, last = True, True
                    if of > 1:
                        some = np.flatnonzero(name % np.uint64(of) == share)
                        if not len(some):
                            continue
                        first, last = some[0] == 0, some[-1] == len(start) - 1
                        start, end, node, name = start[some], end[some], node[some], name[some]
                    bit = column >> np.uint8(7 - b) & np.uint8(1)
                    ones = np.concatenate(([0], np.cumsum(bit, dtype=np.int64)))
                    middle = end - (ones[end] - ones[start])
                    centre = sums[middle]
                    n0, n1 = centre - sums[start], sums[end] - centre
                    types0, types1 = n0[:, -1].astype(np.float32), n1[:, -1].astype(np.float32)
                    n0, n1, own = n0[:, :-1], n1[:, :-1], np.ones(len(start), bool)
                    if first and alive[0] == 0 and depth < len(left) - 1:
                        a, deeper = left[depth], left[depth + 1]
                        own[0] = not self.left[depth, -1]
                        n1[0] += deeper if bit[0] else 0
                        n0[0] += a - deeper if bit[0] else a
                    if last and alive[-1] == len(self.length) - 1 and depth < len(right) - 1:
                        a, deeper = right[depth], right[depth + 1]
                        n1[-1] += a if bit[-1] else a - deeper
                        n0[-1] += 0 if bit[-1] else deeper
                    h = context[start]
                    h += node[:, None]
                    h *= _M2
                    rows = np.cumsum(new) - 1 if of == 1 else None
                    yield Nodes(alive, rows, bit, n1, n0, types1, types0, h, own)
            value = column.astype(np.uint64) + np.uint64(1)
            whole[alive] = (whole[alive] ^ value) * _M2
            whole[alive] ^= whole[alive] >> np.uint64(29)
            h = np.zeros(len(alive), np.uint64)
            for i, order in enumerate(ORDERS):
                if i <= j:
                    h = h * np.uint64(257) + self.rows[alive, j - i] + np.uint64(1)
                mixed = (h + np.uint64(order)) * _M1
                past[alive, i] = mixed ^ (mixed >> np.uint64(32))


@dataclass
class Nodes:
    """Nodes of one depth: rows that go through them, the node and next bit of each row, counts (nodes, classes + all texts)."""

    alive: np.ndarray
    #: None where a share of the nodes was asked for.
    of: np.ndarray | None
    bit: np.ndarray
    n1: np.ndarray
    n0: np.ndarray
    #: Distinct units of this chunk alone.
    types1: np.ndarray
    types0: np.ndarray
    #: Hashes of the node in the context of each order.
    context: np.ndarray
    #: Whether the node begins in this chunk, so that a sum over chunks takes it once.
    own: np.ndarray


def _gate(total: np.ndarray) -> np.ndarray:
    step = _STEP[np.minimum(total, 256)]
    return step[..., :-1] * STEPS + step[..., -1:]


def _logs(z: np.ndarray) -> np.ndarray:
    """Natural log probabilities of a zero and a one."""
    z = np.clip(z, -12, 12)
    one = -np.log1p(np.exp(-z))
    return np.stack((one - z, one), 1)


@dataclass
class Model:
    """Spelling tables (ORDERS, slots) of types after a zero and a one, and the mixer's weights."""

    n1: np.ndarray
    n0: np.ndarray
    weights: np.ndarray

    def __post_init__(self) -> None:
        self.shift = np.uint64(64 - int(self.n1.shape[1]).bit_length() + 1)
        self.table = stretched(self.n1, self.n0)

    def slots(self, context: np.ndarray) -> np.ndarray:
        return (context >> self.shift).astype(np.int64)

    def costs(self, chunk: Chunk) -> np.ndarray:
        """Natural log probability of each unit in each class of texts."""
        k = chunk.n.shape[1]
        out = np.zeros((len(chunk.length), k), np.float32)
        weights = self.weights.astype(np.float32)
        alive, sums = np.empty(0, np.int64), np.empty((0, k), np.float32)
        for node in chunk.nodes():
            if node.alive is not alive:  # a new byte
                out[alive] += sums
                alive, sums = node.alive, np.zeros((len(node.alive), k), np.float32)
            slot = self.slots(node.context)
            inputs = np.empty((len(slot), INPUTS), np.float32)
            for i in range(len(ORDERS)):
                inputs[:, i] = self.table[i][slot[:, i]]
            inputs[:, -2] = stretched(node.n1[:, -1], node.n0[:, -1])
            inputs[:, -1] = 0
            total = node.n1 + node.n0
            every = _STEP[np.minimum(total[:, -1], 256)]
            both = np.empty((len(slot), 2, k), np.float32)
            both[:] = _logs((weights[every] * inputs).sum(1))[..., None]  # as without evidence of the class
            at, own = np.nonzero(total[:, :-1])
            inputs = inputs[at]
            inputs[:, -1] = stretched(node.n1[at, own], node.n0[at, own])
            gate = _STEP[np.minimum(total[at, own], 256)] * STEPS + every[at]
            both[at, :, own] = _logs((weights[gate] * inputs).sum(1))
            sums += np.take(both.reshape(-1, k), node.of * 2 + node.bit, axis=0)
        out[alive] += sums
        return out

    def learn(self, chunk: Chunk, share: int, of: int) -> np.ndarray:
        """(GATES, INPUTS + pairs of inputs): slopes and curvatures of the log probability over this share of the chunk's nodes."""
        pairs = [(i, j) for i in range(INPUTS) for j in range(i, INPUTS)]
        out = np.zeros((GATES, INPUTS + len(pairs)))
        for node in chunk.nodes(share, of, least=2):
            some = np.flatnonzero(node.own & (node.n1[:, -1] + node.n0[:, -1] > 1))
            if not len(some):
                continue
            slot = self.slots(node.context[some])
            spelled = [(self.n1[i][slot[:, i]], self.n0[i][slot[:, i]]) for i in range(len(ORDERS))]
            for bit in (1, 0):
                same, other = (node.n1[some], node.n0[some]) if bit else (node.n0[some], node.n1[some])
                at, k = np.nonzero(same[:, :-1] > 0)
                weight, sign = same[at, k].astype(np.float64), 1 if bit else -1
                alone = same[at, -1] == 1  # its only unit would not have been seen
                x = np.empty((len(at), INPUTS))
                for i, (n1, n0) in enumerate(spelled):
                    a, b = (n1[at], n0[at]) if bit else (n0[at], n1[at])
                    x[:, i] = sign * stretched(np.maximum(a - alone, 0), b)
                for i, c in ((INPUTS - 2, -1), (INPUTS - 1, k)):
                    x[:, i] = sign * stretched(same[at, c] - 1, other[at, c])
                total = (same + other)[at] - 1
                gate = _gate(np.stack((total[np.arange(len(at)), k], total[:, -1]), 1))[:, 0]
                z = np.clip((self.weights[gate] * x).sum(1), -12, 12)
                p = 1 / (1 + np.exp(-z))
                slope, bend = weight * (bit - p), weight * p * (1 - p)
                for i in range(INPUTS):
                    out[:, i] += np.bincount(gate, slope * x[:, i], GATES)
                for c, (i, j) in enumerate(pairs):
                    out[:, INPUTS + c] += np.bincount(gate, bend * x[:, i] * x[:, j], GATES)
        return out


def step(weights: np.ndarray, sums: np.ndarray, ridge: float = 20.0) -> np.ndarray:
    """The weights after a damped Newton step on the sums of learn()."""
    out = weights.copy()
    for g in range(GATES):
        bend = np.zeros((INPUTS, INPUTS))
        bend[np.triu_indices(INPUTS)] = sums[g, INPUTS:]
        bend += np.triu(bend, 1).T + ridge * np.eye(INPUTS)
        out[g] = np.clip(weights[g] + np.linalg.solve(bend, sums[g, :INPUTS]).clip(-0.5, 0.5), -0.5, 1.5)
    return out


def spell(chunk: Chunk, n1: np.ndarray, n0: np.ndarray) -> None:
    """Adds this chunk's units to the spelling tables (ORDERS, slots): types after a one and after a zero."""
    shift = np.uint64(64 - n1.shape[1].bit_length() + 1)
    for node in chunk.nodes(types=True):
        slot = (node.context >> shift).astype(np.int64)
        for i in range(len(ORDERS)):
            np.add.at(n1[i], slot[:, i], node.types1)
            np.add.at(n0[i], slot[:, i], node.types0)


def _bits_shared(a: bytes, b: bytes) -> int:
    """Leading bits that both have; -1 for units of different kinds, which have no context in common."""
    if a[:1] != b[:1] and INSIDE in (a[:1], b[:1]):
        return -1
    for i, (x, y) in enumerate(zip(a, b, strict=False)):
        if x != y:
            return 8 * i + int(_LEAD[x ^ y])
    return 8 * min(len(a), len(b))


def outside(first: list[bytes], last: list[bytes], low: list[np.ndarray], high: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For chunks in order, with their ends(): those of all chunks before that share m bits with the first row, and of all after that
    share m bits with the last row, for each m up to one more than the bits shared."""

    def through(ends: list[np.ndarray], inner: list[int], shared: list[int]) -> list[np.ndarray]:
        # ends[i]: chunk i's counts at the side of the next one; inner[i]: bits that all of chunk i shares; shared[i]: with the next.
        out, had = [], np.zeros((1, ends[0].shape[1]), np.int64)
        for i in range(len(ends)):
            out.append(had)
            if i + 1 < len(ends):
                size = shared[i] + 1
                got = np.zeros((size + 1, had.shape[1]), np.int64)
                own = ends[i][:size]
                got[: len(own)] = own
                more = min(size, inner[i] + 1, len(had))
                got[:more] += had[:more]
                had = got
        return out

    if not (n := len(first)):
        return []
    inner = [_bits_shared(a, b) for a, b in zip(first, last, strict=True)]
    shared = [_bits_shared(last[i], first[i + 1]) for i in range(n - 1)]
    left = through(high, inner, shared)
    right = through(low[::-1], inner[::-1], shared[::-1])[::-1]
    return list(zip(left, right, strict=True))
