"""Language-model scores by online logistic context mixing.

A lower-cased (A-Z) text is a run of words, each with the white-space byte or the end that stops it. Every word is coded bit by bit:
predictors look up contexts (hashed spellings, the whole word so far in all texts, and in the texts of one class) and a logistic
mixer with gated weights, learned by Newton steps over shares of all nodes, combines them (lm_trie). Texts
are split into CLASSES classes by their byte pairs, and a document's probability is mixed from those under the classes, so that its first words tell how to weigh them for the next. A cache
of its own words has a share that every word refines. The kind of a stop is coded by counts in its context. Last comes the longest
context there is: a text that other training documents have too is a copy with the probability that training texts are copies.

What is gathered grows with the corpus: the table of all units with exact counts by class, in byte order, in chunks. Units whose
share of all is FREQUENT or more, which can't be more than 1 / FREQUENT, are known to every worker with their costs; those of all
others meet their documents in a join. Beside the score stands the base, add-one unigrams of words, from the same table.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import lm_text, lm_trie
from tessera.llm.common import materialize, narrow
from tessera.llm.lm_text import INSIDE, KINDS, LONG, PIECE, STOP_CONTEXTS, STOPS
from tessera.llm.sharing import join_by_key

CLASSES, BITS = 6, 6
FEATURES = 1 << BITS
#: Texts that the first class centres are drawn from; all texts move them afterwards.
FIRST_TEXTS = 1000
#: Least share of all units that makes one frequent.
FREQUENT = 5e-7
#: Distinct units that a worker counts before it hands them on, units in a chunk, chunks a task.
COUNTED, CHUNK = 250_000, 1 << 16
#: Passes over shares of all nodes that the mixer's weights are learned in.
SHARES = 2
BLOCK = 1 << 14
#: The cache's share at first: so many hits in so many words.
HITS, WORDS = 1.0, 20.0
_NAMES = [f"n{k}" for k in range(CLASSES)]


def _featured(batches):
    for batch in batches:
        for low, high, data, offsets in lm_text.slices(batch.column(0)):
            rows = lm_text.features(data, offsets, BITS)
            names = [xxhash.xxh3_64_intdigest(data[a:b].tobytes()) >> 1 for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())], ["name", "feature"])


def _nearest(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers**2).sum(1) - 2 * rows.astype(np.float64) @ centers.T).argmin(1)


def _moved(centers: np.ndarray):
    def run(batches):
        sums = np.zeros((CLASSES, FEATURES + 1))
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, FEATURES)
            k = _nearest(rows, centers)
            for c in range(CLASSES):
                sums[c, :-1] += rows[k == c].sum(0, dtype=np.float64)
                sums[c, -1] += (k == c).sum()
        k, i = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(i, pa.int32()), pa.array(sums[k, i])], ["k", "i", "x"])

    return run


def text_classes(learn: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Centres (CLASSES, FEATURES) of the training texts' byte pairs, and the share of the texts near each."""
    rows = materialize(learn.select("text").mapInArrow(_featured, "name long, feature binary"), "features")
    first = [np.frombuffer(bytes(r.feature), np.float32).astype(np.float64) for r in rows.distinct().orderBy("name").limit(FIRST_TEXTS).collect()]
    centers, count = np.zeros((CLASSES, FEATURES)), np.zeros(CLASSES)
    if not first:
        return centers, np.full(CLASSES, 1 / CLASSES)
    first = np.stack(first)
    rng = np.random.default_rng(7)
    centers[0] = first[0]
    for c in range(1, CLASSES):
        far = ((first[:, None] - centers[None, :c]) ** 2).sum(-1).min(1)
        centers[c] = first[rng.choice(len(first), p=far / far.sum())] if far.sum() > 1e-9 else first[0] + 10 + c
    for _ in range(10):
        k = _nearest(first, centers)
        centers = np.stack([first[k == c].mean(0) if (k == c).any() else centers[c] for c in range(CLASSES)])
    for _ in range(3):
        sums = np.zeros((CLASSES, FEATURES + 1))
        for r in rows.mapInArrow(_moved(centers), "k int, i int, x double").groupBy("k", "i").agg(F.sum("x").alias("x")).collect():
            sums[r.k, r.i] = r.x
        count = sums[:, -1]
        centers = np.where(count[:, None] > 0, sums[:, :-1] / np.maximum(count, 1)[:, None], centers)
    return centers.round(9), (count + 1) / (count.sum() + CLASSES)


class _Held:
    """Counts of units until they are handed on."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, data: np.ndarray, offsets: np.ndarray, h: np.ndarray, n: np.ndarray) -> None:
        if len(h):
            self.parts.append((data, np.diff(offsets), h, n))
            self.size += len(h)

    def full(self) -> bool:
        """Whether COUNTED units are held once equal ones are put together."""
        if self.size > 2 * COUNTED:
            self._merge()
        return self.size > COUNTED and len(self.parts) == 1

    def _merge(self) -> None:
        data, length, h, n = (np.concatenate([p[i] for p in self.parts]) for i in range(4))
        order = np.argsort(h, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
        start = (np.cumsum(length) - length)[order[first]]
        data, offsets = lm_text.gather(data, start, length[order[first]], b"")
        self.parts = [(data, np.diff(offsets), h[order[first]], np.add.reduceat(n[order], first, axis=0, dtype=np.uint32))]
        self.size = len(first)

    def out(self) -> pa.RecordBatch:
        self._merge()
        data, length, _, n = self.parts[0]
        self.parts, self.size = [], 0
        offsets = np.concatenate(([0], np.cumsum(length)))
        return pa.RecordBatch.from_arrays([lm_text.binary(data, offsets), *(pa.array(n[:, c].astype(np.int64)) for c in range(n.shape[1]))], ["unit", "seen", *_NAMES])


def _counted(centers: np.ndarray):
    def run(batches):
        held = _Held()
        rare: dict[bytes, np.ndarray] = {}
        for batch in batches:
            for low, high, data, offsets in lm_text.slices(batch.column(0)):
                learn = batch.column(1).slice(low, high - low).to_numpy(zero_copy_only=False).astype(bool)
                k = _nearest(lm_text.features(data, offsets, BITS), centers)
                w = lm_text.words(data, offsets)
                g = lm_text.groups(w)
                n = np.zeros((len(g.sample), CLASSES + 1), np.uint32)
                n[:, 0] = np.bincount(g.of, minlength=len(n))
                own = learn[w.doc]
                n[:, 1:] = np.bincount(g.of[own] * CLASSES + k[w.doc[own]], minlength=len(n) * CLASSES).reshape(-1, CLASSES)
                short = w.length[g.sample] < PIECE
                held.add(*w.take(g.sample[short]), w.hash[g.sample[short]], n[short])
                for i in w.long():
                    row = np.zeros(CLASSES + 1, np.int64)
                    row[0], row[1 + k[w.doc[i]]] = 1, own[i]
                    text = w.text(i)
                    for unit in (LONG + text, *lm_text.pieces(text)):
                        rare[unit] = rare.get(unit, 0) + row
                stops, ctx = w.kind[own], w.stop_contexts()[own]
                for at, count in zip(*np.unique(ctx * KINDS + stops, return_counts=True), strict=True):
                    unit = STOPS + int(at).to_bytes(2, "big")
                    rare[unit] = rare.get(unit, 0) + np.array([count] + [0] * CLASSES)
                if held.full():
                    yield held.out()
                if len(rare) > COUNTED // 10:
                    yield _few(rare)
                    rare = {}
        if held.size:
            yield held.out()
        if rare:
            yield _few(rare)

    return run


def _few(rare: dict) -> pa.RecordBatch:
    n = np.stack(list(rare.values()))
    return pa.RecordBatch.from_arrays([pa.array(list(rare), pa.binary()), *(pa.array(n[:, c]) for c in range(n.shape[1]))], ["unit", "seen", *_NAMES])


def _chunks(batches):
    held: list[tuple] = []
    size = 0

    def out():
        units = [u for part in held for u in part[0]]
        n = np.concatenate([part[1] for part in held])
        held.clear()
        cut = next((i for i, u in enumerate(units) if u[:1] == INSIDE), len(units))
        for low, high in ((0, cut), (cut, len(units))):
            if low < high:
                own = units[low:high]
                chunk = lm_trie.Chunk(np.frombuffer(b"".join(own), np.uint8), np.array([len(u) for u in own], np.uint8), np.ascontiguousarray(n[low:high, 1:]))
                ends = [zlib.compress(e.tobytes(), 1) for e in chunk.ends()]
                row = (own[0], own[-1], chunk.data.tobytes(), chunk.length.tobytes(), np.ascontiguousarray(n[low:high, 0]).tobytes(), chunk.n.tobytes(), *ends)
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], ["first", "last", "data", "length", "seen", "n", "low", "high"])

    for batch in batches:
        for at in range(0, len(batch), CHUNK):
            part = batch.slice(at, CHUNK)
            held.append((part.column(0).to_pylist(), np.stack([part.column(c).to_numpy() for c in range(1, CLASSES + 2)], 1)))
            size += len(part)
            if size >= CHUNK:
                yield from out()
                size = 0
    if held:
        yield from out()


def _read(batches, outside=None):
    """(Chunk, seen) of each row of (first, data, length, seen, n)."""
    for batch in batches:
        for first, data, length, seen, n in zip(*(batch.column(i) for i in range(5)), strict=True):
            left, right = outside[first.as_py()] if outside else (None, None)
            length = np.frombuffer(length.as_buffer(), np.uint8)
            yield lm_trie.Chunk(np.frombuffer(data.as_buffer(), np.uint8), length, np.frombuffer(n.as_buffer(), np.int64).reshape(len(length), -1), left, right), np.frombuffer(seen.as_buffer(), np.int64)


def _spelled(bits: int):
    def run(batches):
        n1 = n0 = np.empty(0)
        for chunk, _ in _read(batches):
            if not n1.size:
                n1, n0 = (np.zeros((len(lm_trie.ORDERS), 1 << bits), np.float32) for _ in range(2))
            lm_trie.spell(chunk, n1, n0)
        if not n1.size:
            return
        x, y = n1.reshape(-1, min(BLOCK, n1.size)), n0.reshape(-1, min(BLOCK, n1.size))
        for i in range(len(x)):
            if (at := np.flatnonzero(x[i] + y[i])).size:
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (at.astype(np.uint16), x[i, at], y[i, at]))], ["block", "at", "n1", "n0"])

    return run


def _merged(batches):
    """Sums of the blocks of a sorted stream."""
    key, sums = None, np.zeros((2, BLOCK))

    def out():
        at = np.flatnonzero(sums.sum(0))
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (at.astype(np.uint16), *sums[:, at].astype(np.float32)))], ["block", "at", "n1", "n0"])

    for batch in batches:
        for k, at, n1, n0 in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if k != key:
                if key is not None:
                    yield out()
                key = k
                sums[:] = 0
            at = np.frombuffer(at, np.uint16)
            sums[0, at] += np.frombuffer(n1, np.float32)
            sums[1, at] += np.frombuffer(n0, np.float32)
    if key is not None:
        yield out()


def _learned(model, outside, share: int):
    def run(batches):
        sums = 0
        for chunk, _ in _read(batches, outside.value):
            sums = sums + model.learn(chunk, share, SHARES)
        if not np.isscalar(sums):
            g, i = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(i, pa.int32()), pa.array(sums[g, i])], ["g", "i", "x"])

    return run


def _costed(model, outside):
    def run(batches):
        for chunk, seen in _read(batches, outside.value):
            cost = model.value.costs(chunk)
            offsets = np.concatenate(([0], np.cumsum(chunk.length, dtype=np.int64)))
            stopped = chunk.data[offsets[1:] - 1] == 32
            c = np.where(stopped & (chunk.length > 1) & (not chunk.inside), chunk.n.sum(1), 0)
            yield pa.RecordBatch.from_arrays([lm_text.binary(chunk.data, offsets), pa.array(seen), pa.array(c), *(pa.array(cost[:, k]) for k in range(CLASSES))], ["unit", "seen", "c", *_NAMES])

    return run


def unit_costs(units: DataFrame) -> DataFrame:
    """(unit, seen, n0 ...) of all documents -> (unit, seen, c, n0 ...): how often it is a word of training texts, for the base
    score, and the natural log probability of the unit in each class of texts. Whole long words have no costs."""
    spark = units.sparkSession
    head = F.expr("substring(unit, 1, 1)")
    own = units.where(~head.isin(bytearray(LONG), bytearray(STOPS)))
    size = own.count()
    chunks = own.repartitionByRange(-(-size // CHUNK) or 1, "unit").sortWithinPartitions("unit").mapInArrow(_chunks, "first binary, last binary, data binary, length binary, seen binary, n binary, low binary, high binary")
    chunks = materialize(chunks, "chunks")
    ends = sorted(((bytes(r.first), bytes(r.last), r.low, r.high) for r in chunks.select("first", "last", "low", "high").toLocalIterator()), key=lambda r: r[0])
    low, high = ([np.frombuffer(zlib.decompress(bytes(r[i])), np.int64).reshape(-1, CLASSES + 1) for r in ends] for i in (2, 3))
    first = [r[0] for r in ends]
    outside = spark.sparkContext.broadcast(dict(zip(first, lm_trie.outside(first, [r[1] for r in ends], low, high), strict=True)))
    body = chunks.select("first", "data", "length", "seen", "n")
    bits = min(max(size.bit_length() + 1, 14), 20)  # contexts of at most four bytes don't go on growing
    blocks = body.mapInArrow(_spelled(bits), "block int, at binary, n1 binary, n0 binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = materialize(blocks.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(_merged, "block int, at binary, n1 binary, n0 binary"), "spelling")
    n1, n0 = (np.zeros((len(lm_trie.ORDERS), 1 << bits), np.float32) for _ in range(2))
    for r in blocks.toLocalIterator():
        at = np.frombuffer(bytes(r.at), np.uint16)
        for table, x in ((n1, r.n1), (n0, r.n0)):
            table.reshape(-1, BLOCK)[r.block, at] = np.frombuffer(bytes(x), np.float32)
    weights = lm_trie.first_weights()
    tables = spark.sparkContext.broadcast((n1, n0))
    for share in range(SHARES):
        sums = np.zeros((lm_trie.GATES, lm_trie.INPUTS * (lm_trie.INPUTS + 3) // 2))
        for r in body.mapInArrow(_learned(_Late(tables, weights), outside, share), "g int, i int, x double").groupBy("g", "i").agg(F.sum("x").alias("x")).collect():
            sums[r.g, r.i] = r.x
        weights = lm_trie.step(weights, sums)
    kinds = "unit binary, seen long, c long, " + ", ".join(f"{n} float" for n in _NAMES)
    costs = body.mapInArrow(_costed(_Late(tables, weights), outside), kinds)
    whole = units.where(head == F.lit(bytearray(LONG))).select("unit", "seen", sum(F.col(n) for n in _NAMES).alias("c"), *[F.lit(0.0).cast("float").alias(n) for n in _NAMES])
    return materialize(costs.union(whole), "costs")


class _Late:
    """A model whose tables are broadcast, made once a worker."""

    def __init__(self, tables, weights: np.ndarray) -> None:
        self.tables, self.weights, self.made = tables, weights, None

    @property
    def value(self) -> lm_trie.Model:
        if self.made is None:
            self.made = lm_trie.Model(*self.tables.value, self.weights)
        return self.made

    def learn(self, *args):
        return self.value.learn(*args)

    def __getstate__(self):
        return self.tables, self.weights, None

    def __setstate__(self, state):
        self.tables, self.weights, self.made = state


class _Known:
    """Costs of frequent units, by the hash of a word or, for other units, by their bytes."""

    def __init__(self, found: pa.Table) -> None:
        found = found.combine_chunks().sort_by("unit") if len(found) else found
        units = found["unit"].to_pylist()
        c = found["c"].to_numpy()
        self.log_c, self.known = np.log10(c + 1.0), c > 0
        self.cost = np.stack([found[n].to_numpy() for n in _NAMES], 1) if len(found) else np.zeros((0, CLASSES), np.float32)
        word = np.array([u[-1:] == b" " and u[:1] != INSIDE and u[:1] != LONG for u in units], bool)
        self.other = {u: i for i, u in enumerate(units) if not word[i]}
        own = [units[i][:-1] for i in np.flatnonzero(word)]
        h = lm_text.hash_rows(np.frombuffer(b"".join(own), np.uint8), np.concatenate(([0], np.cumsum([len(u) for u in own], dtype=np.int64))))
        order = np.argsort(h)
        self.hash, self.at, self.length = h[order], np.flatnonzero(word)[order], np.array([len(u) for u in own], np.int64)[order]

    def find(self, h: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Rows of words, -1 for others. A word of another hash is never taken for one; equal hashes and lengths are equal words."""
        if not len(self.hash):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where((self.hash[at] == h) & (self.length[at] == length), self.at[at], -1)


_SCORED = "n_bytes long, n_tokens long, known long, base double, " + ", ".join(f"s{k} double" for k in range(CLASSES)) + ", digest binary, rare array<binary>, tf array<int>, coded array<int>"


def _scored(known, stops: np.ndarray, prior: np.ndarray):
    def run(batches):
        frequent = known.value
        overall = np.maximum(np.exp(frequent.cost.astype(np.float64)) @ prior, 1e-300)
        for batch in batches:
            for low, high, data, offsets in lm_text.slices(batch.column(1)):
                n = high - low
                w = lm_text.words(data, offsets)
                g = lm_text.groups(w)
                at = frequent.find(w.hash[g.sample], w.length[g.sample])[g.of]
                short = w.length < PIECE
                place = np.arange(len(at)) - w.first[w.doc]
                cached = np.where(short, g.before / np.maximum(place, 1), 0.0)
                hot, again = np.flatnonzero(at >= 0), np.flatnonzero((at < 0) & (cached > 0))
                hit = np.zeros(len(at))
                even = HITS / WORDS
                hit[hot] = even * cached[hot] / (even * cached[hot] + (1 - even) * overall[at[hot]])
                hit[again] = 1
                before = np.cumsum(hit) - hit
                share = (HITS + before - before[w.first[:-1]][w.doc]) / (WORDS + place)
                log = np.log1p(-share)
                log[hot] = 0
                log[again] = np.log(share[again] * cached[again])
                log += stops[w.stop_contexts(), w.kind]
                common = np.bincount(w.doc, log, n)
                # In logarithms: the probability of a long word may be less than any number.
                rest, old = np.log1p(-share[hot]), np.flatnonzero(cached[hot] > 0)
                p = np.log(share[hot[old]] * cached[hot[old]])
                score = []
                for k in range(CLASSES):
                    own = rest + frequent.cost[at[hot], k]
                    own[old] = np.logaddexp(p, own[old])
                    score.append(common + np.bincount(w.doc[hot], own, n).astype(np.float64))
                token = w.length > 0
                told = hot[token[hot]]
                base = np.bincount(w.doc[told], frequent.log_c[at[told]], n).astype(np.float64)
                met = np.bincount(w.doc[told], frequent.known[at[told]], n).astype(np.int64)
                keep = (at[g.once] < 0) & short[g.once]
                once, times = g.once[keep], g.times[keep]
                order = np.argsort(once)
                once, times = once[order], times[order]
                text, cut = w.take(once)
                doc, units, tf, coded = w.doc[once], lm_text.binary(text, cut), times, np.ones(len(once), np.int64)
                more: list[tuple] = []
                for i in w.long():
                    d, word = w.doc[i], w.text(i)
                    for unit, a, b in ((LONG + word, 1, 0), *((u, 0, 1) for u in lm_text.pieces(word))):
                        if (j := frequent.other.get(unit)) is None:
                            more.append((d, unit, a, b))
                        elif a:
                            base[d] += frequent.log_c[j]
                            met[d] += frequent.known[j]
                        else:
                            for k in range(CLASSES):
                                score[k][d] += frequent.cost[j, k]
                if more:
                    doc = np.concatenate((doc, [m[0] for m in more]))
                    order = np.argsort(doc, kind="stable")
                    units = pa.concat_arrays([units, pa.array([m[1] for m in more], pa.binary())]).take(pa.array(order))
                    tf, coded = (np.concatenate((x, [m[i] for m in more]))[order] for i, x in ((2, tf), (3, coded)))
                    doc = doc[order]
                ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n)))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, x) for x in (units, pa.array(tf.astype(np.int32)), pa.array(coded.astype(np.int32)))]
                columns = [pa.array(np.diff(offsets)), pa.array(np.bincount(w.doc, token, n).astype(np.int64) + 1), pa.array(met), *(pa.array(x, pa.float64()) for x in (base, *score)), pa.array(w.digests(), pa.binary()), *lists]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(low, n) for i in (0, 2)), *columns], ["doc_id", "learn", *(c.split()[0] for c in _SCORED.split(", "))])

    return run


def _stop_logs(rows: list) -> np.ndarray:
    """(STOP_CONTEXTS, KINDS): natural log probabilities, smoothed by those of all contexts."""
    n = np.zeros((STOP_CONTEXTS, KINDS))
    for r in rows:
        n.ravel()[int.from_bytes(bytes(r.unit)[1:], "big")] = r.seen
    every = (n.sum(0) + 0.1) / (n.sum() + 0.1 * KINDS)
    return np.log((n + every) / (n.sum(1, keepdims=True) + 1))


def _with_copies(rows: DataFrame, n_docs: int) -> DataFrame:
    """rows and `others`, the other training documents of the same text, null for none, and `copied`, the share of such documents."""
    copies = materialize(rows.where("learn").groupBy("digest").agg(F.count("*").alias("n")), "copies")
    copied = (copies.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0))).first()[0] + 0.5) / (n_docs + 1)
    out = join_by_key(rows, copies.select("digest", "n", F.col("n").alias("same")), "digest", n_docs)
    others = F.coalesce("same", F.lit(0)) - F.col("learn").cast("int")
    return out.withColumn("others", F.when(others > 0, others)).withColumn("copied", F.lit(copied)).drop("same", "digest", "learn")


def score_documents(docs: DataFrame, training) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte), a row for each
    input row.

    training: a Column over docs that is true for the rows to learn from; null counts as false. Tokens are the words of the
    lower-cased text and one end. Null and empty texts have the end alone. Null doc_ids and repeated rows stay; equal texts have
    equal scores, in whatever order and partitions they come, but that a training document is no copy of itself. Extra columns are ignored; an empty table gives an empty one. Without
    training rows no token is known and the model's bits are even. bits_per_byte is the score's bits over the bytes of the text,
    null where it has none.
    """
    spark = docs.sparkSession
    flag = "learn_" + "_" * max(len(c) for c in docs.columns)
    docs = narrow(docs.withColumn(flag, F.coalesce(training, F.lit(False))), doc_id="long", text="string", **{flag: "boolean"}).withColumnRenamed(flag, "learn")
    learn = docs.where("learn")
    centers, prior = text_classes(learn)
    counts = docs.select("text", "learn").mapInArrow(_counted(centers), "unit binary, seen long, " + ", ".join(f"{n} long" for n in _NAMES))
    units = materialize(counts.groupBy("unit").agg(*[F.sum(n).alias(n) for n in ("seen", *_NAMES)]), "units")
    head = F.expr("substring(unit, 1, 1)")
    stops = _stop_logs(units.where(head == F.lit(bytearray(STOPS))).collect())
    costs = unit_costs(units)
    n_docs = learn.count()
    n_words, words, seen = costs.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1)), F.coalesce(F.sum("seen"), F.lit(0))).first()
    n, v = n_words + n_docs, words + (n_docs > 0)
    least = max(seen * FREQUENT, 1)
    known = spark.sparkContext.broadcast(_Known(costs.where(F.col("seen") >= least).toArrow()))
    rows = docs.select("doc_id", "text", "learn").mapInArrow(_scored(known, stops, prior), "doc_id long, learn boolean, " + _SCORED)
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    asked = rows.select("row", F.explode(F.arrays_zip("rare", "tf", "coded")).alias("r")).select("row", F.col("r.rare").alias("unit"), F.col("r.tf").alias("tf"), F.col("r.coded").alias("coded"))
    sums = [F.sum(F.when(F.col("c") > 0, F.col("tf"))).alias("k"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("b"), *[F.sum(F.col("coded") * F.col(x)).alias(x) for x in _NAMES]]
    met = asked.join(costs.where(F.col("seen") < least), "unit").groupBy("row").agg(*sums)
    out = _with_copies(rows.drop("rare", "tf", "coded"), n_docs).join(met, "row", "left")
    end = math.log10(n_docs + 1)
    base = F.col("base") + F.coalesce("b", F.lit(0.0)) + end - F.col("n_tokens") * math.log10(n + v + 1)
    under = [F.col(f"s{k}") + F.coalesce(x, F.lit(0.0)) + math.log(prior[k]) for k, x in enumerate(_NAMES)]
    top = F.greatest(*under)
    model = top + F.log(sum(F.exp(u - top) for u in under)) + F.log1p(-F.col("copied"))
    copy = F.log(F.col("copied") * F.col("others") / max(n_docs, 1))  # null without others
    score = F.coalesce(F.greatest(model, copy) + F.log1p(F.exp(-F.abs(model - copy))), model) / math.log(10)
    bits = F.when(F.col("n_bytes") > 0, -F.col("score") * math.log2(10) / F.col("n_bytes"))
    seen_tokens = F.col("known") + F.coalesce("k", F.lit(0)) + int(n_docs > 0)
    out = out.select("doc_id", "n_bytes", "n_tokens", seen_tokens.cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))
    return out.select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", bits.alias("bits_per_byte"))
