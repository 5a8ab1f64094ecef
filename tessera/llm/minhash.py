"""Near-duplicate documents by HyperMinHash registers, banding, collision-corrected estimates and full-set confirmation.

A document's distinct word shingles are hashed once. The high part of a hash picks one of `bands * rows` buckets; each bucket
keeps its smallest second hash, compressed to a count of leading zeros and ten mantissa bits (16 bits a register). Empty buckets
borrow from a full one by a fixed random sequence, so registers agree with the probability of the Jaccard similarity.

1. Documents with equal sets form a class; only its smallest document goes on (a hot group of copies is one row from here).
2. Registers, `rows` at a time, are band keys. All that share a key are candidates of two members of the bucket, its hubs, so a
   bucket of n rows costs 2 n candidate pairs at most, not n squared.
3. Each class ranks its hubs once by the buckets in common. A round takes the next ranks, and only between components that are
   still different. The estimate, corrected for chance agreement of compressed registers at the sizes of both sets, drops what is
   far below the threshold; full sets confirm the rest.
4. What shares a bucket but is still in different components is joined by the rarest shingles of the sets (a prefix filter, which
   is exact), so that no link is lost to the hubs.

Every pair also has to pass its parities: PARITY bits say of how many shingles of a set, even or odd, each hash falls to it. Two
sets differ in at least as many shingles as bits, so a pair whose bits differ in too many can't link: again exact. It keeps a large
group of texts that are alike, but less than the threshold, from making a pair of any two.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import materialize, narrow, release
from tessera.llm.graph import components

MANTISSA = 10
#: Parity bits of a set, in words of 64.
PARITY = 1024
_WORDS = [f"p{i}" for i in range(PARITY // 64)]
#: Words hashed that a worker keeps at hand; beyond that it starts anew.
MEMO = 200_000
#: Documents whose ids may be broadcast to pick the texts to confirm; beyond that the texts are joined.
BROADCAST_IDS = 300_000
#: Ranks of the hubs of a class that each round tries, from and to; the last one tries all that are left.
RANKS = ((1, 1), (2, 3), (4, 1 << 30))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Memo(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, size: int, memo: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text; its whole word sequence if that is shorter than a shingle."""
    words = text.lower().split() if text else []  # bytes: A-Z only, and white space is 0x20 and 0x09 to 0x0D
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    if len(words) < size:
        return _mix(np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(words))], np.uint64))
    n = len(h) - size + 1
    s = h[:n].copy()
    for k in range(1, size):
        s *= np.uint64(0x9E3779B97F4A7C15)
        s += h[k : k + n]
        s ^= s >> np.uint64(29)
    s = _mix(s)
    s.sort()
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def _borrow(k: int) -> np.ndarray:
    """Where bucket i looks in its attempt t."""
    return np.random.default_rng(20).integers(0, k, (128, k))


def registers(sets: list[np.ndarray], k: int) -> np.ndarray:
    """A row of k 16-bit registers for each set; sets must not be empty."""
    low = np.full((len(sets), k), np.iinfo(np.uint64).max, np.uint64)
    for row, s in zip(low, sets, strict=True):
        bucket = ((s >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)  # sorted, as s is
        at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        row[bucket[at]] = np.minimum.reduceat(_mix(s ^ np.uint64(0xD6E8FEB86659FD93)), at)
    full = low != np.iinfo(np.uint64).max
    zeros = (64 - np.frexp(low.astype(np.float64))[1]).clip(0, 63).astype(np.uint64)
    mantissa = (low << (zeros + np.uint64(1)).clip(0, 63)) >> np.uint64(64 - MANTISSA)
    reg = (zeros << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    left = np.flatnonzero(~full.all(axis=1))
    have = full.copy()
    for at in _borrow(k):
        if not len(left):
            break
        rows = reg[left]
        take = ~have[left] & full[left][:, at]
        rows[take] = rows[:, at][take]
        reg[left] = rows
        have[left] |= take
        left = left[~have[left].all(axis=1)]
    for i in left:  # very small sets: the full buckets in turn, by a fixed mix of the place
        at, miss = np.flatnonzero(full[i]), np.flatnonzero(~have[i])
        reg[i, miss] = reg[i, at[np.argmin(_mix((miss[:, None] * 65537).astype(np.uint64) + reg[i, at].astype(np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15)), axis=1)]]
    return reg


def band_keys(reg: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = reg.reshape(len(reg), bands, rows).astype(np.uint64)
    h = np.full((len(reg), bands), 0x2545F4914F6CDD1D, np.uint64)
    for r in range(rows):
        h = (h ^ parts[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return _mix(h).view(np.int64)


def chance(n_a: np.ndarray, n_b: np.ndarray, k: int) -> np.ndarray:
    """Probability that the registers of two buckets agree although their minima differ, for sets of n_a and n_b hashes in k buckets.

    The minimum of a bucket with a mean of m hashes lies at x with density m * exp(-m * x). A register is a cell of width
    2 ** -(z + 1 + MANTISSA) among x with z leading zeros, so the cells that both minima meet in sum up level by level.
    """
    x, y = (np.maximum(np.asarray(n, np.float64) / k, 1) for n in (n_a, n_b))
    levels = 2.0 ** -np.arange(64)
    mass = np.exp(-np.multiply.outer(x + y, levels / 2)) - np.exp(-np.multiply.outer(x + y, levels))
    return (mass * (levels / 2)).sum(-1) * x * y / (x + y) / 2**MANTISSA


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from rows of registers, less the agreement that compression makes by chance."""
    c = chance(n_a, n_b, a.shape[1])
    return ((a == b).mean(axis=1) - c) / (1 - c)


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, PARITY / 64) words: a bit for each residue of hashes, set if an odd number of a set's hashes has it."""
    out = np.empty((len(sets), PARITY // 8), np.uint8)
    for row, s in zip(out, sets, strict=True):  # one by one: counts of a batch would take a worker's memory
        row[:] = np.packbits((np.bincount((s & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1).astype(np.uint8))
    return out.view(np.int64)


def _features(size: int, k: int):
    def run(batches):
        memo = _Memo()
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                sets = [shingle_set(t, size, memo) for t in part.column(1).cast(pa.binary()).to_pylist()]
                some = [i for i, s in enumerate(sets) if len(s)]
                sig = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                regs: list = [None] * len(sets)
                odd: list = [None] * len(sets)
                if some:
                    full = [sets[i] for i in some]
                    for i, r, b in zip(some, registers(full, k), parities(full), strict=True):
                        regs[i], odd[i] = r.tobytes(), b.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig, pa.binary()), pa.array(regs, pa.binary()), pa.array(odd, pa.binary())],
                    ["doc_id", "n_shingles", "sig", "regs", "odd"],
                )

    return run


def _bands(bands: int, rows: int):
    def run(batches):
        for batch in batches:
            if len(batch):
                keys = band_keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(len(batch), -1), bands, rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(keys), pa.list_(pa.int64()))], ["id", "keys"])

    return run


def _sets(size: int):
    def run(batches):
        memo = _Memo()
        for batch in batches:
            sets = [shingle_set(t, size, memo).tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["doc_id", "sig", "set"])

    return run


def _likely(percent: int):
    least = percent / 100 - 0.15

    def run(batches):
        for batch in batches:
            if len(batch):
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(len(batch), -1) for i in (2, 3))
                n_a, n_b = (batch.column(i).to_numpy() for i in (4, 5))
                odd_a, odd_b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(len(batch), -1) for i in (6, 7))
                can = np.bitwise_count(odd_a ^ odd_b).sum(1, dtype=np.int64) * (100 + percent) <= (n_a + n_b) * (100 - percent)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(can & (estimate(a, b, n_a, n_b) >= least)))

    return run


def _confirmed(percent: int):
    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                if len(small) * 100 < percent * len(large):
                    ok.append(False)
                    continue
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 48, rows: int = 6) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_shingles, component_id, kept), a row for each input row with a doc_id.

    Documents link at 100 * |A n B| >= percent * |A u B| over sets of `shingle`-word shingles. component_id: the smallest doc_id
    reachable by links; kept: it is the document's own. Null, empty and blank texts have an empty set and link with nothing.
    Rows with a null doc_id come back with null component_id and kept false. Rows that repeat a doc_id share its component only
    by their texts; each comes back. Extra columns are ignored; an empty table gives an empty one.
    """
    docs = narrow(docs, doc_id="long", text="string")
    feats = docs.mapInArrow(_features(shingle, bands * rows), "doc_id long, n_shingles long, sig binary, regs binary, odd binary")
    feats = materialize(feats.withColumn("row", F.monotonically_increasing_id()), "features")
    first = F.min(F.struct("doc_id", "row")).alias("m")
    classes = feats.where("sig is not null and doc_id is not null").groupBy("sig").agg(first)
    classes = materialize(classes.select("sig", F.col("m.row").alias("id"), F.col("m.doc_id").alias("rep")), "classes")
    regs = materialize(feats.select(F.col("row").alias("id"), "n_shingles", "regs", "odd").join(classes.select("id"), "id"), "registers")
    buckets = regs.select("id", "regs").mapInArrow(_bands(bands, rows), "id long, keys array<long>").select("id", F.posexplode("keys").alias("band", "key"))
    shared = buckets.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("id").alias("h0"), F.max("id").alias("h1")).where("n > 1").drop("n")
    buckets = materialize(buckets.join(shared, ["band", "key"]), "buckets")
    hubs = buckets.select(F.explode(F.array_distinct(F.array("h0", "h1"))).alias("a"), F.col("id").alias("b")).where("a <> b")
    hits = hubs.groupBy("a", "b").agg(F.count("*").alias("hits"))
    best = Window.partitionBy("b").orderBy(F.desc("hits"), "a")  # at most two rows for each band
    pairs = materialize(hits.select("a", "b", F.row_number().over(best).alias("rank")), "pairs")
    sets = _candidate_sets(docs, classes.join(buckets.select("id").distinct(), "id"), shingle)
    comp = links = None
    for low, high in RANKS:
        some = pairs.where(F.col("rank").between(low, high)).select("a", "b")
        picked = materialize(some if comp is None else _between(some, comp), "picked")
        if picked.isEmpty():
            continue
        new = _verify(picked, regs, sets, percent)
        links = new if links is None else links.union(new)
        comp = materialize(components(links), "components")
    ids = classes.select("sig", "id", "rep")
    if comp is None:
        to = ids.select("sig", F.col("rep").alias("component_id"))
    else:
        rest = materialize(_rest(buckets, comp, sets, percent), "rest")
        if not rest.isEmpty():
            comp = materialize(components(links.union(_verify(rest, regs, sets, percent))), "components")
        member = ids.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
        to = member.join(member.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("sig", "component_id")
    out = feats.select("doc_id", "n_shingles", "sig").join(to, "sig", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _between(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    a, b = comp.toDF("a", "ca"), comp.toDF("b", "cb")
    return pairs.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(*pairs.columns)


def _candidate_sets(docs: DataFrame, needed: DataFrame, shingle: int) -> DataFrame:
    """(id, set) of the classes that share a bucket with another, from a whole text of each."""
    needed = materialize(needed, "needed")
    keys = needed.select(F.col("rep").alias("doc_id")).distinct()
    if needed.count() <= BROADCAST_IDS:
        keys = F.broadcast(keys)
    own = docs.join(keys, "doc_id", "left_semi").mapInArrow(_sets(shingle), "doc_id long, sig binary, set binary")
    own = own.join(needed.select(F.col("rep").alias("doc_id"), "sig", "id"), ["doc_id", "sig"]).select("id", "set")
    return materialize(own.groupBy("id").agg(F.first("set").alias("set")), "sets")


def _verify(pairs: DataFrame, inside: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    k = inside.select("id", "regs", "n_shingles", "odd")
    both = pairs.join(k.toDF("a", "ra", "na", "oa"), "a").join(k.toDF("b", "rb", "nb", "ob"), "b").select("a", "b", "ra", "rb", "na", "nb", "oa", "ob")
    likely = materialize(both.mapInArrow(_likely(percent), "a long, b long"), "likely")
    both = likely.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    out = materialize(both.mapInArrow(_confirmed(percent), "a long, b long"), "confirmed")
    release(likely)
    return out


def _tokens(batches):
    for batch in batches:
        if len(batch):
            sets = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
            odd = parities([x.view(np.uint64) for x in sets])
            columns = [pa.array([len(x) for x in sets], pa.int64()), *(pa.array(odd[:, i]) for i in range(odd.shape[1])), pa.array(sets, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "c", "n", *_WORDS, "tokens"])


def _rest(buckets: DataFrame, comp: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs in different components that can still link, among all that share a bucket with another component.

    A large group of rather similar texts would have a pair for any two here. So pairs are made by prefixes: shingles are ordered
    by how many of these sets have them, the rarest first. The first one that two linking sets have in common leaves room for
    all others after it, so it stands in the larger set among the first n - ceil(n * percent / 100) + 1, and in the smaller
    one, whose size is at most the mean, among the first n - ceil(2 * n * percent / (100 + percent)) + 1. So common shingles that
    only come after a set's own ones meet nothing. The sizes of the sets must allow the similarity too, and so must what is left
    of both sets from the first such shingle on, and their parities.
    """
    rows = buckets.select("band", "key", "id").join(comp, "id", "left").select("band", "key", "id", F.coalesce("component", "id").alias("c"))
    mixed = rows.groupBy("band", "key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("band", "key")
    ids = rows.join(mixed, ["band", "key"]).select("id", "c").distinct()
    lists = materialize(sets.join(ids, "id").select("id", "c", "set").mapInArrow(_tokens, "id long, c long, n long, " + ", ".join(f"{w} long" for w in _WORDS) + ", tokens array<long>"), "tokens")
    tokens = lists.select("id", F.explode("tokens").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("df"))
    ranked = tokens.join(often, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ranked"))
    least = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    prefix = lists.drop("tokens").join(ranked, "id").select("id", "c", "n", *_WORDS, F.posexplode(F.slice("ranked", F.lit(1), least.cast("int"))).alias("at", "t"))
    prefix = materialize(prefix.where("t.df > 1").select("id", "c", F.col("n") - F.col("at"), "n", F.col("t.token").alias("token"), *_WORDS), "prefix")
    x, y = (prefix.toDF(v, f"c{v}", f"r{v}", f"n{v}", "token", *(f"{v}{w}" for w in _WORDS)) for v in "xy")
    x = x.where(F.col("rx") >= F.ceil(F.col("nx") * 2 * percent / (100 + percent)))  # the smaller set of a pair
    near = (F.struct("nx", "x") < F.struct("ny", "y")) & (F.col("nx") * 100 >= F.col("ny") * percent) & (F.col("cx") != F.col("cy"))
    near &= F.least("rx", "ry") * (100 + percent) >= (F.col("nx") + F.col("ny")) * percent
    apart = sum((F.bit_count(F.col(f"x{w}").bitwiseXOR(F.col(f"y{w}"))) for w in _WORDS), F.lit(0))
    near &= apart * (100 + percent) <= (F.col("nx") + F.col("ny")) * (100 - percent)
    return x.join(y, "token").where(near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
