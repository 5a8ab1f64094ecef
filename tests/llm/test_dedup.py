"""op1 and its operator against brute force."""

import random

import numpy as np
import pytest
from brute import components, near_links, shingles
from pyspark.sql import functions as F

from tessera.llm import graph, minhash
from tessera.llm.minhash import chance, estimate, near_duplicates, registers

SCHEMA = "doc_id long, text string"


def planted(n=60, seed=1):
    """Groups of near copies, chains of them, exact copies, short texts and strangers."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(n):
        words = [word() for _ in range(rng.choice([1, 2, 4, 30, 120]))]
        texts.append(" ".join(words))
        for _ in range(rng.randrange(5)):
            words = list(words)
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = word()
            texts.append(" ".join(words).upper() if rng.random() < 0.2 else " ".join(words))
    texts += ["", "  \n", None, "a", "a", "a b", "A  b"]
    rng.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


def expected(rows, size, percent):
    sets = {i: shingles(t, size) for i, t in rows}
    comp = components(list(sets), near_links(sets, percent))
    return {i: (len(s), comp[i], comp[i] == i) for i, s in sets.items()}


@pytest.mark.parametrize(("size", "percent", "bands", "rows"), [(3, 85, 40, 8), (5, 80, 48, 6)])
def test_planted(spark, size, percent, bands, rows):
    data = planted()
    got = near_duplicates(spark.createDataFrame(data, SCHEMA), size, percent, bands, rows).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == expected(data, size, percent)


def test_table(spark):
    from tessera.llm.q_dedup import op1_minhash_near_dedup

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = op1_minhash_near_dedup(spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == expected([tuple(r) for r in docs], 3, 85)


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(empty).count() == 0
    rows = spark.createDataFrame([(1, "a b c d e f", 9), (1, "a b c d e f", 9), (None, "a b c d e f", 9), (2, None, 9)], "doc_id long, text string, Text int")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(rows).collect()), key=str)
    assert got == [(1, 1, True), (1, 1, True), (2, 2, True), (None, None, False)]


def test_estimates():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    for same in (400, 360, 200):
        a = np.sort(base)
        b = np.sort(np.concatenate([base[:same], rng.integers(0, 2**63, 400 - same).astype(np.uint64)]))
        true = same / (800 - same)
        size = np.array([400])
        got = estimate(registers([a], 320), registers([b], 320), size, size)[0]
        assert abs(got - true) < 0.12


def test_chance():
    """Registers of sets without a common hash agree as often as `chance` says, at equal and at unequal sizes."""
    rng = np.random.default_rng(1)
    for n_a, n_b in ((3000, 3000), (20000, 1500)):
        a, b = (registers([np.sort(rng.integers(0, 2**64, n, dtype=np.uint64)) for _ in range(60)], 320) for n in (n_a, n_b))
        got, want = (a == b).mean(), chance(np.array([n_a]), np.array([n_b]), 320)[0]
        assert abs(got - want) < 5 * (want / a.size) ** 0.5


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 430)] + [(500, 501 + i) for i in range(40)]
    want = components({x for link in links for x in link if link[0] != link[1]}, [x for x in links if x[0] != x[1]])
    df = spark.createDataFrame(links, "a long, b long")
    for limit in (10**6, 0):
        assert {r.id: r.component for r in graph.components(df, local_links=limit).collect()} == want
    assert graph.components(df.where(F.lit(False))).count() == 0


def test_rest_is_exact(spark):
    """Sets at and around the threshold, of equal and unequal sizes: every link between different components is a candidate."""
    from tessera.llm import minhash

    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**62, 60)
    sets = {}
    for i in range(120):
        own = set(base[rng.permutation(60)[: rng.integers(45, 61)]].tolist()) | set(rng.integers(0, 2**62, rng.integers(0, 9)).tolist())
        sets[i] = own
    for percent in (80, 85):
        rows = [(i, bytearray(np.array(sorted(s), np.int64).tobytes())) for i, s in sets.items()]
        table = spark.createDataFrame(rows, "id long, set binary")
        buckets = spark.createDataFrame([(0, 7, i) for i in sets], "band int, key long, id long")
        comp = spark.createDataFrame([(i, i) for i in sets], "id long, component long")
        got = {(r.a, r.b) for r in minhash._rest(buckets, comp, table, percent).collect()}
        want = {(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])}
        assert want and want <= got and len(got) < 120 * 119 / 2


def test_a_large_group_below_the_threshold_makes_few_pairs(spark, monkeypatch):
    """Texts that are alike, but too little to link, leave no pair for any two of them; the links among them are found."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(120):
        words = list(base)
        for at in rng.sample(range(200), 3):
            words[at] = f"x{i}y{at}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, rows[i][1] + " end") for i in range(0, 120, 10)]
    left, rest = [], minhash._rest

    def counted(*args):
        out = rest(*args)
        left.append(out.count())
        return out

    monkeypatch.setattr(minhash, "_rest", counted)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: shingles(t, 5) for i, t in rows}
    links = near_links(sets, 80)
    assert got == components(list(sets), links)
    assert left[0] <= len(rows) + len(links)
