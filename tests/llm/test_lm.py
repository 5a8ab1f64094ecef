"""op4: base scores against a plain version; the trie, its chunks and its mixer; copies, edges and partitions."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.llm import lm, lm_text, lm_trie

DIR = "/root/testdata/sf0.01"


def plain_words(text):
    return re.split(rb"[\t\n\x0b\x0c\r ]", (text or "").encode().lower())


def test_base_scores(spark):
    from tessera.llm.q_lm import op4_lm_scoring

    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{DIR}/documents.parquet").to_pylist()}
    words = {r["doc_id"]: [*(r["text"] or "").encode().lower().split(), b" "] for r in pq.read_table(f"{DIR}/documents.parquet").to_pylist()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    c = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    got = op4_lm_scoring(spark, DIR).collect()
    assert len(got) == len(words)
    for r in got:
        ws = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert -1e9 < r.score < 0
        assert math.isclose(r.bits_per_byte, -r.score * math.log2(10) / len(texts[r.doc_id].encode())) if texts[r.doc_id] else r.bits_per_byte is None
    for side in (False, True):  # better than the base on both, although the base doesn't even spell unknown words
        own = [r for r in got if r.held_out == side]
        assert sum(r.score for r in own) > sum(r.base_score for r in own)


def some_texts(rng, n=50):
    letters = list("abcdeé")
    word = lambda: "".join(rng.choice(letters, rng.integers(0, 6)))
    return [" ".join(word() for _ in range(200)) + "\n" + "x" * int(rng.integers(30, 130)) + "\tEnd." for _ in range(n)] + [None, "", " \n", "A b\x0bA", "y" * lm_text.PIECE]


def test_words():
    texts = some_texts(np.random.default_rng(0))
    for cut in (texts, texts[::-1]):
        want = [w for t in cut for w in plain_words(t)]
        for low, high, data, offsets in lm_text.slices(pa.array(cut)):
            assert (low, high) == (0, len(cut))
            w = lm_text.words(data, offsets)
            g = lm_text.groups(w)
            assert [w.text(i) for i in range(len(w.start))] == want
            assert len(g.sample) == len(set(want)) and [want[i] for i in g.sample[g.of]] == want
            assert (lm_text.hash_rows(*w.take(g.sample, b"")) == w.hash[g.sample]).all()
            own = [(d, t) for d, t in zip(w.doc.tolist(), want, strict=True)]
            assert [own[:i].count(x) for i, x in enumerate(own[:300])] == g.before[:300].tolist()
            assert Counter(own) == {own[i]: n for i, n in zip(g.once, g.times, strict=True)}
            assert set(w.kind[w.first[1:] - 1]) == {lm_text.KINDS - 1}


def test_pieces():
    size = lm_text.PIECE
    for n in (size, size + 1, 2 * size, 3 * size - 1):
        cut = lm_text.pieces(b"z" * n)
        assert b"".join(c.removeprefix(lm_text.INSIDE) for c in cut) == b"z" * n + b" " and max(map(len, cut)) <= size + 1


def trained(units, n, bounds):
    """Costs of sorted units that are cut into chunks at `bounds`, and what the weights were learned from."""
    chunks = [lm_trie.Chunk(np.frombuffer(b"".join(units[a:b]), np.uint8), np.array([len(u) for u in units[a:b]], np.uint8), n[a:b]) for a, b in bounds]
    low, high = zip(*(c.ends() for c in chunks), strict=True)
    around = lm_trie.outside([units[a] for a, _ in bounds], [units[b - 1] for _, b in bounds], list(low), list(high))
    n1, n0 = (np.zeros((len(lm_trie.ORDERS), 1 << 14), np.float32) for _ in range(2))
    for c in chunks:
        lm_trie.spell(c, n1, n0)
    weights, sums = lm_trie.first_weights(), []
    for c, (left, right) in zip(chunks, around, strict=True):
        c.left, c.right = left, right
    for share in range(3):
        model = lm_trie.Model(n1, n0, weights)
        sums.append(sum(model.learn(c, share, 3) for c in chunks))
        weights = lm_trie.step(weights, sums[-1])
    model = lm_trie.Model(n1, n0, weights)
    return np.concatenate([model.costs(c) for c in chunks]), np.stack(sums)


def test_trie():
    """Costs are those of one distribution for each class, near the shares, and the same however the units are cut into chunks."""
    rng = np.random.default_rng(0)
    units = sorted({bytes(rng.choice(list(b"abc"), rng.integers(0, 5))) + b" " for _ in range(300)} | {b"a" * 40, b"ab" * 20, b"\xffab ", b"\xffa ", b"\xff" + b"c" * 40})
    n = rng.integers(0, 5, (len(units), 6)).astype(np.int64) ** 3
    cut = next(i for i, u in enumerate(units) if u[:1] == lm_text.INSIDE)
    cost, sums = trained(units, n, [(0, cut), (cut, len(units))])
    for bounds in ([(0, 7), (7, 8), (8, 9), (9, 40), (40, cut), (cut, cut + 1), (cut + 1, len(units))], [(i, i + 1) for i in range(len(units))]):
        other, other_sums = trained(units, n, bounds)
        assert np.allclose(other, cost, atol=1e-6) and np.allclose(other_sums, sums, rtol=1e-9, atol=1e-9)
    p = np.exp(cost[:cut]).sum(0)
    assert (p <= 1 + 1e-5).all() and (p > 0.9).all() and (np.exp(cost[cut:]).sum(0) <= 1 + 1e-5).all()
    for k in range(6):
        own = n[:cut, k] > 8
        assert np.abs(cost[:cut][own, k] - np.log(n[:cut][own, k] / n[:cut, k].sum())).mean() < 0.2


def score(spark, rows, training, **settings):
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        return {r.doc_id: r for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), training).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_copies(spark):
    """A text that another training document has is told apart; held-out copies too, and no document is a copy of itself."""
    texts = [t for t in some_texts(np.random.default_rng(3), 40) if t and len(t) > 100]
    rows = list(enumerate([*texts, texts[0], texts[1], texts[2]]))
    got = score(spark, rows, F.col("doc_id") != len(texts) + 2)
    for i, r in got.items():
        assert (r.bits_per_byte < 0.2) == (i in (0, 1, len(texts), len(texts) + 1, len(texts) + 2)), i


def test_partitions(spark):
    """However texts and tables are dealt, a document has one score, up to the order of sums."""
    rows = list(enumerate(some_texts(np.random.default_rng(4), 60)))
    a = score(spark, rows, F.col("doc_id") % 5 > 0)
    fewer = {"spark.sql.shuffle.partitions": "3", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    shuffled = [rows[i] for i in np.random.default_rng(5).permutation(len(rows))]
    b = score(spark, shuffled, F.col("doc_id") % 5 > 0, **fewer)
    for i, r in a.items():
        assert math.isclose(r.score, b[i].score, rel_tol=1e-6) and math.isclose(r.base_score, b[i].base_score, rel_tol=1e-9)


@pytest.mark.parametrize("least", [1e-2, 10.0])
def test_joined_units(spark, monkeypatch, least):
    """Units that meet their documents in a join count as frequent ones do."""
    rows = list(enumerate(some_texts(np.random.default_rng(6), 30)))
    want = Counter(w for i, t in rows if i % 3 for w in [*filter(None, plain_words(t)), b" "])
    n, v = sum(want.values()), len(want)
    monkeypatch.setattr(lm, "FREQUENT", least)
    for i, r in score(spark, rows, F.col("doc_id") % 3 != 0).items():
        own = [*filter(None, plain_words(rows[i][1])), b" "]
        assert (r.n_tokens, r.n_known) == (len(own), sum(want[w] > 0 for w in own))
        assert math.isclose(r.base_score, sum(math.log10((want[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        assert -3.1 * len(own) - 60 - 2.6 * len(rows[i][1] or "") < r.score < 0


def test_edges(spark):
    rows = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "a a", 1), (3, "a b", 1), (3, "a b", 1)], "doc_id long, text string, Text int")
    got = {(r.doc_id, r.n_tokens): r for r in lm.score_documents(rows, F.col("doc_id") == 3).collect()}
    assert got[(1, 1)].score == got[(2, 1)].score and got[(3, 3)].n_known == 3 and got[(None, 3)].n_known == 3
    none = lm.score_documents(rows, F.lit(None).cast("boolean")).collect()
    assert len(none) == 5 and not any(r.n_known for r in none) and all(r.score < 0 for r in none)
    assert lm.score_documents(rows.limit(0), F.lit(True)).count() == 0


def test_very_long_text(spark):
    long = "lorem ipsum dolor " * 200_000
    got = score(spark, [(1, long), (2, "lorem ipsum"), (3, "w" * 500_000)], F.lit(True))
    assert got[1].n_tokens == 600_001 and got[1].bits_per_byte < 0.5 and got[3].n_tokens == 2
