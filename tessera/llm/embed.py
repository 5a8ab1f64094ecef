"""Near-duplicate embeddings by an inverted multi-index.

Each half of a unit vector has a codebook of its own; the two nearest words name a cell of the product grid, and every vector is
indexed in one cell. A query visits cells in the order of its multi-sequence traversal (distance to the word of the first half
plus that of the second) until the target recall: as many cells as found, in calibration, the cells of the sample's true
neighbours and of vectors moved away to exactly the wanted cosine. What lies in the visited cells is verified in double precision,
and a link that one end alone finds counts for both. Codebooks and calibration use a bounded sample; all vectors are indexed, and
all are queries. Codebooks grow with the root of the number of vectors, so that a cell keeps about CELL of them.

Equal vectors of a label form a class first, so a hot vector is one row. Cells are dealt into shards of about SHARD members, a
hot cell into several; queries go once to each shard that holds a cell they visit, in blocks, and links leave a shard as counts
and a spanning forest, never as all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, narrow
from tessera.llm.graph import components
from tessera.llm.sharing import join_by_key

#: Vectors that codebooks and calibration are fitted on, at most.
SAMPLE = 20_000
#: Sample vectors that calibration takes as queries; vectors in a cell, if all cells had as many; sample vectors a codeword, at least.
QUERIES, CELL, FITTED = 4_000, 64, 4
#: Index members and queries that meet in one task, about.
SHARD, PROBES = 4_096, 32_768
_BLOCK = 1_024


def _squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ book.T + (book**2).sum(1)


def _codebook(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    book = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(12):
        near = _squares(x, book).argmin(1)
        for j in range(k):
            if (own := near == j).any():
                book[j] = x[own].mean(0)
    return book


class MultiIndex:
    """Codebooks of the two halves and the number of cells to visit."""

    def __init__(self, sample: np.ndarray, words: int, cosine: float, recall: float) -> None:
        rng = np.random.default_rng(7)
        self.half = sample.shape[1] // 2
        self.books = [_codebook(sample[:, : self.half], words, rng), _codebook(sample[:, self.half :], words, rng)]
        self.words = words
        at = rng.choice(len(sample), min(len(sample), QUERIES), replace=False)
        need = [self._rank(*pair) for pair in self._neighbours(sample, at, cosine, rng)]
        self.visits = min(words * words, max((int(np.quantile(r, recall, method="higher")) for r in need if len(r)), default=words * words) + 2)

    @staticmethod
    def _neighbours(sample: np.ndarray, at: np.ndarray, cosine: float, rng: np.random.Generator):
        """Pairs of queries and neighbours: made ones, the nearest that need be found, in even directions and in those in which
        sample vectors differ, and all true ones of the sample, a few for each query."""
        x = sample[at]
        other = sample[rng.permutation(len(sample))[: len(x)]] - sample[rng.permutation(len(sample))[: len(x)]]
        for z in (rng.normal(size=x.shape), other):
            z = z - (z * x).sum(1, keepdims=True) * x
            size = np.linalg.norm(z, axis=1, keepdims=True)
            some = size[:, 0] > 1e-9
            z = z[some] / size[some]
            yield x[some], cosine * x[some] + math.sqrt(max(0.0, 1 - cosine**2)) * z
        true: list[tuple[int, int]] = []
        for low in range(0, len(at), 500):
            near = sample[at[low : low + 500]] @ sample.T
            for i, row in enumerate(near):
                own = np.flatnonzero((row >= cosine) & (row < 1 - 1e-9))
                true += [(low + i, j) for j in own[np.argsort(row[own])][:20]]
        if true:
            i, j = np.array(true).T
            yield x[i], sample[j]

    def _rank(self, queries: np.ndarray, neighbours: np.ndarray) -> np.ndarray:
        """How many cells each query visits before that of its neighbour: those that cost less."""
        out = []
        for low in range(0, len(queries), 500):
            x, y = (v[low : low + 500] for v in (queries, neighbours))
            first, second = _squares(x[:, : self.half], self.books[0]), _squares(x[:, self.half :], self.books[1])
            one, two = np.divmod(self.home(y), self.words)
            at = np.arange(len(x))
            cost = first[at, one] + second[at, two]
            second.sort(1)
            out += [int(np.searchsorted(second[i], cost[i] - first[i]).sum()) for i in at]
        return np.array(out, int)

    def home(self, x: np.ndarray) -> np.ndarray:
        return _squares(x[:, : self.half], self.books[0]).argmin(1) * self.words + _squares(x[:, self.half :], self.books[1]).argmin(1)

    def order(self, x: np.ndarray) -> np.ndarray:
        """The first `visits` cells of each row's multi-sequence traversal.

        The cell of the a-th nearest first word and the b-th nearest second one comes after (a + 1) * (b + 1) - 1 others at
        least, so only pairs of ranks under that bound take part.
        """
        d, rank = zip(*((np.sort(s, 1), np.argsort(s, 1, kind="stable")) for s in (_squares(x[:, : self.half], self.books[0]), _squares(x[:, self.half :], self.books[1]))), strict=True)
        a, b = np.array([(a, b) for a in range(self.words) for b in range(min(self.words, self.visits // (a + 1)))]).T
        cost = d[0][:, a] + d[1][:, b]
        first = np.argsort(cost, axis=1, kind="stable")[:, : self.visits]
        return np.take_along_axis(rank[0][:, a] * self.words + rank[1][:, b], first, 1)


def _unit(column: pa.Array) -> np.ndarray:
    x = np.array(column.to_pylist(), np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _forest(ids_a: np.ndarray, ids_b: np.ndarray, hit: np.ndarray) -> list[tuple[int, int]]:
    """Links with the same components as those of the boolean matrix, at most one a row and one a column."""
    rows, cols = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
    hit, ids_a, ids_b = hit[np.ix_(rows, cols)], ids_a[rows], ids_b[cols]
    at = np.nonzero(hit)
    if len(at[0]) <= len(rows) + len(cols):
        return [(int(a), int(b)) for a, b in zip(ids_a[at[0]], ids_b[at[1]], strict=True)]
    low_a, low_b = ids_a.copy(), ids_b.copy()
    top = np.iinfo(np.int64).max
    while True:
        new_a = np.minimum(low_a, np.where(hit, low_b[None], top).min(1))
        new_b = np.minimum(low_b, np.where(hit, new_a[:, None], top).min(0))
        if (new_a == low_a).all() and (new_b == low_b).all():
            return [(int(x), int(y)) for x, y in zip(np.concatenate([ids_a, ids_b]), np.concatenate([low_a, low_b]), strict=True)]
        low_a, low_b = new_a, new_b


def _meet(cosine: float):
    def run(members: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
        links: list[tuple[int, int]] = []
        count, back = np.zeros(len(probes), np.int64), np.zeros(len(members), np.int64)
        if len(members) and len(probes):
            unit = lambda c: (x := np.stack(c.to_numpy()).astype(np.float64)) / np.linalg.norm(x, axis=1, keepdims=True)
            m, q = unit(members["vec"]), unit(probes["q_vec"])
            m_id, q_id, size, q_size = members["id"].to_numpy(), probes["q_id"].to_numpy(), members["size"].to_numpy(), probes["q_size"].to_numpy()
            visited, home = np.stack(members["cells"].to_numpy()), probes["q_home"].to_numpy()
            where = np.concatenate(probes["q_cells"].to_numpy())
            who = np.repeat(np.arange(len(probes)), [len(c) for c in probes["q_cells"]])
            by = np.argsort(where, kind="stable")
            where, who = where[by], who[by]
            cell = members["cell"].to_numpy()
            for c in np.unique(cell):
                own = np.flatnonzero(cell == c)
                visit = who[np.searchsorted(where, c, "left") : np.searchsorted(where, c, "right")]
                for i in range(0, len(visit), _BLOCK):
                    for j in range(0, len(own), _BLOCK):
                        v, o = visit[i : i + _BLOCK], own[j : j + _BLOCK]
                        hit = (q[v] @ m[o].T) >= cosine
                        hit &= q_id[v][:, None] != m_id[o][None]
                        if hit.any():
                            count[v] += hit @ size[o]  # a probe comes once for a cell
                            links += _forest(q_id[v], m_id[o], hit)
                            # The members that don't visit the query's cell won't find this link themselves.
                            rows = np.flatnonzero(hit.any(1))
                            homes, at = np.unique(home[v[rows]], return_inverse=True)
                            blind = np.stack([(visited[o] != h).all(1) for h in homes])
                            back[o] += q_size[v[rows]] @ (hit[rows] & blind[at])
        ids = [*probes["q_id"].to_numpy()[(some := np.flatnonzero(count))], *members["id"].to_numpy()[(more := np.flatnonzero(back))]]
        a, b = zip(*{(min(x), max(x)) for x in links if x[0] != x[1]}, strict=True) if any(x[0] != x[1] for x in links) else ((), ())
        return pd.DataFrame({"a": [*ids, *a], "b": pd.array([None] * len(ids) + list(b), "Int64"), "n": [*count[some], *back[more], *[0] * len(a)]}).astype({"a": "int64", "n": "int64"})

    return run


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.93, recall: float = 0.999, shard: int = SHARD) -> DataFrame:
    """vectors(vec_id, embedding, label) -> (vec_id, n_links, component_id, kept), a row for each input row.

    Vectors link when their labels are equal and not null and their cosine, in double precision, is at least `cosine`; vectors
    of unequal length don't. Null, empty and zero vectors and those with null or non-finite components link with nothing.
    component_id: the smallest vec_id reachable, itself included. Null vec_ids give null, kept false. Rows that repeat a vec_id
    are vectors of their own. Extra columns are ignored; an empty table gives an empty one.
    """
    rows = narrow(vectors, vec_id="long", embedding="array<double>", label="string")
    good = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    good &= ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    good = F.coalesce(good, F.lit(False)) & F.col("vec_id").isNotNull()
    # Equal vectors of a label share a key of 128 bits, so that vectors themselves are grouped and joined by it alone.
    plain = F.transform("embedding", lambda x: x + 0.0)
    key = F.concat(F.hex(F.xxhash64("label", plain)), F.lit("."), F.hex(F.xxhash64(F.lit(1), plain, "label"))).cast("binary")
    # Scaled by the largest component first: squares of very large or small ones would not fit a double.
    top = F.array_max(F.transform("embedding", F.abs))
    classes = rows.where(good).select("vec_id", "label", plain.alias("embedding"), key.alias("key"))
    classes = classes.groupBy("key").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("size"), F.min("vec_id").alias("rep"))
    classes = classes.withColumn("id", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding"))
    classes = materialize(classes.withColumn("vec", F.transform("embedding", lambda x: x / top)).drop("embedding"), "classes")
    per_class = None
    for (dim,) in sorted(classes.select("dim").distinct().collect()):
        found = _links_of(classes.where(F.col("dim") == dim), dim, cosine, recall, shard)
        per_class = found if per_class is None else per_class.unionByName(found)
    keys = classes.select("key", "id", "rep", "size")
    if per_class is not None:
        found = materialize(per_class, "links")
        n = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
        comp = components(found.where("b is not null").select("a", "b"))
        keys = keys.join(n, "id", "left").join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
        keys = keys.join(keys.groupBy("component").agg(F.min("rep").alias("component_id")), "component")
        keys = keys.select("key", F.col("size").alias("n"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id")
    else:
        keys = keys.select("key", F.col("size").alias("n"), F.lit(0).cast("long").alias("n_links"), F.col("rep").alias("component_id"))
    total = classes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    marked = rows.select("vec_id", F.when(good, key).alias("key")).withColumn("row", F.monotonically_increasing_id())
    lone = marked.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = join_by_key(marked.where("key is not null"), keys, "key", total).select("vec_id", "n_links", "component_id").union(lone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _links_of(own: DataFrame, dim: int, cosine: float, recall: float, shard: int) -> DataFrame:
    """(a, b, n): counts of links by class, where b is null, and links of spanning forests; for vectors of one length."""
    spark = own.sparkSession
    total, labels = own.agg(F.count("*"), F.count_distinct("label")).first()
    picked = own.orderBy(F.xxhash64("id", F.lit(3))).limit(SAMPLE).select("vec").collect()
    sample = np.array([r.vec for r in picked])
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    words = max(1, min(len(sample) // FITTED, round((total / CELL) ** 0.5)))
    index = MultiIndex(sample, words, cosine, recall)
    cells = max(1, math.ceil(shard * labels * words * words / total))
    book = spark.sparkContext.broadcast(index)

    def place(batches):
        mi = book.value
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                x = _unit(part.column(part.schema.get_field_index("vec")))
                cols = [part.column(part.schema.get_field_index(c)) for c in ("id", "label", "size", "vec")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(mi.home(x), pa.int64()), pa.array(mi.order(x).tolist(), pa.list_(pa.int64()))], ["id", "label", "size", "vec", "cell", "cells"])

    placed = own.select("id", "label", "size", "vec").mapInArrow(place, "id long, label string, size long, vec array<double>, cell long, cells array<long>")
    placed = materialize(placed, "placed")
    # Members: the shard of their cell, split in `parts` where it holds many. Queries: every shard and part with a visited cell.
    members = placed.select("id", "label", "size", "vec", "cell", "cells", F.floor(F.col("cell") / cells).cast("long").alias("shard"))
    load = members.groupBy("label", "shard").agg(F.count("*").alias("load"))
    asks = placed.select("id", "label", "size", "vec", "cell", F.explode(F.array_distinct(F.transform("cells", lambda c: F.floor(c / cells).cast("long")))).alias("shard"), "cells")
    asks = asks.withColumn("cells", F.filter("cells", lambda c: F.floor(c / cells).cast("long") == F.col("shard")))
    asked = asks.groupBy("label", "shard").agg(F.count("*").alias("asked"))
    plan = load.join(asked, ["label", "shard"]).select("label", "shard", F.ceil(F.col("load") / (2 * shard)).cast("int").alias("m"), F.ceil(F.col("asked") / PROBES).cast("int").alias("p"))
    plan = materialize(plan, "plan")
    left = members.join(plan, ["label", "shard"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("m"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("p") - 1)))
    right = asks.join(plan, ["label", "shard"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("p")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    key = ["label", "shard", "part", "block"]
    of = lambda c: F.col(c) if c == "label" else F.col(c).cast("long")
    left = left.select(*map(of, key), "id", "size", "vec", "cell", "cells")
    asked = {"q_id": "id", "q_size": "size", "q_vec": "vec", "q_home": "cell", "q_cells": "cells"}
    right = right.select(*[of(c).alias(f"q_{c}") for c in key], *[F.col(c).alias(name) for name, c in asked.items()])
    return left.groupBy(key).cogroup(right.groupBy([f"q_{c}" for c in key])).applyInPandas(_meet(cosine), "a long, b long, n long")
