"""Connected components of a link table, without any vertex or link on the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, release

#: One task solves a graph of at most this many links (16 bytes each); a larger one is solved by rounds of stars.
LOCAL_LINKS = 1_000_000


def _solve(batches):
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (p := parent.get(root, root)) != root:
            root = p
        while (p := parent.get(x, x)) != root:
            parent[x] = root
            x = p
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    ids = sorted(parent)
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([find(x) for x in ids], pa.int64())], ["id", "component"])


def components(links: DataFrame, local_links: int = LOCAL_LINKS) -> DataFrame:
    """links(a, b) -> (id, component): the smallest id reachable, for each id in a link.

    Null ends and loops are ignored. Large graphs take alternating large and small stars: each round joins links to the
    smallest neighbour of an end, so a hub's rows are split like those of any skewed join and no list of neighbours is built.
    """
    links = materialize(links.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).where("a < b").distinct(), "links")
    if links.count() <= local_links:
        return links.repartition(1).mapInArrow(_solve, "id long, component long")
    ids = materialize(links.select(F.col("a").alias("id")).union(links.select("b")).distinct(), "ids")
    while True:
        both = links.union(links.select("b", "a").toDF("a", "b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = materialize(both.where("b > a").join(low, "a").select(F.col("low").alias("a"), "b").where("a < b").distinct(), "large")
        low = large.groupBy("b").agg(F.min("a").alias("low"))
        joined = large.join(low, "b").select("b", "a", "low")
        small = joined.select(F.col("low").alias("a"), F.col("b")).union(joined.select(F.col("low").alias("a"), F.col("a").alias("b"))).where("a < b").distinct()
        small = materialize(small, "small")
        same = small.count() == links.count() and links.exceptAll(small).isEmpty()
        release(large)
        release(links)
        links = small
        if same:
            return ids.join(links.select(F.col("b").alias("id"), F.col("a").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
