"""Navigation of the nodes table, set by set: pre-order ids and subtree ranges make ancestors a range of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_KEY = ["doc_id"]


def roots(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent_id is null")


def parents(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, parent_id, parent_kind) of every node but roots.

    Sizes of parsed nodes are guessed from those of their texts, far too low, so the join is told not to broadcast any.
    """
    p = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("kind").alias("parent_kind"))
    return nodes.where("parent_id is not null").select("doc_id", "node_id", "parent_id").join(p.hint("merge"), ["doc_id", "parent_id"]).select("doc_id", "node_id", "parent_id", "parent_kind")


def child(nodes: DataFrame, index: int) -> DataFrame:
    """The child at a place of every node that has so many."""
    return nodes.where(F.col("child_index") == index).where("parent_id is not null")


def child_counts(nodes: DataFrame) -> DataFrame:
    """(doc_id, parent_id, child_count, named_child_count)."""
    return nodes.where("parent_id is not null").groupBy("doc_id", "parent_id").agg(F.count("*").alias("child_count"), F.count_if("is_named").alias("named_child_count"))


def named_child(nodes: DataFrame, index: int) -> DataFrame:
    w = Window.partitionBy("doc_id", "parent_id").orderBy("child_index")
    return nodes.where("is_named and parent_id is not null").withColumn("named_index", F.row_number().over(w) - 1).where(F.col("named_index") == index)


def child_by_field(nodes: DataFrame, field: str) -> DataFrame:
    """The first child of each node under a field."""
    w = Window.partitionBy("doc_id", "parent_id").orderBy("child_index")
    return nodes.where(F.col("field") == field).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def next_siblings(nodes: DataFrame, named: bool = False) -> DataFrame:
    """nodes with next_id and next_kind among its (named) siblings."""
    w = Window.partitionBy("doc_id", "parent_id").orderBy("child_index")
    rows = nodes.where("is_named") if named else nodes
    return rows.withColumn("next_id", F.lead("node_id").over(w)).withColumn("next_kind", F.lead("kind").over(w))


def has_error(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id) of nodes with an error or missing node in their subtree."""
    return nodes.where("has_error").select("doc_id", "node_id")


def ancestors(of: DataFrame) -> DataFrame:
    """(doc_id, node_id, ancestor_id) of nodes parsed with their ancestors: a row's own list, so nothing is joined."""
    return of.select("doc_id", "node_id", F.explode("ancestors").alias("ancestor_id"))


def cursor(nodes: DataFrame) -> DataFrame:
    """nodes with the steps of a cursor: parent_id, first_child_id, next_sibling_id and, in pre-order, next_id; null for none."""
    sibling = Window.partitionBy("doc_id", "parent_id").orderBy("child_index")
    steps = nodes.withColumn("next_sibling_id", F.lead("node_id").over(sibling))
    steps = steps.withColumn("first_child_id", F.when(F.col("subtree_last") > F.col("node_id"), F.col("node_id") + 1))
    last = Window.partitionBy("doc_id")
    return steps.withColumn("next_id", F.when(F.col("node_id") < F.max("node_id").over(last), F.col("node_id") + 1))


def node_metrics(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_count, error_count, max_depth)."""
    return nodes.groupBy("doc_id").agg(F.count("*").alias("node_count"), F.count_if(F.col("is_error") | F.col("is_missing")).alias("error_count"), F.max("depth").cast("long").alias("max_depth"))


def text_of(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """nodes with their source text, cut by bytes."""
    source = docs.select("doc_id", F.col("content").cast("binary").alias("_bytes"))
    cut = F.expr("decode(substring(_bytes, cast(start_byte as int) + 1, cast(end_byte - start_byte as int)), 'utf-8')")
    return nodes.join(source, "doc_id").withColumn("text", cut).drop("_bytes")
