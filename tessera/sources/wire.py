"""The JSON wire form of process() results, and key case."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructField, StructType

from tessera.schemas import FAMILIES

#: Fields whose value may be a name of its own, and where that is.
OTHERS = {"kind": "kind_other", "format": "format_other"}
METRICS = ("total_lines", "code_lines", "comment_lines", "blank_lines", "total_bytes", "node_count", "error_count", "max_depth")


def to_camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(p[:1].upper() + p[1:] for p in rest)


def to_snake(name: str) -> str:
    """Every capital but a leading one becomes an underscore and its small letter."""
    return name[:1] + re.sub(r"[A-Z]", lambda m: "_" + m[0].lower(), name[1:])


def rename_schema(kind: DataType, rename) -> DataType:
    """The type with every field name renamed, at any depth; cast a column to it."""
    if isinstance(kind, StructType):
        return StructType([StructField(rename(f.name), rename_schema(f.dataType, rename), f.nullable) for f in kind])
    if isinstance(kind, ArrayType):
        return ArrayType(rename_schema(kind.elementType, rename), kind.containsNull)
    return kind


def rename_keys(df: DataFrame, rename) -> DataFrame:
    return df.select(*[F.col(f.name).cast(rename_schema(f.dataType, rename)).alias(rename(f.name)) for f in df.schema])


def _skip_empty(c: Column) -> Column:
    return F.when(F.size(c) > 0, c)


def _item(kind: StructType):
    """A family's item as it goes over the wire: empty lists become nulls, which are left out."""
    names = [f.name for f in kind if f.name not in OTHERS.values()]
    others = {f.name: OTHERS[f.name] for f in kind if f.name in OTHERS and OTHERS[f.name] in kind.names}

    def value(x: Column, f: str) -> Column:
        if f in others:  # a name, or an object with the name of another kind
            return F.parse_json(F.when(x[others[f]].isNotNull(), F.to_json(F.struct(x[others[f]].alias("Other")))).otherwise(F.concat(F.lit('"'), x[f], F.lit('"'))))
        return _skip_empty(x[f]) if f in ("decorators", "items", "parsed_sections") else x[f]

    def build(x: Column) -> Column:
        return F.struct(*[value(x, f).alias(f) for f in names])

    return build


def to_wire(processed: DataFrame, pretty: bool = False) -> DataFrame:
    """process() output -> (doc_id, wire): nulls and empty lists are left out; an `Other` kind is an object with its name."""
    have = set(processed.columns)
    parts = [F.col("language"), F.struct(*[F.col(m) for m in METRICS]).alias("metrics")]
    for name in FAMILIES:
        if name in have:
            parts.append(_skip_empty(F.transform(name, _item(processed.schema[name].dataType.elementType))).alias(name))
    parts += [_skip_empty(F.col(n)).alias(n) for n in ("chunks", "data") if n in have]
    options = {"pretty": "true"} if pretty else {}
    return processed.select("doc_id", F.to_json(F.struct(*parts), options).alias("wire"))
