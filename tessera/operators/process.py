"""process(): everything about each document in one pass; parse_documents(), extract_data() and code_chunks(): one thing.

Only doc_id, content and language go to Python, so filter and project before; families that are off are never computed. A
document that fails has its error in a column, or raises with mode="failfast". Nulls give empty results, an unknown or empty
language an error.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructType

from tessera.errors import ConfigError, LanguageNotFoundError, ParseFailedError, TesseraError
from tessera.functions.metrics import metric_columns
from tessera.operators import chunk as chunking
from tessera.operators import formats, intel, syntax
from tessera.operators.catalog import ALIASES, Catalog, builtin
from tessera.operators.syntax.base import paths
from tessera.schemas import FAMILIES, ITEMS, NODES, SPAN_FIELDS, array_of


@dataclass(frozen=True)
class ProcessConfig:
    """What to compute. structure, imports and exports are on at first."""

    structure: bool = True
    imports: bool = True
    exports: bool = True
    comments: bool = False
    docstrings: bool = False
    symbols: bool = False
    diagnostics: bool = False
    chunk_max_size: int | None = None
    data_extraction: bool = False

    def all(self) -> ProcessConfig:
        """The seven families on; chunks and data as they are."""
        return dataclasses.replace(self, **dict.fromkeys(FAMILIES, True))

    def minimal(self) -> ProcessConfig:
        """The seven families off; chunks and data as they are."""
        return dataclasses.replace(self, **dict.fromkeys(FAMILIES, False))

    def with_chunking(self, size: int) -> ProcessConfig:
        return dataclasses.replace(self, chunk_max_size=size)

    def with_data_extraction(self, on: bool = True) -> ProcessConfig:
        return dataclasses.replace(self, data_extraction=on)

    @classmethod
    def of(cls, options: dict) -> ProcessConfig:
        unknown = set(options) - {f.name for f in dataclasses.fields(cls)}
        if unknown:
            raise ConfigError(f"unknown options: {', '.join(sorted(unknown))}")
        return cls(**options)


def _span(s: tuple | None) -> dict | None:
    return None if s is None else dict(zip(SPAN_FIELDS, s, strict=True))


def _rows(family: str, items: list[dict]) -> list[dict]:
    empty = {"decorators": [], "items": [], "parsed_sections": []}
    names = [f.split(":", 1)[0] for f in _fields(ITEMS[family])]
    out = []
    for item in items:
        row = {n: item.get(n, empty.get(n)) for n in names}
        for s in ("span", "body_span"):
            if s in row:
                row[s] = _span(row[s])
        if family == "chunks" and item["comments"]:
            row["comments"] = [c | {"span": _span(c["span"])} for c in item["comments"]]
        out.append(row)
    return out


@cache
def _fields(schema: str) -> list[str]:
    """The top-level fields of a struct's schema string."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(schema[at:i])
            at = i + 1
    return [*out, schema[at:]]


def data_rows(text: str, language: str) -> list[dict] | None:
    """The data nodes of a text in pre-order, or None for a language that holds no data."""
    items = formats.read(text, language)
    if items is None:
        return None
    places = formats.Places(text)
    counts: dict[int, int] = {}
    out = []
    for i, x in enumerate(items):
        ordinal = counts[x.parent] = counts.get(x.parent, -1) + 1
        attributes = [{"name": n, "value": v, "span": _span(places.span(a, b))} for n, v, a, b in x.attributes]
        out.append({"node_id": i, "parent_id": None if x.parent < 0 else x.parent, "depth": x.depth, "ordinal": ordinal, "kind": x.kind, "key": x.key, "value": x.value, "attributes": attributes, "span": _span(places.span(x.start, x.end))})
    return out


def resolve(language: str | None, known: frozenset[str]) -> str:
    to = ALIASES.get(language or "", language or "")
    if to not in known and to not in formats.READERS and not syntax.has_backend(to):
        raise LanguageNotFoundError(f"language not found: {language!r}")
    return to


def process_text(text: str, language: str, config: ProcessConfig) -> dict:
    """All that config asks for of one text, as rows of the families' schemas."""
    nodes = syntax.parse(text, language)
    d = intel.Document(text, language, nodes)
    out: dict = {"node_count": len(nodes), "error_count": sum(n.error or n.missing for n in nodes), "max_depth": max(n.depth for n in nodes)}
    for family in FAMILIES:
        out[family] = _rows(family, intel.FAMILIES[family](d)) if getattr(config, family) else []
    out["chunks"] = _rows("chunks", chunking.chunks(d, config.chunk_max_size)) if config.chunk_max_size is not None else []
    out["data"] = data_rows(text, language) if config.data_extraction else None
    return out


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def as_text(docs: DataFrame) -> DataFrame:
    """docs(doc_id, content, language) with content as a string; bytes that are no UTF-8 become null, marked by `invalid`."""
    if not isinstance(docs.schema["content"].dataType, BinaryType):
        return docs.select("doc_id", "content", "language", F.lit(False).alias("invalid"))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return docs.select("doc_id", text.alias("content"), "language", (F.col("content").isNotNull() & text.isNull()).alias("invalid"))


def _spread(docs: DataFrame) -> DataFrame:
    """docs in as many partitions as there are cores, if they are in fewer; large inputs have more and stay as they are.

    Only plans without a shuffle are asked how many they have: to ask others would run them up to their last one.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if docs.isStreaming or docs._jdf.queryExecution().executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return docs
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)


def _map(docs: DataFrame, schema: str, rows, kept: tuple[str, ...] = ()) -> DataFrame:
    """mapInArrow over as_text(docs), spread over the cores; rows(doc_id, text, language, invalid) gives dicts of the schema.

    kept: columns that go through unseen, where there is one row for each document.
    """
    arrow = _arrow(schema)

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                out: list[dict] = []
                for r in part.select(["doc_id", "content", "language", "invalid"]).to_pylist():
                    out += rows(r["doc_id"], r["content"] or "", r["language"], r["invalid"])
                if out:
                    own = [pa.array([r.get(f.name) for r in out], f.type) for f in arrow]
                    yield pa.RecordBatch.from_arrays([*own, *(part.column(part.schema.get_field_index(k)) for k in kept)], [*arrow.names, *kept])

    more = "".join(f", {k} {docs.schema[k].dataType.simpleString()}" for k in kept)
    return _spread(docs).mapInArrow(run, schema + more)


def process(docs: DataFrame, config: ProcessConfig | None = None, catalog: Catalog | None = None, mode: str = "permissive") -> DataFrame:
    """docs(doc_id, content, language) -> one wide row each: metrics, families, chunks, data and error. The language is the
    resolved one. content: text or bytes; bytes that are no UTF-8 are an error. Metrics are computed where the text is read, so it
    goes to Python once and does not come back."""
    config = config or ProcessConfig()
    known = frozenset((catalog or builtin()).extensions)
    families = [f for f in FAMILIES if getattr(config, f)] + ["chunks"] * (config.chunk_max_size is not None) + ["data"] * config.data_extraction
    schema = "doc_id long, resolved string, node_count long, error_count long, max_depth long, error string" + "".join(f", {f} {array_of(f)}" for f in families)

    def rows(doc_id, text, language, invalid):
        try:
            if invalid:
                raise ParseFailedError("invalid UTF-8")
            to = resolve(language, known)
            got = process_text(text, to, config)
            return [{"doc_id": doc_id, "resolved": to, "error": None} | {k: got[k] for k in ("node_count", "error_count", "max_depth", *families)}]
        except Exception as e:  # noqa: BLE001  one bad document doesn't end the job
            if mode == "failfast":
                raise
            return [{"doc_id": doc_id, "resolved": language, "error": f"{type(e).__name__}: {e}"}]

    texts = as_text(docs)
    m = metric_columns(F.coalesce("content", F.lit("")))
    out = _map(texts.select("*", *[c.alias(n) for n, c in m.items()]), schema, rows, tuple(m))
    return out.select("doc_id", F.col("resolved").alias("language"), *m, "node_count", "error_count", "max_depth", *families, "error")


def family(processed: DataFrame, name: str) -> DataFrame:
    """One family of process() as a table: doc_id, ordinal and the fields of its rows."""
    own = [f.split(":", 1)[0] for f in _fields(ITEMS[name])]
    rows = processed.select("doc_id", F.posexplode(name).alias("_at", "_x"))
    at = [] if "ordinal" in own else [F.col("_at").alias("ordinal")]
    return rows.select("doc_id", *at, *[F.col(f"_x.{f}").alias(f) for f in own])


def flat_span(df: DataFrame, column: str = "span") -> DataFrame:
    """The span's fields as columns in its place."""
    return df.select("*", *[F.col(f"{column}.{f}").alias(f) for f in SPAN_FIELDS]).drop(column)


def parse_documents(docs: DataFrame, catalog: Catalog | None = None, mode: str = "permissive", ancestors: bool = False) -> DataFrame:
    """docs(doc_id, content, language) -> the nodes table. content: text or bytes. A document whose language is not known, or whose
    bytes are no UTF-8, has no rows, or raises. ancestors: with the ids of each node's ancestors, the root first, else null."""
    known = frozenset((catalog or builtin()).extensions)

    def rows(doc_id, text, language, invalid):
        try:
            if invalid:
                raise ParseFailedError("invalid UTF-8")
            nodes = syntax.parse(text, resolve(language, known))
        except TesseraError:
            if mode == "failfast":
                raise
            return []
        places = formats.Places(text)
        above = paths(nodes) if ancestors else [None] * len(nodes)
        return [
            {"doc_id": doc_id, "node_id": i, "subtree_last": n.subtree_last, "parent_id": None if n.parent < 0 else n.parent, "child_index": n.child_index, "depth": n.depth, "kind": n.kind, "field": n.field, "is_named": n.named, "is_error": n.error, "is_missing": n.missing, "is_extra": n.extra, "has_error": n.has_error, "ancestors": above[i]}
            | _span(places.span(n.start, n.end))
            for i, n in enumerate(nodes)
        ]

    return _map(as_text(docs), NODES, rows)


def s_expressions(docs: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """docs(doc_id, content, language) -> (doc_id, language, sexp, has_errors), nulls where the language is not known."""
    known = frozenset((catalog or builtin()).extensions)

    def rows(doc_id, text, language, invalid):
        try:
            nodes = syntax.parse(text, to := resolve(language, known))
        except TesseraError:
            return [{"doc_id": doc_id, "language": language}]
        return [{"doc_id": doc_id, "language": to, "sexp": intel.to_sexp(nodes), "has_errors": any(n.error or n.missing for n in nodes)}]

    return _map(as_text(docs), "doc_id long, language string, sexp string, has_errors boolean", rows)


def extract_data(docs: DataFrame) -> DataFrame:
    """docs(doc_id, content, language) -> the data nodes table; languages without data give no rows."""
    names = [f.split(":", 1) for f in _fields(ITEMS["data"])]
    schema = "doc_id long, " + ", ".join(f"{a} {b}" for a, b in names)

    def rows(doc_id, text, language, invalid):
        return [{"doc_id": doc_id} | r for r in data_rows(text, ALIASES.get(language or "", language or "")) or []]

    return _map(as_text(docs), schema, rows)


def code_chunks(docs: DataFrame, most: int, mode: str = "permissive") -> DataFrame:
    """docs(doc_id, content, language) -> the chunks table."""
    return family(process(docs, ProcessConfig().minimal().with_chunking(most), mode=mode).where("error is null"), "chunks")
