"""The operators as SQL functions and table functions of a session, for users of spark.sql."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tessera.functions.detect import COMPOUND, INTERPRETERS, MAX_EXTENSION
from tessera.operators.catalog import ALIASES, Catalog, builtin


def _text(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _map(pairs: dict[str, str]) -> str:
    return "map(" + ", ".join(_text(x) for pair in sorted(pairs.items()) for x in pair) + ")"


def _functions(catalog: Catalog) -> dict[str, str]:
    """Each function's signature and body; the bodies are inlined by the optimizer."""
    extension = f"CASE WHEN octet_length(e) <= {MAX_EXTENSION} AND octet_length(e) = length(e) THEN element_at({_map(catalog.by_extension)}, lower(e)) END"
    name = r"nullif(nullif(nullif(regexp_extract(regexp_replace(p, '(/\\.?)+$', ''), '([^/]*)$', 1), ''), '.'), '..')"
    last = rf"tessera_extension(nullif(regexp_extract({name}, '^.+\\.([^.]*)$', 1), ''))"
    suffixes = " ".join(f"WHEN endswith(lower({name}), {_text(s)}) THEN {_text(to)}" for s, to in COMPOUND.items())
    line = r"filter(split(substring_index(substr(t, 3), '\n', 1), '[ \\t\\n\\f\\r]+'), w -> w <> '')"
    env = f"(try_element_at({line}, 1) = 'env' OR endswith(try_element_at({line}, 1), '/env'))"
    program = f"CASE WHEN {env} THEN try_element_at(filter(slice({line}, 2, 1073741824), w -> NOT startswith(w, '-')), 1) ELSE substring_index(try_element_at({line}, 1), '/', -1) END"
    version = rf"regexp_replace({program}, '(?s)\\.?[0-9].*$', '')"
    return {
        "tessera_alias(n STRING) RETURNS STRING": f"coalesce(element_at({_map(ALIASES)}, n), n)",
        "tessera_extension(e STRING) RETURNS STRING": extension,
        "tessera_path(p STRING) RETURNS STRING": f"CASE {suffixes} ELSE {last} END",
        "tessera_shebang(t STRING) RETURNS STRING": f"CASE WHEN startswith(t, '#!') THEN element_at({_map(INTERPRETERS)}, {version}) END",
        "tessera_detect(p STRING, t STRING) RETURNS STRING": "coalesce(tessera_path(p), tessera_shebang(t))",
    }


def register(spark: SparkSession, catalog: Catalog | None = None) -> list[str]:
    """Makes the functions known to the session and gives their names.

    Scalar: tessera_alias, tessera_extension, tessera_path, tessera_shebang, tessera_detect(path, text). Tables, under LATERAL:
    tessera_parse(text, language), tessera_structure(text, language), tessera_chunks(text, language, size),
    tessera_data(text, language); unknown languages give no rows. tessera_languages() lists the catalogue.
    """
    catalog = catalog or builtin()
    known = frozenset(catalog.extensions)
    names = []
    for head, body in _functions(catalog).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
        names.append(head.split("(")[0])

    def opened(text, language):
        from tessera.errors import TesseraError
        from tessera.operators import intel, syntax
        from tessera.operators.process import resolve

        try:
            to = resolve(language, known)
        except TesseraError:
            return None
        return intel.Document(text or "", to, syntax.parse(text or "", to))

    class Parse:
        def eval(self, text: str, language: str):
            if (d := opened(text, language)) is not None:
                for i, n in enumerate(d.nodes):
                    yield i, None if n.parent < 0 else n.parent, n.depth, n.kind, n.field, n.named, n.has_error, d.places.at(n.start), d.places.at(n.end)

    class Structure:
        def eval(self, text: str, language: str):
            from tessera.operators import intel

            if (d := opened(text, language)) is not None:
                for r in intel.structure(d):
                    yield r["item_id"], r["parent_item_id"], r["kind"], r["name"], r["span"][0], r["span"][1]

    class Chunks:
        def eval(self, text: str, language: str, size: int):
            from tessera.operators import chunk

            if (d := opened(text, language)) is not None:
                for c in chunk.chunks(d, size):
                    yield c["chunk_index"], c["content"], c["start_byte"], c["end_byte"], c["symbols_defined"]

    class Data:
        def eval(self, text: str, language: str):
            from tessera.operators.process import data_rows

            for r in data_rows(text or "", ALIASES.get(language or "", language or "")) or []:
                yield r["node_id"], r["parent_id"], r["kind"], r["key"], r["value"]

    class Languages:
        def eval(self):
            for name in sorted(known):
                yield (name,)

    tables = {
        "tessera_parse": (Parse, "node_id int, parent_id int, depth int, kind string, field string, is_named boolean, has_error boolean, start_byte long, end_byte long"),
        "tessera_structure": (Structure, "item_id int, parent_item_id int, kind string, name string, start_byte long, end_byte long"),
        "tessera_chunks": (Chunks, "chunk_index int, content string, start_byte long, end_byte long, symbols_defined array<string>"),
        "tessera_data": (Data, "node_id int, parent_id int, kind string, key string, value string"),
        "tessera_languages": (Languages, "name string"),
    }
    for name, (kind, schema) in tables.items():
        spark.udtf.register(name, udtf(kind, returnType=schema))
        names.append(name)
    return names
