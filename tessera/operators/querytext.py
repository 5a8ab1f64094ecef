"""Query texts by language and kind: a lookup table, with overlays before what is vendored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.catalog import ALIASES, resolve_alias
from tessera.operators.intel import RUBY_STRUCTURE, STRUCTURE
from tessera.operators.process import ProcessConfig, process
from tessera.operators.syntax import braces, records

KINDS = ("highlights", "injections", "locals", "tags", "indents", "folds")


#: Captures of tag queries, by the kinds of structure items and symbols.
CAPTURES = {
    "Class": "definition.class",
    "Struct": "definition.class",
    "Enum": "definition.class",
    "Interface": "definition.interface",
    "Trait": "definition.interface",
    "Function": "definition.function",
    "Method": "definition.method",
    "Module": "definition.module",
    "Impl": "reference.implementation",
}
SYMBOL_CAPTURES = {"Type": "definition.type", "Constant": "definition.constant"}


def _definitions(language: str) -> list[tuple[str, str]]:
    """(node kind, capture) of what a language's tree defines by name, in the order of the backend."""
    own = {"python": ("class_definition", "function_definition"), "ruby": ("class", "module", "method", "singleton_method")}
    kinds = own.get(language) or tuple(dict.fromkeys(kind for _, kind in braces.LANGUAGES.get(language, ())))
    of = {**STRUCTURE, **(RUBY_STRUCTURE if language == "ruby" else {})}
    return [(k, CAPTURES[of[k]]) for k in kinds if of.get(k) in CAPTURES]


def text_of(language: str, kind: str) -> str | None:
    """The query text for this library's tree of a language, made from the kinds of its nodes; None where there is none.

    highlights: comments, keys and values; tags: definitions with their names; folds and indents: what has a body or entries;
    locals: scopes and definitions; injections: comments.
    """
    defined = _definitions(language)
    record = records.KINDS.get(language)
    if not defined and not record:
        return None
    if kind == "tags":
        return "\n".join(f"({k} name: (_) @name) @{c}" for k, c in defined if c.startswith("definition")) or None
    if kind == "locals":
        return "\n".join(line for k, c in defined for line in (f"({k}) @local.scope", f"({k} name: (_) @local.definition)") if c.startswith("definition")) or None
    if kind == "highlights":
        return "(comment) @comment" + ("\n(key) @property\n(value) @string" if record else "".join(f"\n({k} name: (_) @{c.split('.')[1]})" for k, c in defined))
    if kind == "injections":
        return '((comment) @injection.content (#set! injection.language "comment"))'
    capture = {"folds": "@fold", "indents": "@indent.begin"}[kind]
    return "\n".join(f"({k}) {capture}" for k in dict.fromkeys([record[1]] if record else [k for k, _ in defined]))


def builtin_queries(spark: SparkSession) -> DataFrame:
    """(language, kind, source): query texts for the trees of this library, of every language with definitions or entries."""
    names = sorted({*braces.LANGUAGES, *records.KINDS, "python", "ruby"})
    rows = [(n, k, text) for n in names for k in KINDS if (text := text_of(n, k))]
    return spark.createDataFrame(rows, "language string, kind string, source string")


def precedence(vendored: DataFrame, overlay: DataFrame) -> DataFrame:
    """(language, kind, source) of both, the overlay's where both have one."""
    o = overlay.select("language", "kind", F.col("source").alias("_overlay"))
    return vendored.join(o, ["language", "kind"], "full").select("language", "kind", F.coalesce("_overlay", "source").alias("source"))


def lookup(asked: DataFrame, queries: DataFrame, aliases: bool = False) -> DataFrame:
    """asked(language, kind) with source, null for none. Aliases are resolved only on demand."""
    rows = asked.withColumn("_to", resolve_alias(F.col("language")) if aliases else F.col("language"))
    texts = queries.select(F.col("language").alias("_to"), "kind", "source")
    return rows.join(texts, ["_to", "kind"], "left").select("language", "kind", "source")


def tags(docs: DataFrame) -> DataFrame:
    """docs(doc_id, content, language) -> (doc_id, capture, name, span) of what each document defines, or implements."""
    out = process(docs, ProcessConfig(structure=True, imports=False, exports=False, symbols=True))

    def captured(family: str, captures: dict[str, str]):
        names = F.create_map(*[F.lit(x) for pair in captures.items() for x in pair])
        item = lambda x: F.struct(F.element_at(names, x["kind"]).alias("capture"), x["name"].alias("name"), x["span"].alias("span"))
        return F.transform(F.filter(family, lambda x: x["kind"].isin(*captures) & x["name"].isNotNull()), item)

    both = F.concat(captured("structure", CAPTURES), captured("symbols", SYMBOL_CAPTURES))
    return out.select("doc_id", F.explode(both).alias("t")).select("doc_id", "t.capture", "t.name", "t.span")


def get_query(queries: DataFrame, language: str, kind: str) -> str | None:
    """The text of a language, or of what its name is an alias of."""
    row = queries.where((F.col("language") == ALIASES.get(language, language)) & (F.col("kind") == kind)).select("source").first()
    return row.source if row else None
