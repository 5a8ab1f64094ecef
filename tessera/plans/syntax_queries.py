"""Queries of trees, record families, chunks and their configuration, over source texts rendered from the driver's tables."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import tree
from tessera.operators.formats import strip_quotes_column
from tessera.operators.process import ProcessConfig, code_chunks, family, parse_documents, process, s_expressions
from tessera.operators.querytext import builtin_queries, get_query, precedence, tags
from tessera.plans.queries import _families, _json_nodes, _python, table
from tessera.plans.render import documents, join
from tessera.sources import wire


def _suppliers(spark, d, text, language: str) -> DataFrame:
    return documents(table(spark, d, "supplier"), "s_suppkey", text, language)


def _key():
    return F.col("s_suppkey")


def _structure(docs: DataFrame) -> DataFrame:
    return family(_families(docs, "structure"), "structure").select("doc_id", "item_id", "parent_item_id", "kind", "kind_other", "name", "visibility")


def q_structure_java(spark, d):
    k = _key()
    return _structure(_suppliers(spark, d, join("package p", k, ";\n\npublic class A", k, " {\n    int f", k, "(int y) {\n        return y;\n    }\n}\n\ninterface I", k, " {\n}\n\nenum E", k, " {\n    ONE\n}\n"), "java"))


def q_structure_rust(spark, d):
    k = _key()
    return _structure(_suppliers(spark, d, join("mod m", k, " {\n    fn inner", k, "() {}\n}\n\nstruct S", k, " {\n    a: u8,\n}\n\ntrait T", k, " {\n    fn t(&self) {}\n}\n\nimpl S", k, " {\n    fn new() {}\n}\n\nenum E", k, " {\n    A,\n}\n"), "rust"))


def q_structure_typescript(spark, d):
    k = _key()
    return _structure(_suppliers(spark, d, join("interface I", k, " {\n  a: number;\n}\n\nclass C", k, " {\n  m", k, "() {\n    return 1;\n  }\n}\n\nfunction f", k, "(x) {\n  return x;\n}\n"), "typescript"))


def q_structure_ruby(spark, d):
    k = _key()
    return _structure(_suppliers(spark, d, join("module M", k, "\n  class A", k, "\n    def m", k, "\n    end\n\n    def self.s", k, "\n    end\n  end\nend\n"), "ruby"))


def q_structure_go(spark, d):
    k = _key()
    return _structure(_suppliers(spark, d, join("package main\n\nfunc f", k, "() {\n}\n\nfunc (t T) m", k, "() {\n}\n"), "go"))


def q_structure_csharp(spark, d):
    k = _key()
    return _structure(_suppliers(spark, d, join("using System;\n\nnamespace N", k, "\n{\n    // note\n    public class C", k, " : Base\n    {\n        public async Task<int> M", k, "(int a)\n        {\n            return a;\n        }\n    }\n\n    enum E", k, " { One }\n    struct S", k, " { }\n}\n"), "csharp"))


def q_structure_php(spark, d):
    k = _key()
    return _structure(_suppliers(spark, d, join("<?php\nnamespace A;\nuse B\\C;\n\nclass C", k, " extends D {\n    public function m", k, "($a) {\n        return $a;\n    }\n}\n\nfunction f", k, "($x) {\n    return $x;\n}\n"), "php"))


def q_structure_swift(spark, d):
    k = _key()
    return _structure(_suppliers(spark, d, join("import Foundation\n\nclass C", k, ": P {\n    var x = 1\n    func m", k, "(a: Int) -> Int {\n        return a\n    }\n}\n\nfunc f", k, "() {\n}\n"), "swift"))


def q_structure_scala(spark, d):
    k = _key()
    return _structure(_suppliers(spark, d, join("package a.b\n\nclass C", k, "(x: Int) {\n  def m", k, "(a: Int): Int = {\n    a\n  }\n}\n\nobject O", k, " {\n}\n"), "scala"))


def q_structure_bash(spark, d):
    k = _key()
    return _structure(_suppliers(spark, d, join("#!/bin/bash\n# note\nx=", k, "\nfunction f", k, " {\n  echo \"a # b\"\n}\n\ng", k, "() {\n  ls | wc\n}\n"), "bash"))


def q_comments_many(spark, d):
    """Comments of languages with other marks for them, and none of what is in strings."""
    k = _key()
    texts = {"bash": join("#!/bin/sh\necho \"# in\" # out ", k, "\n"), "php": join("<?php\n# one ", k, "\n// two\n$x = '# in';\n"), "css": join("/* c ", k, " */\na { color: red; }\n"), "csharp": join("// c ", k, "\nint x = 1; /* d */\n")}
    s = table(spark, d, "supplier")
    out = None
    for language, text in texts.items():
        one = family(_families(documents(s, "s_suppkey", text, language), "comments"), "comments").select("doc_id", F.lit(language).alias("language"), "ordinal", "text")
        out = one if out is None else out.union(one)
    return out


def q_tree_css(spark, d):
    k = _key()
    return _kinds(_suppliers(spark, d, join("@import url('a", k, ".css');\n/* c */\nbody, p > a {\n  color: red;\n  margin: ", k, "px\n}\n@media (max-width: 9px) {\n  p { color: blue; }\n}\n"), "css"))


def _elixir(spark, d) -> DataFrame:
    k = _key()
    return _suppliers(spark, d, join("defmodule A", k, " do\n  use X", k, "\n  alias Y.Z\n\n  defstruct [:a]\n\n  def f", k, "(x) when x > 1 do\n    x\n  end\n\n  defp g", k, "(y), do: y\n\n  defmacro m", k, "(z) do\n    quote do\n      import Hidden\n    end\n  end\nend\n"), "elixir")


def q_structure_elixir(spark, d):
    return _structure(_elixir(spark, d))


def q_imports_elixir(spark, d):
    return family(_families(_elixir(spark, d), "imports"), "imports").select("doc_id", "ordinal", "source", "is_wildcard")


def q_wire_elixir(spark, d):
    """Kinds as they go over the wire: names, and an object for another one."""
    out = wire.to_wire(process(_elixir(spark, d)))
    item = F.from_json("wire", "structure array<struct<children:string,kind:string>>").structure
    return out.select("doc_id", F.posexplode(item).alias("ordinal", "item")).select("doc_id", "ordinal", F.col("item.kind").alias("kind"))


def q_empty_fields(spark, d):
    """Outside Elixir nothing fills these."""
    s = family(_families(_python(spark, d), "structure"), "structure")
    empty = F.col("visibility").isNull() & (F.size("decorators") == 0) & F.col("doc_comment").isNull() & F.col("signature").isNull()
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(empty).alias("n_empty"), F.count_if(F.col("body_span").isNotNull()).alias("with_body"))


def q_symbols_go(spark, d):
    k = _key()
    docs = _suppliers(spark, d, join("package main\n\ntype T", k, " struct {\n\ta int\n}\n\ntype I", k, " interface {\n\tM()\n}\n\ntype N", k, " int\n\nfunc f", k, "() {\n}\n"), "go")
    return family(_families(docs, "symbols"), "symbols").select("doc_id", "ordinal", "name", "kind")


def q_imports_many(spark, d):
    """Imports of four languages, and a wildcard."""
    k = _key()
    texts = {"java": join("import a.B", k, ";\nimport c.*;\n"), "kotlin": join("import a.B", k, "\n"), "rust": join("use a::b", k, "::*;\n"), "typescript": join('import { x } from "m', k, '";\n')}
    s = table(spark, d, "supplier")
    out = None
    for language, text in texts.items():
        one = family(_families(documents(s, "s_suppkey", text, language), "imports"), "imports").select("doc_id", F.lit(language).alias("language"), "ordinal", "source", "is_wildcard")
        out = one if out is None else out.union(one)
    return out


def _long_python(spark, d) -> DataFrame:
    """A class with two methods, a comment and a function: more than one chunk."""
    k = _key()
    return _suppliers(spark, d, join("class C", k, ":\n    def a", k, "(self):\n        return 1\n\n    def b", k, "(self):\n        return 2\n# end ", k, "\ndef f", k, "():\n    return 3\n"), "python")


def q_chunk_tree(spark, d):
    """Chunks at the boundaries of the tree, with the names that they hold and the scopes that they are in."""
    c = code_chunks(_long_python(spark, d), 50)
    return c.select("doc_id", "chunk_index", F.substring_index(F.ltrim("content"), "\n", 1).alias("first_line"), F.array_join("symbols_defined", " ").alias("symbols"), F.array_join("context_path", " ").alias("context"), F.array_join("comments.text", " ").alias("comments"), F.size("docstrings").cast("long").alias("n_docstrings"), "has_error_nodes")


def q_chunk_definitions(spark, d):
    """Which definitions of TypeScript a chunk names: classes, functions and enums, but no interfaces."""
    k = _key()
    docs = _suppliers(spark, d, join("enum E", k, " { A }\ninterface I", k, " { a: number }\nclass K", k, " { }\nfunction f", k, "() { }\n"), "typescript")
    return code_chunks(docs, 10_000).select("doc_id", F.array_join("symbols_defined", " ").alias("symbols"), "total_chunks")


def q_chunk_errors(spark, d):
    """Of broken modules, the chunks that a broken node overlaps; node kinds of the top level in the order they come."""
    k = _key()
    docs = _suppliers(spark, d, join('{"a": ', k, "}", F.when(k % 3 == 0, " ]").otherwise("")), "json")
    c = code_chunks(docs, 1000)
    return c.select("doc_id", "has_error_nodes", F.element_at("node_types", 1).alias("first_kind"), F.array_contains("node_types", "object").alias("has_object"))


def q_walk(spark, d):
    """Named kinds of a small tree in pre-order, with the root first."""
    nodes = _json_nodes(spark, d).where("is_named")
    kinds = nodes.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node_id", "kind"))), lambda x: x.kind), " ").alias("kinds"))
    return tree.roots(nodes).select("doc_id", F.col("kind").alias("root")).join(kinds, "doc_id")


def q_parents(spark, d):
    p = tree.parents(_json_nodes(spark, d))
    return p.groupBy("doc_id", "parent_kind").agg(F.count("*").alias("n"))


def q_cursor(spark, d):
    """A cursor's walk from the root: first child, its next sibling, and the last node, which has none after it."""
    c = tree.cursor(_json_nodes(spark, d).select("doc_id", "node_id", "parent_id", "child_index", "subtree_last", "kind"))
    return c.groupBy("doc_id").agg(F.count_if(F.col("next_id").isNull()).alias("ends"), F.count_if(F.col("first_child_id").isNotNull()).alias("inner"), F.count_if(F.col("next_sibling_id").isNotNull()).alias("with_sibling"), F.max("first_child_id").cast("long").alias("deepest_first"))


def q_has_error(spark, d):
    """Broken and whole JSON: nodes with an error below them, the root among them."""
    k = _key()
    docs = _suppliers(spark, d, join('{"a": ', k, "}", F.when(k % 4 == 0, " ]").otherwise("")), "json")
    nodes = parse_documents(docs)
    bad = tree.has_error(nodes).where("node_id = 0").select("doc_id", F.lit(True).alias("broken"))
    return tree.roots(nodes).select("doc_id", "kind").join(bad, "doc_id", "left").select("doc_id", "kind", F.coalesce("broken", F.lit(False)).alias("broken"))


def q_parse_bytes(spark, d):
    """Bytes parse as text does; every fifth text is no UTF-8 and has no tree."""
    k = _key()
    text = F.when(k % 5 == 0, F.unhex(F.lit("7BFF7D"))).otherwise(F.encode(join('{"k": ', k, "}"), "utf-8"))
    docs = documents(table(spark, d, "supplier"), "s_suppkey", text, "json")
    return parse_documents(docs).groupBy("doc_id").agg(F.count_if(F.col("kind") == "pair").alias("pairs"), F.max("end_byte").alias("bytes"))


def q_bytes_error(spark, d):
    k = _key()
    docs = documents(table(spark, d, "supplier"), "s_suppkey", F.when(k % 5 == 0, F.unhex(F.lit("7BFF7D"))).otherwise(F.encode(join("{}"), "utf-8")), "json")
    return process(docs).select("doc_id", "error", "total_bytes")


def q_sexp(spark, d):
    k = _key()
    return s_expressions(_suppliers(spark, d, join('{"a": ', k, "}"), "json")).select("doc_id", "language", "sexp", "has_errors")


def q_parse_wire(spark, d):
    """The parse result as JSON text."""
    k = _key()
    out = s_expressions(_suppliers(spark, d, join("[", k, "]"), "json"))
    return out.select("doc_id", F.to_json(F.struct("language", "sexp", "has_errors")).alias("wire"))


def q_key_case(spark, d):
    """Keys of nested records in the other case, and back."""
    k = _key()
    imports = process(_suppliers(spark, d, join("import m", k, "\n"), "python")).select("doc_id", "imports")
    camel = wire.rename_keys(imports, wire.to_camel)
    back = wire.rename_keys(camel, wire.to_snake)
    one = camel.select(F.col("docId").alias("doc_id"), F.to_json(F.struct(F.element_at("imports", 1).isWildcard.alias("isWildcard"), F.element_at("imports", 1).span.endByte.alias("endByte"))).alias("camel"))
    return one.join(back.select("doc_id", F.element_at("imports", 1).span.end_byte.alias("end_byte")), "doc_id")


def _counts(docs: DataFrame, config: ProcessConfig, name: str) -> DataFrame:
    out = process(docs, config)
    have = [f for f in ("structure", "imports", "comments", "symbols", "docstrings", "chunks", "data") if f in out.columns]
    size = lambda f: F.size(f).cast("long") if f in have else F.lit(-1).cast("long")
    return out.groupBy(F.lit(name).alias("config")).agg(*[F.sum(size(f)).alias(f) for f in ("structure", "imports", "comments", "symbols", "docstrings", "chunks")])


def q_configs(spark, d):
    """What each configuration computes: the defaults, all, minimal and with chunks; what is off isn't there (-1 a document)."""
    docs = _python(spark, d).where("doc_id <= 20")
    one = ProcessConfig()
    parts = {"default": one, "all": one.all(), "minimal": one.minimal(), "chunks": one.minimal().with_chunking(100_000), "own": dataclasses.replace(one.minimal(), comments=True)}
    out = None
    for name, config in parts.items():
        got = _counts(docs, config, name)
        out = got if out is None else out.union(got)
    return out


def q_strip_quotes(spark, d):
    k = _key()
    text = F.when(k % 4 == 0, join('"', k, '"')).when(k % 4 == 1, join(" '", k, "' ")).when(k % 4 == 2, join('"', k, "'")).otherwise(F.lit('"'))
    return table(spark, d, "supplier").select("s_suppkey", strip_quotes_column(text).alias("bare"))


def q_tags(spark, d):
    """Definitions and references of Python modules, by the capture vocabulary of tag queries."""
    return tags(_python(spark, d)).groupBy("doc_id", "capture").agg(F.count("*").alias("n"), F.min("name").alias("first_name"))


def q_get_query(spark, d):
    """A query text by a language's name and by an alias of it."""
    own = spark.createDataFrame([("bash", "tags", "b"), ("make", "folds", "m")], "language string, kind string, source string")
    rows = [(n, k, get_query(own, n, k)) for n, k in (("shell", "tags"), ("bash", "tags"), ("makefile", "folds"), ("makefile", "tags"))]
    return spark.createDataFrame(rows, "language string, kind string, source string")


def q_builtin_queries(spark, d):
    """Query texts of two languages by kind, and an overlay before them."""
    overlay = spark.createDataFrame([("python", "folds", "own")], "language string, kind string, source string")
    return precedence(builtin_queries(spark), overlay).where("language in ('python', 'toml')")


def q_query_kinds(spark, d):
    """How many languages have a text of each kind, among those whose trees define names."""
    return builtin_queries(spark).where("language in ('python', 'ruby', 'java', 'go', 'rust', 'php', 'yaml', 'css')").groupBy("kind").agg(F.count("*").alias("n"))


def q_tree_toml(spark, d):
    """Node kinds of TOML files."""
    k = _key()
    return _kinds(_suppliers(spark, d, join("# about ", k, "\n[supplier]\nname = \"", F.col("s_name"), "\"\nkeys = [", k, ", 7]\n"), "toml"))


def q_tree_yaml(spark, d):
    k = _key()
    return _kinds(_suppliers(spark, d, join("# about ", k, "\nsupplier:\n  name: ", F.col("s_name"), "\n  keys:\n    - ", k, "\n    - 7\n"), "yaml"))


def q_tree_ini(spark, d):
    k = _key()
    return _kinds(_suppliers(spark, d, join("; about ", k, "\n[supplier]\nname = ", F.col("s_name"), "\nkey = ", k, "\n"), "ini"))


def q_tree_hcl(spark, d):
    k = _key()
    return _kinds(_suppliers(spark, d, join("# about ", k, "\nsupplier \"s", k, "\" {\n  name = \"", F.col("s_name"), "\"\n  key = ", k, "\n}\n"), "hcl"))


def _kinds(docs: DataFrame) -> DataFrame:
    return parse_documents(docs).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


def q_comments_config(spark, d):
    """Comments of configuration files."""
    k = _key()
    docs = _suppliers(spark, d, join("# about ", k, "\n[supplier]\nname = 'a # b' # after ", k, "\n"), "toml")
    return family(_families(docs, "comments"), "comments").select("doc_id", "ordinal", "text", "kind")


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_") and callable(v)}

_S = "s_suppkey AS doc_id"


def _items(*rows: tuple) -> str:
    """Structure rows: item, parent, kind, other, name with the key after it, visibility."""
    q = lambda x: "NULL" if x is None else f"'{x}'"
    body = ", ".join(f"({i}, {'NULL' if p is None else p}, {q(k)}, {q(o)}, {q(n)}, {q(v)})" for i, p, k, o, n, v in rows)
    name = "CASE WHEN n IS NULL THEN NULL WHEN n LIKE '%!' THEN rtrim(n, '!') ELSE n || s_suppkey END"
    return f"SELECT {_S}, i::INTEGER AS item_id, p::INTEGER AS parent_item_id, k AS kind, o::VARCHAR AS kind_other, {name} AS name, v::VARCHAR AS visibility FROM supplier, (VALUES {body}) t(i, p, k, o, n, v)"


def _kind_counts(**counts: int) -> str:
    return f"SELECT {_S}, k AS kind, n::BIGINT AS n FROM supplier, (VALUES {', '.join(f"('{k}', {n})" for k, n in counts.items())}) v(k, n)"


ORACLE_SQL = {
    "q_structure_java": _items((0, None, "Module", None, "p", None), (1, None, "Class", None, "A", None), (2, 1, "Method", None, "f", None), (3, None, "Interface", None, "I", None), (4, None, "Enum", None, "E", None)),
    "q_structure_rust": _items((0, None, "Module", None, "m", None), (1, 0, "Function", None, "inner", None), (2, None, "Struct", None, "S", None), (3, None, "Trait", None, "T", None), (4, 3, "Function", None, "t!", None), (5, None, "Impl", None, "S", None), (6, 5, "Function", None, "new!", None), (7, None, "Enum", None, "E", None)),
    "q_structure_typescript": _items((0, None, "Interface", None, "I", None), (1, None, "Class", None, "C", None), (2, 1, "Method", None, "m", None), (3, None, "Function", None, "f", None)),
    "q_structure_ruby": _items((0, None, "Module", None, "M", None), (1, 0, "Class", None, "A", None), (2, 1, "Method", None, "m", None), (3, 1, "Method", None, "s", None)),
    "q_structure_go": _items((0, None, "Function", None, "f", None), (1, None, "Method", None, "m", None)),
    "q_structure_csharp": _items((0, None, "Class", None, "C", None), (1, 0, "Method", None, "M", None), (2, None, "Enum", None, "E", None), (3, None, "Struct", None, "S", None)),
    "q_structure_php": _items((0, None, "Class", None, "C", None), (1, 0, "Method", None, "m", None), (2, None, "Function", None, "f", None)),
    "q_structure_swift": _items((0, None, "Class", None, "C", None), (1, 0, "Function", None, "m", None), (2, None, "Function", None, "f", None)),
    "q_structure_scala": _items((0, None, "Class", None, "C", None), (1, 0, "Function", None, "m", None)),
    "q_structure_bash": _items((0, None, "Function", None, "f", None), (1, None, "Function", None, "g", None)),
    "q_comments_many": f"SELECT {_S}, l AS language, i::INTEGER AS ordinal, t || CASE WHEN k THEN s_suppkey || e ELSE '' END AS text FROM supplier, (VALUES ('bash', 0, '#!/bin/sh', false, ''), ('bash', 1, '# out ', true, ''), ('php', 0, '# one ', true, ''), ('php', 1, '// two', false, ''), ('css', 0, '/* c ', true, ' */'), ('csharp', 0, '// c ', true, ''), ('csharp', 1, '/* d */', false, '')) v(l, i, t, k, e)",
    "q_tree_css": _kind_counts(stylesheet=1, import_statement=1, comment=1, rule_set=2, media_statement=1, declaration=3, block=3),
    "q_structure_elixir": _items((0, None, "Module", None, "A", None), (1, 0, "Struct", None, None, None), (2, 0, "Function", None, "f", "public"), (3, 0, "Function", None, "g", "private"), (4, 0, "Other", "Macro", "m", "public")),
    "q_imports_elixir": f"SELECT {_S}, 0 AS ordinal, 'use X' || s_suppkey AS source, false AS is_wildcard FROM supplier UNION ALL SELECT s_suppkey, 1, 'alias Y.Z', false FROM supplier",
    "q_wire_elixir": f"SELECT {_S}, i::INTEGER AS ordinal, k AS kind FROM supplier, (VALUES (0, 'Module'), (1, 'Struct'), (2, 'Function'), (3, 'Function'), (4, '{{\"Other\":\"Macro\"}}')) v(i, k)",
    "q_empty_fields": "SELECT p_partkey AS doc_id, 3::BIGINT AS n, 3::BIGINT AS n_empty, 3::BIGINT AS with_body FROM part",
    "q_symbols_go": f"SELECT {_S}, i::INTEGER AS ordinal, n || s_suppkey AS name, k AS kind FROM supplier, (VALUES (0, 'T', 'Type'), (1, 'I', 'Interface'), (2, 'N', 'Type'), (3, 'f', 'Function')) v(i, n, k)",
    "q_imports_many": f"""SELECT {_S}, 'java' AS language, 0 AS ordinal, 'import a.B' || s_suppkey || ';' AS source, false AS is_wildcard FROM supplier UNION ALL SELECT s_suppkey, 'java', 1, 'import c.*;', true FROM supplier
UNION ALL SELECT s_suppkey, 'kotlin', 0, 'import a.B' || s_suppkey, false FROM supplier UNION ALL SELECT s_suppkey, 'rust', 0, 'use a::b' || s_suppkey || '::*;', true FROM supplier
UNION ALL SELECT s_suppkey, 'typescript', 0, 'import {{ x }} from "m' || s_suppkey || '";', false FROM supplier""",
    "q_chunk_definitions": f"SELECT {_S}, 'E' || s_suppkey || ' K' || s_suppkey || ' f' || s_suppkey AS symbols, 1 AS total_chunks FROM supplier",
    "q_chunk_errors": f"SELECT {_S}, s_suppkey % 3 = 0 AS has_error_nodes, 'document' AS first_kind, true AS has_object FROM supplier",
    "q_walk": "SELECT c_custkey AS doc_id, 'document' AS root, 'document object pair string number pair string object pair string string' AS kinds FROM customer",
    "q_parents": "SELECT c_custkey AS doc_id, k AS parent_kind, n::BIGINT AS n FROM customer, (VALUES ('document', 1), ('object', 8), ('pair', 9)) v(k, n)",
    "q_cursor": "SELECT c_custkey AS doc_id, 1::BIGINT AS ends, 6::BIGINT AS inner, 12::BIGINT AS with_sibling, 14::BIGINT AS deepest_first FROM customer",
    "q_chunk_tree": f"""SELECT {_S}, i::INTEGER AS chunk_index, l || s_suppkey || r AS first_line, CASE i WHEN 3 THEN 'f' || s_suppkey WHEN 0 THEN 'C' || s_suppkey ELSE 'C' || s_suppkey || ' ' || chr(96 + i) || s_suppkey END AS symbols,
CASE WHEN i IN (1, 2) THEN 'C' || s_suppkey ELSE '' END AS context, CASE WHEN i = 3 THEN '# end ' || s_suppkey ELSE '' END AS comments, 0::BIGINT AS n_docstrings, false AS has_error_nodes
FROM supplier, (VALUES (0, 'class C', ':'), (1, 'def a', '(self):'), (2, 'def b', '(self):'), (3, '# end ', '')) v(i, l, r)""",
    "q_has_error": f"SELECT {_S}, 'document' AS kind, s_suppkey % 4 = 0 AS broken FROM supplier",
    "q_parse_bytes": f"SELECT {_S}, 1::BIGINT AS pairs, 7 + length(s_suppkey::VARCHAR) AS bytes FROM supplier WHERE s_suppkey % 5 <> 0",
    "q_bytes_error": f"SELECT {_S}, CASE WHEN s_suppkey % 5 = 0 THEN 'ParseFailedError: invalid UTF-8' END AS error, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE 2 END::BIGINT AS total_bytes FROM supplier",
    "q_sexp": f"SELECT {_S}, 'json' AS language, '(document (object (pair key: (string) value: (number))))' AS sexp, false AS has_errors FROM supplier",
    "q_parse_wire": f"SELECT {_S}, '{{\"language\":\"json\",\"sexp\":\"(document (array (number)))\",\"has_errors\":false}}' AS wire FROM supplier",
    "q_key_case": f"SELECT {_S}, '{{\"isWildcard\":false,\"endByte\":' || (8 + length(s_suppkey::VARCHAR)) || '}}' AS camel, 8 + length(s_suppkey::VARCHAR) AS end_byte FROM supplier",
    "q_configs": "WITH n AS (SELECT count(*) AS n FROM part WHERE p_partkey <= 20) SELECT c AS config, (s * n)::BIGINT AS structure, (i * n)::BIGINT AS imports, (k * n)::BIGINT AS comments, (y * n)::BIGINT AS symbols, (o * n)::BIGINT AS docstrings, (h * n)::BIGINT AS chunks FROM n, (VALUES ('default', 3, 2, -1, -1, -1, -1), ('all', 3, 2, 1, 3, 2, -1), ('minimal', -1, -1, -1, -1, -1, -1), ('chunks', -1, -1, -1, -1, -1, 1), ('own', -1, -1, 1, -1, -1, -1)) v(c, s, i, k, y, o, h)",
    "q_strip_quotes": "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 2 THEN '\"' || s_suppkey || '''' WHEN 3 THEN '\"' ELSE s_suppkey::VARCHAR END AS bare FROM supplier",
    "q_tags": "SELECT p_partkey AS doc_id, c AS capture, n::BIGINT AS n, f || p_partkey AS first_name FROM part, (VALUES ('definition.class', 1, 'C_'), ('definition.function', 2, 'f_')) v(c, n, f)",
    "q_builtin_queries": """SELECT l AS language, k AS kind, replace(t, '|', chr(10)) AS source FROM (VALUES
('python', 'highlights', '(comment) @comment|(class_definition name: (_) @class)|(function_definition name: (_) @function)'),
('python', 'injections', '((comment) @injection.content (#set! injection.language "comment"))'),
('python', 'locals', '(class_definition) @local.scope|(class_definition name: (_) @local.definition)|(function_definition) @local.scope|(function_definition name: (_) @local.definition)'),
('python', 'tags', '(class_definition name: (_) @name) @definition.class|(function_definition name: (_) @name) @definition.function'),
('python', 'indents', '(class_definition) @indent.begin|(function_definition) @indent.begin'), ('python', 'folds', 'own'),
('toml', 'highlights', '(comment) @comment|(key) @property|(value) @string'), ('toml', 'injections', '((comment) @injection.content (#set! injection.language "comment"))'),
('toml', 'indents', '(table) @indent.begin'), ('toml', 'folds', '(table) @fold')) v(l, k, t)""",
    "q_query_kinds": "SELECT * FROM (VALUES ('highlights', 7::BIGINT), ('injections', 7), ('locals', 6), ('tags', 6), ('indents', 7), ('folds', 7)) v(kind, n)",
    "q_get_query": "SELECT * FROM (VALUES ('shell', 'tags', 'b'), ('bash', 'tags', 'b'), ('makefile', 'folds', 'm'), ('makefile', 'tags', NULL)) v(language, kind, source)",
    "q_tree_toml": _kind_counts(document=1, comment=1, table=2, pair=1, array_item=2, key=3, value=1),
    "q_tree_yaml": _kind_counts(stream=1, comment=1, block_mapping=2, block_mapping_pair=1, block_sequence_item=2, key=3, value=3),
    "q_tree_ini": _kind_counts(document=1, comment=1, section=1, setting=2, key=3, value=2),
    "q_tree_hcl": _kind_counts(config_file=1, comment=1, block=1, attribute=2, key=2, value=2),
    "q_comments_config": f"SELECT {_S}, 0 AS ordinal, '# about ' || s_suppkey AS text, 'Line' AS kind FROM supplier UNION ALL SELECT s_suppkey, 1, '# after ' || s_suppkey, 'Line' FROM supplier",
}
