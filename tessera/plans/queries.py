"""Queries of the library's own operators, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import detect
from tessera.functions.metrics import metric_columns
from tessera.operators import catalog, tree
from tessera.operators.process import ProcessConfig, code_chunks, extract_data, family, flat_span, parse_documents, process
from tessera.operators.querytext import lookup, precedence
from tessera.plans.render import documents, join, python_module
from tessera.sources.wire import to_wire
from tessera.streaming.pipelines import event_keys, run_to_end

#: Extensions, interpreters and names that synthetic queries go through.
EXTENSIONS = ("py", "RS", "js", "Go", "java", "xyz", "app.src", "json", "tar.gz", "")
PROGRAMS = ("python3.11", "bash", "node", "ruby2.7", "awk", "perl5", "env", "Rscript")
NAMES = ("shell", "makefile", "python", "bazel", "nosuch", "lisp", "json", "")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def texts(spark: SparkSession, d: str, language: str = "markdown") -> DataFrame:
    return documents(table(spark, d, "documents"), "doc_id", F.col("text"), language)


def q_flagship(spark, d):
    """Documents with line metrics and the bytes of their chunks, by language."""
    docs = table(spark, d, "documents")
    m = metric_columns(F.col("text"))
    lines = docs.select("doc_id", "lang", *[c.alias(n) for n, c in m.items()])
    n = code_chunks(texts(spark, d), 1000).groupBy("doc_id").agg(F.sum(F.col("end_byte") - F.col("start_byte")).alias("chunked"))
    totals = [F.sum(c).alias(c) for c in ("total_lines", "total_bytes")]
    return lines.join(n, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("n_docs"), *totals, F.coalesce(F.sum("chunked"), F.lit(0)).alias("chunked_bytes"))


def q_line_metrics(spark, d):
    return table(spark, d, "documents").select("doc_id", *[c.alias(n) for n, c in metric_columns(F.col("text")).items()])


def q_line_metrics_by_lang(spark, d):
    m = table(spark, d, "documents").select("lang", *[c.alias(n) for n, c in metric_columns(F.col("text")).items()])
    return m.groupBy("lang").agg(F.count("*").alias("n_docs"), *[F.sum(c).alias(c) for c in ("total_lines", "blank_lines", "comment_lines", "code_lines", "total_bytes")])


def q_bytes(spark, d):
    return table(spark, d, "pages").select("page_id", metric_columns(F.col("html"))["total_bytes"].alias("total_bytes"), metric_columns(F.col("html"))["total_lines"].alias("total_lines"))


def q_comment_heuristic(spark, d):
    text = join("# a ", F.col("s_name"), "\n\n  // b\n\t* c\n/* d\n", F.repeat(F.lit("code\n"), F.col("s_suppkey").cast("int") % 5), "   \nlast")
    return table(spark, d, "supplier").select("s_suppkey", *[c.alias(n) for n, c in metric_columns(text).items()])


def q_rollup(spark, d):
    m = table(spark, d, "documents").select("lang", "source", *[c.alias(n) for n, c in metric_columns(F.col("text")).items()])
    return m.rollup("lang", "source").agg(F.count("*").alias("n_docs"), F.sum("total_lines").alias("total_lines"), F.sum("total_bytes").alias("total_bytes"))


def q_detect_path(spark, d):
    path = F.regexp_replace("url", "[?#].*$", "")
    return table(spark, d, "pages").select("page_id", detect.from_path(path).alias("language"))


def _cycle(values: tuple[str, ...], key: str):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def q_detect_synthetic(spark, d):
    path = join("dir_", F.col("p_partkey") % 7, "/file_", F.col("p_partkey"), ".", _cycle(EXTENSIONS, "p_partkey"))
    p = table(spark, d, "part")
    return p.select("p_partkey", detect.from_path(path).alias("by_path"), detect.from_extension(_cycle(EXTENSIONS, "p_partkey")).alias("by_extension"))


def q_detect_loose(spark, d):
    path = join(F.when(F.col("s_suppkey") % 2 == 0, ".").otherwise(""), _cycle(EXTENSIONS, "s_suppkey"))
    return table(spark, d, "supplier").select("s_suppkey", detect.detect(path).alias("loose"), detect.from_path(path).alias("strict"))


def q_detect_shebang(spark, d):
    docs = table(spark, d, "documents")
    text = join(F.when(F.col("doc_id") % 3 == 0, "#!/usr/bin/env -S ").when(F.col("doc_id") % 3 == 1, "#! /usr/local/bin/").otherwise("#/bin/"), _cycle(PROGRAMS, "doc_id"), " -x\n", F.col("text"))
    return docs.select("doc_id", detect.from_content(text).alias("language"))


def q_detect_combined(spark, d):
    docs = table(spark, d, "documents")
    text = join("#!/bin/", _cycle(PROGRAMS, "doc_id"), "\n", F.col("text"))
    path = join("a/b.", _cycle(EXTENSIONS, "doc_id"))
    return docs.select("doc_id", detect.combined(path, text).alias("language"))


def _asked(spark) -> DataFrame:
    return spark.createDataFrame([(n,) for n in NAMES], "name string")


def q_alias(spark, d):
    return _asked(spark).select("name", catalog.resolve_alias(F.col("name")).alias("resolved"))


def q_c_symbol(spark, d):
    rows = spark.createDataFrame([("csharp",), ("python",), ("vb",)], "name string")
    return rows.select("name", catalog.c_symbol_for(F.col("name")).alias("symbol"), catalog.name_for_symbol(catalog.c_symbol_for(F.col("name"))).alias("back"))


def _languages(spark) -> DataFrame:
    return catalog.builtin().frame(spark)


def q_has_language(spark, d):
    langs = _languages(spark)
    return catalog.has_parser(catalog.has_language(_asked(spark), langs), langs)


def q_available(spark, d):
    return catalog.available_languages(_languages(spark))


def q_language_count(spark, d):
    return catalog.language_count(_languages(spark))


def q_list_filter(spark, d):
    return catalog.list_filter(_languages(spark), "script")


def q_prefix_complete(spark, d):
    return catalog.complete(_languages(spark), "p", 5)


def q_language_info(spark, d):
    return catalog.info(_languages(spark), "python").union(catalog.info(_languages(spark), "nosuch"))


def q_downloaded(spark, d):
    return catalog.downloaded_languages(_languages(spark))


def q_query_text(spark, d):
    vendored = spark.createDataFrame([("python", "tags", "v"), ("java", "tags", "v"), ("java", "folds", "v")], "language string, kind string, source string")
    overlay = spark.createDataFrame([("java", "tags", "o"), ("scala", "tags", "o")], "language string, kind string, source string")
    asked = spark.createDataFrame([("java", "tags"), ("scala", "tags"), ("shell", "tags"), ("python", "folds")], "language string, kind string")
    return lookup(asked, precedence(vendored, overlay))


def q_json_data(spark, d):
    """Which keys and values occur in event properties, and how often."""
    docs = documents(table(spark, d, "events"), "event_id", F.col("props"), "json")
    data = extract_data(docs).where("parent_id is not null")
    return data.groupBy("key", "value").agg(F.count("*").alias("n"), F.min("span.start_byte").alias("first_start"))


def q_json_spans(spark, d):
    docs = documents(table(spark, d, "events"), "event_id", F.col("props"), "json")
    data = extract_data(docs).where("parent_id is not null")
    return flat_span(data.select("doc_id", "depth", "ordinal", "kind", "key", "value", "span"))


def _leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, parent key, ordinal, key, value) of nodes with a value."""
    data = extract_data(docs)
    up = data.select("doc_id", F.col("node_id").alias("parent_id"), F.col("key").alias("parent_key"))
    return data.where("value is not null").join(up, ["doc_id", "parent_id"]).select("doc_id", "parent_key", "ordinal", "key", "value")


def q_json_roundtrip(spark, d):
    c = table(spark, d, "customer")
    return _leaves(documents(c, "c_custkey", F.to_json(F.struct("c_custkey", "c_name", "c_nationkey", "c_mktsegment")), "json"))


def q_csv_roundtrip(spark, d):
    n = table(spark, d, "nation")
    return _leaves(documents(n, "n_nationkey", join("key,name\n", F.col("n_nationkey"), ",", F.col("n_name"), "\n"), "csv"))


def q_psv_roundtrip(spark, d):
    n = table(spark, d, "nation")
    return _leaves(documents(n, "n_nationkey", join(F.col("n_nationkey"), "|", F.col("n_name"), "|", F.col("n_regionkey")), "psv"))


def q_properties_roundtrip(spark, d):
    s = table(spark, d, "supplier")
    return _leaves(documents(s, "s_suppkey", join("# supplier\nname = ", F.col("s_name"), "\nnation:", F.col("s_nationkey"), "\n"), "properties"))


def q_ini_roundtrip(spark, d):
    s = table(spark, d, "supplier")
    return _leaves(documents(s, "s_suppkey", join("[supplier ", F.col("s_suppkey"), "]\nname=", F.col("s_name"), "\n; none\nnation = ", F.col("s_nationkey"), "\n"), "ini"))


def q_toml_roundtrip(spark, d):
    s = table(spark, d, "supplier")
    return _leaves(documents(s, "s_suppkey", join("[supplier]\nname = \"", F.col("s_name"), "\" # n\nnation = ", F.col("s_nationkey"), "\nlist = [", F.col("s_suppkey"), ", 7]\n"), "toml"))


def q_po_roundtrip(spark, d):
    s = table(spark, d, "supplier")
    return _leaves(documents(s, "s_suppkey", join("# c\nmsgid \"", F.col("s_suppkey"), "\"\nmsgstr \"", F.col("s_name"), "\"\n"), "po"))


def q_xml_roundtrip(spark, d):
    s = table(spark, d, "supplier")
    docs = documents(s, "s_suppkey", join("<?xml version=\"1.0\"?>\n<supplier id=\"", F.col("s_suppkey"), "\">\n<name> ", F.col("s_name"), " </name><e/>\n</supplier>"), "xml")
    return _leaves(docs)


def q_xml_attributes(spark, d):
    s = table(spark, d, "supplier")
    docs = documents(s, "s_suppkey", join("<supplier id=\"", F.col("s_suppkey"), "\" name='", F.col("s_name"), "'/>"), "xml")
    return extract_data(docs).select("doc_id", F.col("key").alias("element"), F.explode("attributes").alias("a")).select("doc_id", "element", F.col("a.name").alias("name"), F.col("a.value").alias("value"))


def q_yaml_roundtrip(spark, d):
    s = table(spark, d, "supplier")
    return _leaves(documents(s, "s_suppkey", join("supplier:\n  name: ", F.col("s_name"), "\n  nation: '", F.col("s_nationkey"), "'\n  list:\n    - ", F.col("s_suppkey"), "\n    - b\n"), "yaml"))


def q_hcl_roundtrip(spark, d):
    s = table(spark, d, "supplier")
    return _leaves(documents(s, "s_suppkey", join("supplier \"s", F.col("s_suppkey"), "\" {\n  name = \"", F.col("s_name"), "\"\n  nation = ", F.col("s_nationkey"), "\n}\n"), "hcl"))


def q_kdl_roundtrip(spark, d):
    s = table(spark, d, "supplier")
    return _leaves(documents(s, "s_suppkey", join("supplier ", F.col("s_suppkey"), " a=1 {\n  name \"", F.col("s_name"), "\"\n}\n"), "kdl"))


def q_cue_roundtrip(spark, d):
    s = table(spark, d, "supplier")
    return _leaves(documents(s, "s_suppkey", join("name: \"", F.col("s_name"), "\"\n\"nation\": ", F.col("s_nationkey"), "\n"), "cue"))


def q_nginx_roundtrip(spark, d):
    s = table(spark, d, "supplier")
    return _leaves(documents(s, "s_suppkey", join("http {\n  server {\n    listen ", F.col("s_suppkey"), ";\n    root /srv/", F.col("s_nationkey"), " x;\n  }\n}\n"), "nginx"))


def q_caddy_roundtrip(spark, d):
    s = table(spark, d, "supplier")
    return _leaves(documents(s, "s_suppkey", join("example.com {\n  root * /srv/", F.col("s_suppkey"), "\n  file_server\n}\n"), "caddy"))


def q_hocon_roundtrip(spark, d):
    s = table(spark, d, "supplier")
    return _leaves(documents(s, "s_suppkey", join("name = ", F.col("s_suppkey"), "\nnation : ", F.col("s_nationkey"), "\n"), "hocon"))


def q_dtd_roundtrip(spark, d):
    s = table(spark, d, "supplier")
    return _leaves(documents(s, "s_suppkey", join("<!ELEMENT s", F.col("s_suppkey"), " (a)>\n<!ENTITY e \"", F.col("s_nationkey"), "\">"), "dtd"))


def _only(*names: str) -> ProcessConfig:
    return ProcessConfig(**({"structure": False, "imports": False, "exports": False} | dict.fromkeys(names, True)))


def q_html_comments(spark, d):
    docs = documents(table(spark, d, "pages"), "page_id", F.col("html"), "html")
    return family(process(docs, _only("comments")), "comments").select("doc_id", "ordinal", "text", "kind")


def q_chunk_cover(spark, d):
    """Chunks of each document: contiguous, none too large, all of the text."""
    c = code_chunks(texts(spark, d), 1000)
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    c = c.withColumn("gap", F.col("start_byte") != F.coalesce(F.lag("end_byte").over(w), F.lit(0)))
    return c.groupBy("doc_id").agg(F.max("end_byte").alias("covered"), F.count_if("gap").alias("gaps"), F.count_if(F.col("end_byte") - F.col("start_byte") > 1000).alias("too_large"), (F.max("total_chunks") - F.count("*")).cast("long").alias("uncounted"))


def q_chunk_linenos(spark, d):
    c = code_chunks(texts(spark, d), 1000)
    last = c.where("chunk_index = total_chunks - 1")
    return last.select("doc_id", F.col("end_line").alias("line_ends"))


def q_chunk_text(spark, d):
    """The chunks put together again."""
    c = code_chunks(texts(spark, d), 1000)
    parts = c.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "content"))).alias("parts"))
    return parts.select("doc_id", F.sha2(F.array_join(F.col("parts.content"), ""), 256).alias("text_sha256"))


def q_chunk_lines(spark, d):
    """Where the first chunk of texts in whole lines ends."""
    text = join(F.repeat(F.lit("0123456789\n"), (F.col("s_suppkey") % 9 + 1).cast("int")), "tail")
    c = code_chunks(documents(table(spark, d, "supplier"), "s_suppkey", text, "markdown"), 40)
    return c.select("doc_id", "chunk_index", "start_byte", "end_byte", "start_line", "end_line")


def q_dedup_chunks(spark, d):
    """Chunks that occur in more than one benchmark item, by content."""
    docs = documents(table(spark, d, "benchmark"), "item_id", F.col("text"), "markdown")
    return code_chunks(docs, 100_000).groupBy(F.sha2("content", 256).alias("content_sha256")).agg(F.count("*").alias("n"))


def _python(spark, d) -> DataFrame:
    return documents(table(spark, d, "part"), "p_partkey", python_module(F.col("p_name"), F.col("p_partkey")), "python")


def _families(docs: DataFrame, *names: str) -> DataFrame:
    return process(docs, _only(*names))


def q_py_structure(spark, d):
    return flat_span(family(_families(_python(spark, d), "structure"), "structure").select("doc_id", "item_id", "parent_item_id", "depth", "kind", "name", "span")).select("doc_id", "item_id", "parent_item_id", "depth", "kind", "name")


def q_py_imports(spark, d):
    return family(_families(_python(spark, d), "imports"), "imports").select("doc_id", "ordinal", "source", "is_wildcard")


def q_py_symbols(spark, d):
    return family(_families(_python(spark, d), "symbols"), "symbols").select("doc_id", "ordinal", "name", "kind")


def q_py_docstrings(spark, d):
    return family(_families(_python(spark, d), "docstrings"), "docstrings").select("doc_id", "ordinal", "text", "associated_item")


def q_py_comments(spark, d):
    return family(_families(_python(spark, d), "comments"), "comments").select("doc_id", "ordinal", "text", "kind", "associated_node")


def q_js_exports(spark, d):
    text = join("export function f_", F.col("s_suppkey"), "() {\n  return 1;\n}\nexport { a } from \"./m_", F.col("s_suppkey"), "\";\n")
    return family(_families(documents(table(spark, d, "supplier"), "s_suppkey", text, "javascript"), "exports"), "exports").select("doc_id", "ordinal", "name", "kind")


def q_diagnostics(spark, d):
    """Every seventh module is broken."""
    text = F.when(F.col("p_partkey") % 7 == 0, join("def (:\n", F.col("p_partkey"))).otherwise(join("x = ", F.col("p_partkey"), "\n"))
    p = _families(documents(table(spark, d, "part"), "p_partkey", text, "python"), "diagnostics")
    return p.select("doc_id", "error_count", F.size("diagnostics").cast("long").alias("diagnostics"))


def q_process_error(spark, d):
    """A language that is not known is an error in its row."""
    s = table(spark, d, "supplier")
    docs = documents(s, "s_suppkey", F.lit("x"), F.when(F.col("s_suppkey") % 2 == 0, "python").otherwise("nosuch"))
    return process(docs).select("doc_id", F.col("error").isNotNull().alias("failed"), "language")


def _json_nodes(spark, d, ancestors: bool = False) -> DataFrame:
    return parse_documents(documents(table(spark, d, "customer"), "c_custkey", F.to_json(F.struct("c_custkey", F.struct("c_name").alias("n"))), "json"), ancestors=ancestors)


def q_node_metrics(spark, d):
    return tree.node_metrics(_json_nodes(spark, d))


def q_next_sibling(spark, d):
    n = tree.next_siblings(_json_nodes(spark, d), named=True).where("kind = 'pair'")
    return n.select("doc_id", "depth", "next_kind")


def q_ancestors(spark, d):
    nodes = _json_nodes(spark, d, ancestors=True)
    return tree.ancestors(nodes.where("kind = 'string' and field = 'value'")).groupBy("doc_id").agg(F.count("*").alias("n_ancestors"))


def q_field_text(spark, d):
    docs = documents(table(spark, d, "customer"), "c_custkey", F.to_json(F.struct("c_custkey", "c_name")), "json")
    return tree.text_of(tree.child_by_field(parse_documents(docs), "value"), docs).select("doc_id", "depth", "kind", "text")


def q_child_counts(spark, d):
    return tree.child_counts(_json_nodes(spark, d)).groupBy("doc_id").agg(F.sum("child_count").alias("children"), F.sum("named_child_count").alias("named_children"))


def q_top_kinds(spark, d):
    """The two most frequent node kinds of HTML pages."""
    nodes = parse_documents(documents(table(spark, d, "pages"), "page_id", F.col("html"), "html")).where("kind in ('comment', 'script_element', 'style_element')")
    n = nodes.groupBy("kind").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "kind")).cast("long")).where("rank <= 2")


def q_wire_json(spark, d):
    s = table(spark, d, "supplier")
    out = to_wire(process(documents(s, "s_suppkey", join("x = ", F.col("s_suppkey"), "\n"), "python")))
    return out.select("doc_id", F.get_json_object("wire", "$.language").alias("language"), F.get_json_object("wire", "$.metrics.total_lines").cast("long").alias("total_lines"), F.contains(F.col("wire"), F.lit("imports")).alias("has_imports"))


def q_stream_events(spark, d):
    """Keys of event properties by event type, from a file stream run to its end."""
    return run_to_end(spark, f"{d}/events.parquet", lambda s: event_keys(s))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_") and callable(v)}
