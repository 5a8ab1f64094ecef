"""Queries of sources, configuration, the catalogue's commands, the command line, SQL functions and streams."""

from __future__ import annotations

import contextlib
import hashlib
import io
import json
import tarfile
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import cli
from tessera.errors import TesseraError
from tessera.functions import detect, sql
from tessera.operators import catalog
from tessera.operators.process import ProcessConfig, extract_data, process
from tessera.plans.queries import EXTENSIONS, _cycle, _leaves, table
from tessera.plans.render import documents, join
from tessera.sources import config, files
from tessera.streaming.pipelines import dedup_stream, run_to_end, windowed_counts


def q_read_sources(spark, d):
    """Files that a folder has, as documents: JSON of the nations, a file each, by its values."""
    path = files.scratch(spark, "sources")
    n = table(spark, d, "nation")
    n.select("n_nationkey", "n_name", "n_regionkey").repartition(4, "n_nationkey").write.partitionBy("n_nationkey").json(path)
    docs = files.read_sources(spark, path, glob="*.json")
    data = extract_data(docs).where("key is not null").select("doc_id", "key", "value")
    return docs.select("doc_id", "language", "error", F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("int").alias("nation")).join(data, "doc_id").select("nation", "language", "error", "key", "value")


def q_utf8_gate(spark, d):
    """Files that are no text have an error and no content."""
    out = files.read_sources(spark, d, glob="{region,nation}.parquet")
    return out.select(F.element_at(F.split("path", "/"), -1).alias("file"), "language", "content", "error")


def q_ndjson(spark, d):
    """Lines of a file as JSON documents."""
    path = files.scratch(spark, "lines")
    table(spark, d, "events").where("event_id < 500").select("props").write.text(path)
    docs = files.read_ndjson(spark, path)
    return extract_data(docs).where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def q_memory_source(spark, d):
    """A text at hand, as a document."""
    out = process(files.read_text(spark, "import os\nx = 1\n", "python"))
    return out.select("doc_id", "language", "total_lines", F.element_at("imports", 1)["source"].alias("first_import"))


def q_archives(spark, d):
    """Members of tar archives as documents: one archive of all regions, read by its names and whole."""
    path = files.scratch(spark, "archives")
    rows = table(spark, d, "region").orderBy("r_regionkey").limit(10).collect()
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as archive:
        for r in rows:
            body = json.dumps({"name": r.r_name}).encode()
            info = tarfile.TarInfo(f"data/region_{r.r_regionkey}.json")
            info.size = len(body)
            archive.addfile(info, io.BytesIO(body))
    _put(spark, f"{path}/all.tar.gz", buffer.getvalue())
    members = files.read_archives(spark, path)
    some = files.read_archives(spark, path, ["data/region_0.json"]).select("name", F.lit(True).alias("asked"))
    text = members.select("name", "language", F.get_json_object(F.col("content").cast("string"), "$.name").alias("region"))
    return text.join(some, "name", "left").select("name", "language", "region", F.coalesce("asked", F.lit(False)).alias("asked"))


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(data))
    out.close()


def q_manifest(spark, d):
    """A local manifest, and which of the files at hand have its digests."""
    path = files.scratch(spark, "manifest") + "/manifest.json"
    rows = table(spark, d, "region").select("r_name").orderBy("r_name").limit(10).collect()
    entries = [{"name": r.r_name, "group": "g", "url": f"file:///{r.r_name}", "sha256": hashlib.sha256(r.r_name.encode()).hexdigest(), "size": len(r.r_name)} for r in rows]
    _put(spark, path, json.dumps(entries).encode())
    manifest = files.read_manifest(spark, path)
    have = table(spark, d, "region").select(F.col("r_name").alias("name"), F.encode(F.when(F.col("r_regionkey") == 1, "other").otherwise(F.col("r_name")), "utf-8").alias("content"))
    return files.verify_sha256(have, manifest).join(manifest, "name").select("name", "ok", "size", "url")


def q_config(spark, d):
    """A configuration written, found from a folder below it, and applied."""
    with tempfile.TemporaryDirectory() as folder:
        deep = Path(folder, "a", "b")
        deep.mkdir(parents=True)
        config.write(Path(folder, config.FILE), config.PackConfig('/c "q"\\x', ["shell", "python"], ["web"]))
        found = config.discover(deep)
        plain = Path(folder, "other.toml")
        plain.write_text("languages = [\n  'go', # one\n]\n", encoding="utf-8")
        loaded = config.load(plain)
    ready = config.configure(spark, found, catalog.Catalog(catalog.builtin().extensions, {"web": ("html", "css")}))
    rows = [("cache_dir", found.cache_dir), ("languages", " ".join(found.languages)), ("groups", " ".join(found.groups)), ("loaded", " ".join(loaded.languages)), ("ready", " ".join(ready)), ("session", config.cache_dir(spark))]
    spark.conf.unset(config.CACHE_DIR)
    return spark.createDataFrame(rows, "name string, value string")


def q_cache(spark, d):
    """A cache folder's files are counted as they go; of none there are none."""
    with tempfile.TemporaryDirectory() as folder:
        Path(folder, "c").mkdir()
        for name in "xyz":
            Path(folder, "c", name).write_text(name, encoding="utf-8")
        rows = [(config.clean_cache(Path(folder, "c")), config.clean_cache(Path(folder, "c")), config.clean_cache(Path(folder, "none")))]
    return spark.createDataFrame(rows, "first long, again long, missing long")


_GROUPED = {"web": ("html", "css", "javascript"), "data": ("json", "yaml")}


def _grouped() -> catalog.Catalog:
    return catalog.Catalog(catalog.builtin().extensions, _GROUPED)


def _outcome(call) -> str:
    try:
        got = call()
        return " ".join(got) if isinstance(got, list) else str(got)
    except TesseraError as e:
        return f"{type(e).__name__}: {e}"


def q_download_plan(spark, d):
    """Which languages a download means: all of them, else groups, else names, else a configuration's."""
    c = _grouped()
    own = config.PackConfig(None, ["go"], ["data"])
    asked = {
        "groups first": lambda: catalog.download_plan(c, groups=("web",), languages=("go",), config=own),
        "names": lambda: catalog.download_plan(c, languages=("shell", "go", "bash"), config=own),
        "config": lambda: catalog.download_plan(c, config=own),
        "nothing": lambda: catalog.download_plan(c),
        "all": lambda: len(catalog.download_plan(c, everything=True)) == len(c.extensions),
        "unknown group": lambda: catalog.download_plan(c, groups=("nosuch",)),
        "unknown name": lambda: catalog.download_plan(c, languages=("nosuch",)),
    }
    return spark.createDataFrame([(k, _outcome(f)) for k, f in asked.items()], "asked string, got string")


def q_require(spark, d):
    """How many languages a download makes ready: unique names asked for; all there are for a group; unknown ones raise."""
    c, langs = _grouped(), catalog.builtin().frame(spark)
    rows = {
        "none": lambda: catalog.require(langs, []),
        "twice": lambda: catalog.require(langs, ["python", "python", "shell"]),
        "unknown": lambda: catalog.require(langs, ["python", "nosuch"]),
        "group": lambda: catalog.require_group(c, "web") == len(c.extensions),
        "prefetch": lambda: catalog.prefetch(spark, c, ["python", "json", "json"]),
        "get alias": lambda: catalog.get_language(c, "makefile"),
        "get unknown": lambda: catalog.get_language(c, ""),
    }
    return spark.createDataFrame([(k, _outcome(f)) for k, f in rows.items()], "asked string, got string")


def q_get_language(spark, d):
    """Canonical names as a column; null for what is no language."""
    name = _cycle(("python", "shell", "lisp", "nosuch", "json", ""), "s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", catalog.language_of(name).alias("language"))


def q_markdown_catalog(spark, d):
    """A catalogue read from a Markdown table, and detection by it."""
    c = catalog.load_markdown(["| Language | Extensions |", "|---|---|", "| Foo Lang | `.foo`, `.fo` |", "| Bar | `.bar` |", "| No Ext | - |"])
    path = join("x/y.", _cycle(("foo", "FO", "bar", "py"), "s_suppkey"))
    return table(spark, d, "supplier").select("s_suppkey", detect.from_path(path, c).alias("language"))


def q_manifest_languages(spark, d):
    return catalog.manifest_languages(catalog.load_table(spark.createDataFrame([("b", ["x"]), ("a", None)], "name string, extensions array<string>")).frame(spark))


def q_ambiguity(spark, d):
    """Other languages of an extension, from a table at hand."""
    ext = _cycle(("h", "M", "py", "v"), "s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(detect.ambiguity(ext, {"h": ["cpp", "objc"], "m": ["matlab"], "v": []}), " ").alias("others"))


def _cli(*argv: str) -> tuple[int, str]:
    out, err = io.StringIO(), io.StringIO()
    with contextlib.redirect_stdout(out), contextlib.redirect_stderr(err):
        code = cli.main(list(argv))
    return code, (out.getvalue() if code == 0 else err.getvalue()).strip()


def q_cli(spark, d):
    """The commands and what they print."""
    with tempfile.TemporaryDirectory() as folder:
        at = Path(folder, "a.py")
        at.write_text("import os\n\n\ndef f():\n    pass\n", encoding="utf-8")
        bad = Path(folder, "b.py")
        bad.write_bytes(b"\xff")
        rows = [("list", *_cli("list", "--filter", "script")), ("parse", *_cli("parse", str(at), "--format", "json")), ("unknown", *_cli("process", str(Path(folder, "x.nosuch")))), ("download", *_cli("download", "shell", "go"))]
        code, text = _cli("process", str(at), "--symbols", "--chunk-size", "1000")
        got = json.loads(text)
        rows.append(("process", code, f"{[s['name'] for s in got['symbols']]} {got['imports']} {len(got['chunks'])}"))
        code, text = _cli("process", str(at), "--all")
        got = json.loads(text)
        rows.append(("process all", code, f"{[s['source'] for s in got['imports']]} {[s['name'] for s in got['structure']]}"))
        rows.append(("info", 0, json.dumps({k: v for k, v in json.loads(_cli("info", "shell")[1]).items() if k != "cache_dir"})))
        rows.append(("bad bytes", _cli("process", str(bad))[0], ""))
    return spark.createDataFrame(rows, "command string, code long, out string")


def q_errors(spark, d):
    """Errors of documents by their class, a row each; the others go on."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    out = process(documents(s, "s_suppkey", F.lit("x = 1\n"), F.when(k % 3 == 0, "python").when(k % 3 == 1, "").otherwise("nosuch")), ProcessConfig().minimal())
    return out.groupBy(F.substring_index("error", ":", 1).alias("error")).agg(F.count("*").alias("n"), F.sum("total_lines").alias("total_lines"))


def q_sql_functions(spark, d):
    """Detection by SQL functions."""
    sql.register(spark)
    path = join("dir_", F.col("p_partkey") % 7, "/file_", F.col("p_partkey"), ".", _cycle(EXTENSIONS, "p_partkey"))
    table(spark, d, "part").select("p_partkey", path.alias("path")).createOrReplaceTempView("tessera_paths")
    return spark.sql("SELECT p_partkey, tessera_path(path) AS by_path, tessera_detect('x', concat('#!/usr/bin/env python3.', p_partkey, '\\n')) AS by_text, tessera_alias('shell') AS alias FROM tessera_paths")


def q_sql_tables(spark, d):
    """Structure, data and chunks by table functions."""
    sql.register(spark)
    s = table(spark, d, "supplier")
    s.select("s_suppkey", join("class C", F.col("s_suppkey"), ":\n    pass\n").alias("source"), join('{"k": ', F.col("s_suppkey"), "}").alias("doc")).createOrReplaceTempView("tessera_sources")
    return spark.sql("""
SELECT s_suppkey, 'structure' AS what, t.kind AS kind, t.name AS value FROM tessera_sources, LATERAL tessera_structure(source, 'python') t
UNION ALL SELECT s_suppkey, 'data', t.key, t.value FROM tessera_sources, LATERAL tessera_data(doc, 'json') t WHERE t.key IS NOT NULL
UNION ALL SELECT s_suppkey, 'chunk', t.symbols_defined[0], trim(t.content) FROM tessera_sources, LATERAL tessera_chunks(source, 'python', 1000) t
UNION ALL SELECT s_suppkey, 'parse', t.kind, NULL FROM tessera_sources, LATERAL tessera_parse(source, 'python') t WHERE t.parent_id IS NULL""")


def q_unchanged(spark, d):
    """Documents whose content a table seen before does not have."""
    s = table(spark, d, "supplier")
    docs = documents(s, "s_suppkey", join("v", F.col("s_suppkey") % 10), "text")
    return files.unchanged(docs, docs.where(F.col("doc_id") % 10 < 4)).groupBy("content").agg(F.count("*").alias("n"))


def q_stream_windows(spark, d):
    """Events by day and type, from a stream run to its end."""
    out = run_to_end(spark, f"{d}/events.parquet", lambda s: windowed_counts(s))
    return out.select(F.col("window.start").cast("date").cast("string").alias("day"), "event_type", "n")


def q_stream_dedup(spark, d):
    """Contents of a stream, each once within the watermark."""
    first = lambda s: dedup_stream(s.select("ts", F.col("event_type").alias("content")), "ts", "3650 days")
    return run_to_end(spark, f"{d}/events.parquet", first, "append").groupBy("content").agg(F.count("*").alias("n"))


QUERIES: dict = {k: v for k, v in list(globals().items()) if k.startswith("q_") and callable(v)}

_CYCLE = lambda values, key: f"[{', '.join(repr(v) for v in values)}][({key} % {len(values)} + 1)::INT]"
ORACLE_SQL = {
    "q_read_sources": "SELECT n_nationkey::INTEGER AS nation, 'json' AS language, NULL::VARCHAR AS error, 'n_name' AS key, '\"' || n_name || '\"' AS value FROM nation UNION ALL SELECT n_nationkey, 'json', NULL, 'n_regionkey', n_regionkey::VARCHAR FROM nation",
    "q_utf8_gate": "SELECT f AS file, NULL::VARCHAR AS language, NULL::VARCHAR AS content, 'invalid UTF-8' AS error FROM (VALUES ('region.parquet'), ('nation.parquet')) v(f)",
    "q_ndjson": "SELECT 'k' AS key, count(*) AS n, count(*) AS n_docs FROM events WHERE event_id < 500",
    "q_memory_source": "SELECT 0::BIGINT AS doc_id, 'python' AS language, 2::BIGINT AS total_lines, 'import os' AS first_import",
    "q_archives": "SELECT 'data/region_' || r_regionkey || '.json' AS name, 'json' AS language, r_name AS region, r_regionkey = 0 AS asked FROM region",
    "q_manifest": "SELECT r_name AS name, r_regionkey <> 1 AS ok, length(r_name) AS size, 'file:///' || r_name AS url FROM region",
    "q_config": "SELECT * FROM (VALUES ('cache_dir', '/c \"q\"\\x'), ('languages', 'shell python'), ('groups', 'web'), ('loaded', 'go'), ('ready', 'bash css html python'), ('session', '/c \"q\"\\x')) v(name, value)",
    "q_cache": "SELECT 3::BIGINT AS first, 0::BIGINT AS again, 0::BIGINT AS missing",
    "q_download_plan": "SELECT * FROM (VALUES ('groups first', 'css html javascript'), ('names', 'bash go'), ('config', 'go json yaml'), ('nothing', ''), ('all', 'True'), ('unknown group', 'DownloadError: no such group: nosuch'), ('unknown name', 'LanguageNotFoundError: language not found: ''nosuch''')) v(asked, got)",
    "q_require": "SELECT * FROM (VALUES ('none', '0'), ('twice', '2'), ('unknown', 'DownloadError: not in the catalogue: nosuch'), ('group', 'True'), ('prefetch', '2'), ('get alias', 'make'), ('get unknown', 'LanguageNotFoundError: language not found: ''''')) v(asked, got)",
    "q_get_language": f"SELECT s_suppkey, CASE {_CYCLE(('python', 'shell', 'lisp', 'nosuch', 'json', ''), 's_suppkey')} WHEN 'python' THEN 'python' WHEN 'shell' THEN 'bash' WHEN 'lisp' THEN 'commonlisp' WHEN 'json' THEN 'json' END AS language FROM supplier",
    "q_markdown_catalog": f"SELECT s_suppkey, CASE lower({_CYCLE(('foo', 'FO', 'bar', 'py'), 's_suppkey')}) WHEN 'foo' THEN 'foo_lang' WHEN 'fo' THEN 'foo_lang' WHEN 'bar' THEN 'bar' END AS language FROM supplier",
    "q_manifest_languages": "SELECT * FROM (VALUES ('a'), ('b')) v(name)",
    "q_ambiguity": f"SELECT s_suppkey, CASE {_CYCLE(('h', 'M', 'py', 'v'), 's_suppkey')} WHEN 'h' THEN 'cpp objc' WHEN 'M' THEN 'matlab' WHEN 'v' THEN '' END AS others FROM supplier",
    "q_cli": """SELECT * FROM (VALUES ('list', 0, 'javascript' || chr(10) || 'typescript'), ('unknown', 1, 'error: no language found; give one with --language'), ('download', 0, 'bash' || chr(10) || 'go'),
('parse', 0, '{"language": "python", "sexp": "(module (import_statement) (function_definition name: (identifier) parameters: (parameters) body: (block (pass_statement))))", "has_errors": false}'),
('process', 0, '[''f''] [] 1'), ('process all', 0, '[''import os''] [''f'']'), ('info', 0, '{"name": "shell", "known": true, "backend": true}'), ('bad bytes', 1, '')) v(command, code, out)""",
    "q_errors": "SELECT CASE WHEN s_suppkey % 3 <> 0 THEN 'LanguageNotFoundError' END AS error, count(*) AS n, count(*)::BIGINT AS total_lines FROM supplier GROUP BY 1",
    "q_sql_functions": f"SELECT p_partkey, CASE {_CYCLE(EXTENSIONS, 'p_partkey')} WHEN 'py' THEN 'python' WHEN 'RS' THEN 'rust' WHEN 'js' THEN 'javascript' WHEN 'Go' THEN 'go' WHEN 'java' THEN 'java' WHEN 'app.src' THEN 'erlang' WHEN 'json' THEN 'json' END AS by_path, 'python' AS by_text, 'bash' AS alias FROM part",
    "q_sql_tables": "SELECT s_suppkey, w AS what, k || CASE WHEN w = 'chunk' THEN s_suppkey::VARCHAR ELSE '' END AS kind, CASE w WHEN 'structure' THEN 'C' || s_suppkey WHEN 'data' THEN s_suppkey::VARCHAR WHEN 'chunk' THEN 'class C' || s_suppkey || ':' || chr(10) || '    pass' || chr(10) END AS value FROM supplier, (VALUES ('structure', 'Class'), ('data', 'k'), ('chunk', 'C'), ('parse', 'module')) v(w, k)",
    "q_unchanged": "SELECT 'v' || s_suppkey % 10 AS content, count(*) AS n FROM supplier WHERE s_suppkey % 10 >= 4 GROUP BY 1",
    "q_stream_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "q_stream_dedup": "SELECT event_type AS content, 1::BIGINT AS n FROM events GROUP BY 1",
}
