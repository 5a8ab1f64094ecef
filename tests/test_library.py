"""Detection, metrics, catalogue, sources, wire form and command line."""

import json

import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.errors import DownloadError, LanguageNotFoundError
from tessera.functions import detect, sql
from tessera.functions.metrics import metric_columns
from tessera.operators import catalog, tree
from tessera.operators.process import ProcessConfig, parse_documents, process
from tessera.sources import config, files, wire


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_paths(spark):
    got = column(spark, ["src/main.rs", "Main.java", "Makefile", ".gitignore", "x.app.src", "a/b/", "..", "foo.", "a.PY/", None], detect.from_path)
    assert got == ["rust", "java", None, None, "erlang", None, None, None, "python", None]
    assert column(spark, [".gitignore", "py", "Makefile"], detect.detect) == ["gitignore", "python", None]


def test_extensions(spark):
    assert column(spark, ["RS", "xyz", "", "a" * 33, "ré"], detect.from_extension) == ["rust", None, None, None, None]


def test_shebangs(spark):
    texts = ["#!/usr/bin/env python3\n", "#!/bin/bash\n", "no", "#!/usr/bin/env -S node -x", "#!/usr/bin/env FOO=1 python", "#! /usr/bin/perl5.30", "#!", "#!/bin/awk"]
    assert column(spark, texts, detect.from_content) == ["python", "bash", None, "javascript", None, "perl", None, None]


def test_metrics(spark):
    df = spark.createDataFrame([(0, ""), (1, "a\n\n# c\n"), (2, " \n*x\r\n"), (3, None)], "i int, t string")
    got = [tuple(r)[1:] for r in df.select("i", *[c.alias(n) for n, c in metric_columns(F.col("t")).items()]).orderBy("i").collect()]
    assert got == [(0, 0, 0, 0, 0), (3, 1, 1, 1, 7), (2, 1, 1, 0, 7), (None,) * 5]


def test_catalog(spark):
    c = catalog.builtin()
    assert catalog.get_language(c, "shell") == "bash"
    for bad in ("", "nosuch"):
        with pytest.raises(LanguageNotFoundError):
            catalog.get_language(c, bad)
    langs = c.frame(spark)
    assert catalog.require(langs, []) == 0 and catalog.require(langs, ["python", "python", "shell"]) == 2
    with pytest.raises(DownloadError):
        catalog.require(langs, ["nosuch"])
    md = ["| Language | Extensions | R |", "| --- | --- | --- |", "| Emacs Lisp | `.el` | x |", "| Git Config | — | y |"]
    assert catalog.load_markdown(md).extensions == {"elisp": ("el",), "git_config": ()}


def test_process_nulls_and_errors(spark):
    docs = spark.createDataFrame([(1, None, "python"), (2, "x = 1\n", ""), (3, "x = 1\n", "nosuch"), (4, "", "json")], "doc_id long, content string, language string")
    got = {r.doc_id: r for r in process(docs, ProcessConfig().with_data_extraction()).collect()}
    assert got[1].error is None and got[1].total_bytes == 0
    assert "LanguageNotFoundError" in got[2].error and "LanguageNotFoundError" in got[3].error
    assert got[4].data[0].kind == "KeyValue"
    assert process(docs.limit(0)).count() == 0
    with pytest.raises(Exception, match="LanguageNotFoundError"):
        process(docs, mode="failfast").count()
    assert parse_documents(docs).where("doc_id = 1").count() == 1


def test_wire(spark):
    docs = spark.createDataFrame([(1, "import os\n", "python")], "doc_id long, content string, language string")
    got = json.loads(wire.to_wire(process(docs)).first().wire)
    assert got["metrics"]["total_lines"] == 1 and "exports" not in got and got["imports"][0]["source"] == "import os"
    assert wire.to_camel("start_byte") == "startByte" and wire.to_snake("startByte") == "start_byte" and wire.to_snake("Xy") == "Xy"
    df = wire.rename_keys(process(docs).select("doc_id", "imports"), wire.to_camel)
    assert df.columns == ["docId", "imports"] and "isWildcard" in df.schema["imports"].dataType.elementType.names


def test_files(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "b.rs").write_bytes(b"\xff\xfe")
    got = {r.path.rsplit("/", 1)[1]: (r.language, r.content, r.error) for r in files.read_sources(spark, str(tmp_path)).collect()}
    assert got == {"a.py": ("python", "x = 1\n", None), "b.rs": ("rust", None, "invalid UTF-8")}


@pytest.mark.parametrize("folder", ["/c", 'C:\\a "b"', "é\n\x7f"])
def test_config(tmp_path, folder):
    config.write(tmp_path / config.FILE, config.PackConfig(folder, ["python"], []))
    (tmp_path / "x" / "y").mkdir(parents=True)
    assert config.discover(tmp_path / "x" / "y") == config.PackConfig(folder, ["python"], [])


def test_sql_functions_as_columns(spark):
    """The SQL functions and the native expressions are two forms of one thing."""
    sql.register(spark)
    paths = ["src/main.rs", "a.PY/", ".gitignore", "..", "x.APP.src", "foo.", "a b.json", "", None, "x.tar.gz"]
    texts = ["#!/usr/bin/env -S node -x\n", "#! /usr/bin/perl5.30", "#!", "no", "", None, "#!/usr/bin/env FOO=1 python", "#!/bin/sh\nx"]
    for values, name, expression in ((paths, "tessera_path", detect.from_path), (texts, "tessera_shebang", detect.from_content)):
        df = spark.createDataFrame([(x,) for x in values], "x string")
        got = df.select(F.expr(f"{name}(x)").alias("a"), expression(F.col("x")).alias("b")).collect()
        assert [r.a for r in got] == [r.b for r in got] and any(r.a for r in got)


def test_broken_archives(spark, tmp_path):
    """Members before a break are read; what is no archive gives none."""
    import tarfile

    (tmp_path / "m.py").write_text("x = 1\n")
    with tarfile.open(tmp_path / "a.tar", "w") as t:
        t.add(tmp_path / "m.py", "m.py")
        t.add(tmp_path / "m.py", "n.txt")
    whole = (tmp_path / "a.tar").read_bytes()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tar").write_bytes(whole)
    (tmp_path / "in" / "b.tar").write_bytes(whole[:700])
    (tmp_path / "in" / "c.tar").write_bytes(b"no archive")
    got = files.read_archives(spark, str(tmp_path / "in")).collect()
    assert sorted((r.name, bytes(r.content), r.language) for r in got)[:1] == [("m.py", b"x = 1\n", "python")] and {r.name for r in got} == {"m.py", "n.txt"}


def test_cli(tmp_path, capsys):
    f = tmp_path / "a.py"
    f.write_text("def f():\n    pass\n")
    assert cli.main(["parse", str(f)]) == 0 and "function_definition" in capsys.readouterr().out
    assert cli.main(["process", str(f), "--symbols"]) == 0
    out = json.loads(capsys.readouterr().out)
    assert [s["name"] for s in out["symbols"]] == ["f"] and not out["structure"]
    assert cli.main(["process", str(tmp_path / "no.xyz")]) == 1


def test_parents_broadcast_no_nodes(spark, tmp_path):
    """Spark guesses the size of parsed nodes from that of their texts; a broadcast of them took the driver's memory."""
    spark.range(3).selectExpr("id as doc_id", """'{"a": {"b": [1]}}' as content""", "'json' as language").write.parquet(f"{tmp_path}/docs")
    nodes = parse_documents(spark.read.parquet(f"{tmp_path}/docs"))
    found = tree.parents(nodes)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    by_id = {(r.doc_id, r.node_id): r for r in nodes.collect()}
    want = {(r.doc_id, r.node_id, r.parent_id, by_id[r.doc_id, r.parent_id].kind) for r in by_id.values() if r.parent_id is not None}
    got = found.collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
