"""Trees, record families and chunks."""

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import chunk, intel
from tessera.operators.process import ProcessConfig, process_text
from tessera.operators.syntax import parse, records
from tessera.operators.syntax.base import paths

PY = '"""mod"""\nimport os\n# hi\n@dec\nclass A(B):\n    """doc"""\n\n    def m(self):\n        return 1\n\n    async def n(self): pass\n\n\ndef f():\n    pass\n'


def families(text, language):
    d = intel.Document(text, language, parse(text, language))
    return {n: f(d) for n, f in intel.FAMILIES.items()}


def named(rows):
    return [(r["kind"], r["name"]) for r in rows]


def test_python():
    got = families(PY, "python")
    assert named(got["structure"]) == [("Class", "A"), ("Function", "m"), ("Function", "n"), ("Function", "f")]
    assert [r["parent_item_id"] for r in got["structure"]] == [None, 0, 0, None]
    assert [r["source"] for r in got["imports"]] == ["import os"]
    assert [(r["text"], r["associated_item"]) for r in got["docstrings"]] == [('"""mod"""', None), ('"""doc"""', "A")]
    assert [(r["kind"], r["associated_node"]) for r in got["comments"]] == [("Line", "decorated_definition")]
    assert not got["exports"] and not got["diagnostics"]


def test_broken_python():
    got = process_text("def half_open(a,\n    return a\n", "python", ProcessConfig().all())
    assert got["error_count"] == len(got["diagnostics"]) == 1


def test_javascript():
    got = families('import a from "b";\nexport function f(x) { return 1 }\nexport default class Z { m() {} }\nexport { q } from "w"\nconst g = (x) => { return x }\n', "javascript")
    assert [r["kind"] for r in got["exports"]] == ["Named", "Named", "ReExport"]
    assert got["exports"][0]["name"] == "export function f(x) { return 1 }"
    assert named(got["structure"])[:3] == [("Function", "f"), ("Class", "Z"), ("Method", "m")]


def test_go():
    got = families('package main\n\nimport (\n\t"fmt"\n)\n\ntype T struct {\n a int\n}\ntype I interface { M() }\nfunc (t T) M() { }\nfunc main() { }\n', "go")
    assert [r["source"] for r in got["imports"]] == ['import (\n\t"fmt"\n)', '"fmt"']
    assert named(got["structure"]) == [("Method", "M"), ("Function", "main")]
    assert named(got["symbols"]) == [("Type", "T"), ("Interface", "I"), ("Function", "main")]


def test_java_kotlin_rust_ruby_elixir():
    assert named(families("package a.b;\npublic class A {\n  int f(int y) { return y; }\n}\n", "java")["structure"]) == [("Module", "a.b"), ("Class", "A"), ("Method", "f")]
    assert named(families("package a.b\nclass A {\n  fun f(): Int = 1\n}\n", "kotlin")["structure"])[:2] == [("Module", "a.b"), ("Class", "A")]
    assert named(families("struct S { a: u8 }\nimpl S { fn new() {} }\n", "rust")["structure"]) == [("Struct", "S"), ("Impl", "S"), ("Function", "new")]
    assert named(families("module M\n  class A\n    def m; end\n    def self.s; end\n  end\nend\n", "ruby")["structure"]) == [("Module", "M"), ("Class", "A"), ("Method", "m"), ("Method", "s")]
    got = families("defmodule A do\n  use X\n  defstruct [:a]\n  defp g(y), do: y\n  defmacro m(z) do\n    quote do\n      def q(), do: 1\n    end\n  end\nend\n", "elixir")
    assert [(r["kind"], r["kind_other"], r["name"], r["visibility"]) for r in got["structure"]] == [("Module", None, "A", None), ("Struct", None, None, None), ("Function", None, "g", "private"), ("Other", "Macro", "m", "public")]
    assert [r["source"] for r in got["imports"]] == ["use X"]


def test_chunk_metadata():
    """Kinds of the top level, named or not, in the order they come; errors of all chunks that a broken node overlaps."""
    text = "import os\n" + "def f():\n    return 1\n" * 3
    d = intel.Document(text, "python", parse(text, "python"))
    one = chunk.chunks(d, 10_000)
    assert len(one) == 1 and one[0]["node_types"] == ["module", "import_statement", "function_definition"] and one[0]["symbols_defined"] == ["f"] * 3
    many = chunk.chunks(d, 25)
    assert len(many) > 2 and not any("module" in c["node_types"] for c in many) and sum("f" in c["symbols_defined"] for c in many) >= 3
    inner = chunk.chunks(d, 12)
    assert any(c["context_path"] == ["f"] for c in inner)
    whole = intel.Document("# a\nx = 1\n", "python", parse("# a\nx = 1\n", "python"))
    assert chunk.chunks(whole, 100)[0]["comments"][0]["associated_node"] == "expression_statement"


@settings(max_examples=100, deadline=None)
@given(st.sampled_from(sorted(records.KINDS)), st.text(alphabet="{}[]<>=:;,|#\"'/-\n\t abé1", max_size=60))
def test_record_trees(language, text):
    nodes = parse(text, language)
    for n in nodes[1:]:
        assert nodes[n.parent].start <= n.start <= n.end <= nodes[n.parent].end
    assert not any(n.error for n in nodes)


def test_ancestor_paths():
    nodes = parse('{"a": [1]}', "json")
    above = paths(nodes)
    for i, n in enumerate(nodes):
        assert len(above[i]) == n.depth and all(nodes[a].subtree_last >= i for a in above[i])


def test_sexp():
    assert intel.to_sexp(parse('{"a": 1}', "json")) == "(document (object (pair key: (string) value: (number))))"


@settings(max_examples=120, deadline=None)
@given(st.sampled_from(["bash", "php", "css", "csharp", "python", "javascript", "rust", "ruby", "elixir", "html", "json", "csv", "c", "text"]), st.text(alphabet="{}()[]<>:;,=@#/*\"'\n\t defclasimport12é😀", max_size=80), st.integers(1, 30))
def test_trees_and_chunks_of_any_text(language, text, most):
    nodes = parse(text, language)
    for i, n in enumerate(nodes):
        assert n.parent < i and i <= n.subtree_last < len(nodes)
    d = intel.Document(text, language, nodes)
    assert len(intel.diagnostics(d)) == sum(n.error or n.missing for n in nodes)
    data = text.encode()
    got = chunk.chunks(d, most)
    assert b"".join(data[c["start_byte"] : c["end_byte"]] for c in got) == data
    for c in got:
        assert c["end_byte"] - c["start_byte"] <= most or len(c["content"]) == 1
        assert c["start_line"] == data[: c["start_byte"]].count(b"\n") and c["end_line"] == data[: c["end_byte"]].count(b"\n")


def test_split_edges():
    assert chunk.split("abc🍏🍏d".encode(), 5) == [(0, 3), (3, 7), (7, 12)]
    assert chunk.split(b"", 5) == [] and chunk.split(b"ab", 0) == []
    assert chunk.split(b"ab", 5) == [(0, 2)]


def test_config():
    c = ProcessConfig()
    assert (c.structure, c.imports, c.exports, c.comments, c.chunk_max_size, c.data_extraction) == (True, True, True, False, None, False)
    assert c.with_chunking(9).all().chunk_max_size == 9 and not c.minimal().structure and c.all().symbols
