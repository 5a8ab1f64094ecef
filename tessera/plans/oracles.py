"""DuckDB SQL for the queries of this package, by another way than the operators where there is one."""

from __future__ import annotations

from tessera.functions.detect import COMPOUND, INTERPRETERS
from tessera.operators.catalog import C_SYMBOLS, builtin
from tessera.plans.queries import EXTENSIONS, NAMES, PROGRAMS


def _s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(_s(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


_EXT = f"ext(e, l) AS (VALUES {_values(sorted(builtin().by_extension.items()))})"
_CYCLE = lambda values, key: f"[{', '.join(map(_s, values))}][({key} % {len(values)} + 1)::INT]"
#: Spelled out here, not taken from the operators.
_BACKENDS = "bash c cpp csharp csv css cue dtd editorconfig elixir go hcl hocon html ini java javascript json json5 kdl kotlin nginx php po properties psv python ruby rust scala swift toml tsx typescript xml yaml".split()
_TARGETS = {"bazel": "starlark", "gradle": "groovy", "ignorefile": "gitignore", "lisp": "commonlisp", "makefile": "make", "shell": "bash"}
_LANGS = f"langs(name) AS (VALUES {_values([(n,) for n in builtin().extensions])})"
_ALIASES = f"aliases(a, t) AS (VALUES {_values(sorted(_TARGETS.items()))})"
_ASKED = f"asked(name) AS (VALUES {_values([(n,) for n in NAMES])})"
_ALL = f"{_LANGS}, {_ALIASES}, everything AS (SELECT name FROM langs UNION SELECT a FROM aliases JOIN langs ON t = name)"


def _lines(text: str) -> str:
    return f"CASE WHEN {text} = '' THEN []::VARCHAR[] ELSE string_split(regexp_replace({text}, '\\n$', ''), chr(10)) END"


def _metrics(text: str) -> str:
    ls = _lines(text)
    blank = f"len(list_filter({ls}, lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) = ''))"
    comment = f"len(list_filter({ls}, lambda x: regexp_matches(x, '^\\s*(//|#|/\\*|\\*)')))"
    return f"len({ls})::BIGINT AS total_lines, {blank}::BIGINT AS blank_lines, {comment}::BIGINT AS comment_lines, greatest(0, len({ls}) - {blank} - {comment})::BIGINT AS code_lines, strlen({text})::BIGINT AS total_bytes"


_SUMS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in ("total_lines", "blank_lines", "comment_lines", "code_lines", "total_bytes"))


def _roundtrip(source: str, key: str, *leaves: tuple[str, int, str, str]) -> str:
    """Leaves: parent key, ordinal, key and value, each as SQL."""
    return " UNION ALL ".join(f"SELECT {key}::BIGINT AS doc_id, {p} AS parent_key, {o}::INTEGER AS ordinal, {k} AS key, {v} AS value FROM {source}" for p, o, k, v in leaves)


_NULL = "NULL::VARCHAR"
_Q = lambda c: f"'\"' || {c} || '\"'"
_SUPPLIER = ("supplier", "s_suppkey")
_PROGRAM = f"m(p, l) AS (VALUES {_values(sorted(INTERPRETERS.items()))})"
_BASE = lambda p: f"regexp_replace({p}, '\\.?[0-9].*$', '')"
assert COMPOUND == {".app.src": "erlang"}
_LAST = "regexp_extract({}, '[^.]*$')"
_BY_EXT = lambda e: f"(SELECT l FROM ext WHERE e = lower({e}) AND strlen({e}) <= 32)"

ORACLE_SQL = {
    "q_flagship": f"SELECT lang, count(*) AS n_docs, sum(total_lines)::BIGINT AS total_lines, sum(total_bytes)::BIGINT AS total_bytes, sum(total_bytes)::BIGINT AS chunked_bytes FROM (SELECT lang, {_metrics('text')} FROM documents) GROUP BY lang",
    "q_line_metrics": f"SELECT doc_id, {_metrics('text')} FROM documents",
    "q_line_metrics_by_lang": f"SELECT lang, count(*) AS n_docs, {_SUMS} FROM (SELECT lang, {_metrics('text')} FROM documents) GROUP BY lang",
    "q_bytes": f"SELECT page_id, total_bytes, total_lines FROM (SELECT page_id, {_metrics('html')} FROM pages)",
    "q_comment_heuristic": f"SELECT s_suppkey, {_metrics('t')} FROM (SELECT s_suppkey, '# a ' || s_name || chr(10) || chr(10) || '  // b' || chr(10) || chr(9) || '* c' || chr(10) || '/* d' || chr(10) || repeat('code' || chr(10), (s_suppkey % 5)::INT) || '   ' || chr(10) || 'last' AS t FROM supplier)",
    "q_rollup": f"SELECT lang, source, count(*) AS n_docs, sum(total_lines)::BIGINT AS total_lines, sum(total_bytes)::BIGINT AS total_bytes FROM (SELECT lang, source, {_metrics('text')} FROM documents) GROUP BY ROLLUP (lang, source)",
    "q_detect_path": f"WITH {_EXT}, p AS (SELECT page_id, regexp_extract(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)/*$', 1), '^.+\\.([^.]*)$', 1) AS e FROM pages) SELECT page_id, l AS language FROM p LEFT JOIN ext ON ext.e = lower(p.e)",
    "q_detect_synthetic": f"WITH {_EXT}, p AS (SELECT p_partkey, {_CYCLE(EXTENSIONS, 'p_partkey')} AS x FROM part) SELECT p_partkey, CASE WHEN x = 'app.src' THEN 'erlang' ELSE {_BY_EXT(_LAST.format('x'))} END AS by_path, {_BY_EXT('x')} AS by_extension FROM p",
    "q_detect_loose": f"WITH {_EXT}, p AS (SELECT s_suppkey, {_CYCLE(EXTENSIONS, 's_suppkey')} AS x, s_suppkey % 2 = 0 AS dot FROM supplier) SELECT s_suppkey, coalesce(CASE WHEN x = 'app.src' AND dot THEN 'erlang' WHEN x IN ('app.src', 'tar.gz') THEN NULL ELSE {_BY_EXT('x')} END) AS loose, CASE WHEN x = 'app.src' AND dot THEN 'erlang' END AS strict FROM p",
    "q_detect_shebang": f"WITH {_PROGRAM}, p AS (SELECT doc_id, {_CYCLE(PROGRAMS, 'doc_id')} AS x FROM documents) SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN (SELECT l FROM m WHERE p = {_BASE('x')}) WHEN doc_id % 3 = 1 AND x <> 'env' THEN (SELECT l FROM m WHERE p = {_BASE('x')}) END AS language FROM p",
    "q_detect_combined": f"WITH {_EXT}, {_PROGRAM}, p AS (SELECT doc_id, {_CYCLE(PROGRAMS, 'doc_id')} AS x, {_CYCLE(EXTENSIONS, 'doc_id')} AS y FROM documents) SELECT doc_id, coalesce(CASE WHEN y = 'app.src' THEN 'erlang' ELSE {_BY_EXT(_LAST.format('y'))} END, CASE WHEN x <> 'env' THEN (SELECT l FROM m WHERE p = {_BASE('x')}) END) AS language FROM p",
    "q_alias": f"WITH {_ALIASES}, {_ASKED} SELECT name, coalesce(t, name) AS resolved FROM asked LEFT JOIN aliases ON a = name",
    "q_c_symbol": f"WITH s(n, c) AS (VALUES {_values(sorted(C_SYMBOLS.items()))}), q(name) AS (VALUES ('csharp'), ('python'), ('vb')) SELECT name, coalesce(c, name) AS symbol, name AS back FROM q LEFT JOIN s ON n = name",
    "q_has_language": f"WITH {_LANGS}, {_ALIASES}, {_ASKED}, r AS (SELECT name, coalesce(t, name) AS q FROM asked LEFT JOIN aliases ON a = name) SELECT name, q IN (SELECT name FROM langs) AS known, q IN ({', '.join(map(_s, _BACKENDS))}) AS has_parser FROM r",
    "q_available": f"WITH {_ALL} SELECT name FROM everything",
    "q_language_count": f"WITH {_ALL} SELECT count(*) AS languages FROM everything",
    "q_list_filter": f"WITH {_ALL} SELECT name FROM everything WHERE contains(name, 'script')",
    "q_prefix_complete": f"WITH {_ALL}, f AS (SELECT name FROM everything WHERE starts_with(name, 'p')) SELECT name, (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM f) > 5 AS has_more FROM f ORDER BY name LIMIT 5",
    "q_language_info": "SELECT * FROM (VALUES ('python', true, true, ''), ('nosuch', false, false, '')) v(name, known, downloaded, cache_dir)",
    "q_downloaded": f"SELECT * FROM (VALUES {_values([(n,) for n in _BACKENDS])}) v(name)",
    "q_query_text": "SELECT * FROM (VALUES ('java', 'tags', 'o'), ('scala', 'tags', 'o'), ('shell', 'tags', NULL), ('python', 'folds', NULL)) v(language, kind, source)",
    "q_json_data": "SELECT 'k' AS key, regexp_extract(props, ': (.*)\\}', 1) AS value, count(*) AS n, 6::BIGINT AS first_start FROM events GROUP BY 2",
    "q_json_spans": "SELECT event_id AS doc_id, 1 AS depth, 0 AS ordinal, 'KeyValue' AS kind, 'k' AS key, v AS value, 6::BIGINT AS start_byte, 6 + strlen(v) AS end_byte, 0::BIGINT AS start_line, 6::BIGINT AS start_column, 0::BIGINT AS end_line, 6 + strlen(v) AS end_column FROM (SELECT event_id, regexp_extract(props, ': (.*)\\}', 1) AS v FROM events)",
    "q_json_roundtrip": _roundtrip("customer", "c_custkey", (_NULL, 0, "'c_custkey'", "c_custkey::VARCHAR"), (_NULL, 1, "'c_name'", _Q("c_name")), (_NULL, 2, "'c_nationkey'", "c_nationkey::VARCHAR"), (_NULL, 3, "'c_mktsegment'", _Q("c_mktsegment"))),
    "q_csv_roundtrip": _roundtrip("nation", "n_nationkey", ("'0'", 0, "'0'", "'key'"), ("'0'", 1, "'1'", "'name'"), ("'1'", 0, "'0'", "n_nationkey::VARCHAR"), ("'1'", 1, "'1'", "n_name")),
    "q_psv_roundtrip": _roundtrip("nation", "n_nationkey", ("'0'", 0, "'0'", "n_nationkey::VARCHAR"), ("'0'", 1, "'1'", "n_name"), ("'0'", 2, "'2'", "n_regionkey::VARCHAR")),
    "q_properties_roundtrip": _roundtrip(*_SUPPLIER, (_NULL, 0, "'name'", "s_name"), (_NULL, 1, "'nation'", "s_nationkey::VARCHAR")),
    "q_ini_roundtrip": _roundtrip(*_SUPPLIER, ("'supplier ' || s_suppkey", 0, "'name'", "s_name"), ("'supplier ' || s_suppkey", 1, "'nation'", "s_nationkey::VARCHAR")),
    "q_toml_roundtrip": _roundtrip(*_SUPPLIER, ("'supplier'", 0, "'name'", _Q("s_name")), ("'supplier'", 1, "'nation'", "s_nationkey::VARCHAR"), ("'list'", 0, "'0'", "s_suppkey::VARCHAR"), ("'list'", 1, "'1'", "'7'")),
    "q_po_roundtrip": _roundtrip(*_SUPPLIER, (_NULL, 0, "s_suppkey::VARCHAR", "s_name")),
    "q_xml_roundtrip": _roundtrip(*_SUPPLIER, ("'supplier'", 0, "'name'", "s_name")),
    "q_xml_attributes": "SELECT s_suppkey AS doc_id, 'supplier' AS element, 'id' AS name, s_suppkey::VARCHAR AS value FROM supplier UNION ALL SELECT s_suppkey, 'supplier', 'name', s_name FROM supplier",
    "q_yaml_roundtrip": _roundtrip(*_SUPPLIER, ("'supplier'", 0, "'name'", "s_name"), ("'supplier'", 1, "'nation'", "s_nationkey::VARCHAR"), ("'list'", 0, "'0'", "s_suppkey::VARCHAR"), ("'list'", 1, "'1'", "'b'")),
    "q_hcl_roundtrip": _roundtrip(*_SUPPLIER, ("'supplier.\"s' || s_suppkey || '\"'", 0, "'name'", _Q("s_name")), ("'supplier.\"s' || s_suppkey || '\"'", 1, "'nation'", "s_nationkey::VARCHAR")),
    "q_kdl_roundtrip": _roundtrip(*_SUPPLIER, (_NULL, 0, "'supplier'", "s_suppkey::VARCHAR"), ("'supplier'", 0, "'name'", _Q("s_name"))),
    "q_cue_roundtrip": _roundtrip(*_SUPPLIER, (_NULL, 0, "'name'", _Q("s_name")), (_NULL, 1, "'nation'", "s_nationkey::VARCHAR")),
    "q_nginx_roundtrip": _roundtrip(*_SUPPLIER, (_NULL, 0, "'listen'", "s_suppkey::VARCHAR"), (_NULL, 1, "'root'", "'/srv/' || s_nationkey || ' x'")),
    "q_caddy_roundtrip": _roundtrip(*_SUPPLIER, (_NULL, 0, "'root'", "'* /srv/' || s_suppkey")),
    "q_hocon_roundtrip": _roundtrip(*_SUPPLIER, (_NULL, 0, "'name'", "s_suppkey::VARCHAR"), (_NULL, 1, "'nation'", "s_nationkey::VARCHAR")),
    "q_dtd_roundtrip": _roundtrip(*_SUPPLIER, (_NULL, 0, "'s' || s_suppkey", "'<!ELEMENT s' || s_suppkey || ' (a)>'"), (_NULL, 1, "'e'", "'<!ENTITY e \"' || s_nationkey || '\">'")),
    "q_html_comments": "SELECT page_id AS doc_id, (i - 1)::INTEGER AS ordinal, c[i] AS text, 'Line' AS kind FROM (SELECT page_id, regexp_extract_all(html, '<!--.*?-->') AS c FROM pages) t, generate_series(1, len(c)) g(i)",
    "q_chunk_cover": "SELECT doc_id, strlen(text)::BIGINT AS covered, 0::BIGINT AS gaps, 0::BIGINT AS too_large, 0::BIGINT AS uncounted FROM documents WHERE text <> ''",
    "q_chunk_linenos": "SELECT doc_id, (length(text) - length(replace(text, chr(10), '')))::BIGINT AS line_ends FROM documents WHERE text <> ''",
    "q_chunk_text": "SELECT doc_id, sha256(text) AS text_sha256 FROM documents WHERE text <> ''",
    "q_chunk_lines": """
WITH d AS (SELECT s_suppkey AS doc_id, s_suppkey % 9 + 1 AS n FROM supplier),
c AS (SELECT doc_id, n, i, 33 * i AS a, CASE WHEN 11 * n + 4 - 33 * i <= 40 THEN 11 * n + 4 ELSE 33 * (i + 1) END AS b FROM d, generate_series(0, 3) g(i) WHERE i = 0 OR 11 * n + 4 - 33 * (i - 1) > 40)
SELECT doc_id, i::INTEGER AS chunk_index, a::BIGINT AS start_byte, b::BIGINT AS end_byte, (a // 11)::BIGINT AS start_line, least(b // 11, n)::BIGINT AS end_line FROM c""",
    "q_dedup_chunks": "SELECT sha256(text) AS content_sha256, count(*) AS n FROM benchmark WHERE text <> '' GROUP BY text",
    "q_py_structure": "SELECT p_partkey AS doc_id, i::INTEGER AS item_id, p::INTEGER AS parent_item_id, d::INTEGER AS depth, k AS kind, n || p_partkey AS name FROM part, (VALUES (0, NULL, 0, 'Class', 'C_'), (1, 0, 1, 'Function', 'm_'), (2, NULL, 0, 'Function', 'f_')) v(i, p, d, k, n)",
    "q_py_imports": "SELECT p_partkey AS doc_id, 0 AS ordinal, 'import mod_' || p_partkey AS source, false AS is_wildcard FROM part UNION ALL SELECT p_partkey, 1, 'from pkg_' || p_partkey || ' import *', true FROM part",
    "q_py_symbols": "SELECT p_partkey AS doc_id, i::INTEGER AS ordinal, n || p_partkey AS name, k AS kind FROM part, (VALUES (0, 'C_', 'Class'), (1, 'm_', 'Function'), (2, 'f_', 'Function')) v(i, n, k)",
    "q_py_docstrings": "SELECT p_partkey AS doc_id, 0 AS ordinal, '\"\"\"module ' || p_partkey || '\"\"\"' AS text, NULL::VARCHAR AS associated_item FROM part UNION ALL SELECT p_partkey, 1, '\"\"\"class ' || p_partkey || '\"\"\"', 'C_' || p_partkey FROM part",
    "q_py_comments": "SELECT p_partkey AS doc_id, 0 AS ordinal, '# note ' || p_name AS text, 'Line' AS kind, 'class_definition' AS associated_node FROM part",
    "q_js_exports": "SELECT s_suppkey AS doc_id, 0 AS ordinal, 'export function f_' || s_suppkey || '() {' AS name, 'Named' AS kind FROM supplier UNION ALL SELECT s_suppkey, 1, 'export { a } from \"./m_' || s_suppkey || '\";', 'ReExport' FROM supplier",
    "q_diagnostics": "SELECT p_partkey AS doc_id, (p_partkey % 7 = 0)::BIGINT AS error_count, (p_partkey % 7 = 0)::BIGINT AS diagnostics FROM part",
    "q_process_error": "SELECT s_suppkey AS doc_id, s_suppkey % 2 = 1 AS failed, CASE WHEN s_suppkey % 2 = 0 THEN 'python' ELSE 'nosuch' END AS language FROM supplier",
    "q_node_metrics": "SELECT c_custkey AS doc_id, 19::BIGINT AS node_count, 0::BIGINT AS error_count, 5::BIGINT AS max_depth FROM customer",
    "q_next_sibling": "SELECT c_custkey AS doc_id, d::INTEGER AS depth, n AS next_kind FROM customer, (VALUES (2, 'pair'), (2, NULL), (4, NULL)) v(d, n)",
    "q_ancestors": "SELECT c_custkey AS doc_id, 5::BIGINT AS n_ancestors FROM customer",
    "q_field_text": "SELECT c_custkey AS doc_id, 3 AS depth, 'number' AS kind, c_custkey::VARCHAR AS text FROM customer UNION ALL SELECT c_custkey, 3, 'string', '\"' || c_name || '\"' FROM customer",
    "q_child_counts": "SELECT c_custkey AS doc_id, 18::BIGINT AS children, 10::BIGINT AS named_children FROM customer",
    "q_top_kinds": "WITH n AS (SELECT 'comment' AS kind, sum(len(regexp_extract_all(html, '<!--.*?-->')))::BIGINT AS n FROM pages UNION ALL SELECT 'script_element', sum(len(regexp_extract_all(html, '<script[ >]')))::BIGINT FROM pages UNION ALL SELECT 'style_element', sum(len(regexp_extract_all(html, '<style[ >]')))::BIGINT FROM pages), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, kind) AS rank FROM n) SELECT * FROM r WHERE rank <= 2",
    "q_wire_json": "SELECT s_suppkey AS doc_id, 'python' AS language, 1::BIGINT AS total_lines, false AS has_imports FROM supplier",
    "q_stream_events": "SELECT 'k' AS key, count(*) AS n, count(*) AS n_values FROM events",
}
