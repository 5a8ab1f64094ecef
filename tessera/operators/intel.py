"""Record families of one document, from the nodes of its tree: structure, imports, exports, comments, docstrings, symbols, diagnostics."""

from __future__ import annotations

import re

from tessera.operators.formats import Places
from tessera.operators.syntax import Node

#: Node kinds of structure items; some for one language only.
STRUCTURE = {
    "function_definition": "Function",
    "function_declaration": "Function",
    "function_item": "Function",
    "arrow_function": "Function",
    "method_definition": "Method",
    "method_declaration": "Method",
    "class_definition": "Class",
    "class_declaration": "Class",
    "class": "Class",
    "struct_item": "Struct",
    "struct_definition": "Struct",
    "struct_declaration": "Struct",
    "interface_declaration": "Interface",
    "interface_definition": "Interface",
    "enum_item": "Enum",
    "enum_definition": "Enum",
    "enum_declaration": "Enum",
    "module_definition": "Module",
    "mod_item": "Module",
    "package_header": "Module",
    "package_declaration": "Module",
    "trait_item": "Trait",
    "impl_item": "Impl",
}
RUBY_STRUCTURE = {"method": "Method", "singleton_method": "Method", "module": "Module"}
#: Node kinds of symbols.
SYMBOLS = {
    "function_definition": "Function",
    "function_declaration": "Function",
    "function_item": "Function",
    "class_definition": "Class",
    "class_declaration": "Class",
    "type_alias_declaration": "Type",
    "type_item": "Type",
    "interface_declaration": "Interface",
    "enum_item": "Enum",
    "enum_declaration": "Enum",
    "const_item": "Constant",
    "const_declaration": "Constant",
    "let_declaration": "Variable",
    "variable_declaration": "Variable",
    "lexical_declaration": "Variable",
}
#: Import statements by language.
IMPORTS = {
    "python": ("import_statement", "import_from_statement"),
    "javascript": ("import_statement",),
    "typescript": ("import_statement",),
    "tsx": ("import_statement",),
    "rust": ("use_declaration",),
    "go": ("import_declaration", "import_spec"),
    "java": ("import_declaration",),
    "kotlin": ("import_declaration",),
}
COMMENTS = ("comment", "line_comment", "block_comment", "doc_comment", "documentation_comment")
DOC_MARKS = ("///", "//!", "/**", "/*!", "##")
#: Elixir calls that define, and those that import.
ELIXIR = {"defmodule": ("Module", None), "defprotocol": ("Interface", None), "defimpl": ("Impl", None), "defstruct": ("Struct", None), "def": ("Function", "public"), "defdelegate": ("Function", "public"), "defguard": ("Function", "public"), "defp": ("Function", "private"), "defguardp": ("Function", "private"), "defmacro": ("Other", "public"), "defmacrop": ("Other", "private")}
ELIXIR_IMPORTS = ("import", "alias", "require", "use")


class Document:
    """A text with its nodes and the lookups that families need."""

    def __init__(self, text: str, language: str, nodes: list[Node]) -> None:
        self.text, self.language, self.nodes = text, language, nodes
        self.places = Places(text)
        self.kids: list[list[int]] = [[] for _ in nodes]
        for i, n in enumerate(nodes):
            if n.parent >= 0:
                self.kids[n.parent].append(i)

    def source(self, i: int) -> str:
        return self.text[self.nodes[i].start : self.nodes[i].end]

    def child(self, i: int, field: str) -> int | None:
        return next((k for k in self.kids[i] if self.nodes[k].field == field), None)

    def span(self, i: int) -> tuple:
        return self.places.span(self.nodes[i].start, self.nodes[i].end)

    def next_named(self, i: int) -> str | None:
        p = self.nodes[i].parent
        if p < 0:
            return None
        return next((self.nodes[k].kind for k in self.kids[p] if k > i and self.nodes[k].named), None)

    def in_quote(self, i: int) -> bool:
        while (i := self.nodes[i].parent) >= 0:
            t = self.child(i, "target")
            if t is not None and self.source(t) == "quote":
                return True
        return False


def _name(d: Document, i: int) -> str | None:
    at = d.child(i, "name")
    for kind in ("type_identifier", "identifier", "scoped_identifier"):
        if at is None:
            at = next((k for k in d.kids[i] if d.nodes[k].kind == kind and d.nodes[k].named), None)
    return d.source(at) or None if at is not None else None


def _elixir(d: Document, i: int) -> tuple | None:
    """(kind, other, name, visibility, body) of a defining call."""
    target = d.child(i, "target")
    if d.nodes[i].kind != "call" or target is None or d.source(target) not in ELIXIR:
        return None
    word = d.source(target)
    kind, visibility = ELIXIR[word]
    args = next((d.source(k) for k in d.kids[i] if d.nodes[k].kind == "arguments"), "")
    body = next((k for k in d.kids[i] if d.nodes[k].kind == "do_block"), None)
    args = args.strip().removeprefix("(").removesuffix(")") if args.startswith("(") and args.endswith(")") else args
    name = None
    if kind in ("Module", "Interface", "Impl"):
        m = re.match(r"[A-Za-z_][\w.]*", args)
        name = m[0] if m else None
    elif kind != "Struct":
        m = re.match(r"([a-z_]\w*[?!]?)\s*(?:\(|,|$|when\b|\s+do\b|\s*do:)", args) or re.match(r"([a-z_]\w*[?!]?)\Z", args)
        name = m[1] if m else None
    return kind, "Macro" if kind == "Other" else None, name, visibility, None if kind == "Struct" else body


def structure(d: Document) -> list[dict]:
    """Items in pre-order, with item_id and parent_item_id; what a matched node has below it is searched in its body only."""
    out: list[dict] = []
    stack: list[tuple[int, int, int]] = [(0, -1, 0)] if d.nodes else []
    ordinals: dict[int, int] = {}
    while stack:
        i, parent, depth = stack.pop()
        n = d.nodes[i]
        found = None
        if d.language == "elixir":
            target = d.child(i, "target")
            if n.kind == "call" and target is not None and d.source(target) == "quote":
                continue
            if got := _elixir(d, i):
                kind, other, name, visibility, body = got
                found = kind, other, name, visibility, body
        else:
            kind = STRUCTURE.get(n.kind) or (RUBY_STRUCTURE.get(n.kind) if d.language == "ruby" else None)
            if kind and not (n.kind == "module" and d.language != "ruby"):
                found = kind, None, _name(d, i), None, d.child(i, "body")
        if found is None:
            stack += [(k, parent, depth) for k in reversed(d.kids[i])]
            continue
        kind, other, name, visibility, body = found
        ordinal = ordinals[parent] = ordinals.get(parent, -1) + 1
        me = len(out)
        out.append({"item_id": me, "parent_item_id": None if parent < 0 else parent, "depth": depth, "ordinal": ordinal, "kind": kind, "kind_other": other, "name": name, "visibility": visibility, "span": d.span(i), "body_span": d.span(body) if body is not None else None})
        if body is not None:
            stack += [(k, me, depth + 1) for k in reversed(d.kids[body])]
    return out


def imports(d: Document) -> list[dict]:
    out = []
    for i, n in enumerate(d.nodes):
        if d.language == "elixir":
            t = d.child(i, "target") if n.kind == "call" else None
            if t is not None and d.source(t) in ELIXIR_IMPORTS and not d.in_quote(i):
                out.append({"source": d.source(i), "is_wildcard": False, "span": d.span(i)})
        elif n.kind in IMPORTS.get(d.language, ()):
            out.append({"source": d.source(i), "is_wildcard": "*" in d.source(i), "span": d.span(i)})
    return out


def exports(d: Document) -> list[dict]:
    if d.language not in ("javascript", "typescript", "tsx"):
        return []
    kind = lambda i: "Default" if d.child(i, "default") is not None else "ReExport" if d.child(i, "source") is not None else "Named"
    return [{"name": d.source(i).split("\n", 1)[0].removesuffix("\r"), "kind": kind(i), "span": d.span(i)} for i, n in enumerate(d.nodes) if n.kind == "export_statement"]


def comments(d: Document) -> list[dict]:
    out = []
    for i, n in enumerate(d.nodes):
        if n.kind in COMMENTS:
            text = d.source(i)
            kind = "Doc" if n.kind in ("doc_comment", "documentation_comment") else "Block" if n.kind == "block_comment" else "Doc" if text.startswith(DOC_MARKS) else "Line"
            out.append({"text": text, "kind": kind, "span": d.span(i), "associated_node": d.next_named(i)})
    return out


def docstrings(d: Document) -> list[dict]:
    """Python only: every statement that is a string, in a module or block."""
    if d.language != "python":
        return []
    out = []
    for i, n in enumerate(d.nodes):
        first = d.kids[i][0] if d.kids[i] else None
        if n.kind != "expression_statement" or first is None or d.nodes[first].kind not in ("string", "concatenated_string") or n.parent < 0 or d.nodes[n.parent].kind not in ("block", "module"):
            continue
        up = d.nodes[n.parent].parent
        name = d.child(up, "name") if up >= 0 else None
        out.append({"text": d.source(first), "format": "PythonTripleQuote", "format_other": None, "span": d.span(first), "associated_item": d.source(name) if name is not None else None})
    return out


def symbols(d: Document) -> list[dict]:
    out = []
    for i, n in enumerate(d.nodes):
        kind = SYMBOLS.get(n.kind)
        if n.kind == "type_spec":
            t = d.child(i, "type")
            kind = "Interface" if t is not None and d.nodes[t].kind == "interface_type" else "Type"
        name = d.child(i, "name") if kind else None
        if name is not None:
            t = d.child(i, "type")
            out.append({"name": d.source(name), "kind": kind, "kind_other": None, "span": d.span(i), "type_annotation": d.source(t) if t is not None else None})
    return out


def diagnostics(d: Document) -> list[dict]:
    """One for each error or missing node."""
    out = []
    for i, n in enumerate(d.nodes):
        if n.error:
            out.append({"message": f"Syntax error: unexpected '{d.source(i)}'", "severity": "Error", "span": d.span(i)})
        elif n.missing:
            out.append({"message": f"Missing expected node: {n.kind}", "severity": "Error", "span": d.span(i)})
    return out


FAMILIES = {"structure": structure, "imports": imports, "exports": exports, "comments": comments, "docstrings": docstrings, "symbols": symbols, "diagnostics": diagnostics}


def to_sexp(nodes: list[Node]) -> str:
    """The named nodes as an S-expression, with fields."""
    out: list[str] = []
    depth = -1
    levels: list[int] = []
    for n in nodes:
        level = 0 if n.parent < 0 else levels[n.parent] + nodes[n.parent].named
        levels.append(level)
        if not (n.named or n.missing):
            continue
        out.append(")" * (depth - level + 1) if level <= depth else "")
        text = f"(MISSING {n.kind}" if n.missing else f"({n.kind}"
        out.append((" " if len(out) > 1 else "") + (f"{n.field}: " if n.field else "") + text)
        depth = level
    return "".join(out) + ")" * (depth + 1)
