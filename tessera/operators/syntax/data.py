"""Data formats and markup as trees."""

from __future__ import annotations

import re

from tessera.operators.syntax.base import Node

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][\w:.-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_RAW = {"script": "script_element", "style": "style_element"}


def parse_markup(text: str, language: str) -> Node:
    """Elements, their tags and comments; what a script or style holds is raw text."""
    html = language == "html"
    root = Node("document", 0, len(text))
    stack = [root]
    at = 0
    while m := _MARKUP.search(text, at):
        at = m.end()
        if m[2] is None:
            stack[-1].add("comment" if html else "Comment", m.start(), m.end(), extra=True)
            continue
        name = m[2].lower() if html else m[2]
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if _tag(text, stack[i], html) == name), 0)
            if depth:
                while len(stack) > depth:
                    node = stack.pop()
                    node.end = m.end() if len(stack) == depth else m.start()
                node.add("end_tag" if html else "ETag", m.start(), m.end())
            else:
                stack[-1].add("erroneous_end_tag", m.start(), m.end(), error=True)
            continue
        node = stack[-1].add(_RAW.get(name, "element") if html else "element", m.start(), m.end())
        tag = node.add("start_tag" if html else "STag", m.start(), m.end())
        tag.add("tag_name" if html else "Name", m.start(2), m.end(2))
        if html and name in _RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(text, m.end())
            stop = close.start() if close else len(text)
            if stop > m.end():
                node.add("raw_text", m.end(), stop)
            at = node.end = close.end() if close else len(text)
        elif not (m[3].endswith("/") or html and name in _VOID):
            stack.append(node)
    for node in stack[1:]:
        node.end = len(text)
    return root


def _tag(text: str, node: Node, html: bool) -> str:
    name = node.children[0].children[0]
    word = text[name.start : name.end]
    return word.lower() if html else word


_JSON = re.compile(r'(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:[^"\\\n]|\\.)*"?)|(?P<number>-?\d[\d.eE+-]*)|(?P<word>\w+)|(?P<mark>.)', re.S)
_OPEN, _CLOSE = {"{": "object", "[": "array"}, {"}": "object", "]": "array"}


def parse_json(text: str, language: str = "json") -> Node:
    """document, object, array, pair (key and value), string, number, true, false and null; marks are anonymous."""
    root = Node("document", 0, len(text))
    stack = [root]

    def settle(end: int) -> None:
        """A pair ends with its value."""
        if stack[-1].kind == "pair" and any(c.field == "value" for c in stack[-1].children):
            stack.pop().end = end

    for m in _JSON.finditer(text):
        kind, at, end = m.lastgroup, m.start(), m.end()
        if kind == "space":
            continue
        top = stack[-1]
        if kind == "comment":
            top.add("comment", at, end, extra=True)
            continue
        value = "value" if top.kind == "pair" else None
        if m[0] in _OPEN:
            node = top.add(_OPEN[m[0]], at, end, field=value)
            node.add(m[0], at, end, named=False)
            stack.append(node)
        elif m[0] in _CLOSE:
            if stack[-1].kind == "pair":
                stack.pop().add("MISSING", at, at, missing=True)
            if stack[-1].kind == _CLOSE[m[0]]:
                stack[-1].add(m[0], at, end, named=False)
                stack.pop().end = end
                settle(end)
            else:
                stack[-1].add("ERROR", at, end, error=True)
        elif m[0] in ",:":
            top.add(m[0], at, end, named=False)
        elif kind in ("string", "number") or m[0] in ("true", "false", "null"):
            leaf = kind if kind in ("string", "number") else m[0]
            if top.kind == "object":
                pair = top.add("pair", at, end)
                pair.add(leaf, at, end, field="key")
                stack.append(pair)
            else:
                top.add(leaf, at, end, field=value)
                settle(end)
        else:
            top.add("ERROR", at, end, error=True)
            settle(end)
    while len(stack) > 1:
        node = stack.pop()
        node.end = len(text)
        if node.kind != "pair":
            node.add({"object": "}", "array": "]"}[node.kind], len(text), len(text), named=False, missing=True)
    return root


def parse_separated(text: str, language: str) -> Node:
    """document, row, field and text, for fields with or without quotes."""
    mark = "|" if language == "psv" else ","
    root = Node("document", 0, len(text))
    cell = re.compile(rf'"(?:[^"]|"")*"|[^{re.escape(mark)}\n]*')
    at = 0
    while at < len(text):
        if text[at] in "\r\n":
            at += 1
            continue
        row = root.add("row", at, at)
        while True:
            m = cell.match(text, at)
            node = row.add("field", at, m.end())
            if m[0]:
                node.add("text" if not m[0][0].isdigit() else "number", at, m.end())
            at = row.end = m.end()
            if text[at : at + 1] != mark:
                break
            row.add(mark, at, at + 1, named=False)
            at += 1
        line = text.find("\n", at)
        at = len(text) if line < 0 else line + 1
    return root
