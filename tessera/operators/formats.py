"""Position-keeping readers of data formats.

Each reader takes a text and an Out and puts down its nodes in pre-order. Values are source text as it stands, never typed;
places are code points here and become bytes in rows(). No reader recurses, so depth is bounded by memory alone, and none fails
on malformed text: what does not fit is passed over.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_VALUE, SEQUENCE, ELEMENT = "KeyValue", "Sequence", "Element"


@dataclass
class Item:
    kind: str
    key: str | None
    value: str | None
    start: int
    end: int
    depth: int
    parent: int
    attributes: list[tuple[str, str, int, int]] = field(default_factory=list)


class Out:
    """Nodes in pre-order; open() makes one the parent of what follows until close()."""

    def __init__(self) -> None:
        self.items: list[Item] = []
        self.stack: list[int] = []

    def leaf(self, kind: str, key: str | None, value: str | None, start: int, end: int) -> Item:
        item = Item(kind, key, value, start, end, len(self.stack), self.stack[-1] if self.stack else -1)
        self.items.append(item)
        return item

    def open(self, kind: str, key: str | None, start: int, end: int = -1) -> Item:
        item = self.leaf(kind, key, None, start, end)
        self.stack.append(len(self.items) - 1)
        return item

    def close(self, end: int) -> None:
        self.items[self.stack.pop()].end = end

    @property
    def top(self) -> Item:
        return self.items[self.stack[-1]]


def strip_quotes(text: str) -> str:
    """Without one pair of equal quotes around it; a lone quote stays."""
    text = text.strip()
    return text[1:-1] if len(text) >= 2 and text[0] == text[-1] and text[0] in "\"'" else text


def strip_quotes_column(text: Column) -> Column:
    """strip_quotes() as a native expression."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    quoted = bare.rlike(r"""(?s)^("(.*)"|'(.*)')$""")
    return F.when(quoted, F.substr(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare)


# JSON and its relatives

_JSON = re.compile(
    r"""(?P<space>[\s﻿]+)|(?P<comment>//[^\n]*|\#[^\n]*|/\*.*?(?:\*/|\Z))|(?P<triple>'''.*?(?:'''|\Z))"""
    r"""|(?P<string>"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?)|(?P<mark>[{}\[\],:])|(?P<word>[^\s{}\[\],:"']+)""",
    re.S,
)
_NUMBER = re.compile(r"[+-]?(?:0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|Infinity|NaN)\Z")


def json(text: str, out: Out, loose: bool = False) -> None:
    """Objects, arrays, pairs and scalars. Comments take an index in an array; so does a value of no known kind."""
    counts: list[int] = []
    key: str | None = None
    colon = seen = False
    for m in _JSON.finditer(text):
        kind, at, end = m.lastgroup, m.start(), m.end()
        if kind == "space" or seen and not out.stack:
            continue
        inside = out.top if out.stack else None
        array = inside is not None and inside.kind == SEQUENCE
        if kind == "comment":
            if array:
                counts[-1] += 1
        elif m[0] in ("{", "["):
            name = str(counts[-1]) if array else key
            out.open(KEY_VALUE if m[0] == "{" else SEQUENCE, name, at)
            counts.append(0)
            key, colon, seen = None, False, True
        elif m[0] in ("}", "]"):
            if out.stack:
                out.close(end)
                counts.pop()
                if out.stack and out.top.kind == SEQUENCE:
                    counts[-1] += 1
            key, colon = None, False
        elif m[0] == ",":
            key, colon = None, False
        elif m[0] == ":":
            colon = True
        elif inside is not None and not array and not colon:
            key = strip_quotes(m[0]) if kind in ("string", "triple") else m[0]
        else:
            known = kind in ("string", "triple") or loose or m[0] in ("true", "false", "null") or _NUMBER.match(m[0])
            if known:
                out.leaf(KEY_VALUE, str(counts[-1]) if array else key, m[0], at, end)
                seen = True
            if array:
                counts[-1] += 1
            key, colon = None, False
    while out.stack:
        out.close(len(text))
    if not out.items:
        out.leaf(KEY_VALUE, None, None, 0, len(text))


def json_loose(text: str, out: Out) -> None:
    json(text, out, loose=True)


# TOML

_TOML_VALUE = re.compile(r'"""(?:[^\\]|\\.)*?"{3,5}|\'\'\'.*?\'{3,5}|"(?:[^"\\\n]|\\.)*"|\'[^\'\n]*\'', re.S)
_TOML_SKIP = re.compile(r"(?:[ \t\r\n]+|#[^\n]*)*")
_TOML_KEY = re.compile(r"""(?:[A-Za-z0-9_-]+|"(?:[^"\\\n]|\\.)*"|'[^'\n]*')(?:[ \t]*\.[ \t]*(?:[A-Za-z0-9_-]+|"(?:[^"\\\n]|\\.)*"|'[^'\n]*'))*""")
_TOML_BARE = re.compile(r"[^\s,\]}#]+(?:[ ]\d\d:[^\s,\]}#]+)?")


def _toml_values(text: str, at: int, key: str, out: Out) -> int:
    """The value at `at` with all that is in it; returns where it ends."""
    base = len(out.stack)
    counts: list[int] = []
    name: str | None = key
    while True:
        if m := _TOML_VALUE.match(text, at) or _TOML_BARE.match(text, at):
            if text[at] not in "[{":
                out.leaf(KEY_VALUE, name, m[0], at, m.end())
                at, name = m.end(), None
        if at < len(text) and text[at] in "[{" and name is not None:
            out.open(SEQUENCE if text[at] == "[" else KEY_VALUE, name, at)
            counts.append(0)
            at, name = at + 1, None
        elif name is not None:
            return at
        while True:
            if len(out.stack) == base:
                return at
            at = _TOML_SKIP.match(text, at).end()
            if at >= len(text):
                while len(out.stack) > base:
                    out.close(at)
                return at
            if text[at] in "]}":
                out.close(at + 1)
                counts.pop()
                at += 1
                continue
            if text[at] == ",":
                at += 1
                continue
            break
        if out.top.kind == SEQUENCE:
            name, counts[-1] = str(counts[-1]), counts[-1] + 1
        elif m := _TOML_KEY.match(text, at):
            name, at = m[0], _TOML_SKIP.match(text, m.end()).end()
            if text[at : at + 1] == "=":
                at = _TOML_SKIP.match(text, at + 1).end()
        else:
            at += 1
            continue


def toml(text: str, out: Out) -> None:
    out.open(KEY_VALUE, None, 0)
    at, table, last = 0, False, 0
    while (at := _TOML_SKIP.match(text, at).end()) < len(text):
        if text[at] == "[":
            if table:
                out.close(last)
            many = text.startswith("[[", at)
            m = _TOML_KEY.match(text, _TOML_SKIP.match(text, at + 1 + many).end())
            close = text.find("]]" if many else "]", m.end() if m else at)
            end = len(text) if close < 0 else close + 1 + many
            if m:
                out.open(SEQUENCE if many else KEY_VALUE, m[0], at)
            table, at, last = bool(m), end, end
        elif m := _TOML_KEY.match(text, at):
            after = re.compile(r"[ \t]*").match(text, m.end()).end()
            if text[after : after + 1] == "=":
                value = re.compile(r"[ \t]*").match(text, after + 1).end()
                if value >= len(text) or text[value] in "\r\n#":
                    out.leaf(KEY_VALUE, m[0], None, at, after + 1)
                    at = value
                else:
                    at = max(_toml_values(text, value, m[0], out), value + 1)
            else:
                at = m.end()
            last = at
        else:
            line = text.find("\n", at)
            at = len(text) if line < 0 else line
    if table:
        out.close(last)
    out.close(len(text))


# Line formats


def _lines(text: str):
    """(start, end) of each line, without its line end."""
    at = 0
    while at < len(text):
        end = text.find("\n", at)
        stop = len(text) if end < 0 else end
        yield at, stop - (text[at:stop].endswith("\r") and 1)
        at = stop + 1


def properties(text: str, out: Out) -> None:
    """key = value, key: value or key value; # and ! start comments, a backslash at the end of a line continues it."""
    out.open(KEY_VALUE, None, 0)
    lines = list(_lines(text))
    i = 0
    while i < len(lines):
        start, end = lines[i]
        while i + 1 < len(lines) and text[start:end].rstrip("\\") != text[start:end] and (len(text[start:end]) - len(text[start:end].rstrip("\\"))) % 2 and text[start] not in "#!":
            i += 1
            end = lines[i][1]
        i += 1
        m = re.compile(r"[ \t\f]*((?:[^=: \t\f\\]|\\.)+)(?:[ \t\f]*[=:][ \t\f]*|[ \t\f]+)?", re.S).match(text, start, end)
        if m and m[1][0] not in "#!":
            value = text[m.end() : end]
            out.leaf(KEY_VALUE, m[1], value or None, m.start(1), end)
    out.close(len(text))


def ini(text: str, out: Out) -> None:
    """[section] lines and name = value lines; # and ; start comments."""
    out.open(KEY_VALUE, None, 0)
    section, last = False, 0
    for start, end in _lines(text):
        line = text[start:end]
        body = line.strip()
        if not body or body[0] in "#;":
            continue
        at = start + line.index(body[0])
        if body[0] == "[" and "]" in body:
            if section:
                out.close(last)
            out.open(KEY_VALUE, body[1 : body.rindex("]")], at)
            section = True
        else:
            name, mark, value = re.match(r"([^=:]*)([=:]?)(.*)", body, re.S).groups()
            out.leaf(KEY_VALUE, name.strip(), value.strip() or None if mark else None, at, at + len(body))
        last = at + len(body)
    if section:
        out.close(last)
    out.close(len(text))


def _separated(text: str, out: Out, mark: str) -> None:
    out.open(SEQUENCE, None, 0)
    cell = re.compile(rf'"(?:[^"]|"")*"|[^{re.escape(mark)}\n]*')
    at, row = 0, 0
    while at < len(text):
        start, column = at, 0
        if text[at] in "\r\n":  # an empty line is no row
            at += 1
            continue
        out.open(SEQUENCE, str(row), start)
        while True:
            m = cell.match(text, at)
            value = m[0].removesuffix("\r")
            out.leaf(SEQUENCE, str(column), value, at, at + len(value))
            at, column = m.end(), column + 1
            if text[at : at + 1] != mark:
                break
            at += 1
        end = text.find("\n", at)
        stop = len(text) if end < 0 else end
        out.close(min(stop, start + len(text[start:stop].rstrip("\r"))))
        at, row = stop + 1, row + 1
    out.close(len(text))


def csv(text: str, out: Out) -> None:
    _separated(text, out, ",")


def psv(text: str, out: Out) -> None:
    _separated(text, out, "|")


def po(text: str, out: Out) -> None:
    """Messages: the first string of msgid is the key, that of msgstr the value."""
    out.open(KEY_VALUE, None, 0)
    item, key, value, start, last = None, None, None, 0, 0

    def done() -> None:
        if item:
            out.leaf(KEY_VALUE, key, value, start, last)

    for at, end in _lines(text):
        line = text[at:end]
        m = re.match(r"""\s*(msgctxt|msgid_plural|msgid|msgstr(?:\[\d+\])?)\s*(".*")?\s*$""", line)
        if m and (m[1] == "msgctxt" or m[1] == "msgid" and item != "msgctxt"):
            done()
            item, key, value, start = m[1], None, None, at
        if m:
            item = m[1]
            if m[1] == "msgid" and m[2]:
                key = strip_quotes(m[2])
            elif m[1] == "msgstr" and m[2] and value is None:
                value = strip_quotes(m[2])
        if m or line.lstrip().startswith('"'):
            last = end
    done()
    out.close(len(text))


# Block formats

_BLOCK = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|\#[^\n]*|/\*.*?(?:\*/|\Z))|(?P<heredoc><<-?(?P<tag>\w+)\n.*?\n[ \t]*(?P=tag)(?=\n|\Z))"""
    r"""|(?P<string>"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?|`[^`]*`?)|(?P<open>[{(\[])|(?P<close>[)}\]])|(?P<mark>[=:;,])|(?P<word>[^\s{}()\[\]=:;,"'`]+)""",
    re.S,
)


def _tokens(text: str) -> list[tuple[str, int, int]]:
    return [(m.lastgroup if m.lastgroup != "tag" else "heredoc", m.start(), m.end()) for m in _BLOCK.finditer(text) if m.lastgroup not in ("space", "comment")]


def _balanced(tokens: list, i: int) -> int:
    """The index after the token that closes the one at i."""
    depth = 0
    while i < len(tokens):
        depth += (tokens[i][0] == "open") - (tokens[i][0] == "close")
        i += 1
        if depth <= 0:
            break
    return i


def _expression(text: str, tokens: list, i: int) -> int:
    """The index after an expression: to the end of its line or a separator, brackets and what they hold taken together."""
    first = True
    while i < len(tokens):
        kind, at, _ = tokens[i]
        if not first and "\n" in text[tokens[i - 1][2] : at] or kind == "close" or text[at] in ";," and kind == "mark":
            break
        i = _balanced(tokens, i) if kind == "open" else i + 1
        first = False
    return i


def hcl(text: str, out: Out) -> None:
    """Attributes, and blocks named by their type and labels, joined by dots with quotes kept."""
    out.open(KEY_VALUE, None, 0)
    tokens, i = _tokens(text), 0
    while i < len(tokens):
        kind, at, end = tokens[i]
        if kind == "close":
            if len(out.stack) > 1:
                out.close(end)
            i += 1
        elif kind in ("word", "string"):
            labels, j = [], i
            while j < len(tokens) and tokens[j][0] in ("word", "string"):
                labels.append(text[tokens[j][1] : tokens[j][2]])
                j += 1
            if j < len(tokens) and text[tokens[j][1]] in "=:" and tokens[j][0] == "mark":
                stop = _expression(text, tokens, j + 1)
                last = tokens[stop - 1][2] if stop > j + 1 else tokens[j][2]
                value = text[tokens[j + 1][1] : last] if stop > j + 1 else None
                out.leaf(KEY_VALUE, labels[-1], value, tokens[j - 1][1], last)
                i = stop
            elif j < len(tokens) and text[tokens[j][1]] == "{":
                out.open(KEY_VALUE, ".".join(labels), at)
                i = j + 1
            else:
                i = j
        else:
            i += 1
    while out.stack:
        out.close(len(text))


def hocon(text: str, out: Out) -> None:
    """Pairs of the outermost object: a key and the text of its value."""
    out.open(KEY_VALUE, None, 0)
    tokens, i = _tokens(text), 0
    while i < len(tokens):
        kind, at, end = tokens[i]
        if kind in ("word", "string") and i + 1 < len(tokens) and (text[tokens[i + 1][1]] in "=:{"):
            j = i + 1 if text[tokens[i + 1][1]] == "{" else i + 2
            stop = _expression(text, tokens, j)
            last = tokens[stop - 1][2]
            out.leaf(KEY_VALUE, text[at:end], text[tokens[j][1] : last] if stop > j else None, at, last)
            i = stop
        else:
            i += 1
    out.close(len(text))


def cue(text: str, out: Out) -> None:
    """Fields: a label without quotes and the text of its value."""
    out.open(KEY_VALUE, None, 0)
    tokens, i = _tokens(text), 0
    while i < len(tokens):
        kind, at, end = tokens[i]
        if kind in ("word", "string") and i + 1 < len(tokens) and text[tokens[i + 1][1]] == ":":
            stop = _expression(text, tokens, i + 2)
            last = tokens[stop - 1][2]
            out.leaf(KEY_VALUE, strip_quotes(text[at:end]).rstrip("?!"), text[tokens[i + 2][1] : last] if stop > i + 2 else None, at, last)
            i = max(stop, i + 2)
        else:
            i += 1
    out.close(len(text))


_KDL = re.compile(
    r"""(?P<space>(?:[ \t﻿]|\\[ \t]*(?://[^\n]*)?\n)+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<line>[\r\n;])|(?P<open>\{)|(?P<close>\})|(?P<off>/-)"""
    r"""|(?P<type>\([^)\n]*\))|(?P<prop>[^\s{}()"=;/\\]+=(?:"(?:[^"\\]|\\.)*"|[^\s{};]+)|"(?:[^"\\]|\\.)*"=(?:"(?:[^"\\]|\\.)*"|[^\s{};]+))|(?P<string>r?\#*"(?:[^"\\]|\\.)*"\#*)|(?P<word>[^\s{}();"]+)""",
    re.S,
)


def kdl(text: str, out: Out) -> None:
    """Nodes: a name, the first argument as value, children in braces."""
    out.open(KEY_VALUE, None, 0)
    node: Item | None = None
    for m in _KDL.finditer(text):
        kind = m.lastgroup
        if kind in ("space", "comment", "type", "off"):
            continue
        if kind == "open":
            if node is not None:
                out.stack.append(out.items.index(node, max(0, len(out.items) - 1)))
            node = None
        elif kind == "close":
            if len(out.stack) > 1:
                out.close(m.end())
            node = None
        elif kind == "line":
            node = None
        elif node is None:
            node = out.leaf(KEY_VALUE, m[0], None, m.start(), m.end())
        else:
            if kind != "prop" and node.value is None:
                node.value = m[0]
            node.end = m.end()
    while out.stack:
        out.close(len(text))


_WORDS = re.compile(r"""(?P<comment>\#[^\n]*)|(?P<string>"(?:[^"\\]|\\.)*"?|'(?:[^'\\]|\\.)*'?)|(?P<mark>[{};\n])|(?P<word>(?:\$\{\w+\}|\{[\w.]+\}|[^\s{};"'])+)""")


def nginx(text: str, out: Out) -> None:
    """Directives that a semicolon ends; blocks of any kind are flat."""
    out.open(KEY_VALUE, None, 0)
    words: list[tuple[int, int]] = []
    for m in _WORDS.finditer(text):
        if m.lastgroup in ("word", "string"):
            words.append(m.span())
        elif m.lastgroup == "mark" and m[0] != "\n":
            if m[0] == ";" and words:
                args = [text[a:b] for a, b in words]
                out.leaf(KEY_VALUE, args[0], " ".join(args[1:]) or None, words[0][0], m.end())
            words = []
    out.close(len(text))


def caddy(text: str, out: Out) -> None:
    """Directives of the blocks of a site, a line each; nested blocks are flat. Site addresses are no directives."""
    out.open(KEY_VALUE, None, 0)
    words: list[tuple[int, int]] = []
    depth = 0
    for m in [*_WORDS.finditer(text), None]:
        if m is not None and m.lastgroup in ("word", "string"):
            words.append(m.span())
        elif m is None or m.lastgroup == "mark":
            if words and depth:
                args = [text[a:b] for a, b in words]
                out.leaf(KEY_VALUE, args[0], " ".join(args[1:]) or None, words[0][0], words[-1][1])
            words = []
            depth = max(0, depth + (m is not None and ((m[0] == "{") - (m[0] == "}"))))
    out.close(len(text))


# YAML


_YAML_KEY = re.compile(r"""((?:"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#'"\[\]{},&*!|>%@`-][^\n]*?|-[^\s\n][^\n]*?))[ \t]*:(?=[ \t]|\Z)""")
_YAML_NOTE = re.compile(r"[ \t]+#.*\Z")


def yaml(text: str, out: Out) -> None:
    """Block mappings and sequences, nested; flow mappings give their pairs, flow sequences stay text; documents run on."""
    out.open(KEY_VALUE, None, 0)
    levels: list[tuple[int, int, bool]] = []  # column, depth of the stack, whether it is a sequence item
    counts: dict[tuple[int, int], int] = {}
    lines = list(_lines(text))
    i = last = 0

    def close_to(indent: int, item: bool) -> None:
        """Closes what is deeper; on the same column, a new item closes an item only, a key anything."""
        while levels and (levels[-1][0] > indent or levels[-1][0] == indent and (not item or levels[-1][2])):
            depth = levels.pop()[1]
            while len(out.stack) > depth:
                out.close(last)

    def value_of(at: int, end: int, indent: int) -> tuple[str, int]:
        """The scalar that starts at `at`, over more lines where they are deeper, and its end."""
        nonlocal i
        raw = text[at:end]
        block = re.match(r"[|>][+-]?\d?[+-]?[ \t]*(?:#.*)?\Z", raw)
        stop = end
        if block or raw[:1] in "\"'" and not re.fullmatch(r"""(?:"(?:[^"\\]|\\.)*"|'(?:[^']|'')*')(?:[ \t]+#.*)?[ \t]*""", raw) or raw[:1] in "[{" and raw.count("[") + raw.count("{") > raw.count("]") + raw.count("}"):
            while i + 1 < len(lines):
                s, e = lines[i + 1]
                body = text[s:e]
                flow = not block and raw[:1] in "[{"
                if body.strip() and len(body) - len(body.lstrip(" ")) <= indent and not flow:
                    break
                i += 1
                stop = e if body.strip() else stop
                if flow and text[at:stop].count("[") + text[at:stop].count("{") <= text[at:stop].count("]") + text[at:stop].count("}"):
                    break
                if not block and not flow and body.rstrip().endswith(raw[0]):
                    break
        elif raw[:1] not in "\"'[{":
            while i + 1 < len(lines):  # a plain scalar goes on over deeper lines
                s, e = lines[i + 1]
                body = text[s:e]
                deep = len(body) - len(body.lstrip(" ")) > indent
                if not body.strip() or not deep or _YAML_KEY.match(body.strip()) or body.lstrip().startswith(("- ", "#")) or not raw.strip():
                    break
                i += 1
                stop = e
        value = text[at:stop]
        if quoted := re.match(r"""(?s)"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'""", value):  # a comment mark may be in it
            return quoted[0], stop
        return (value if block else _YAML_NOTE.sub("", value).rstrip()), stop

    def flow_pairs(value: str, at: int) -> None:
        """The pairs of a flow mapping, nested ones too."""
        depth, start, quote = 0, 1, ""
        body = value.strip()
        for k, c in enumerate(body):
            if quote:
                quote = "" if c == quote else quote
            elif c in "\"'":
                quote = c
            elif c in "[{":
                depth += 1
            elif c in "]}" or c == "," and depth == 1:
                if depth == 1 and (part := body[start:k]).strip():
                    name, _, rest = part.partition(":")
                    lead = at + start + len(part) - len(part.lstrip())
                    if rest.strip().startswith("{"):
                        out.open(KEY_VALUE, strip_quotes(name), lead)
                        flow_pairs(rest.strip(), at + start + part.index(rest.strip()))
                        out.close(at + k)
                    elif rest.strip():
                        out.leaf(KEY_VALUE, strip_quotes(name), strip_quotes(rest), lead, at + k)
                start = k + 1
                depth -= c in "]}"

    while i < len(lines):
        start, end = lines[i]
        line = text[start:end]
        body = line.strip()
        indent = len(line) - len(line.lstrip(" "))
        if not body or body[0] in "#%" or body in ("...",) or body.startswith("---"):
            if body.startswith("---"):
                close_to(-1, False)
                counts.clear()
            i += 1
            continue
        at = start + indent
        while text.startswith("-", at) and (at + 1 >= end or text[at + 1] in " \t"):
            column = at - start
            close_to(column, True)
            key = (len(out.stack), column)
            for k in [k for k in counts if k[0] > len(out.stack)]:
                del counts[k]
            n = counts.get(key, 0)
            counts[key] = n + 1
            depth = len(out.stack)
            out.open(SEQUENCE, str(n), at)
            levels.append((column, depth, True))
            rest = re.compile(r"-[ \t]*").match(text, at, end).end()
            last = end
            at = rest
            if at >= end:
                break
        if at < end:
            column = at - start
            m = _YAML_KEY.match(text[at:end])
            if m:
                close_to(column, False)
                value_at = at + m.end()
                value_at += len(text[value_at:end]) - len(text[value_at:end].lstrip())
                rest = text[value_at:end]
                depth = len(out.stack)
                key_text = strip_quotes(m[1])
                plain = re.sub(r"^(?:[&!][^\s]*[ \t]*)+", "", rest)
                if not _YAML_NOTE.sub("", " " + plain).strip():
                    # a nested block may follow; without one the value is missing
                    out.open(KEY_VALUE, key_text, at)
                    levels.append((column, depth, False))
                    last = end
                elif plain.startswith("{"):
                    value, stop = value_of(value_at, end, column)
                    out.open(KEY_VALUE, key_text, at)
                    before = len(out.items)
                    flow_pairs(value, value_at)
                    if len(out.items) == before:
                        out.top.value = strip_quotes(value)
                    out.close(stop)
                    last = stop
                else:
                    value, stop = value_of(value_at, end, column)
                    out.leaf(KEY_VALUE, key_text, strip_quotes(value), at, stop)
                    last = stop
            elif text[at] == "{" and len(out.stack):
                value, stop = value_of(at, end, column)
                flow_pairs(value, at)
                last = stop
            elif out.top.kind == SEQUENCE:
                value, stop = value_of(at, end, levels[-1][0] if levels else -1)
                out.top.value = strip_quotes(value)
                last = stop
        i += 1
    close_to(-1, False)
    out.close(len(text))


# XML and DTD

_XML = re.compile(
    r"""(?P<comment><!--.*?(?:-->|\Z))|(?P<cdata><!\[CDATA\[.*?(?:\]\]>|\Z))|(?P<pi><\?.*?(?:\?>|\Z))|(?P<doctype><!DOCTYPE(?:[^\[>]|\[.*?\])*>)"""
    r"""|(?P<close></[^>]*>?)|(?P<open><[^\s/>!?][^\s/>]*(?:\s+[^\s=/>]+\s*=\s*(?:"[^"]*"|'[^']*')|\s+[^\s=/>]+)*\s*/?>)|(?P<text>[^<]+)|(?P<other><)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/>]+)\s*=\s*("[^"]*"|'[^']*')""")


def xml(text: str, out: Out) -> None:
    """Elements with attributes; the value is the first text or CDATA of an element, trimmed, if that is not blank."""
    out.open(ELEMENT, None, 0)
    taken = [True]
    for m in _XML.finditer(text):
        kind = m.lastgroup
        if kind == "open":
            name = re.match(r"<([^\s/>]+)", m[0])[1]
            item = out.open(ELEMENT, name, m.start())
            head = m.start() + 1 + len(name)
            item.attributes = [(a[1], strip_quotes(a[2]), a.start(), a.end()) for a in _ATTRIBUTE.finditer(text, head, m.end())]
            taken.append(False)
            if m[0].endswith("/>"):
                out.close(m.end())
                taken.pop()
        elif kind == "close":
            if len(out.stack) > 1:
                out.close(m.end())
                taken.pop()
        elif kind in ("text", "cdata") and not taken[-1]:
            body = m[0].removeprefix("<![CDATA[").removesuffix("]]>") if kind == "cdata" else m[0]
            out.top.value = body.strip() or None
            taken[-1] = True
    while out.stack:
        out.close(len(text))


def dtd(text: str, out: Out) -> None:
    """Element, attribute-list and entity declarations: the name, and the declaration as value."""
    out.open(KEY_VALUE, None, 0)
    for m in re.finditer(r"""<!--.*?-->|<!(?:ELEMENT|ATTLIST|ENTITY\s+%|ENTITY)\s+([^\s>]+)(?:"[^"]*"|'[^']*'|[^>"'])*>""", text, re.S):
        if m[1]:
            out.leaf(KEY_VALUE, m[1], m[0], m.start(), m.end())
    out.close(len(text))


READERS = {
    "json": json,
    "hjson": json_loose,
    "json5": json,
    "toml": toml,
    "properties": properties,
    "hcl": hcl,
    "hocon": hocon,
    "kdl": kdl,
    "cue": cue,
    "yaml": yaml,
    "ini": ini,
    "editorconfig": ini,
    "csv": csv,
    "psv": psv,
    "po": po,
    "nginx": nginx,
    "caddy": caddy,
    "xml": xml,
    "dtd": dtd,
}


class Places:
    """Bytes, lines and byte columns of the code points of a text."""

    def __init__(self, text: str) -> None:
        self.byte = None
        if not text.isascii():
            code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            size = (code > 0x7F).astype(np.int64)
            size += code > 0x7FF
            size += code > 0xFFFF
            self.byte = [0, *np.cumsum(size + 1).tolist()]
        self.line_starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def at(self, place: int) -> int:
        return place if self.byte is None else self.byte[place]

    def point(self, place: int) -> tuple[int, int]:
        line = bisect_right(self.line_starts, place) - 1
        return line, self.at(place) - self.at(self.line_starts[line])

    def span(self, start: int, end: int) -> tuple[int, int, int, int, int, int]:
        """start and end byte, start line and column, end line and column."""
        return (self.at(start), self.at(end), *self.point(start), *self.point(end))


def read(text: str, language: str) -> list[Item] | None:
    """The nodes of a text, or None for a language that holds no data."""
    reader = READERS.get(language)
    if reader is None:
        return None
    out = Out()
    reader(text, out)
    return out.items
