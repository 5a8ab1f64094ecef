"""Python, by its tokens: logical lines, and blocks by indentation."""

from __future__ import annotations

import re

from tessera.operators.syntax.base import Node, Token, match_brackets, tokens

_TOKENS = re.compile(
    r"""(?P<space>[ \t\f\r]+|\\\r?\n)|(?P<comment>\#[^\n]*)|(?P<string>[rRbBuUfFtT]{0,2}(?:\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?))"""
    r"""|(?P<end>\n)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<word>[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<mark>.)""",
    re.S,
)
_SIMPLE = {"import": "import_statement", "from": "import_from_statement", "return": "return_statement", "raise": "raise_statement", "pass": "pass_statement", "break": "break_statement", "continue": "continue_statement", "global": "global_statement", "nonlocal": "nonlocal_statement", "assert": "assert_statement", "del": "delete_statement"}
_COMPOUND = {"if": "if_statement", "for": "for_statement", "while": "while_statement", "with": "with_statement", "try": "try_statement", "match": "match_statement", "elif": "elif_clause", "else": "else_clause", "except": "except_clause", "finally": "finally_clause", "case": "case_clause"}


def _lines(toks: list[Token], pairs: dict[int, int]) -> list[list[Token]]:
    """Logical lines; a comment is a line of its own."""
    out, line, inside = [], [], 0
    closers = set(pairs.values())
    for i, t in enumerate(toks):
        inside += (i in pairs) - (i in closers)
        if t.kind == "end":
            if line and not inside:
                out.append(line)
                line = []
        elif t.kind == "comment":
            out.append([t])
        else:
            line.append(t)
    if line:
        out.append(line)
    return sorted(out, key=lambda ln: ln[0].start)


def _column(text: str, at: int) -> int:
    return at - (text.rfind("\n", 0, at) + 1)


def _header(words: list[Token]) -> tuple[str, int] | None:
    """The kind of a compound statement and the index of its name, if it has one."""
    i = 1 if words[0].text == "async" and len(words) > 1 else 0
    head = words[i].text
    if head in ("def", "class") and len(words) > i + 1 and words[i + 1].kind == "word":
        return ("function_definition" if head == "def" else "class_definition"), i + 1
    return None


def parse_python(text: str, language: str = "python") -> Node:
    root = Node("module", 0, len(text))
    toks = tokens(text, _TOKENS)
    pairs, wrong = match_brackets(toks)
    blocks: list[tuple[int, Node, list[Node]]] = [(-1, root, [root])]  # column, where statements go, what ends with the block
    pending: list[Node] = []  # decorators of the definition to come
    waiting: tuple[int, Node, list[Node]] | None = None  # a header whose block is on the lines after it
    for line in _lines(toks, pairs):
        first, last = line[0], line[-1]
        column = _column(text, first.start)
        if first.kind == "comment":
            deep = [b for b in blocks if b[0] <= column]
            target = waiting[1] if waiting and column > waiting[0] else deep[-1][1] if deep else root
            (target if waiting is None or target is waiting[1] else blocks[-1][1]).add("comment", first.start, first.end, extra=True)
            continue
        if waiting is not None:
            if column > waiting[0]:
                waiting[1].start = min(waiting[1].start, first.start) if waiting[1].start >= 0 else first.start
                blocks.append((column, waiting[1], waiting[2]))
            waiting = None
        while len(blocks) > 1 and column < blocks[-1][0]:
            blocks.pop()
        for _, block, owners in blocks[1:]:
            for n in (block, *owners):
                n.end = max(n.end, last.end)
        into = blocks[-1][1]
        if first.text == "@" and first.kind == "mark":
            pending.append(Node("decorator", first.start, last.end))
            continue
        named = _header(line)
        word = line[1].text if first.text == "async" and len(line) > 1 else first.text
        colon = next((i for i, t in enumerate(line) if t.text == ":" and not any(a.kind == "open" for a in line[: i + 1]) or t.text == ":" and _level(line, i) == 0), None)
        compound = named or word in _COMPOUND and colon is not None and (word not in ("match", "case", "else", "try", "finally") or line[-1].text == ":" or word in ("else", "try", "finally"))
        if not compound:
            _simple(into, line)
            continue
        node = Node(named[0] if named else _COMPOUND[word], first.start, last.end)
        if pending:
            outer = into.add("decorated_definition", pending[0].start, last.end)
            outer.children += pending
            node.field = "definition"
            outer.children.append(node)
            owners = [node, outer]
            pending = []
        else:
            into.children.append(node)
            owners = [node]
        if named:
            node.add(line[named[1] - 1].text, line[named[1] - 1].start, line[named[1] - 1].end, named=False)
            node.add("identifier", line[named[1]].start, line[named[1]].end, field="name")
            if len(line) > named[1] + 1 and line[named[1] + 1].text == "(":
                close = next((t for i, t in enumerate(line) if i > named[1] and t.text == ")" and _level(line, i + 1) == 0), line[named[1] + 1])
                node.add("parameters" if node.kind == "function_definition" else "argument_list", line[named[1] + 1].start, close.end, field="parameters" if node.kind == "function_definition" else "superclasses")
        body = Node("block", -1, last.end, field="body")
        if colon is not None and colon < len(line) - 1:  # on the same line
            body.start = line[colon + 1].start
            node.children.append(body)
            _simple(body, line[colon + 1 :])
        else:
            body.start = last.end
            node.children.append(body)
            waiting = (column, body, owners)
    _fix_blocks(root)
    for i in wrong:
        t = toks[i]
        end = text.find("\n", t.start)
        root.add("ERROR", t.start, t.end if end < 0 or t.kind == "close" else end, error=True)
        break
    return root


def _level(line: list[Token], i: int) -> int:
    return sum((t.kind == "open") - (t.kind == "close") for t in line[:i])


def _simple(into: Node, line: list[Token]) -> None:
    """The statements of a line that semicolons part."""
    part: list[Token] = []
    for i, t in enumerate([*line, None]):
        if t is not None and not (t.text == ";" and _level(line, i) == 0):
            part.append(t)
            continue
        if part:
            kind = _SIMPLE.get(part[0].text, "expression_statement")
            node = into.add(kind, part[0].start, part[-1].end)
            strings = [p for p in part if p.kind == "string"]
            if len(strings) == len(part):
                if len(part) == 1:
                    node.add("string", part[0].start, part[0].end)
                else:
                    many = node.add("concatenated_string", part[0].start, part[-1].end)
                    for s in strings:
                        many.add("string", s.start, s.end)
            elif kind == "expression_statement" and len(part) > 2 and part[1].text == "=" and part[2].text != "=":
                a = node.add("assignment", part[0].start, part[-1].end)
                a.add("identifier", part[0].start, part[0].end, field="left")
        part = []


def _fix_blocks(root: Node) -> None:
    """Blocks begin at their first child."""
    stack = [root]
    while stack:
        n = stack.pop()
        if n.kind == "block" and n.children:
            n.start, n.end = min(c.start for c in n.children), max(n.end, max(c.end for c in n.children))
        stack += n.children
