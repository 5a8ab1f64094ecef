"""Languages whose blocks close with `end`: Ruby and Elixir, line by line."""

from __future__ import annotations

import re

from tessera.operators.syntax.base import Node

_RUBY_OPEN = re.compile(r"(class|module|def|if|unless|case|while|until|begin|for)\b")
_RUBY_NAME = re.compile(r"(class|module)\s+(?:<<\s*)?([\w:]+)|def\s+(self\.)?([\w?!=\[\]<>+*/%-]+)")
_LINE = re.compile(r"[^\n]*")


def _code_lines(text: str):
    """(start, code, comment place or -1) of each line; strings are blanked out, so that what they hold counts for nothing."""
    at = 0
    while at <= len(text):
        m = _LINE.match(text, at)
        clean = re.sub(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|~[a-zA-Z]\([^)\n]*\)', lambda s: s[0][0] + "_" * (len(s[0]) - 2) + s[0][-1] if len(s[0]) > 1 else s[0], m[0])
        mark = clean.find("#")
        yield at, clean if mark < 0 else clean[:mark], -1 if mark < 0 else at + mark
        at = m.end() + 1


def parse_ruby(text: str, language: str = "ruby") -> Node:
    root = Node("program", 0, len(text))
    stack: list[tuple[Node, Node]] = [(root, root)]  # node, where its statements go
    for start, code, mark in _code_lines(text):
        body = code.strip()
        at = start + len(code) - len(code.lstrip())
        end = at + len(body)
        if mark >= 0:
            stop = start + len(_LINE.match(text, start)[0])
            stack[-1][1].add("comment", mark, stop, extra=True)
        if not body:
            continue
        if re.match(r"end\b", body):
            if len(stack) > 1:
                node, inner = stack.pop()
                node.end = at + 3
                inner.end = max(inner.end, inner.children[-1].end if inner.children else inner.start)
            else:
                root.add("ERROR", at, end, error=True)
            continue
        if re.match(r"(else|elsif|when|rescue|ensure|in)\b", body):
            continue
        m = _RUBY_OPEN.match(body)
        if m and not re.search(r"\bend\s*$", body):
            word = m[1]
            kind = {"def": "method"}.get(word, word)
            name = _RUBY_NAME.match(body)
            if word == "def" and name and name[3]:
                kind = "singleton_method"
            node = stack[-1][1].add(kind, at, end)
            if name:
                group = 2 if name[2] else 4
                node.add("constant" if group == 2 else "identifier", at + name.start(group), at + name.end(group), field="name")
            inner = node.add("body_statement", end, end, field="body")
            stack.append((node, inner))
        else:
            if m and m[1] == "def":
                name = _RUBY_NAME.match(body)
                node = stack[-1][1].add("singleton_method" if name and name[3] else "method", at, end)
                if name:
                    node.add("identifier", at + name.start(4), at + name.end(4), field="name")
            else:
                node = stack[-1][1].add("call" if re.match(r"[a-z_]\w*[ (]", body) else "expression_statement", at, end)
            if re.search(r"\bdo\s*(\|[^|]*\|)?\s*$", body):
                stack.append((node, node.add("do_block", end, end)))
    while len(stack) > 1:
        node, inner = stack.pop()
        node.end = inner.end = len(text)
        root.add("ERROR", node.start, node.start + 1, error=True)
    return root


_EX_CALL = re.compile(r"([a-z_]\w*[?!]?)(?:\s+|(?=\())(.*)", re.S)


def parse_elixir(text: str, language: str = "elixir") -> Node:
    """Calls with target, arguments and do_block; a line is a statement."""
    root = Node("source", 0, len(text))
    stack: list[tuple[Node, Node]] = [(root, root)]
    quoted = False
    for start, code, mark in _code_lines(text):
        if text.startswith('"""', start + len(code) - len(code.lstrip())) or code.rstrip().endswith('"""'):
            quoted = not quoted
        if mark >= 0 and not quoted:
            stack[-1][1].add("comment", mark, start + len(_LINE.match(text, start)[0]), extra=True)
        body = code.strip()
        if not body or quoted:
            continue
        at = start + len(code) - len(code.lstrip())
        end = at + len(body)
        if re.match(r"end\b", body):
            if len(stack) > 1:
                node, inner = stack.pop()
                node.end = inner.end = at + 3
            else:
                root.add("ERROR", at, end, error=True)
            continue
        m = _EX_CALL.match(body)
        opens = bool(re.search(r"\bdo\s*$", body)) or bool(re.search(r"\bfn\b[^,]*->\s*$", body))
        if not m and not opens:
            stack[-1][1].add("expression", at, end)
            continue
        node = stack[-1][1].add("call", at, end)
        if m:
            node.add("identifier", at, at + len(m[1]), field="target")
            args = re.sub(r"\s*\bdo\s*$", "", m[2]) if opens else m[2]
            if args.strip():
                node.add("arguments", at + m.start(2), at + m.start(2) + len(args.rstrip()))
        if opens:
            stack.append((node, node.add("do_block", end - 2, end)))
    while len(stack) > 1:
        node, inner = stack.pop()
        node.end = inner.end = len(text)
        root.add("ERROR", node.start, node.start + 1, error=True)
    return root
