"""Tree nodes and the lexing that backends share. Places are code points."""

from __future__ import annotations

import re
import dataclasses
from dataclasses import dataclass


@dataclass
class Node:
    kind: str
    start: int
    end: int
    named: bool = True
    field: str | None = None
    error: bool = False
    missing: bool = False
    extra: bool = False
    children: list[Node] = dataclasses.field(default_factory=list)
    parent: int = -1
    child_index: int = 0
    depth: int = 0
    subtree_last: int = 0
    has_error: bool = False

    def add(self, kind: str, start: int, end: int, **more) -> Node:
        child = Node(kind, start, end, **more)
        self.children.append(child)
        return child


def flatten(root: Node) -> list[Node]:
    """Pre-order, without recursion; children by their places."""
    out, stack = [], [(root, -1, 0, 0)]
    while stack:
        node, parent, index, depth = stack.pop()
        node.parent, node.child_index, node.depth = parent, index, depth
        at = len(out)
        node.subtree_last = at
        out.append(node)
        node.children.sort(key=lambda c: (c.start, c.end))
        stack += [(c, at, i, depth + 1) for i, c in reversed(list(enumerate(node.children)))]
    for i in range(len(out) - 1, 0, -1):
        p = out[out[i].parent]
        p.subtree_last = max(p.subtree_last, out[i].subtree_last)
        out[i].has_error |= out[i].error or out[i].missing
        p.has_error |= out[i].has_error
    if out:
        out[0].has_error |= out[0].error or out[0].missing
    return out


def paths(nodes: list[Node]) -> list[tuple[int, ...]]:
    """The ancestors of each node, the root first."""
    out: list[tuple[int, ...]] = []
    for n in nodes:
        out.append(() if n.parent < 0 else (*out[n.parent], n.parent))
    return out


@dataclass(frozen=True)
class Token:
    kind: str  # comment, string, word, open, close, mark, end (of a line)
    start: int
    end: int
    text: str


def tokens(text: str, pattern: re.Pattern) -> list[Token]:
    """What the named groups of the pattern match, without spaces."""
    return [Token(m.lastgroup, m.start(), m.end(), m[0]) for m in pattern.finditer(text) if m.lastgroup != "space"]


def match_brackets(toks: list[Token]) -> tuple[dict[int, int], list[int]]:
    """The index of the token that closes each opening one, and the indexes of brackets without a partner."""
    pairs, wrong, stack = {}, [], []
    for i, t in enumerate(toks):
        if t.kind == "open":
            stack.append(i)
        elif t.kind == "close":
            if stack and toks[stack[-1]].text + t.text in ("()", "[]", "{}"):
                pairs[stack.pop()] = i
            else:
                wrong.append(i)
    return pairs, sorted(wrong + stack)
