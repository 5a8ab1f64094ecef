"""Trees of data formats, from the nodes that their readers give: groups, entries with key and value, and comments."""

from __future__ import annotations

import re
from bisect import bisect_right

from tessera.operators.formats import SEQUENCE, Item, read
from tessera.operators.syntax.base import Node

#: Kinds of a format's root, of an entry with others below it, of one without, and of an item of a sequence.
KINDS = {
    "toml": ("document", "table", "pair", "array_item"),
    "json5": ("document", "object", "pair", "array_item"),
    "hjson": ("document", "object", "pair", "array_item"),
    "yaml": ("stream", "block_mapping", "block_mapping_pair", "block_sequence_item"),
    "ini": ("document", "section", "setting", "setting"),
    "editorconfig": ("document", "section", "setting", "setting"),
    "properties": ("file", "property", "property", "property"),
    "po": ("source_file", "message", "message", "message"),
    "hcl": ("config_file", "block", "attribute", "attribute"),
    "hocon": ("hocon_file", "object", "field", "field"),
    "kdl": ("document", "node", "node", "node"),
    "cue": ("source_file", "field", "field", "field"),
    "nginx": ("conf", "block", "directive", "directive"),
    "caddy": ("server", "block", "directive", "directive"),
    "dtd": ("document", "declaration", "declaration", "declaration"),
}
#: Formats whose readers give the place of a value without its key.
_VALUES_ONLY = ("toml", "json5", "hjson")
_HASH, _SLASH, _BLOCK = r"(?<!\S)#[^\n]*", r"//[^\n]*", r"/\*[\s\S]*?(?:\*/|\Z)"
_COMMENTS = {
    **dict.fromkeys(("toml", "yaml", "po", "nginx", "caddy"), _HASH),
    **dict.fromkeys(("ini", "editorconfig"), r"^[ \t]*[#;][^\n]*"),
    "properties": r"^[ \t]*[#!][^\n]*",
    **dict.fromkeys(("hcl", "hocon", "hjson"), f"{_HASH}|{_SLASH}|{_BLOCK}"),
    **dict.fromkeys(("json5", "cue", "kdl"), f"{_SLASH}|{_BLOCK}"),
    "dtd": r"<!--.*?(?:-->|\Z)",
}


def _in_sequence(items: list[Item], x: Item) -> bool:
    """Whether an item's key is its place in a sequence; a reader marks the sequence, or each item of it."""
    return x.key is not None and x.key.isdigit() and SEQUENCE in (x.kind, items[x.parent].kind)


def _ranges(items: list[Item], text: str, values_only: bool) -> tuple[list[list[int]], list[tuple | None], list[tuple | None]]:
    """The ranges of items, grown so that each holds those below it, and of their keys and values where they stand in the text."""
    ranges = [[x.start, x.end] for x in items]
    keys: list[tuple | None] = [None] * len(items)
    values: list[tuple | None] = [None] * len(items)
    floor: dict[int, int] = {}
    for i, x in enumerate(items[1:], 1):
        in_sequence = _in_sequence(items, x)
        low = max(floor.get(x.parent, 0), items[x.parent].start if x.parent else 0)
        if x.key and not in_sequence:
            at = text.rfind(x.key, low, x.start) if values_only and not text.startswith("[", x.start) else text.find(x.key, x.start, x.end)
            if at < 0:
                at = text.rfind(x.key, low, x.start)
            if at >= 0:
                keys[i] = (at, at + len(x.key))
                ranges[i][0] = min(ranges[i][0], at)
        if x.value:
            at = text.rfind(x.value, max(x.start, keys[i][1] if keys[i] and keys[i][1] <= x.end else x.start), x.end)
            if at >= 0:
                values[i] = (at, at + len(x.value))
        floor[x.parent] = x.end
    for i in range(len(items) - 1, 0, -1):
        up = ranges[items[i].parent]
        up[0], up[1] = min(up[0], ranges[i][0]), max(up[1], ranges[i][1])
    return ranges, keys, values


def parse_records(text: str, language: str) -> Node:
    root_kind, group, entry, item = KINDS[language]
    items = read(text, language) or []
    root = Node(root_kind, 0, len(text))
    nodes = [root] * max(len(items), 1)
    above = {x.parent for x in items}
    ranges, keys, values = _ranges(items, text, language in _VALUES_ONLY)
    taken: list[tuple[int, int]] = []
    for i, x in enumerate(items[1:], 1):
        kind = item if _in_sequence(items, x) else group if i in above else entry
        nodes[i] = nodes[x.parent].add(kind, *ranges[i], field=None)
        for field, at in (("key", keys[i]), ("value", values[i])):
            if at is not None and ranges[i][0] <= at[0] and at[1] <= ranges[i][1] and (at[0], at[1]) != tuple(ranges[i]):
                nodes[i].add(field, *at, field=field)
        if values[i] and i not in above:
            taken.append(values[i])
    _comments(text, language, root, sorted(taken))
    return root


def _comments(text: str, language: str, root: Node, taken: list[tuple[int, int]]) -> None:
    """Adds comments that are not in a value, each to the innermost node that holds it."""
    starts = [a for a, _ in taken]
    pattern, place = re.compile(_COMMENTS[language], re.M | re.S if language == "dtd" else re.M), 0
    while m := pattern.search(text, place):
        place = max(m.end(), place + 1)
        a, b = m.start() + len(m[0]) - len(m[0].lstrip(" \t")), m.end()
        k = bisect_right(starts, a) - 1
        if k >= 0 and a < taken[k][1]:
            place = taken[k][1]
            continue
        at = root
        while (inner := next((c for c in at.children if c.start <= a and b <= c.end and c.kind not in ("key", "value", "comment")), None)) is not None:
            at = inner
        if not any(c.start < b and a < c.end for c in at.children):
            at.add("comment", a, b, extra=True)
