"""Syntax backends: parse(text, language) gives the nodes of a concrete syntax tree in pre-order.

The kinds follow the names that common grammars use, as far as a backend goes; languages without one have a root node only.
"""

from __future__ import annotations

from tessera.operators.syntax.base import Node, flatten
from tessera.operators.syntax import braces, data, ends, indented, records

_BACKENDS = {
    "python": indented.parse_python,
    "ruby": ends.parse_ruby,
    "elixir": ends.parse_elixir,
    "html": data.parse_markup,
    "xml": data.parse_markup,
    "json": data.parse_json,
    "csv": data.parse_separated,
    "psv": data.parse_separated,
    **dict.fromkeys(records.KINDS, records.parse_records),
}


def parse(text: str, language: str) -> list[Node]:
    """The nodes of a text in pre-order, with parent, child_index, depth and subtree_last set."""
    if language in _BACKENDS:
        root = _BACKENDS[language](text, language)
    elif language in braces.LANGUAGES:
        root = braces.parse(text, language)
    else:
        root = Node("source_file", 0, len(text))
    return flatten(root)


def has_backend(language: str) -> bool:
    return language in _BACKENDS or language in braces.LANGUAGES
