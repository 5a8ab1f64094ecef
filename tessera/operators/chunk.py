"""Syntax-aware chunks: greedy packing of tree boundaries, with whole lines and then bytes where there are none.

Places are bytes here. Chunks are contiguous, cover the text and hold at most `most` bytes, unless one character is larger.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np

from tessera.operators.intel import Document

#: Node kinds whose names a chunk lists.
DEFINITIONS = {"function_definition", "function_declaration", "function_item", "class_definition", "class_declaration", "struct_item", "struct_definition", "enum_item", "enum_declaration", "method_definition", "method_declaration", "trait_item", "impl_item"}
CHUNK_COMMENTS = ("comment", "line_comment", "block_comment")


def _by_bytes(data: bytes, start: int, end: int, most: int) -> list[tuple[int, int]]:
    """Slices of most bytes, cut back to whole characters; one character at least."""
    out = []
    while start < end:
        stop = min(start + most, end)
        while start < stop < end and data[stop] & 0xC0 == 0x80:
            stop -= 1
        if stop == start:
            stop += 1
            while stop < end and data[stop] & 0xC0 == 0x80:
                stop += 1
        out.append((start, stop))
        start = stop
    return out


def _by_lines(data: bytes, start: int, end: int, most: int, ends: list[int]) -> list[tuple[int, int]]:
    """Whole lines, as many as fit; a line that is too long alone goes by bytes. ends: places after line ends."""
    out = []
    while start < end:
        if end - start <= most:
            out.append((start, end))
            break
        at = bisect_right(ends, start + most) - 1
        stop = ends[at] if at >= 0 and ends[at] > start else None
        if stop is None:
            next_end = ends[at + 1] if at + 1 < len(ends) else end
            stop = min(next_end, end)
            out += _by_bytes(data, start, stop, most)
        else:
            out.append((start, stop))
        start = stop
    return out


def split(data: bytes, most: int, boundaries: list[list[int]] | None = None) -> list[tuple[int, int]]:
    """Byte ranges. boundaries: sorted starts of nodes at each depth, from the root's children on."""
    if not data or most <= 0:
        return []
    if len(data) <= most:
        return [(0, len(data))]
    ends = (np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1).tolist()
    levels = [sorted({*level, len(data)}) for level in boundaries or []]
    out: list[tuple[int, int]] = []
    work = [(0, len(data), 0)]
    while work:
        start, end, depth = work.pop()
        if end - start <= most:
            out.append((start, end))
            continue
        while depth < len(levels) and not _inside(levels[depth], start, end):
            depth += 1
        if depth >= len(levels):
            out += _by_lines(data, start, end, most, ends)
            continue
        cuts = [*_inside(levels[depth], start, end), end]
        pieces, at, i = [], start, 0
        while at < end:
            i = bisect_right(cuts, at)
            last = bisect_right(cuts, at + most) - 1
            if last >= i:
                pieces.append((at, cuts[last], -1))
                at = cuts[last]
            else:  # one section is too large: it alone goes a level down
                pieces.append((at, cuts[i], depth + 1))
                at = cuts[i]
        for a, b, d in reversed(pieces):
            work.append((a, b, d if d >= 0 else depth))
    return out


def _inside(level: list[int], start: int, end: int) -> list[int]:
    return level[bisect_right(level, start) : bisect_left(level, end)]


def boundaries(d: Document) -> list[list[int]]:
    out: list[list[int]] = []
    for n in d.nodes[1:]:
        while len(out) < n.depth:
            out.append([])
        out[n.depth - 1].append(d.places.at(n.start))
    return out


def chunks(d: Document, most: int) -> list[dict]:
    """The chunks of a document with what they hold; one sweep over the nodes serves all chunks.

    A node belongs to the chunks that it overlaps; its kind (at most one level below the root) and a comment only to a chunk that
    has all of it.
    """
    data = d.text.encode("utf-8", "surrogatepass")
    ranges = split(data, most, boundaries(d))
    newlines = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    starts = [a for a, _ in ranges]
    lines = np.searchsorted(newlines, np.array(ranges, np.int64).reshape(-1, 2)).tolist()
    out = []
    for i, ((a, b), (first, last)) in enumerate(zip(ranges, lines, strict=True)):
        out.append({"chunk_index": i, "total_chunks": len(ranges), "content": data[a:b].decode("utf-8", "replace"), "start_byte": a, "end_byte": b, "start_line": first, "end_line": last, "language": d.language, "node_types": [], "context_path": [], "symbols_defined": [], "comments": [], "docstrings": [], "has_error_nodes": False})
    for i, n in enumerate(d.nodes if out else ()):
        a, b = d.places.at(n.start), d.places.at(n.end)
        first = bisect_right(starts, a) - 1
        last = bisect_left(starts, b) - 1
        if a == starts[first] == b:  # nothing at the very start of a chunk lies outside of it
            continue
        last = max(last, first)
        if n.error or n.missing:
            for k in range(first, last + 1):
                out[k]["has_error_nodes"] = True
        if first == last:
            if n.depth <= 1 and n.kind not in out[first]["node_types"]:
                out[first]["node_types"].append(n.kind)
            if n.kind in CHUNK_COMMENTS:
                text = d.source(i)
                kind = "Block" if n.kind == "block_comment" else "Doc" if text.startswith(("///", "//!", "/**", "/*!")) else "Line"
                out[first]["comments"].append({"text": text, "kind": kind, "span": d.span(i), "associated_node": d.next_named(i)})
        if n.kind in DEFINITIONS:
            at = next((x for x in (d.child(i, f) for f in ("name", "declarator", "binding")) if x is not None), None)
            if at is not None:
                name = d.source(at)
                for k in range(first, last + 1):
                    out[k]["symbols_defined"].append(name)
                    if a < out[k]["start_byte"]:
                        out[k]["context_path"].append(name)
    return out
