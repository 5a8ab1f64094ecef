"""Chat formatting by a grammar that is parsed back.

    conversation = turn*
    turn         = "[TURN " role mark "]\\n" body "\\n[/TURN]\\n"
    mark         = "" | "!" | "#"

The role is always escaped; the body only where the mark says so. In a body marked "!" a backslash stands before each backslash
and inside each control string (after its first character); one marked "#" is hexadecimal. A role has white space, marks, "<",
brackets and backslashes as numbers. The parser reads a header line, then up to the first end marker; it knows nothing of the
source. Each turn is rendered plain first, parsed back and, if the turns recovered aren't the one put in, escaped and parsed
again until they are; the last mark fits any text. Other formats' control strings are escaped too, so that no text can speak
for the template of a model trained on the output. A conversation's text is its turns', one after another; the parser takes it
as a stream, whatever the pieces, and the loss mask is spans of that text: what assistants say, still escaped.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import narrow

OPEN, CLOSE = "[TURN ", "\n[/TURN]\n"
#: Strings that mark turns here or in common templates.
CONTROL = ("[TURN ", "[/TURN]", "[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)) + r"|\\")
_ROLE = re.compile(r"[\s!#\]\[\\<]")
#: How a body is written, from the plainest on.
MARKS = ("", "!", "#")
_ESCAPED = re.compile(r"\\(.)", re.S)
NO_ROLE = "\\0"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\.{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" if m[1] == "\\" else "" if m[1] == "." else m[1], text)


def _body(text: str, mark: str) -> str:
    return text if not mark else escape(text) if mark == "!" else text.encode("utf-8", "surrogatepass").hex()


def read_body(body: str, mark: str) -> str:
    return body if not mark else unescape(body) if mark == "!" else bytes.fromhex(body).decode("utf-8", "surrogatepass")


def render(role: str | None, text: str, mark: str = "") -> str:
    """One turn as text."""
    name = NO_ROLE if role is None else _ROLE.sub(lambda m: f"\\u{ord(m[0]):x};", role)
    return f"{OPEN}{name}{mark}]\n{_body(text, mark)}{CLOSE}"


@dataclass
class Turn:
    role: str | None
    mark: str
    #: The body as it stands in the conversation's text, and where, in code points.
    body: str
    start: int
    end: int

    @property
    def text(self) -> str:
        return read_body(self.body, self.mark)


class Reader:
    """A parser that takes a conversation's text in pieces and holds what is not yet a whole turn."""

    def __init__(self) -> None:
        self.held, self.before = "", 0

    def feed(self, piece: str) -> list[Turn]:
        """The turns that this piece completes; ValueError for a text that is not of the grammar."""
        self.held += piece
        out, at = [], 0
        while at < len(self.held):
            if not self.held.startswith(OPEN[: len(self.held) - at], at):
                raise ValueError("no turn begins here")
            line = self.held.find("]\n", at)
            end = self.held.find(CLOSE, line + 2) if line >= 0 else -1
            if end < 0:
                break
            head = self.held[at + len(OPEN) : line]
            mark = head[-1:] if head[-1:] in MARKS[1:] else ""
            name = head[: len(head) - len(mark)]
            role = None if name == NO_ROLE else re.sub(r"\\u([0-9a-f]+);", lambda m: chr(int(m[1], 16)), name)
            out.append(Turn(role, mark, self.held[line + 2 : end], self.before + line + 2, self.before + end))
            at = end + len(CLOSE)
        self.held, self.before = self.held[at:], self.before + at
        return out


def parse(text: str) -> list[tuple[str | None, str, str]] | None:
    """The (role, text, mark) of each turn, or None if the text is not of the grammar."""
    reader = Reader()
    try:
        out = [(t.role, t.text, t.mark) for t in reader.feed(text)]
    except ValueError:
        return None
    return None if reader.held else out


def round_trip(role: str | None, text: str) -> tuple[str, str | None, str]:
    """(rendered turn, role and text recovered from it), with the first mark under which they are those put in; a body that holds
    a control string isn't written plain."""
    for mark in MARKS[any(c in text for c in CONTROL) :]:
        turn = render(role, text, mark)
        got = parse(turn)
        if got is not None and len(got) == 1 and got[0][:2] == (role, text):
            break
    return turn, got[0][0], got[0][1]


def _turns(batches):
    for batch in batches:
        names = ("conv_id", "turn", "role", "text")
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        rendered = [round_trip(r, t or "")[0] for r, t in zip(columns[2].to_pylist(), columns[3].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(rendered, pa.string())], [*names, "formatted"])


def format_turns(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> (conv_id, turn, role, text, formatted): each turn as the grammar has it.

    A conversation's output is its turns' formatted texts by turn, one after another. A null text is an empty one, a null role is
    kept apart from every name, empty included.
    """
    return narrow(conversations, conv_id="long", turn="long", role="string", text="string").mapInArrow(_turns, "conv_id long, turn long, role string, text string, formatted string")


def _digest(batches):
    """Parses a stream of formatted texts, sorted by conversation; holds one turn at a time."""
    key, state = object(), None

    def row():
        reader, n, turns, chars, loss = state
        if reader.held:
            raise ValueError("a conversation ends inside a turn")
        return key, n, turns.hexdigest(), chars, loss.hexdigest(), reader.before

    for batch in batches:
        done = []
        for conv, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if state is None or conv != key:
                if state is not None:
                    done.append(row())
                key, state = conv, [Reader(), 0, hashlib.sha256(), 0, hashlib.sha256()]
            turns = state[0].feed(text)
            for turn in turns:
                state[1] += 1
                state[2].update(f"{turn.role or ''}\n{turn.text}\n".encode("utf-8", "surrogatepass"))
            for under in masked(turns):
                state[3] += len(under)
                state[4].update(under.encode("utf-8", "surrogatepass"))
        if done:
            yield _rows(done)
    if state is not None:
        yield _rows([row()])


def mask(turns: list[Turn]) -> list[tuple[int, int, str]]:
    """The loss mask of a conversation's text: the span of each assistant's body in code points, and its mark."""
    return [(t.start, t.end, t.mark) for t in turns if t.role == "assistant"]


def masked(turns: list[Turn]) -> list[str]:
    """What lies under the mask, unescaped: a turn's body is the text between the ends of its span."""
    return [read_body(t.body, t.mark) for t in turns if t.role == "assistant"]


def _rows(done):
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)


def digest(formatted: DataFrame) -> DataFrame:
    """format_turns() output -> (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from it.

    Turns that tie are taken by role, then text (nulls first). Rows with a null conv_id are one conversation, named null. A
    digest is over a sequence, so a conversation is one sorted stream, of which a task holds one batch however long it is.
    """
    return _ordered(formatted).mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def loss_spans(formatted: DataFrame) -> DataFrame:
    """(conv_id, start, end, mark): the loss mask over each conversation's text, in code points, in its order."""

    def run(batches):
        key, reader = object(), Reader()
        for batch in batches:
            rows = []
            for conv, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if conv != key:
                    key, reader = conv, Reader()
                rows += [(conv, *span) for span in mask(reader.feed(text))]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "start", "end", "mark"])

    return _ordered(formatted).mapInArrow(run, "conv_id long, start long, end long, mark string")


def _ordered(formatted: DataFrame) -> DataFrame:
    n = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return formatted.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "formatted")
