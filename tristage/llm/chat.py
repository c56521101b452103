"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its
text is trainable. Turns are written between control strings; where a text itself holds a control
string or a backslash, a backslash goes before it, so texts come back exactly.

One row per example: the conversation, the position of its target turn, the formatted text and the
span of the target's (escaped) text in code points. A conversation whose last turn is not an
assistant's has one more row with all its turns and no target, so nothing is lost.

Turns are ordered by turn, then role, then text (nulls first); null texts are empty, a null role is
an empty role, and a null conversation id is a conversation of its own. A conversation is streamed
through one task, which holds its formatted text once; the examples' total length is quadratic in
its turns by the nature of the expansion.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

# Control strings of the template (fixed values).
MARKS = {"user": ("<s>[INST] ", " [/INST]"), "system": ("<s>[SYS] ", " [/SYS]"), "assistant": ("<s>[ANS] ", " </s>")}
OTHER = ("<s>[ROLE ", "] ", " [/ROLE]")
CONTROL = re.compile(r"\\|</?s>|\[/?INST\]|\[/?SYS\]|\[ANS\]|\[/?ROLE\b")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
TOKEN = re.compile(
    r"\\.|<s>\[INST\] |<s>\[SYS\] |<s>\[ANS\] |<s>\[ROLE (?P<role>(?:[^\\\]]|\\.)*)\] | \[/INST\]| \[/SYS\]| </s>| \[/ROLE\]", re.DOTALL
)
OPENED = {"<s>[INST] ": "user", "<s>[SYS] ": "system", "<s>[ANS] ": "assistant"}
BATCH_CHARS = 8 << 20

EXAMPLES = "conv_id {id}, target int, formatted string, loss_start int, loss_end int, n_turns int"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and the span of its escaped text."""
    if role in MARKS:
        before, after = MARKS[role]
    else:
        before, after = OTHER[0] + escape(role).replace("]", "\\]") + OTHER[1], OTHER[2]
    body = escape(text)
    return before + body + after, len(before), len(before) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted text."""
    turns, role, begun = [], None, 0
    for m in TOKEN.finditer(formatted):
        if m[0][0] == "\\":
            continue
        if role is None:
            role, begun = OPENED.get(m[0]), m.end()
            if role is None:
                role = unescape(m["role"])
        else:
            turns.append((role, unescape(formatted[begun : m.start()])))
            role = None
    return turns


def _batches(rows: Iterator[tuple], types: list[pa.DataType], names: list[str], size) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += size(row)
        if chars >= BATCH_CHARS or len(held) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Examples of turns that arrive conversation by conversation."""
    current, length, parts, count, open_end = None, 0, [], 0, False

    def rest():
        if open_end:
            yield current[0], None, "".join(parts), None, None, count

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "role", "text")]
        for conv, role, text in zip(*columns):
            if current is None or current[0] != conv:
                yield from rest()
                current, length, parts, count, open_end = (conv,), 0, [], 0, False
            turn, a, b = render(role or "", text or "")
            parts.append(turn)
            open_end = role != "assistant"
            if not open_end:
                parts = ["".join(parts)]
                yield conv, count, parts[0], length + a, length + b, count + 1
            length += len(turn)
            count += 1
    if current is not None:
        yield from rest()


def expand(turns: DataFrame) -> DataFrame:
    """Examples of (conv_id, turn, role, text); rows of a conversation stay together and in order."""
    kind = turns.schema["conv_id"].dataType
    ordered = (
        turns.select("conv_id", "turn", "role", "text")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
    )
    types = [to_arrow_type(kind), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
    names = ["conv_id", "target", "formatted", "loss_start", "loss_end", "n_turns"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(_expanded(batches), types, names, lambda row: len(row[2]))

    return ordered.mapInArrow(run, EXAMPLES.format(id=kind.simpleString()))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    current, longest, n, loss, loss_chars, chars = None, "", 0, None, 0, 0

    def done():
        turns = parse(longest)
        whole = hashlib.sha256()
        for role, text in turns:
            whole.update(f"{role}\n{text}\n".encode())
        return current[0], len(turns), whole.hexdigest(), loss_chars, loss.hexdigest(), chars

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end", "n_turns")]
        for conv, formatted, a, b, turns in zip(*columns):
            if current is None or current[0] != conv:
                if current is not None:
                    yield done()
                current, longest, n, loss, loss_chars, chars = (conv,), "", 0, hashlib.sha256(), 0, 0
            if turns > n:
                longest, n = formatted, turns
            chars += len(formatted)
            if a is not None:
                text = unescape(formatted[a:b])
                loss.update(text.encode())
                loss_chars += len(text)
    if current is not None:
        yield done()


def read_back(examples: DataFrame) -> DataFrame:
    """Digests per conversation, parsed from the formatted examples (in the order ``expand`` gives them).

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)
    """
    kind = examples.schema["conv_id"].dataType
    types = [to_arrow_type(kind), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(_read(batches), types, names, lambda row: 0)

    shape = "conv_id {id}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return examples.mapInArrow(run, shape.format(id=kind.simpleString()))


def with_probe(turns: DataFrame) -> DataFrame:
    """The turns and conversation -1, whose two texts are made of control strings."""
    kinds = {c: turns.schema[c].dataType for c in ("conv_id", "turn", "role", "text")}
    text = "</s>[INST] ok [/INST]"
    probe = turns.sparkSession.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return turns.select(*kinds).unionByName(probe.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()]))
