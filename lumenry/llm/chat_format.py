"""Chat formatting: conversations as training windows with a loss mask, and reading them back.

A window is a run of whole turns within a budget of byte-pair tokens. Prefix sums of turn tokens choose where it ends and which of its last turns the
next window repeats as history; a leading system turn is repeated in every window. Loss falls on each assistant text
once, in the window where it is new; repeated turns are masked. A turn above the budget, alone or beside the repeated system turn, stands whole with that in a window
that has no other turn; so a window exceeds the budget only where its system turn and one more do. Turns are marked by control strings; in texts and roles, a backslash goes into every `<|`, so that
no text can pose as a turn, and comes out again on reading. Both directions stream over sorted rows with one window in
memory, so a conversation of any length is fine.

Null texts and roles count as empty; turns with equal numbers (or none: last) follow by role, then text; repeated rows are
separate turns; a null conv_id is a conversation of its own; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenry.llm import bpe
from lumenry.llm.common import with_workers

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)
#: Tokens that a turn's marks cost: its start, the line end after the role, its end, and the line end after that.
MARKS = 4


def escape(text: str) -> str:
    """A text in which `<|` doesn't occur."""
    return _ESCAPE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


@dataclass
class Turn:
    role: str
    text: str
    tokens: int


@dataclass
class Window:
    """Formatted text; the first `repeated` turns were in earlier windows. spans: code points under loss, end exclusive."""

    text: str
    turns: int
    repeated: int
    tokens: int
    spans: list[tuple[int, int]] = field(default_factory=list)


def _formatted(repeated: list[Turn], new: list[Turn]) -> Window:
    parts, spans, at = [], [], 0
    for k, turn in enumerate([*repeated, *new]):
        head, body = f"{START}{escape(turn.role).replace(chr(10), LINE)}\n", escape(turn.text)
        if k >= len(repeated) and turn.role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return Window("".join(parts), len(repeated) + len(new), len(repeated), sum(t.tokens for t in [*repeated, *new]), spans)


def windows(turns: Iterable[Turn], budget: int, history: int) -> Iterator[Window]:
    """The windows of one conversation; holds one window's turns at a time."""
    system: list[Turn] = []
    old: list[Turn] = []
    new: list[Turn] = []
    sums = [0]  # prefix sums of the tokens of old + new
    first = True
    for turn in turns:
        fixed = sum(t.tokens for t in system) * (not first)
        if new and fixed + sums[-1] + turn.tokens > budget:
            yield _formatted([*(system * (not first)), *old], new)
            fixed, first = sum(t.tokens for t in system), False
            room = max(0, min(history, budget - fixed - turn.tokens))
            run, skip = [*old, *new], len(system) if not old and new[: len(system)] == system else 0
            begin = max(bisect_left(sums, sums[-1] - room), skip)
            old, new = run[begin:], []
            sums = [s - sums[begin] for s in sums[begin:]]
        if first and not new and turn.role == "system":
            system = [turn]
        new.append(turn)
        sums.append(sums[-1] + turn.tokens)
    if new:
        yield _formatted([*(system * (not first)), *old], new)


def parsed(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted text."""
    return [(unescape(r.replace(LINE, "\n")), unescape(t)) for r, t in _TURN.findall(text)]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Any, Iterator[tuple]]]:
    """Runs of rows with the same first value, as they come; each run must be used up before the next is asked for."""
    from itertools import groupby

    def rows() -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    return groupby(rows(), key=lambda r: r[0])


def _batched(rows: Iterator[tuple], schema: pa.Schema, at_once: int = 256) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == at_once:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def format_windows(conversations: DataFrame, budget: int = 1024, history: int = 192, tokens: Callable[[str], int] | None = None) -> DataFrame:
    """(conv_id, window, text, n_turns, n_repeated, n_tokens, loss_spans) of conversations (conv_id, turn, role, text).

    tokens counts those of a text; by default it is the byte-level BPE of the machine's public vocabulary, over roles and texts as they are written.
    """
    path, pattern = bpe.vocabulary() if tokens is None else ("", "")
    with_workers(conversations.sparkSession)
    kind = conversations.schema["conv_id"].dataType
    rows = conversations.select("conv_id", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "turn")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = tokens or (lambda text: len(bpe.codec(path, pattern).encode(text)) // 4)
        of_role = lru_cache(1 << 10)(lambda role: count(escape(role).replace("\n", LINE)) + MARKS)

        def made(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for conv, group in _groups(it):
                turns = (Turn(r, t, of_role(r) + count(escape(t))) for _, r, t, _ in group)
                for k, w in enumerate(windows(turns, budget, history)):
                    yield conv, k, w.text, w.turns, w.repeated, w.tokens, [{"start": a, "end": b} for a, b in w.spans]

        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([("conv_id", first.schema.field(0).type), ("window", pa.int64()), ("text", pa.string()), ("n_turns", pa.int64()), ("n_repeated", pa.int64()), ("n_tokens", pa.int64()), ("loss_spans", _SPANS)])

        def again() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        yield from _batched(made(again()), schema)

    out = T.StructType([T.StructField("conv_id", kind), *[T.StructField(n, t) for n, t in (("window", T.LongType()), ("text", T.StringType()), ("n_turns", T.LongType()), ("n_repeated", T.LongType()), ("n_tokens", T.LongType()))]])
    out.add("loss_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))
    return rows.mapInArrow(run, out)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its windows alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows."""
    with_workers(formatted.sparkSession)
    rows = formatted.select("conv_id", "window", "text", "n_repeated", "loss_spans").repartition("conv_id").sortWithinPartitions("conv_id", "window")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for conv, group in _groups(it):
                turns, loss = hashlib.sha256(), hashlib.sha256()
                n = loss_chars = chars = k = 0
                for _, _, text, repeated, spans in group:
                    k += 1
                    chars += len(text)
                    for role, said in parsed(text)[repeated:]:
                        turns.update(f"{role}\n{said}\n".encode())
                        n += 1
                    for s in spans:
                        said = unescape(text[s["start"] : s["end"]])
                        loss.update(said.encode())
                        loss_chars += len(said)
                yield conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, k

        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([("conv_id", first.schema.field(0).type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])

        def again() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        yield from _batched(made(again()), schema)

    kind = formatted.schema["conv_id"].dataType
    long, text = T.LongType(), T.StringType()
    return rows.mapInArrow(run, T.StructType([T.StructField("conv_id", kind), *[T.StructField(n, t) for n, t in (("n_turns", long), ("turns_sha256", text), ("loss_chars", long), ("loss_sha256", text), ("formatted_chars", long), ("n_windows", long))]]))
