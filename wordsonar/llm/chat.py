"""Chat formatting with a grammar round trip.

A conversation's turns are rendered one after another:

    user         <s>[INST]text[/INST]</s>
    assistant    <s>text</s>
    any other    <s><<ROLE>>role<</ROLE>>text</s>

The parser is deterministic: what follows `<s>` decides the kind of turn, a backslash makes the next character literal,
and the first control string that is met must be the one that ends the turn: no other may stand in a text. A turn is
first written with its text as it is, parsed again and compared with its source; only one that does not come back
identical is escaped: by a backslash before each backslash and each control string and, should that not do, before every
character that could begin one. So what is plain stays plain.

Rendering is done where the rows are; the rendered turns are then dealt by conversation and sorted. There the whole
conversation is parsed again as one text, by a stream that knows nothing of where the rendered turns met: what it finds
must end where the text does, and the loss mask, moved to its place in that text, must be where assistants' texts are
found. It holds one turn at a time, so even a conversation with very many turns takes bounded memory.

Defined results: a null text or role is empty; turns go by turn (null first), then role, then text; repeated rows are
turns of their own; rows with a null conversation id form one conversation; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OPEN, _CLOSE = "<s>", "</s>"
_USER, _USER_END = "[INST]", "[/INST]"
_ROLE, _ROLE_END = "<<ROLE>>", "<</ROLE>>"
_LIGHT = re.compile(r"\\|<(?=/?s>|</?ROLE>>)|\[(?=/?INST\])")
_FULL = re.compile(r"[\\<\[]")
#: What a parser stops at: an escaped character, or a control string.
_STOP = re.compile(r"\\(?:.|\Z)|</?s>|\[/?INST\]|<</?ROLE>>", re.S)
_LITERAL = re.compile(r"\\(.)", re.S)
#: The ways to write a text, from the lightest to the safest.
ESCAPES = (lambda t: t, lambda t: _LIGHT.sub(r"\\\g<0>", t), lambda t: _FULL.sub(r"\\\g<0>", t))


def unescape(text: str) -> str:
    return _LITERAL.sub(r"\1", text) if "\\" in text else text


class Incomplete(ValueError):
    """The text ends within a turn."""


def _until(end: str, line: str, at: int) -> tuple[str, int]:
    for m in _STOP.finditer(line, at):
        if m[0][0] != "\\":
            if line.startswith(end, m.start()):
                return line[at : m.start()], m.start() + len(end)
            if end.startswith(line[m.start() :]):
                break
            raise ValueError(f"{m[0]} before {end} at {m.start()}")
    raise Incomplete(f"no {end} after {at}")


def parse(line: str, at: int = 0) -> tuple[str, str, tuple[int, int], int]:
    """The turn that begins at `at`: role, text, where the text stands in the line, and the turn's end."""
    if not line.startswith(_OPEN, at):
        raise (Incomplete if _OPEN.startswith(line[at : at + len(_OPEN)]) else ValueError)(f"no turn at {at}")
    at += len(_OPEN)
    if line.startswith(_USER, at):
        start = at + len(_USER)
        body, end = _until(_USER_END + _CLOSE, line, start)
        role = "user"
    elif line.startswith(_ROLE, at):
        name, start = _until(_ROLE_END, line, at + len(_ROLE))
        body, end = _until(_CLOSE, line, start)
        role = unescape(name)
    else:
        start = at
        body, end = _until(_CLOSE, line, start)
        role = "assistant"
    return role, unescape(body), (start, start + len(body)), end


def parse_all(line: str) -> list[tuple[str, str, tuple[int, int]]]:
    """All turns of a rendered conversation."""
    turns, at = [], 0
    while at < len(line):
        role, text, span, at = parse(line, at)
        turns.append((role, text, span))
    return turns


def _write(role: str, text: str, escape) -> str:
    if role == "user":
        return f"{_OPEN}{_USER}{escape(text)}{_USER_END}{_CLOSE}"
    if role == "assistant":
        return f"{_OPEN}{escape(text)}{_CLOSE}"
    return f"{_OPEN}{_ROLE}{escape(role)}{_ROLE_END}{escape(text)}{_CLOSE}"


def render(role: str, text: str) -> str:
    """The turn in its lightest form that parses to the same role and text."""
    for escape in ESCAPES:
        line = _write(role, text, escape)
        try:
            back = parse(line)
        except ValueError:
            continue
        if back[0] == role and back[1] == text and back[3] == len(line):
            return line
    raise ValueError("a turn has no form that parses back")


def rendered(turns: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """(conv_id, turn, role, text, formatted, loss_start, loss_end): each turn as formatted; the loss mask covers the
    characters from loss_start to loss_end of an assistant's turn, and nothing (null) of others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, starts, ends = [], [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                lines.append(render(role, text))
                role, _, (a, b), _ = parse(lines[-1])
                starts.append(a if role == "assistant" else None)
                ends.append(b if role == "assistant" else None)
            more = [pa.array(lines, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]
            yield pa.RecordBatch.from_arrays(batch.columns + more, names=["conv_id", "turn", "role", "text", "formatted", "loss_start", "loss_end"])

    rows = turns.select(
        F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    return rows.mapInArrow(run, "conv_id bigint, turn bigint, role string, text string, formatted string, loss_start int, loss_end int")


class _Fold:
    """What is read back from a conversation's formatted text, which comes in parts."""

    def __init__(self, conv):
        self.conv, self.turns, self.loss, self.size = conv, 0, 0, 0
        self.all, self.masked = hashlib.sha256(), hashlib.sha256()
        self.rest, self.begins, self.masks = "", 0, deque()  # what isn't parsed yet, where it begins, and the mask from there on

    def add(self, part: str, start: int | None, end: int | None) -> None:
        """start and end: what the loss mask covers of the part, if anything."""
        if start is not None:
            self.masks.append((self.size + start, self.size + end))
        self.rest, self.size, at = self.rest + part, self.size + len(part), 0
        while at < len(self.rest):
            try:
                role, text, (a, b), end = parse(self.rest, at)
            except Incomplete:
                break
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
            if self.masks and self.masks[0][0] < self.begins + end:
                if self.masks.popleft() != (self.begins + a, self.begins + b):
                    raise ValueError(f"conversation {self.conv}: the loss mask isn't a turn's text at {self.begins + a}")
                text = unescape(self.rest[a:b])
                self.loss += len(text)
                self.masked.update(text.encode())
            at = end
        self.rest, self.begins = self.rest[at:], self.begins + at

    def row(self) -> tuple:
        if self.rest:
            raise ValueError(f"conversation {self.conv} ends within a turn")
        return self.conv, self.turns, self.all.hexdigest(), self.loss, self.masked.hexdigest(), self.size


def report(lines: DataFrame) -> DataFrame:
    """One row per conversation of rendered(): what its formatted text, parsed again, holds."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, fold = [], None
        give = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            masks = (batch.column(c).to_pylist() for c in ("loss_start", "loss_end"))
            for conv, line, a, b in zip(batch.column("conv_id").to_pylist(), batch.column("formatted"), *masks, strict=True):
                if fold is None or fold.conv != conv:
                    if fold:
                        rows.append(fold.row())
                    fold = _Fold(conv)
                fold.add(line.as_py(), a, b)
            if len(rows) > 1000:
                yield give()
                rows = []
        if fold:
            rows.append(fold.row())
        if rows:
            yield give()

    shown = ["conv_id", "formatted", "loss_start", "loss_end"]
    dealt = lines.select(*shown, "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select(*shown).mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
