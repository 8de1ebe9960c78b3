"""Chat formatting in budgeted, turn-aligned windows with a loss mask."""

from __future__ import annotations

import hashlib
import re
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, quoted
from .packing import TOKENIZER, encoder

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens of a window, and turns of history repeated in front of its new turns.
BUDGET = 1024
HISTORY = 2
#: Turns of one conversation that are held at a time.
HELD = 4096

_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)
_ROLE = {"\\\\": "\\", "\\n": "\n"}


def escape(text: str) -> str:
    """One more backslash in every ``<|``, so that no text holds a control string."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\[\\n]", lambda m: _ROLE[m.group()], unescape(role))


@dataclass(frozen=True)
class Turn:
    role: str
    text: str
    target: bool
    tokens: int

    @property
    def head(self) -> str:
        return f"{START}{self.role}\n"

    @property
    def formatted(self) -> str:
        return f"{self.head}{self.text}{END}\n"


class Windows:
    """Cuts the turns of one conversation into windows as they come."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system: Turn | None = None
        self.past: deque[Turn] = deque(maxlen=max(history, 1))
        self.held: list[Turn] = []
        self.number = 0

    def add(self, turn: Turn):
        self.held.append(turn)
        if len(self.held) >= HELD:
            yield from self.cut(last=False)

    def cut(self, last: bool):
        """Windows of the held turns; the span that may still grow stays unless the conversation is over."""
        upto = np.concatenate([[0], np.cumsum([t.tokens for t in self.held])])
        at = 0
        while at < len(self.held):
            kept = [self.system] if self.system else []
            room = self.budget - sum(t.tokens for t in kept)
            repeated: list[Turn] = []
            for t in reversed(self.past if self.history else ()):
                if sum(x.tokens for x in repeated) + t.tokens > room // 4:
                    break
                repeated.insert(0, t)
            room -= sum(t.tokens for t in repeated)
            end = max(at + 1, int(np.searchsorted(upto, upto[at] + room, "right")) - 1)
            if end >= len(self.held) and not last:
                break
            new = self.held[at:end]
            yield self.window(kept + repeated, new)
            if self.number == 1 and new[0].role == "system":
                self.system = new[0]
            self.past.extend(new[1:] if new[0] is self.system else new)
            at = end
        self.held = self.held[at:]

    def window(self, repeated: list[Turn], new: list[Turn]) -> dict:
        parts, spans, length = [], [], 0
        for i, t in enumerate([*repeated, *new]):
            if t.target and i >= len(repeated):
                begin = length + len(t.head)
                spans.append({"start": begin, "end": begin + len(t.text)})
            parts.append(t.formatted)
            length += len(t.formatted)
        self.number += 1
        return {"window": self.number - 1, "formatted": "".join(parts), "loss": spans, "repeated": len(repeated),
                "turns": len(new), "tokens": sum(t.tokens for t in [*repeated, *new])}


_FIELDS = [("window", pa.int32()), ("formatted", pa.string()),
           ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
           ("repeated", pa.int32()), ("turns", pa.int32()), ("tokens", pa.int64())]
_SCHEMA = "window int, formatted string, loss array<struct<start: long, end: long>>, repeated int, turns int, tokens long"


def _token_batches(tokenizer: str):
    """Rows (conv_id, turn, role, text) with the number of tokens of the formatted turn."""
    def run(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            counts = [len(encode(Turn(escape_role(role.as_py()), escape(text.as_py()), False, 0).formatted))
                      for role, text in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], names=[*batch.schema.names, "tokens"])
    return run


def _window_batches(budget: int, history: int):
    def run(batches):
        kind, ids, rows, size = None, [], [], 0
        open_, conv = None, None

        def flush():
            arrays = [pa.array(ids, kind), *[pa.array([r[n] for r in rows], t) for n, t in _FIELDS]]
            return pa.RecordBatch.from_arrays(arrays, names=["conv_id", *[n for n, _ in _FIELDS]])
        for batch in batches:
            kind = batch.column(0).type
            for c, role, text, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
                done = []
                if open_ is None or c != conv:
                    if open_ is not None:
                        done += [(conv, w) for w in open_.cut(last=True)]
                    open_, conv = Windows(budget, history), c
                safe, name = escape(text), escape_role(role)
                done += [(conv, w) for w in open_.add(Turn(name, safe, role == "assistant", n))]
                for i, w in done:
                    ids.append(i)
                    rows.append(w)
                    size += len(w["formatted"])
                if size > 1 << 23:
                    yield flush()
                    ids, rows, size = [], [], 0
        if open_ is not None:
            for w in open_.cut(last=True):
                ids.append(conv)
                rows.append(w)
        if rows:
            yield flush()
    return run


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer: str = TOKENIZER,
            conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Training windows (conv_id, window, formatted, loss, repeated, turns, tokens).

    Turns are taken in the order of (turn, role, text), nulls first; null roles and texts are empty. A prefix sum of
    token counts gives the longest span of new turns that fits ``budget`` beside the leading system turn, which every
    window retains, and up to ``history`` earlier turns, which take at most a quarter of the rest. A turn that does not
    fit has a window of its own, whole. ``loss`` holds the code point spans of new assistant texts;
    repeated ones are masked. Rows without conversation id form one conversation; repeated rows stay repeated turns; an
    empty table gives no windows. Extra columns are not read.

    Tokens are counted where the rows are read. Rows are then dealt and sorted by conversation, and a task streams
    through them with their counts: of a conversation, however long, it holds 4,096 turns.
    """
    rows = turns.select(
        F.col(quoted(conv_col)).alias("conv_id"), F.col(quoted(turn_col)).alias("turn"),
        F.coalesce(F.col(quoted(role_col)), F.lit("")).alias("role"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    kind, order = (rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    rows = rows.mapInArrow(_token_batches(tokenizer), f"conv_id {kind}, turn {order}, role string, text string, tokens long")
    rows = rows.repartition(partitions(turns), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text", "tokens").mapInArrow(
        _window_batches(budget, history), f"conv_id {kind}, {_SCHEMA}")


def read_back(formatted: str, repeated: int, loss: list[dict]) -> tuple[list[tuple[str, str]], list[str]]:
    """New turns (role, text) and texts under the loss mask of one window, unescaped."""
    turns = [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]
    return turns[repeated:], [unescape(formatted[s["start"]:s["end"]]) for s in loss]


def _digest_batches(batches):
    kind, open_, conv = None, None, None
    out = [[] for _ in range(6)]

    def close():
        for column, value in zip(out, (conv, open_[0], open_[1].hexdigest(), open_[2], open_[3].hexdigest(), open_[4])):
            column.append(value)
    for batch in batches:
        kind = batch.column(0).type
        for c, formatted, loss, repeated in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if open_ is None or c != conv:
                if open_ is not None:
                    close()
                open_, conv = [0, hashlib.sha256(), 0, hashlib.sha256(), 0], c
            turns, targets = read_back(formatted, repeated, loss)
            open_[0] += len(turns)
            for role, text in turns:
                open_[1].update(f"{role}\n{text}\n".encode())
            for text in targets:
                open_[2] += len(text)
                open_[3].update(text.encode())
            open_[4] += len(formatted)
    if open_ is not None:
        close()
    if kind is not None:
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(out, kinds)],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digests(formatted: DataFrame) -> DataFrame:
    """What windows say when read back, by conversation: turns and targets once each, in order."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    rows = formatted.select("conv_id", "window", "formatted", "loss", "repeated").repartition(
        partitions(formatted), "conv_id").sortWithinPartitions("conv_id", "window")
    return rows.select("conv_id", "formatted", "loss", "repeated").mapInArrow(
        _digest_batches, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
