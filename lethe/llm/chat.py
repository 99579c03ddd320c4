"""Chat formatting with budgeted windows.

A conversation becomes training windows of at most ``budget`` tokens.  Prefix sums of turn
tokens choose the longest turn-aligned span of new turns that fits; each window after the
first repeats the leading system turns and the latest turns before the span, up to
``history`` tokens.  Loss covers the text of assistant turns, in the window where the turn
is new; repeated turns are masked.

Template: ``<|role|>ROLE<|text|>TEXT<|end|>`` a turn.  In roles and texts a backslash is
doubled and ``<|`` and ``|>`` get a backslash inside, so no text can hold a mark and every
text is read back exactly.

A conversation streams through one task in order of turn, with memory for one window: its
output is a sequence, and its digests are sequential.  Turns are never cut: a turn that is
longer than the budget has a window of its own, with the system turns.  The leading system
turns are repeated whole however long they are; where they leave no room, a window has one
new turn and passes the budget.

Defined results: null text and role are empty; rows of one turn number stand in order of
role, then text; a null turn stands first; rows with a null conversation are one
conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import NULL_ID

ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
_MARKS = 3                     # tokens that a turn's marks count as
_TURN = re.compile(r"<\|role\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
WINDOWS = "conv_id long, window int, n_repeated int, n_tokens long, text string, loss array<struct<first:int,end:int>>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|").replace("|>", "|\\>")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def n_tokens(role: str, text: str) -> int:
    """Tokens of a turn for the budget: words of the text, and the marks."""
    return len(text.split()) + _MARKS


def _render(turns, n_repeated: int):
    """Window text and the loss spans of its new assistant turns (in code points)."""
    parts, loss, at = [], [], 0
    for k, (role, text, _) in enumerate(turns):
        head, body = f"{ROLE}{escape(role)}{TEXT}", escape(text)
        if role == "assistant" and k >= n_repeated:
            loss.append({"first": at + len(head), "end": at + len(head) + len(body)})
        parts += (head, body, END)
        at += len(head) + len(body) + len(END)
    return "".join(parts), loss


class Windows:
    """Turns of one conversation in, windows out as soon as they are full."""

    def __init__(self, conv: int, budget: int, history: int):
        self.conv, self.budget, self.history = conv, budget, history
        self.system: list = []            # leading system turns, repeated in every window
        self.leading = True
        self.recent: deque = deque()      # latest turns of the windows before, up to `history` tokens
        self.fixed = 0                    # tokens of the repeated turns
        self.new: list = []
        self.total = 0                    # prefix sum over the new turns
        self.number = 0

    def put(self, role: str, text: str):
        turn = (role, text, n_tokens(role, text))
        if self.new and self.fixed + self.total + turn[2] > self.budget:
            yield self._close()
            while self.recent and self.fixed + turn[2] > self.budget:      # a long turn needs the room of the history
                self.fixed -= self.recent.popleft()[2]
        self.new.append(turn)
        self.total += turn[2]

    def _close(self):
        repeated = [*self.system, *self.recent] if self.number else []
        text, loss = _render([*repeated, *self.new], len(repeated))
        out = (self.conv, self.number, len(repeated), sum(t[2] for t in repeated) + self.total, text, loss)
        for t in self.new:
            self.leading = self.leading and t[0] == "system"
            if self.leading:
                self.system.append(t)
            else:
                self.recent.append(t)
        size = sum(t[2] for t in self.recent)
        while self.recent and size > self.history:
            size -= self.recent.popleft()[2]
        self.number += 1
        self.fixed, self.new, self.total = size + sum(t[2] for t in self.system), [], 0
        return out

    def end(self):
        if self.new:
            yield self._close()


def _format(budget: int, history: int):
    def run(batches):
        state, out, size = None, [], 0

        def flush():
            cols = list(zip(*out)) or [[]] * 6
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                              names=["conv_id", "window", "n_repeated", "n_tokens", "text", "loss"])
        for b in batches:
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv", "role", "text"))):
                if state is None or state.conv != conv:
                    if state:
                        out += state.end()
                    state = Windows(conv, budget, history)
                for w in state.put(role, text):
                    out.append(w)
                size += len(text)
                if size > 4 << 20:
                    yield flush()
                    out, size = [], 0
        if state:
            out += state.end()
        if out:
            yield flush()
    return run


def format_windows(turns: DataFrame, budget: int = 2048, history: int = 256, conv_col: str = "conv_id", turn_col: str = "turn",
                   role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per window: conv_id, window, n_repeated (turns that stand for context only),
    n_tokens, text, loss spans."""
    rows = turns.select(F.coalesce(F.col(conv_col).cast("long"), F.lit(NULL_ID)).alias("conv"), F.col(turn_col).alias("turn"),
                        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    out = dealt.select("conv", "role", "text").mapInArrow(_format(budget, history), WINDOWS)
    return out.withColumn("conv_id", F.expr(f"nullif(conv_id, {NULL_ID}L)"))


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, first and end of the escaped text) of each turn of a window."""
    return [(unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in _TURN.finditer(text)]


def _read(batches):
    at, turns, sha, loss_sha, chars, formatted, out = None, 0, None, None, 0, 0, []

    def row():
        return at, turns, sha.hexdigest(), chars, loss_sha.hexdigest(), formatted
    for b in batches:
        for conv, again, text, loss in zip(*(b.column(c).to_pylist() for c in ("conv_id", "n_repeated", "text", "loss"))):
            if sha is None or conv != at:
                if sha:
                    out.append(row())
                at, turns, chars, formatted, sha, loss_sha = conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            for role, body, _, _ in parse(text)[again:]:
                turns += 1
                sha.update(f"{role}\n{body}\n".encode())
            for span in loss:
                part = unescape(text[span["first"]:span["end"]])
                chars += len(part)
                loss_sha.update(part.encode())
            formatted += len(text)
        if len(out) > 5000:
            yield _digest_batch(out)
            out = []
    if sha:
        out.append(row())
    if out:
        yield _digest_batch(out)


def _digest_batch(out):
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                      names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, from the windows alone: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars."""
    dealt = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return dealt.select("conv_id", "n_repeated", "text", "loss").mapInArrow(
        _read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
