"""Chat formatting in budgeted windows.

A conversation longer than the token budget is cut into windows at turn ends: running sums of the
turns' tokens choose each window's span of fresh turns. Every window opens with the system turn if
the conversation has one, then repeats a limited history, then has its fresh turns. The loss mask
covers the assistant text of fresh turns only, so no target is trained on twice.

A turn is written `### role`, a line feed, its text, `</turn>`, a line feed. Inside roles and texts
the control strings and the backslash get a backslash in front, which reading takes off again.

Rows are dealt by conversation and sorted by turn; a worker streams through them with one window in
memory, whatever the length of a conversation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens (runs of characters other than white space, and one a turn) of a window, the most turns that are
#: repeated before its fresh ones, and the tokens these may have.
BUDGET, HISTORY_TURNS, HISTORY_TOKENS = 512, 2, 128
#: Rows of output that are handed on at once.
_BATCH = 512

_CONTROL = re.compile(r"\\|###|</turn>|\n")
_CONTROL_TEXT = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|\n)")
_TURN = re.compile(r"### ((?:[^\\\n]++|\\(?:\\|###|</turn>|\n))*+)\n((?:[^\\<]++|\\(?:\\|###|</turn>)|<(?!/turn>))*+)</turn>\n")

WINDOW = "conv_id string, window long, formatted string, repeated int, mask array<struct<start: int, end: int>>"


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def written(role: str, text: str) -> tuple[str, int, int]:
    """A turn as written, and where in it the text starts and ends."""
    head = "### " + _CONTROL.sub(r"\\\g<0>", role) + "\n"
    body = _CONTROL_TEXT.sub(r"\\\g<0>", text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def read(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted window."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


class _Windows:
    """Windows of one conversation, its turns given one after the other."""

    def __init__(self, conv: str | None, budget: int, turns: int, tokens: int):
        self.conv, self.budget, self.turns, self.tokens = conv, budget, turns, tokens
        self.system: tuple | None = None
        self.count = 0
        self.end = 0  # tokens up to here: the running sum
        self.base = 0  # the running sum where the window's fresh turns begin
        self.kept: list[tuple] = []  # repeated turns of the open window
        self.fresh: list[tuple] = []
        self.seen = 0

    def _room(self) -> int:
        return self.budget - (self.system[2] if self.system else 0) - sum(t[2] for t in self.kept)

    def add(self, role: str, text: str) -> Iterator[tuple]:
        turn = (role, text, len(text.split()) + 1)
        if self.fresh and self.end + turn[2] - self.base > self._room():
            yield self.close()
            self.kept = []
            for old in reversed(self.last):
                if len(self.kept) == self.turns or sum(t[2] for t in self.kept) + old[2] > self.tokens:
                    break
                self.kept.insert(0, old)
            while self.kept and turn[2] > self._room():
                self.kept.pop(0)
            self.base, self.fresh = self.end, []
        if not self.seen and role == "system":
            self.first = turn
        self.seen += 1
        self.fresh.append(turn)
        self.end += turn[2]

    first: tuple | None = None
    last: list[tuple] = []

    def close(self) -> tuple:
        shown = ([self.system] if self.system else []) + self.kept
        parts, mask, at = [], [], 0
        for i, (role, text, _) in enumerate(shown + self.fresh):
            piece, a, b = written(role, text)
            if i >= len(shown) and role == "assistant" and b > a:
                mask.append({"start": at + a, "end": at + b})
            parts.append(piece)
            at += len(piece)
        row = (self.conv, self.count, "".join(parts), len(shown), mask)
        self.count += 1
        own = self.fresh[1:] if self.first is not None and self.system is None else self.fresh
        self.last = (self.kept + own)[-self.turns :] if self.turns else []
        self.system = self.first  # retained from the second window on
        return row


def format_chats(turns: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """One row per window: conv_id, window, formatted, repeated (turns at its head that are not
    fresh), mask (spans of code points under the loss), from turns (conv_id, turn, role, text).

    Rows go by turn, equal turns by role and text; a null turn comes first. Null roles and texts are
    empty. Rows with a null conv_id are one conversation. Repeated rows are separate turns. A turn
    longer than the budget has a window of its own and is never cut; the system turn is retained
    whole. Other columns are not read; an empty table gives an empty result.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("string").alias("conv_id"), "turn", text("role").alias("role"), text("text").alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, now = [], None
        for batch in batches:
            for conv, role, said in zip(batch["conv_id"], batch["role"], batch["text"], strict=True):
                conv = conv if isinstance(conv, str) else None
                if now is None or now.conv != conv:
                    if now:
                        out.append(now.close())
                    now = _Windows(conv, budget, history_turns, history_tokens)
                out.extend(now.add(role, said))
                if len(out) >= _BATCH:
                    yield pd.DataFrame(out, columns=["conv_id", "window", "formatted", "repeated", "mask"])
                    out = []
        if now:
            out.append(now.close())
            yield pd.DataFrame(out, columns=["conv_id", "window", "formatted", "repeated", "mask"])

    return rows.mapInPandas(stream, WINDOW).withColumn("conv_id", F.col("conv_id").cast(turns.schema["conv_id"].dataType))


def read_back(windows: DataFrame) -> DataFrame:
    """One row per conversation of what format_chats() returned (in its order, undealt since):
    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, windows."""

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "windows"]
        out, now, said, learnt, sums = [], None, None, None, None

        def done() -> tuple:
            return (now[0], sums[0], said.hexdigest(), sums[1], learnt.hexdigest(), sums[2], sums[3])

        for batch in batches:
            for conv, formatted, repeated, mask in zip(batch["conv_id"], batch["formatted"], batch["repeated"], batch["mask"], strict=True):
                conv = conv if isinstance(conv, str) else None
                if now is None or now[0] != conv:
                    if now:
                        out.append(done())
                    now, said, learnt, sums = (conv,), sha256(), sha256(), [0, 0, 0, 0]
                for role, text in read(formatted)[repeated:]:
                    said.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
                    sums[0] += 1
                for span in mask:
                    text = unescape(formatted[span["start"] : span["end"]])
                    learnt.update(text.encode("utf-8", "replace"))
                    sums[1] += len(text)
                sums[2] += len(formatted)
                sums[3] += 1
            if len(out) >= _BATCH:
                yield pd.DataFrame(out, columns=names)
                out = []
        if now:
            out.append(done())
        yield pd.DataFrame(out, columns=names)

    kind = windows.schema["conv_id"].dataType
    told = windows.withColumn("conv_id", F.col("conv_id").cast("string"))
    told = told.mapInPandas(stream, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, windows long")
    return told.withColumn("conv_id", F.col("conv_id").cast(kind))
