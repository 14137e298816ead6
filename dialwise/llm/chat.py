"""Chat formatting in budgeted windows.

The turns of a conversation, in order, are formatted by a template into windows of at most ``BUDGET``
tokens. Prefix sums of the turns' tokens choose where a window ends, always between turns. A window
that doesn't begin the conversation repeats the system turn and then the last turns before it, at most
``HISTORY`` turns and ``HISTORY_TOKENS`` tokens, as far as the next turn still fits. The loss mask
covers the assistant texts of a window except the repeated ones, so each is learnt once. Nothing is
cut: a turn larger than the budget has a window without history.

Conversations are shuffled whole and sorted by turn, and streamed: a task holds one window, however
long a conversation is (its digest, like any, is computed in order).

Template: ``<s>`` begins a window; then ``[SYS]text[/SYS]``, ``[INST]text[/INST]``, ``[OUT]text</s>``
or, for other roles, ``[ROLE]name[/ROLE]text</s>``. A control string inside a text gets a backslash
after its first character (one more, if it has some), which reading back takes away again.

Defined cases: a null text or role counts as empty; a null conversation id is one conversation; a null
turn comes first; turns of one number are ordered by role, then text, and repeated rows are turns of
their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import deque
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialwise.llm.packing import VOCABULARY, token_ids

BUDGET, HISTORY, HISTORY_TOKENS = 2048, 4, 512
#: Tokens that the template adds to a turn at most.
MARKS = 8

_CONTROL = re.compile(r"([<\[])(\\*)(/?(?:s>|(?:INST|SYS|OUT|ROLE)\]))")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?(?:s>|(?:INST|SYS|OUT|ROLE)\]))")
_TURN = re.compile(
    r"\[SYS\](?P<system>.*?)\[/SYS\]|\[INST\](?P<user>.*?)\[/INST\]|\[OUT\](?P<assistant>.*?)</s>"
    r"|\[ROLE\](?P<role>.*?)\[/ROLE\](?P<other>.*?)</s>",
    re.DOTALL,
)
_WRAP = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>")}

_WINDOWS = (
    "conv_id long, window int, first_turn long, repeated int, text string,"
    " loss array<struct<start:int,end:int>>"
)
_DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string,"
    " formatted_chars long"
)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn by the template, and where its text begins and ends."""
    head, tail = _WRAP.get(role) or (f"[ROLE]{escape(role)}[/ROLE]", "</s>")
    body = escape(text)
    return head + body + tail, len(head), len(head) + len(body)


def parse(window: str) -> list[tuple[str, str, int, int]]:
    """role, text, and the place of the (escaped) text, of each turn of a formatted window."""
    turns = []
    for m in _TURN.finditer(window, len("<s>")):
        kind = m.lastgroup
        role = unescape(m["role"]) if kind == "other" else kind
        turns.append((role, unescape(m[kind]), m.start(kind), m.end(kind)))
    return turns


class _Windows:
    """Windows of one conversation, turn by turn."""

    def __init__(self, conv_id, budget: int, history: int, history_tokens: int):
        self.conv_id, self.budget = conv_id, budget
        self.history, self.history_tokens = history, history_tokens
        self.system, self.recent = None, deque(maxlen=history)
        self.held, self.repeated, self.done, self.number = [], 0, 0, 0

    def add(self, role: str, text: str, tokens: int):
        """The window that this turn closes, if any."""
        turn, closed = (role, text, tokens), None
        if self.held and sum(t for _, _, t in self.held) + tokens > self.budget:
            closed = self.close()
            kept = [self.system] if self.system else []
            room = self.budget - tokens - sum(t for _, _, t in kept)
            # From the latest turn backwards, the prefix sums that the room for history allows.
            past = [t for t in reversed(self.recent) if t is not self.system]
            sums = np.cumsum([t for _, _, t in past])
            fits = int(np.searchsorted(sums, min(room, self.history_tokens), "right"))
            self.held = (kept if room >= 0 else []) + past[:fits][::-1]
            self.repeated = len(self.held)
        self.held.append(turn)
        if role == "system" and self.system is None and self.done + len(self.held) == 1:
            self.system = turn
        self.recent.append(turn)
        return closed

    def close(self):
        parts, loss, at = ["<s>"], [], len("<s>")
        for i, (role, text, _) in enumerate(self.held):
            shown, start, end = render(role, text)
            if role == "assistant" and i >= self.repeated:
                loss.append({"start": at + start, "end": at + end})
            parts.append(shown)
            at += len(shown)
        row = (self.conv_id, self.number, self.done, self.repeated, "".join(parts), loss)
        self.done += len(self.held) - self.repeated
        self.number += 1
        self.held, self.repeated = [], 0
        return row


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
    )


_WINDOW_SCHEMA = pa.schema(
    [
        ("conv_id", pa.int64()), ("window", pa.int32()), ("first_turn", pa.int64()),
        ("repeated", pa.int32()), ("text", pa.string()),
        ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ]
)
_DIGEST_SCHEMA = pa.schema(
    [
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ]
)


def _format(path: str, budget: int, history: int, history_tokens: int):
    def run(batches):
        now = None
        for batch in batches:
            rows = []
            for conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv_id != now.conv_id:
                    if now:
                        rows.append(now.close())
                    now = _Windows(conv_id, budget, history, history_tokens)
                tokens = len(token_ids(escape(text), path)) + MARKS
                closed = now.add(role, text, tokens)
                if closed:
                    rows.append(closed)
            yield _batch(rows, _WINDOW_SCHEMA)
        if now:
            yield _batch([now.close()], _WINDOW_SCHEMA)

    return run


def format_conversations(
    turns: DataFrame,
    path: str = VOCABULARY,
    budget: int = BUDGET,
    history: int = HISTORY,
    history_tokens: int = HISTORY_TOKENS,
) -> DataFrame:
    """Windows: conv_id, window, first_turn (place of the first new turn), repeated (turns at the
    front that repeat earlier ones), text, loss (spans of the text under the loss mask).

    Windows of a conversation follow one another in one partition.
    """
    ordered = (
        turns.select(
            "conv_id",
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        )
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
    )
    return ordered.mapInArrow(_format(path, budget, history, history_tokens), _WINDOWS)


class _Digest:
    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss = conv_id, sha256(), sha256()
        self.n, self.loss_chars, self.chars = 0, 0, 0

    def add(self, repeated: int, text: str, loss: list) -> None:
        self.chars += len(text)
        turns = parse(text)[repeated:]
        self.n += len(turns)
        for role, said, _, _ in turns:
            self.turns.update(f"{role}\n{said}\n".encode())
        for span in loss:
            learnt = unescape(text[span["start"] : span["end"]])
            self.loss_chars += len(learnt)
            self.loss.update(learnt.encode())

    def row(self):
        return (
            self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars,
            self.loss.hexdigest(), self.chars,
        )


def _read_back(batches):
    now = None
    for batch in batches:
        rows = []
        columns = (batch.column(n).to_pylist() for n in ("conv_id", "repeated", "text", "loss"))
        for conv_id, repeated, text, loss in zip(*columns):
            if now is None or conv_id != now.conv_id:
                if now:
                    rows.append(now.row())
                now = _Digest(conv_id)
            now.add(repeated, text, loss)
        yield _batch(rows, _DIGEST_SCHEMA)
    if now:
        yield _batch([now.row()], _DIGEST_SCHEMA)


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation, what its formatted windows say when they are parsed again."""
    return windows.mapInArrow(_read_back, _DIGESTS)
