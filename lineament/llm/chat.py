"""Chat formatting by a finite-state machine over roles.

A template says, by role, what opens and closes a turn and whether its text is
under the loss; transitions say which role may follow which.  Turns become
segments: text to put down, with a loss flag.  Control strings inside texts are
broken by a backslash after their first character, and backslashes are doubled,
so the segments can be read back exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineament.plans.storage import partitions


@dataclass(frozen=True)
class Turn:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """turns by role; a role without a turn of its own is spelled out between role_open and role_close."""

    turns: dict[str, Turn] = field(
        default_factory=lambda: {"system": Turn("<<SYS>>", "<</SYS>>"), "user": Turn("[INST] ", " [/INST]"), "assistant": Turn("<s>", "</s>", True)}
    )
    role_open: str = "<|role|>"
    role_close: str = "<|text|>"
    other_close: str = "<|end|>"
    #: role -> roles that may follow; "" is the start and stands for any role not named.
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        marks = [m for t in self.turns.values() for m in (t.open, t.close)] + [self.role_open, self.role_close, self.other_close]
        return sorted({m.strip() for m in marks}, key=lambda m: (-len(m), m))

    def check(self) -> None:
        marks = self.controls()
        for a in marks:
            if "\\" in a or not a:
                raise ValueError(f"a control string may not be empty or hold a backslash: {a!r}")
            for b in marks:
                if a != b and b.startswith(a):
                    raise ValueError(f"{b!r} begins with {a!r}")
                if any(b.startswith(a[-k:]) for k in range(1, min(len(a), len(b)))):
                    raise ValueError(f"text that ends in a part of {a!r} could run into {b!r}")


class Codec:
    def __init__(self, template: Template):
        template.check()
        self.template = template
        marks = "|".join(map(re.escape, template.controls()))
        self._breaks = re.compile(rf"(?=(?:{marks}))(.)", re.S)
        self._escaped = re.compile(r"\\(.)", re.S)
        own = [rf"(?P<o{i}>{re.escape(t.open)})(?P<b{i}>.*?){re.escape(t.close)}" for i, t in enumerate(template.turns.values())]
        other = rf"{re.escape(template.role_open)}(?P<role>.*?){re.escape(template.role_close)}(?P<body>.*?){re.escape(template.other_close)}"
        self._turn = re.compile("|".join([*own, other]), re.S)
        self.roles = list(template.turns)

    def escape(self, text: str) -> str:
        return self._breaks.sub(r"\1\\", text.replace("\\", "\\\\"))

    def unescape(self, text: str) -> str:
        return self._escaped.sub(r"\1", text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, loss) of a turn, in order; an empty text makes an empty segment."""
        turn = self.template.turns.get(role)
        if turn:
            return [(turn.open, False), (self.escape(text), turn.loss), (turn.close, False)]
        t = self.template
        return [(t.role_open + self.escape(role) + t.role_close, False), (self.escape(text), False), (t.other_close, False)]

    def closes(self, text: str) -> bool:
        return any(text.endswith(m) for m in (*(t.close for t in self.template.turns.values()), self.template.other_close))

    def turns(self, text: str) -> Iterator[tuple[str, str, int]]:
        """(role, text, end) of the turns that text starts with."""
        at = 0
        while m := self._turn.match(text, at):
            at = m.end()
            if m["body"] is not None:
                yield self.unescape(m["role"]), self.unescape(m["body"]), at
            else:
                i = int(m.lastgroup[1:])
                yield self.roles[i], self.unescape(m[f"b{i}"]), at


SEGMENT = "conv_id long, turn_no long, segment_no long, text string, loss boolean, allowed boolean"


def _formatted(template: Template):
    def run(batches):
        codec, conv, state, turn_no, begun = Codec(template), None, "", -1, False
        for b in batches:
            rows = []
            for c, role, text in zip(*(b.column(k).to_pylist() for k in ("conv_id", "role", "text"))):
                if not begun or c != conv:
                    conv, state, turn_no, begun = c, "", -1, True
                role, turn_no = role or "", turn_no + 1
                allowed = role in template.follows.get(state, ())
                if role in template.turns:
                    state = role
                rows += [(c, turn_no, k, t, loss, allowed) for k, (t, loss) in enumerate(codec.segments(role, text or ""))]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()))], names=["conv_id", "turn_no", "segment_no", "text", "loss", "allowed"]
                )

    return run


def formatted(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, turn_no, segment_no, text, loss, allowed of every turn of conversations (conv_id, turn, role, text, ...).

    A conversation's turns are taken by turn, then role, then text, so ties and
    rows that repeat have a fixed order and are turns each.  A null text or role
    is empty, a null turn comes first, rows with a null conv_id are one
    conversation.  allowed says whether the role may stand where it does; a turn
    that may not is put down all the same.  Rows are sorted, not gathered: a
    task keeps one turn at a time, however long the conversation.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(_formatted(template), SEGMENT)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_violations long, valid boolean"


def _read(template: Template):
    def run(batches):
        codec = Codec(template)
        conv, begun = None, False
        out: list[tuple] = []

        def start(c):
            nonlocal conv, begun, turns, turn_sha, loss_sha, loss_chars, chars, bad, text, last, seen
            conv, begun = c, True
            turns, loss_chars, chars, bad, text, last, seen = 0, 0, 0, 0, "", "", None
            turn_sha, loss_sha = sha256(), sha256()

        turns = turn_sha = loss_sha = loss_chars = chars = bad = text = last = seen = None

        def end():
            if text:
                raise ValueError(f"conversation {conv} ends inside a turn")
            out.append((conv, turns, turn_sha.hexdigest(), loss_chars, loss_sha.hexdigest(), chars, bad, bad == 0 and last in template.ends))

        def table():
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=[c.split()[0] for c in DIGEST.split(", ")])

        for b in batches:
            for c, n, piece, loss, allowed in zip(*(b.column(k).to_pylist() for k in ("conv_id", "turn_no", "text", "loss", "allowed"))):
                if not begun or c != conv:
                    if begun:
                        end()
                    start(c)
                if n != seen:
                    seen = n
                    bad += not allowed
                chars += len(piece)
                text += piece
                if loss:
                    plain = codec.unescape(piece)
                    loss_chars += len(plain)
                    loss_sha.update(plain.encode())
                elif codec.closes(piece):
                    at = 0
                    for role, body, at in codec.turns(text):
                        turns, last = turns + 1, role
                        turn_sha.update(f"{role}\n{body}\n".encode())
                    text = text[at:]
            if out:
                yield table()
                out.clear()
        if begun:
            end()
            yield table()

    return run


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """What formatted() put down, read from the texts and loss flags alone: one row a conversation.

    Segments must come as formatted() gives them, a conversation's in order in
    one partition.  Turns are parsed from the joined text; hashes are taken as
    turns come.
    """
    return segments.mapInArrow(_read(template), DIGEST)
