"""Chat formatting: a finite-state machine over roles turns conversations into text segments.

A declarative ``Template`` gives the text around the turns of each role, which roles are trained on
(loss), and the machine: from each state the roles that may follow and the state they lead to. The
machine walks every conversation in turn order and emits a row per turn with its segments (text and
loss flag). Only the text of a trained role is under the loss mask. A turn that the machine does not
allow is kept, marked ``valid = false`` and followed from the state its role would lead to.

Control strings inside texts and role names get a backslash after their first character, and every
backslash is doubled, so the output can be parsed back to exactly the same turns (``read_back``).

One shuffle by conversation, then a streamed pass over sorted rows: memory does not grow with the
length of a conversation.

Defined cases: null role or text: empty; turns in the order of (turn, role, text), nulls first, so
repeated turns stay in a fixed order; rows with null conv_id form one conversation; other columns are
dropped; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SEGMENTS = "array<struct<text: string, loss: boolean>>"
_TURNS = f"conv_id long, turn_no long, state string, valid boolean, segments {_SEGMENTS}"


@dataclass(frozen=True)
class Role:
    prefix: str
    suffix: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    begin: str = "<s>"
    roles: dict[str, Role] = field(
        default_factory=lambda: {
            "system": Role("<<SYS>>\n", "\n<</SYS>>\n\n"),
            "user": Role("[INST] ", " [/INST]"),
            "assistant": Role(" ", " </s>", loss=True),
        }
    )
    other: tuple[str, str, str] = ("<|role|>", "<|said|>", "<|end|>")
    controls: tuple[str, ...] = ("<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<|role|>", "<|said|>", "<|end|>")
    start: str = "start"
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "briefed",
            ("start", "user"): "asked",
            ("briefed", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )

    def step(self, state: str, role: str) -> tuple[str, bool]:
        """The next state, and whether the machine allows the move."""
        if (state, role) in self.moves:
            return self.moves[state, role], True
        return next((to for (_, r), to in self.moves.items() if r == role), state), False

    def turn(self, role: str, text: str, first: bool) -> list[tuple[str, bool]]:
        begin = self.begin if first else ""
        if known := self.roles.get(role):
            return [(begin + known.prefix, False), (self.escape(text), known.loss), (known.suffix, False)]
        a, b, c = self.other
        return [(begin + a + self.escape(role) + b, False), (self.escape(text), False), (c, False)]

    def escape(self, text: str) -> str:
        heads = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls)
        return re.sub(heads, lambda m: m[0] + "\\", text.replace("\\", "\\\\"))

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def parse(self, text: str) -> list[tuple[str, str]]:
        """The turns (role, text) in formatted text that holds whole turns."""
        out, at = [], len(self.begin) if text.startswith(self.begin) else 0
        while at < len(text):
            a, b, c = self.other
            if text.startswith(a, at):
                body, stop = at + len(a), text.index(c, at)
                role, _, said = text[body:stop].partition(b)
                stop += len(c)
            else:
                role, known = max(((r, k) for r, k in self.roles.items() if text.startswith(k.prefix, at)), key=lambda x: len(x[1].prefix))
                stop = text.index(known.suffix, at + len(known.prefix))
                said, stop = text[at + len(known.prefix) : stop], stop + len(known.suffix)
            out.append((self.unescape(role), self.unescape(said)))
            at = stop
        return out


def _format(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, n = object(), template.start, 0
        for batch in batches:
            rows = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv != last:
                    last, state, n = conv, template.start, 0
                state, valid = template.step(state, role)
                rows.append((conv, n, state, valid, [{"text": t, "loss": loss} for t, loss in template.turn(role, text, n == 0)]))
                n += 1
            yield _batch(rows, _SCHEMA)

    return run


_SCHEMA = pa.schema([("conv_id", pa.int64()), ("turn_no", pa.int64()), ("state", pa.string()), ("valid", pa.bool_()), ("segments", pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())])))])
_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema.types, strict=True)], schema=schema)


class _Digest:
    """What one conversation's output says, turn by turn."""

    def __init__(self, conv):
        self.conv, self.turns, self.chars, self.loss_chars, self.valid = conv, 0, 0, 0, True
        self.said, self.loss = hashlib.sha256(), hashlib.sha256()

    def row(self) -> tuple:
        return self.conv, self.turns, self.said.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid


def _read(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Digest | None = None
        for batch in batches:
            done = []
            for conv, valid, segments in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "valid", "segments")), strict=True):
                if now is None or conv != now.conv:
                    done += [now.row()] if now else []
                    now = _Digest(conv)
                text = "".join(x["text"] for x in segments)
                for role, said in template.parse(text):
                    now.said.update(f"{role}\n{said}\n".encode())
                    now.turns += 1
                for x in segments:
                    if x["loss"]:
                        trained = template.unescape(x["text"])
                        now.loss.update(trained.encode())
                        now.loss_chars += len(trained)
                now.chars += len(text)
                now.valid &= valid
            yield _batch(done, _READ)
        if now:
            yield _batch([now.row()], _READ)

    return run


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """A row per turn of ``turns`` (conv_id, turn, role, text): conv_id, turn_no from 0, the machine's
    state after it, whether it was allowed, and the segments. A conversation's rows are next to each
    other, in order, in one partition."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_format(template or Template()), _TURNS)


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """A row per conversation of ``format_chats``' output, parsed from its text: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars, valid (every turn was allowed)."""
    return formatted.mapInArrow(_read(template or Template()), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
