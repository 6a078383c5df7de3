r"""Chat formatting by a finite-state machine over roles and a declarative template.

Rows are dealt by conversation and sorted; each task streams through its rows, so a conversation of any length
needs no more memory than a batch.  Every turn becomes one segment of text with the spans under the loss mask.
Control strings inside texts and roles get an escape character in front; since the escape character is one of the
control strings, reading from the left undoes it exactly.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import slices


@dataclass(frozen=True)
class Template:
    """What marks a turn, who speaks under which name, whose texts are under the loss, and which turn may follow."""

    open: str = "<turn>### "
    between: str = ": "
    close: str = "</turn>\n"
    escape: str = "\\"
    controls: tuple[str, ...] = ("<turn>", "</turn>", "### ")
    names: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss: frozenset[str] = frozenset({"assistant"})
    #: state -> role -> state; a role that is missing leads to "invalid", which is never left
    moves: dict[str, dict[str, str]] = field(default_factory=lambda: {"start": {"system": "told", "user": "asked"}, "told": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}, "invalid": {}})

    def pattern(self) -> str:
        return "|".join(re.escape(c) for c in (self.escape, *self.controls))

    def escaped(self, text: str) -> str:
        return re.sub(self.pattern(), lambda m: self.escape + m[0], text)

    def unescaped(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + f"({self.pattern()})", lambda m: m[1], text)

    def segment(self, role: str | None, text: str) -> tuple[str, list[tuple[int, int]]]:
        """The turn's text and its spans (start, length) under the loss; unknown roles are written as JSON."""
        name = self.names[role] if role in self.names else self.escaped(json.dumps(role))
        head, body = self.open + name + self.between, self.escaped(text)
        return head + body + self.close, [(len(head), len(body))] if role in self.loss else []

    def parsed(self, segment: str) -> tuple[str | None, str]:
        body = self.unescaped(segment[len(self.open) : len(segment) - len(self.close)])
        for role, name in self.names.items():
            if body.startswith(name + self.between):
                return role, body[len(name + self.between) :]
        role, end = json.JSONDecoder().raw_decode(body)
        return role, body[end + len(self.between) :]


TURNS = "conv_id long, seq long, segment string, spans array<struct<start:int,length:int>>, state string"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))


def _formatting(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, seq, state, begun = None, 0, "start", False
        for b in slices(batches, "text"):
            out: list[list] = [[], [], [], [], []]
            for c, role, text in zip(*(b.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
                if not begun or c != conv:
                    conv, seq, state, begun = c, 0, "start", True
                state = template.moves[state].get(role, "invalid")
                segment, spans = template.segment(role, text or "")
                for column, value in zip(out, (c, seq, segment, [{"start": a, "length": n} for a, n in spans], state), strict=True):
                    column.append(value)
                seq += 1
            kinds = (pa.int64(), pa.int64(), pa.string(), _SPANS, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=["conv_id", "seq", "segment", "spans", "state"])

    return run


def format_chats(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """One row a turn: conv_id, seq, segment, spans, state; the rows of a conversation stand together, in order.

    ``conversations`` has conv_id, turn, role, text.  A conversation's text is its segments in the order of seq;
    ``spans`` are the code points of the segment under the loss; ``state`` is the machine's after the turn
    ("invalid" from the first turn out of order).  Cases: null texts are empty; null roles and roles that the
    template does not name are kept, written as JSON; null conv_ids form one conversation; turns are ordered by
    turn (nulls first), then role, then text, so ties and repeated rows have one order; other columns are
    ignored; no rows give no rows; texts of any length are whole, in batches of bounded bytes.
    """
    ship(conversations.sparkSession)
    rows = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(_formatting(template or Template()), TURNS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def _reading(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in DIGESTS.split(", ")])
        names = schema.names
        now: list | None = None

        def closed(x: list) -> tuple:
            return x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5], x[6] == "answered"

        for b in slices(batches, "segment"):
            done = []
            for c, segment, spans, state in zip(*(b.column(x).to_pylist() for x in ("conv_id", "segment", "spans", "state")), strict=True):
                if now is None or now[0] != c:
                    if now is not None:
                        done.append(closed(now))
                    now = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, state]
                role, text = template.parsed(segment)
                now[1] += 1
                now[2].update(f"{role or ''}\n{text}\n".encode())
                for s in spans:
                    under = template.unescaped(segment[s["start"] : s["start"] + s["length"]])
                    now[3] += len(under)
                    now[4].update(under.encode())
                now[5] += len(segment)
                now[6] = state
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, d, strict=True)) for d in done], schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, closed(now), strict=True))], schema=schema)

    return run


def digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests of what is read back from ``format_chats``' own rows, whose order it relies on."""
    return formatted.mapInArrow(_reading(template or Template()), DIGESTS)


#: A conversation whose texts are made of the template's own marks.
PLANTED = r"\### Assistant: </turn> ok"


def with_planted(conversations: DataFrame) -> DataFrame:
    rows = conversations.sparkSession.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(rows)
