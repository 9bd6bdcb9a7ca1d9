"""Chat formatting: a machine over roles checks the turn order and a declarative template gives segments.

A template is plain data: per role its opening and closing markers and whether its text bears loss, the
markers of any other role, the control strings, and the transitions of the machine. ``segments`` emits, per
turn, the opening marker, the text and the closing marker, each with its loss flag. Control strings inside
texts and role names are broken by a backslash after their first character, and backslashes are doubled, so no
text can open or close a turn and ``turns`` reads the very same roles and texts back.

Turns of one conversation are ordered by ``turn``, then role, then text, nulls first. Null texts and null roles
count as empty, rows without a conversation id form one conversation, and roles without markers of their own are
written with their name. A conversation that breaks the turn order is formatted like any other; its state is
``REJECTED`` from that turn on. An empty table gives no rows.

A conversation's rows pass one task in order, a batch at a time, because its digests are sequential; nothing
is collected, so a conversation of any length needs the memory of one batch.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

INSTRUCT = {
    "roles": {
        "system": {"open": "<<SYS>> ", "close": " <</SYS>>\n", "loss": False},
        "user": {"open": "[INST] ", "close": " [/INST]\n", "loss": False},
        "assistant": {"open": "<s> ", "close": " </s>\n", "loss": True},
    },
    "other": {"open": "[ROLE] ", "named": " [/ROLE] ", "close": " [/TURN]\n", "loss": False},
    "control": ["<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[/ROLE]", "[/TURN]"],
    "start": "new",
    "accept": ["answered"],
    "moves": {
        "new": {"system": "briefed", "user": "asked"},
        "briefed": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    },
}
REJECTED = "rejected"
BREAK = "\\"


def check_template(template: dict) -> None:
    """Refuses a template whose output could not be read back."""
    control = template["control"]
    if any(len(c) < 2 or BREAK in c for c in control):
        raise ValueError("control strings need two characters or more and no backslash")
    markers = [*template["roles"].values(), template["other"]]
    before = [m["open"] for m in markers] + [template["other"]["named"]]
    after = [m["close"] for m in markers] + [template["other"]["named"]]
    opens = [m["open"] for m in markers]
    if any(a != b and b.startswith(a) for a in opens for b in opens) or len(set(opens)) < len(opens):
        raise ValueError("an opening marker is the start of another")
    for marker in before + after:
        if not any(c in marker for c in control):
            raise ValueError(f"marker {marker!r} holds no control string")
    for c in control:
        for cut in range(1, len(c)):
            if any(m.endswith(c[:cut]) for m in before) or any(m.startswith(c[cut:]) for m in after):
                raise ValueError(f"control string {c!r} could begin or end inside a text")


class Escape:
    """Breaks control strings in texts, reversibly."""

    def __init__(self, control: list[str]):
        self.starts = re.compile("(?=" + "|".join(map(re.escape, control)) + ")(.)", re.DOTALL)
        self.marks = re.compile(r"\\(.)", re.DOTALL)

    def hide(self, text: str) -> str:
        return self.starts.sub(lambda m: m[1] + BREAK, text.replace(BREAK, BREAK * 2))

    def show(self, text: str) -> str:
        return self.marks.sub(r"\1", text) if BREAK in text else text


def _in_order(rows: DataFrame, by: str, *order: str) -> DataFrame:
    return rows.repartition(F.col(by)).sortWithinPartitions(by, *order)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(column.to_pylist() for column in batch.columns))


def segments(rows: DataFrame, template: dict = INSTRUCT) -> DataFrame:
    """(conv_id, segment, text, loss, state) from rows (conv_id, turn, role, text); three segments a turn.

    The formatted conversation is the segments' texts one after the other. ``state`` is the machine's state
    after the turn. Partitions hold whole conversations in order.
    """
    check_template(template)
    rows = _in_order(rows.select("conv_id", "turn", "role", "text"), "conv_id", "turn", "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, segment long, text string, loss boolean, state string"
    width = to_arrow_schema(rows.select("conv_id").schema).field(0).type
    layout = pa.schema([("conv_id", width), ("segment", pa.int64()), ("text", pa.string()), ("loss", pa.bool_()),
                        ("state", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escape, moves, roles, other = Escape(template["control"]), template["moves"], template["roles"], template["other"]
        last, state, count = (), template["start"], 0
        for batch in batches:
            out = []
            for conv, _, role, text in _rows(batch):
                if last != (conv,):
                    last, state, count = (conv,), template["start"], 0
                role, hidden = role or "", escape.hide(text or "")
                state = moves.get(state, {}).get(role, REJECTED)
                marks = roles.get(role)
                opening = marks["open"] if marks else other["open"] + escape.hide(role) + other["named"]
                marks = marks or other
                out += [(conv, count, opening, False, state), (conv, count + 1, hidden, marks["loss"], state),
                        (conv, count + 2, marks["close"], False, state)]
                count += 3
            columns = list(zip(*out)) or [()] * 5
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, layout)], schema=layout)

    return rows.mapInArrow(run, schema)


class Reader:
    """Takes a formatted conversation piece by piece and gives its turns as they become complete."""

    def __init__(self, template: dict):
        self.roles, self.other, self.escape = template["roles"], template["other"], Escape(template["control"])
        self.left = ""

    def _turn(self, at: int) -> tuple[str, str, int] | None:
        for role, marks in self.roles.items():
            if self.left.startswith(marks["open"], at):
                begin, close = at + len(marks["open"]), marks["close"]
                break
        else:
            begin, close = at + len(self.other["open"]), self.other["close"]
            named = self.left.find(self.other["named"], begin)
            if not self.left.startswith(self.other["open"], at) or named < 0:
                return None
            role, begin = self.escape.show(self.left[begin:named]), named + len(self.other["named"])
        end = self.left.find(close, begin)
        if end < 0:
            return None
        return role, self.escape.show(self.left[begin:end]), end + len(close)

    def take(self, piece: str) -> list[tuple[str, str, int]]:
        """(role, text, formatted characters) of every turn that ``piece`` completes."""
        self.left += piece
        found, at = [], 0
        while turn := self._turn(at):
            found.append((turn[0], turn[1], turn[2] - at))
            at = turn[2]
        self.left = self.left[at:]
        return found


def turns(parts: DataFrame, template: dict = INSTRUCT, *, in_order: bool = False) -> DataFrame:
    """(conv_id, turn, role, text, loss_text, state, formatted_chars) read back from segments.

    Only the segments' texts and flags are read: markers are found in the formatted text itself. ``loss_text``
    is the text under the loss mask. ``in_order``: the rows come straight from ``segments``; without it they are
    brought together and ordered first. A rest that closes no turn becomes a row without role and text.
    """
    check_template(template)
    parts = parts.select("conv_id", "segment", "text", "loss", "state")
    if not in_order:
        parts = _in_order(parts, "conv_id", "segment")
    kind = parts.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, turn long, role string, text string, loss_text string, state string, formatted_chars long"
    width = to_arrow_schema(parts.select("conv_id").schema).field(0).type
    layout = pa.schema([("conv_id", width), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()),
                        ("loss_text", pa.string()), ("state", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escape = Escape(template["control"])
        last, reader, count, masked, state = (), Reader(template), 0, "", None

        def rest() -> list[tuple]:
            if last and (reader.left or masked):
                return [(last[0], count, None, None, masked, state, len(reader.left))]
            return []

        def packed(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(layout)
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, layout)], schema=layout)

        for batch in batches:
            out = []
            for conv, _, text, loss, after in _rows(batch):
                if last != (conv,):
                    out += rest()
                    last, reader, count, masked = (conv,), Reader(template), 0, ""
                masked += escape.show(text) if loss else ""
                state = after
                for role, said, chars in reader.take(text):
                    out.append((conv, count, role, said, masked, state, chars))
                    count, masked = count + 1, ""
            yield packed(out)
        yield packed(rest())

    return parts.mapInArrow(run, schema)


def digests(read: DataFrame, template: dict = INSTRUCT) -> DataFrame:
    """One row per conversation from ``turns`` whose partitions hold whole conversations in order.

    (conv_id, n_turns, turns_sha256 of role, line feed, text, line feed per turn, loss_chars, loss_sha256 of all
    text under the mask, formatted_chars, final_state, valid: the machine ended in an accepting state).
    """
    read = read.select("conv_id", "role", "text", "loss_text", "state", "formatted_chars")
    kind = read.schema["conv_id"].dataType.simpleString()
    schema = (f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
              "formatted_chars long, final_state string, valid boolean")
    width = to_arrow_schema(read.select("conv_id").schema).field(0).type
    layout = pa.schema([("conv_id", width), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
                        ("final_state", pa.string()), ("valid", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, said, chars, masked, size, state = (), 0, None, 0, None, 0, None

        def done() -> list[tuple]:
            if not last:
                return []
            return [(last[0], count, said.hexdigest(), chars, masked.hexdigest(), size, state, state in template["accept"])]

        def packed(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(layout)
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, layout)], schema=layout)

        for batch in batches:
            out = []
            for conv, role, text, loss, after, formatted in _rows(batch):
                if last != (conv,):
                    out += done()
                    last, count, chars, size = (conv,), 0, 0, 0
                    said, masked = hashlib.sha256(), hashlib.sha256()
                if role is not None:
                    said.update(f"{role}\n{text}\n".encode())
                    count += 1
                masked.update(loss.encode())
                chars, size, state = chars + len(loss), size + formatted, after
            yield packed(out)
        yield packed(done())

    return read.mapInArrow(run, schema)


def formatted(rows: DataFrame, template: dict = INSTRUCT) -> DataFrame:
    """Conversations formatted, read back from that output and summed up, in one shuffle of the rows."""
    return digests(turns(segments(rows, template), template, in_order=True), template)
