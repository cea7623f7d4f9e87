"""Chat formatting: a finite-state machine over roles, text segments with loss flags, and the way back.

A template is data: what opens and closes a turn, which roles' texts are trained on, and which role may follow which.
Turns pass one by one, ordered within their conversation, so a task holds a batch of them however long a conversation is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship


@dataclass(frozen=True)
class Template:
    """How conversations are written and which turn orders are valid.

    opening (with {role}, then a line feed) and closing begin with `guard`, which no text or role contains once it is
    escaped. moves maps (state, role) to the next state; a turn that no move allows is marked, and the machine goes on
    from the state of the role's name if there is one, else from where it is. A conversation may end in `final` states.
    """

    opening: str = "<|im_start|>{role}\n"
    closing: str = "<|im_end|>\n"
    guard: str = "<|"
    trained: frozenset[str] = frozenset({"assistant"})
    start: str = "start"
    final: frozenset[str] = frozenset({"assistant"})
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"}
    )

    def __post_init__(self):
        if len(self.guard) != 2 or self.guard[0] == self.guard[1] or "\\" in self.guard or not self.opening.endswith("{role}\n") or not all(x.startswith(self.guard) for x in (self.opening, self.closing)):
            raise ValueError("opening and closing must begin with a guard of two different characters, and {role} and a line feed end the opening")

    def escape(self, text: str) -> str:
        """The text with one more backslash between the guard's characters wherever they stand with any number of them."""
        a, b = map(re.escape, self.guard)
        return re.sub(rf"{a}(\\*){b}", rf"{self.guard[0]}\\\1{self.guard[1]}", text)

    def unescape(self, text: str) -> str:
        """What escape was given."""
        a, b = map(re.escape, self.guard)
        return re.sub(rf"{a}\\(\\*){b}", rf"{self.guard[0]}\1{self.guard[1]}", text)

    def escape_role(self, role: str) -> str:
        """A role in one line."""
        return self.escape(role.replace("\\", "\\\\").replace("\n", "\\n"))

    def unescape_role(self, role: str) -> str:
        """What escape_role was given."""
        return re.sub(r"\\([\\n])", lambda m: "\n" if m[1] == "n" else "\\", self.unescape(role))

    def step(self, state: str, role: str) -> tuple[str, bool]:
        """(next state, whether a move allows the role)."""
        after = self.moves.get((state, role))
        if after is not None:
            return after, True
        return (role if role in self.moves.values() else state), False

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, loss) pieces of a turn: what opens it, its escaped text, what closes it."""
        return [(self.opening.replace("{role}", self.escape_role(role)), False), (self.escape(text), role in self.trained), (self.closing, False)]


CHATML = Template()
#: The columns of formatted turns beside the conversation's id.
FORMATTED = "seq long, state string, allowed boolean, segments array<struct<text: string, loss: boolean>>"


def in_order(turns: DataFrame, key: str, *order) -> DataFrame:
    """Rows of a key in one partition, one after another, ordered."""
    return turns.repartition(key).sortWithinPartitions(F.asc_nulls_first(key), *order)


def format_chat(conversations: DataFrame, template: Template = CHATML) -> DataFrame:
    """conv_id, seq (from 0), state after the turn, whether it was allowed, and its segments with their loss flags.

    Turns are ordered by turn (null first), then role and text, so repeated rows and ties are turns of their own in a
    stated order. A null role or text is empty; a null conv_id is one conversation. Other columns aren't read. A
    conversation's rows are one sequence: they meet in one task, which holds a batch of them at a time.
    """
    ship(conversations.sparkSession)
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = in_order(turns, "conv_id", F.asc_nulls_first("turn"), "role", "text").select("conv_id", "role", "text")
    schema = T.StructType([turns.schema["conv_id"], *T.StructType.fromDDL(FORMATTED)])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, seq, state = object(), 0, template.start
        for batch in batches:
            keys, roles, texts = (batch.column(i).to_pylist() for i in range(3))
            rows: list[list] = [[], [], [], []]
            for key, role, text in zip(keys, roles, texts, strict=True):
                if key != here:
                    here, seq, state = key, 0, template.start
                state, allowed = template.step(state, role)
                for column, value in zip(rows, (seq, state, allowed, [{"text": t, "loss": x} for t, x in template.segments(role, text)]), strict=True):
                    column.append(value)
                seq += 1
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), *[pa.array(c, arrow.field(i + 1).type) for i, c in enumerate(rows)]], schema=arrow)

    return turns.mapInArrow(run, schema)


class Reader:
    """Reads one conversation back from its segments, in order, holding no more than a turn."""

    def __init__(self, template: Template):
        a, b = (re.escape(x) for x in (template.opening.removesuffix("{role}\n"), template.closing))
        self.template, self.turn = template, re.compile(rf"{a}([^\n]*)\n(.*?){b}", re.S)
        self.pending, self.n, self.chars, self.loss_chars = "", 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, loss: bool) -> None:
        """One segment."""
        self.chars += len(text)
        self.pending += text
        if loss:
            plain = self.template.unescape(text)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode())
        if text.endswith(self.template.closing):
            while m := self.turn.match(self.pending):
                self.n += 1
                self.all.update(f"{self.template.unescape_role(m[1])}\n{self.template.unescape(m[2])}\n".encode())
                self.pending = self.pending[m.end() :]

    def result(self) -> tuple:
        """n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars; raises if text is left that is no turn."""
        if self.pending:
            raise ValueError(f"{len(self.pending)} characters that are no turn")
        return self.n, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


#: What read_back finds of a conversation. first_refused is the first turn that no move allowed; valid says that there is
#: none and that the last state is final.
READ = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, first_refused long"


def read_back(formatted: DataFrame, template: Template = CHATML, ordered: bool = False) -> DataFrame:
    """conv_id and READ, a row for each conversation, parsed from the formatted text and the loss flags.

    ordered: the rows come straight from format_chat, so they lie in order; otherwise they are dealt and sorted by seq.
    A digest of a whole conversation needs its text in order: it is taken as the rows pass, a turn at a time.
    """
    ship(formatted.sparkSession)
    rows = (formatted if ordered else in_order(formatted, "conv_id", "seq")).select("conv_id", "seq", "state", "allowed", "segments")
    schema = T.StructType([formatted.schema["conv_id"], *T.StructType.fromDDL(READ)])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, reader, refused, state, found = None, None, None, "", []

        def done() -> tuple:
            return (here, *reader.result(), refused is None and state in template.final, refused)

        for batch in batches:
            for key, seq, state_, allowed, segments in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if reader is None or key != here:
                    if reader is not None:
                        found.append(done())
                    here, reader, refused = key, Reader(template), None
                state = state_
                if not allowed and refused is None:
                    refused = seq
                for s in segments:
                    reader.add(s["text"], s["loss"])
            if len(found) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), arrow, strict=True)], schema=arrow)
                found = []
        if reader is not None:
            found.append(done())
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(run, schema)
