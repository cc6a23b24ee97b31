"""Chats as training examples: each assistant turn is an example, all turns before it its context.

A conversation is formatted once, turn by turn.  The template marks turns by control strings; where a
text or a role holds one, a backslash is put after its first character, one more if some are there,
so that every control string in the output is the template's, and texts can be read back exactly.

Prefix-target expansion: every assistant turn is exploded into an example of its own, written out
whole: its context, which is the formatted conversation before that turn, and the turn itself as the
target.  Only the reply is trainable (the span [loss_start, loss_end) of characters of both together).
So the output of a conversation grows with the square of its turns, as the method has it.

Rows of a conversation are streamed in order of (turn, role, text) through one task that holds the
conversation up to its current turn and a batch of examples; its input is one sorted run, which Spark
spills.  A row holds one example, so a conversation of more than 2 GB is beyond Spark's rows.  Null
texts and roles count as empty; rows without a conversation or a turn form one conversation, or come
first in theirs.  Repeated rows are turns of their own.  Conversations without an assistant have no
example, and yet their pieces.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a batch that goes back to Spark, and characters after which it goes earlier.
OUT_ROWS, OUT_CHARS = 2000, 1 << 22
PIECE = "conv_id {}, turn_no long, piece string, start long, example long, context string, loss_start long, loss_end long"
DIGEST = "conv_id {}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long, expanded_chars long"


@dataclass(frozen=True)
class Template:
    """Strings before and after the text of a turn, by role; other roles are named between the strings of named."""

    roles: dict[str, tuple[str, str]] = field(default_factory=lambda: {"user": ("[INST] ", " [/INST]"), "assistant": (" ", "</s>"), "system": ("<<SYS>>", "<</SYS>>")})
    named: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")
    #: Further strings that a tokenizer takes for control.
    more: tuple[str, ...] = ("<s>",)
    target: str = "assistant"

    def controls(self) -> list[str]:
        own = {x.strip() for pair in self.roles.values() for x in pair} | set(self.named) | set(self.more)
        return sorted(own - {""}, key=lambda x: (-len(x), x))

    def pattern(self) -> str:
        """A control string with backslashes after its first character, if any."""
        return "|".join(rf"({re.escape(c[0])})(\\*)({re.escape(c[1:])})" for c in self.controls())

    def escape(self) -> Callable[[str], str]:
        found = re.compile(self.pattern())
        return lambda s: found.sub(lambda m: m[0][0] + "\\" + m[0][1:], s)

    def unescape(self) -> Callable[[str], str]:
        found = re.compile(self.pattern())
        return lambda s: found.sub(lambda m: m[0][0] + m[0][2:] if m[0][1:2] == "\\" else m[0], s)

    def frame(self) -> Callable[[str], tuple[str, str]]:
        """A function from a role to the strings around its text."""
        escape = self.escape()
        return lambda role: self.roles.get(role) or (f"{self.named[0]}{escape(role)}{self.named[1]}", self.named[2])

    def reader(self) -> Callable[[str], tuple[str, str]]:
        """A function from a piece to its role and its text, both unescaped."""
        unescape = self.unescape()
        # the target's first string may be short, so roles with longer ones are tried first
        order = sorted(self.roles.items(), key=lambda x: -len(x[1][0]))

        def read(piece: str) -> tuple[str, str]:
            if piece.startswith(self.named[0]):
                head, _, rest = piece.partition(self.named[1])
                return unescape(head[len(self.named[0]) :]), unescape(rest[: -len(self.named[2])])
            for role, (before, after) in order:
                if piece.startswith(before):
                    return role, unescape(piece[len(before) : -len(after)])
            raise ValueError(f"no turn of this template: {piece[:40]!r}")

        return read


TEMPLATE = Template()


def _batches(rows: Iterator[tuple], fields: str, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    names = [x.strip().split(" ")[0] for x in fields.split(",")]
    kinds = [kind, *(pa.string() if x.endswith("string") else pa.int64() for x in fields.split(",")[1:])]
    some, chars = [], 0
    for row in rows:
        some.append(row)
        chars += sum(len(x) for x in row if isinstance(x, str))
        if len(some) >= OUT_ROWS or chars >= OUT_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), kinds, strict=True)], names)
            some, chars = [], 0
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), kinds, strict=True)], names)


def _each(batches: Iterator[pa.RecordBatch], kind: list) -> Iterator[tuple]:
    for batch in batches:
        kind[:] = [batch.schema.field(0).type]
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _mapped(df: DataFrame, make: Callable[[Iterator[tuple]], Iterator[tuple]], fields: str) -> DataFrame:
    """df's rows as tuples through make; the first column keeps its type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind: list = []
        rows = make(_each(batches, kind))
        first = next(rows, None)
        if first is not None:
            from itertools import chain

            yield from _batches(chain([first], rows), fields, kind[0])

    return df.mapInArrow(run, fields.format(df.schema[df.columns[0]].dataType.simpleString()))


def expanded(conversations: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """The turns of all conversations(conv_id, turn, role, text), assistant turns as examples with their contexts.

    conv_id, turn_no (from 0), piece (the formatted turn) and start (characters of the conversation
    before it); for an assistant turn also example (from 0), context (all pieces before it; the piece
    is its target) and loss_start and loss_end (the trainable characters, counted in context and
    piece).  Rows come out in order, conversation by conversation, within partitions.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def make(each: Iterator[tuple]) -> Iterator[tuple]:
        escape, frame = template.escape(), template.frame()
        at, n, start, examples, past = object(), 0, 0, 0, []
        for conv, _, role, text in each:
            if conv != at:
                at, n, start, examples, past = conv, 0, 0, 0, []
            before, after = frame(role)
            body = escape(text)
            piece, own = f"{before}{body}{after}", (None,) * 4
            if role == template.target:
                past = ["".join(past)]
                own = examples, past[0], start + len(before), start + len(before) + len(body)
            yield conv, n, piece, start, *own
            past.append(piece)
            n, start, examples = n + 1, start + len(piece), examples + (role == template.target)

    return _mapped(rows, make, PIECE)


def examples(pieces: DataFrame) -> DataFrame:
    """The examples among expanded turns: a row for each assistant turn."""
    return pieces.where("example is not null")


def texts(pieces: DataFrame) -> DataFrame:
    """conv_id, example, text, loss_start, loss_end: context and target of each example as one text."""
    return examples(pieces).select("conv_id", "example", F.concat("context", "piece").alias("text"), "loss_start", "loss_end")


def read_back(pieces: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Of each conversation what its turns and examples say when they are parsed; pieces as expanded leaves them, in order.

    n_turns and the digest of role, line feed, text, line feed of each turn; the number of characters
    and the digest of all text under the examples' loss masks; the characters of the formatted
    conversation, its examples, and the characters of these with their contexts.  What a mask covers
    is cut from the example's whole text before the conversation's rows meet.
    """
    text = F.concat("context", "piece")
    masked = text.substr(F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int"))
    seen = pieces.select("conv_id", "piece", masked.alias("masked"), F.length(text).cast("long").alias("example_chars"))

    def make(each: Iterator[tuple]) -> Iterator[tuple]:
        read, unescape = template.reader(), template.unescape()
        at, open_ = object(), None

        def closed() -> tuple:
            conv, n, turns, chars, loss, formatted, count, wide = open_
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, count, wide

        for conv, piece, masked, example_chars in each:
            if conv != at:
                if open_:
                    yield closed()
                at, open_ = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
            role, text = read(piece)
            open_[1] += 1
            open_[2].update(f"{role}\n{text}\n".encode())
            open_[5] += len(piece)
            if masked is not None:
                reply = unescape(masked)
                open_[3] += len(reply)
                open_[4].update(reply.encode())
                open_[6] += 1
                open_[7] += example_chars
        if open_:
            yield closed()

    return _mapped(seen, make, DIGEST)
