"""Chat formatting: a finite-state machine over roles and a declarative template.

The machine's states are roles. A turn moves it to the turn's role; the template
declares, for each state, which roles may follow and which segments entering it
emits, each with a loss flag. Control strings inside texts are escaped reversibly,
so that the formatted text can be read back; reading back runs the machine again
over the roles found there.

Defined results: a null text is empty; a null role is the empty role; turns
that tie on ``turn`` follow by role, then text; repeated rows are turns of their
own; a null ``turn`` comes first; null ``conv_id`` is one conversation; an empty
table gives no rows. A turn that the machine doesn't allow is formatted all the
same and marked in ``valid``; with ``unexpected="mask"`` it also bears no loss.
Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bound_arrow

Piece = tuple[str, bool]


@dataclass(frozen=True)
class ChatTemplate:
    """Marks of a turn; ``emits``: state to the pieces that entering it emits, with
    {role} and {text} for the turn's own, and whether they bear loss (``other`` for
    states not listed); ``follows``: state ('' at the start) to the roles that may
    follow; in a state of ``final`` a conversation may end."""

    opening: str = "<|im_start|>"
    closing: str = "<|im_end|>"
    after_role: str = "\n"
    after_turn: str = "\n"
    emits: dict[str, tuple[Piece, ...]] = field(default_factory=lambda: {"assistant": (("{open}", False), ("{text}", True), ("{close}", False))})
    other: tuple[Piece, ...] = (("{open}", False), ("{text}", False), ("{close}", False))
    follows: dict[str, frozenset[str]] = field(
        default_factory=lambda: {
            "": frozenset({"system", "user"}),
            "system": frozenset({"user"}),
            "user": frozenset({"assistant"}),
            "assistant": frozenset({"user"}),
        }
    )
    final: frozenset[str] = frozenset({"assistant"})
    unexpected: str = "mark"


class Machine:
    """Where a conversation stands. ``step`` enters the state of a role."""

    def __init__(self, template: ChatTemplate):
        self.template, self.state, self.valid = template, "", True

    def enter(self, role: str) -> bool:
        ok = role in self.template.follows.get(self.state, ())
        self.state, self.valid = role, self.valid and ok
        return ok

    def step(self, role: str, text: str) -> tuple[list[dict], bool]:
        """The segments that the new state emits, and whether the turn was allowed."""
        t, ok = self.template, self.enter(role)
        said = {"{open}": t.opening + escape_role(role) + t.after_role, "{text}": escape(text), "{close}": t.closing + t.after_turn}
        masked = not ok and t.unexpected == "mask"
        return [{"text": said.get(piece, piece), "loss": loss and not masked} for piece, loss in t.emits.get(self.state, t.other)], ok

    def complete(self) -> bool:
        return self.valid and self.state in self.template.final


#: Both marks start with "<|"; a text's own "<|" gets one backslash between, and
#: one that had n backslashes there already gets n + 1, so nothing is lost.
_ESCAPE = re.compile(r"<(\\*)\|")
_UNESCAPE = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _same(a, b) -> bool:
    return a == b or (a != a and b != b)


def format_turns(conversations: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """One row per turn, conversation by conversation in order within its
    partition: conv_id, turn, turn_no, segments, valid_turn (the machine allows
    this role here), may_end (the machine may stop after it).

    A conversation is streamed through one task, sorted with spilling; its turns
    are never gathered in memory, however many they are. Ids stay Arrow values, so
    that none of them passes through a floating-point number.
    """
    bound_arrow(conversations.sparkSession)
    ordered = (
        conversations.select(
            "conv_id",
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        )
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )
    parts = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, machine, number = object(), Machine(template), 0
        for batch in batches:
            out = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if not _same(conv, current):
                    current, machine, number = conv, Machine(template), 0
                segments, ok = machine.step(role, text)
                out.append((number, segments, ok, role in template.final))
                number += 1
            made = list(zip(*out)) or [()] * 4
            kinds = (pa.int64(), parts, pa.bool_(), pa.bool_())
            columns = [pa.array(c, k) for c, k in zip(made, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), *columns], names=["conv_id", "turn", "turn_no", "segments", "valid_turn", "may_end"])

    kind = ordered.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(
        run,
        f"conv_id {kind}, turn long, turn_no long, segments array<struct<text:string,loss:boolean>>, valid_turn boolean, may_end boolean",
    )


def read_back(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Parse formatted turns (as ``format_turns`` orders them) and digest each
    conversation: role and text of every turn, and all text under the loss mask.
    ``valid`` is the verdict of the machine on the roles that were read."""
    head = re.compile(re.escape(template.opening) + "(.*?)" + re.escape(template.after_role), re.S)
    tail = template.closing + template.after_turn
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sums, machine, id_kind = object(), None, Machine(template), None

        def close(done: list) -> None:
            done.append((current, sums[0], sums[1].hexdigest(), sums[2], sums[3].hexdigest(), sums[4], machine.complete()))

        def rows(done: list) -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [id_kind, *kinds])], names=["conv_id", *names])

        for batch in batches:
            id_kind = batch.schema.field("conv_id").type
            done = []
            for conv, parts in zip(batch.column("conv_id").to_pylist(), batch.column("segments").to_pylist()):
                if not _same(conv, current):
                    if sums:
                        close(done)
                    current, sums, machine = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0], Machine(template)
                whole = "".join(p["text"] for p in parts)
                m = head.match(whole)
                if not m or not whole.endswith(tail):
                    raise ValueError("not a formatted turn")
                role = unescape_role(m[1])
                text = unescape(whole[m.end() : -len(tail)])
                loss = "".join(unescape(p["text"]) for p in parts if p["loss"])
                machine.enter(role)
                sums[0] += 1
                sums[1].update(f"{role}\n{text}\n".encode())
                sums[2] += len(loss)
                sums[3].update(loss.encode())
                sums[4] += len(whole)
            yield rows(done)
        if sums:
            done = []
            close(done)
            yield rows(done)

    kind = turns.schema["conv_id"].dataType.simpleString()
    return turns.select("conv_id", "segments").mapInArrow(
        run,
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean",
    )
