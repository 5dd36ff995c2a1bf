"""Chat formatting: a state machine over roles and a template that gives text segments with loss flags."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.words import column


@dataclass(frozen=True)
class Template:
    """How a turn is written, which roles are learnt, and which role may follow which.

    ``follows`` maps a role (empty: the beginning) to the roles that may come
    next; ``ends`` are the roles a conversation may end with.
    """

    begin: str = "### "
    after_role: str = ": "
    end: str = "</turn>\n"
    learnt: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant",)


DEFAULT = Template()
_CONTROL = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """A backslash is doubled; after the first character of a control string comes one."""
    return _CONTROL.sub(lambda m: m[0] + "\\" if m[0] != "\\" else "\\\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _role(text: str) -> str:
    return escape(text).replace(":", "\\:")


def segments(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Text segments of every conversation, in order, with loss flags.

    Reads conv_id, turn, role, text. Returns conv_id, segment (from 0), text,
    loss and valid (false from the first turn that the state machine does not
    allow). Turns go by turn, then role, then text; repeated rows are turns of
    their own. Null texts and roles are empty; null conversation ids are one
    conversation. Rows stream through sorted, so that a conversation may be of
    any length. An empty table gives no segments.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, valid, n = object(), "", True, 0
        for batch in batches:
            out: list[tuple] = []
            for conv, role, text in zip(*(column(batch, c).to_pylist() for c in ("conv_id", "role", "text"))):
                if conv != last:
                    last, state, valid, n = conv, "", True, 0
                valid = valid and role in template.follows.get(state, ())
                state = role
                parts = ((template.begin + _role(role) + template.after_role, False), (escape(text), role in template.learnt), (template.end, False))
                out += [(conv, n + k, part, loss, valid) for k, (part, loss) in enumerate(parts)]
                n += len(parts)
            cols = list(zip(*out)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["conv_id", "segment", "text", "loss", "valid"])

    rows = conversations.select(
        F.col("conv_id").cast("long"), "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(run, "conv_id long, segment long, text string, loss boolean, valid boolean")


class _Reader:
    """Reads the turns of one conversation back from its formatted text, piece by piece."""

    def __init__(self, template: Template):
        self.t, self.rest = template, ""
        self.turns, self.learnt = hashlib.sha256(), hashlib.sha256()
        self.n = self.learnt_chars = self.chars = 0
        self.valid, self.role = True, ""
        self.head = re.compile(re.escape(template.begin) + r"((?:[^\\:]|\\.)*)" + re.escape(template.after_role), re.DOTALL)

    def add(self, text: str, loss: bool, valid: bool) -> None:
        self.chars += len(text)
        self.valid = self.valid and valid
        if loss:
            plain = unescape(text)
            self.learnt_chars += len(plain)
            self.learnt.update(plain.encode("utf-8", "surrogatepass"))
        self.rest += text
        while self.rest.endswith(self.t.end):
            turn, _, self.rest = self.rest.partition(self.t.end)
            head = self.head.match(turn)
            self.role = unescape(head[1])
            self.n += 1
            self.turns.update(f"{self.role}\n{unescape(turn[head.end():])}\n".encode("utf-8", "surrogatepass"))

    def row(self, conv: int | None) -> tuple:
        return (conv, self.n, self.turns.hexdigest(), self.learnt_chars, self.learnt.hexdigest(), self.chars, self.valid and self.role in self.t.ends)


def read_back(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """One row for each conversation of ``segments``, read from the formatted text alone.

    Returns conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars and valid (the state machine allows all turns and the end).
    The segments of a conversation must follow one another in their order.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        last, reader = None, None
        for batch in batches:
            out = []
            for conv, text, loss, valid in zip(*(column(batch, c).to_pylist() for c in ("conv_id", "text", "loss", "valid"))):
                if reader is None or conv != last:
                    out += [reader.row(last)] if reader else []
                    last, reader = conv, _Reader(template)
                reader.add(text, loss, valid)
            yield table(out)
        if reader:
            yield table([reader.row(last)])

    return formatted.mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
