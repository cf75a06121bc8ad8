"""Chat formatting with typed content parts.

A visitor walks the parts of every turn in order: texts are escaped, images,
audio and documents become numbered placeholders with an attachment record
(reference, place, expanded token count). A turn is
``<|turn|>role<|says|>body<|end|>`` and a conversation is its turns in order.

Escaping is reversible and makes every control string impossible inside texts: a
backslash doubles, and a control string gets a backslash after its first
character. The loss mask covers the text parts of assistant turns.

Output is one row per turn, so a conversation of any length stays a stream of
bounded rows. Formatting needs no shuffle. ``read_back`` parses the output:
conversations are dealt by key and sorted, and each task streams over its rows
with running digests, so even a conversation that holds a third of all turns is
never gathered; its digest over all turns in order is sequential by nature.

Defined cases: a null text, role or parts list counts as empty; an unknown part
kind becomes a document placeholder; turns with equal numbers are ordered by
role and text, nulls first; repeated rows are turns of their own; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

TURN, SAYS, DONE = "<|turn|>", "<|says|>", "<|end|>"
# Control strings of common templates; "<|" opens all of this template's.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LOSS_ROLE = "assistant"
PATCH = 28  # pixels of an image patch's side: one token each
AUDIO_RATE = 25  # tokens of a second
PAGE_TOKENS = 512
IMAGE_TOKENS = 256  # of an image of unknown size

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
SPANS = "array<struct<start:bigint,end:bigint>>"
ATTACHMENTS = "array<struct<ordinal:int,kind:string,ref:string,at:bigint,tokens:bigint>>"
_ESCAPE = re.compile("|".join(["\\\\", *map(re.escape, CONTROLS)]))
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_LONGEST = max(map(len, CONTROLS)) - 1
_UNESCAPE = re.compile(r"\\(\\?)")
_TURN = re.compile(r"<\|turn\|>(.*?)<\|says\|>(.*?)<\|end\|>", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


@dataclass
class TurnVisitor:
    """Flattens the parts of one turn; ``loss`` and ``attachments`` refer to code points of ``out``."""

    role: str
    out: str = ""
    loss: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[tuple[int, str, str | None, int, int]] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part['kind']}", self.visit_document)(part)

    def visit_text(self, part: dict) -> None:
        start, text = len(self.out), escape(part["text"] or "")
        tail = self.out[-_LONGEST:]
        if any(m.start() < len(tail) < m.end() for m in _CONTROL.finditer(tail + text[:_LONGEST])):
            text = "\\" + text  # two text parts would spell a control string between them
        self.out += text
        if self.role == LOSS_ROLE:
            self.loss.append((start, len(self.out)))

    def visit_image(self, part: dict) -> None:
        size = part["width"], part["height"]
        known = all(x is not None and x > 0 for x in size)
        self._attach("image", part, math.prod(-(-x // PATCH) for x in size) if known else IMAGE_TOKENS)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil(max(part["seconds"] or 0, 0) * AUDIO_RATE))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(part["pages"] or 1, 1) * PAGE_TOKENS)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        ordinal = len(self.attachments) + 1
        self.attachments.append((ordinal, kind, part["ref"], len(self.out), tokens))
        self.out += f"<|{kind}:{ordinal}|>"


def format_turn(role: str | None, parts: list[dict] | None) -> TurnVisitor:
    visitor = TurnVisitor(role or "", f"{TURN}{escape(role or '')}{SAYS}")
    for part in parts or ():
        if part is not None:
            visitor.visit(part)
    visitor.out += DONE
    return visitor


def _format(batches):
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    records = pa.list_(pa.struct([("ordinal", pa.int32()), ("kind", pa.string()), ("ref", pa.string()),
                                  ("at", pa.int64()), ("tokens", pa.int64())]))
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            done = [format_turn(r, p) for r, p in zip(batch.column("role").to_pylist(), batch.column("parts").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), batch.column("turn"), pc.fill_null(batch.column("role").cast(pa.string()), ""),
                 pa.array([unescape(v.out[len(TURN + escape(v.role) + SAYS) : -len(DONE)]) for v in done], type=pa.string()),
                 pa.array([v.out for v in done], type=pa.string()),
                 pa.array([[{"start": a, "end": b} for a, b in v.loss] for v in done], type=spans),
                 pa.array([[dict(zip(("ordinal", "kind", "ref", "at", "tokens"), x, strict=True)) for x in v.attachments]
                           for v in done], type=records)],
                names=["conv", "turn", "role", "said", "formatted", "loss", "attachments"])


def text_part(text: Column) -> Column:
    """A parts list of one text."""
    return F.array(F.struct(
        F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"),
        *(F.lit(None).cast(kind).alias(name) for name, kind in (("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")))))


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 parts_col: str = "parts") -> DataFrame:
    """(conv, turn, role, said, formatted, loss, attachments) for every row; a map without shuffle.

    ``said`` is the turn's text as it was, with placeholders; rows of one turn are ordered by role and ``said``.
    """
    kinds = {c: turns.schema[x].dataType.simpleString() for c, x in (("conv", conv_col), ("turn", turn_col))}
    return turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"),
        F.col(parts_col).cast(f"array<{PART}>").alias("parts"),
    ).mapInArrow(_format, f"conv {kinds['conv']}, turn {kinds['turn']}, role string, said string, formatted string, loss {SPANS}, attachments {ATTACHMENTS}")


def ordered(formatted: DataFrame) -> DataFrame:
    """The rows of each conversation together, in turn order."""
    return formatted.repartition("conv").sortWithinPartitions("conv", "turn", "role", "said", "formatted")


class _Reader:
    """Running digests of one conversation."""

    def __init__(self):
        self.turns = self.loss_chars = self.chars = self.attachments = self.tokens = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def read(self, formatted: str, loss: list[dict], attachments: list[dict]) -> None:
        for role, body in _TURN.findall(formatted):
            text = unescape(re.sub(r"<\|\w+:\d+\|>", "", body))
            self.all.update(f"{unescape(role)}\n{text}\n".encode("utf-8", "surrogatepass"))
            self.turns += 1
        for span in loss:
            text = unescape(formatted[span["start"] : span["end"]])
            self.loss_chars += len(text)
            self.loss.update(text.encode("utf-8", "surrogatepass"))
        self.chars += len(formatted)
        self.attachments += len(attachments)
        self.tokens += sum(x["tokens"] for x in attachments)

    def row(self) -> tuple:
        return (self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars,
                self.attachments, self.tokens)


def reader(conv_type: pa.DataType):
    schema = pa.schema([("conv", conv_type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
                        ("n_attachments", pa.int64()), ("attachment_tokens", pa.int64())])

    def read(batches):
        now, state, rows = None, None, []

        def flush():
            out = pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()
            return out

        for batch in batches:
            for conv, *turn in zip(*(batch.column(c).to_pylist() for c in ("conv", "formatted", "loss", "attachments")), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        rows.append((now, *state.row()))
                        if len(rows) == 1000:
                            yield flush()
                    now, state = conv, _Reader()
                state.read(*turn)
        if state is not None:
            rows.append((now, *state.row()))
            yield flush()

    return read


def read_back(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation what its formatted turns say: turn count, digests, masked text, sizes, attachments."""
    kind = formatted.schema["conv"].dataType
    return ordered(formatted).mapInArrow(
        reader(to_arrow_type(kind)),
        f"conv {kind.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint, n_attachments bigint, attachment_tokens bigint").withColumnRenamed("conv", conv_col)
