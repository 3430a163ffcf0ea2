r"""Chat formatting: conversations of typed content parts as one marked text with a loss mask.

A turn is <turn ROLE>CONTENT</turn> and a newline. Inside, a visitor flattens the parts in order: a text is
escaped, an image, audio or document part becomes a placeholder <part N KIND TOKENS>, where N
numbers the conversation's attachments and TOKENS is what the part expands to. In texts (and
roles) a backslash goes before every backslash, < and >, so only the template's own < and > are bare and
everything can be read back.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm import common

ESCAPED = re.compile(r"[\\<>]")
TAG = re.compile(r"\\.|<[^<>\\]*(?:\\.[^<>\\]*)*>", re.S)

#: An attachment with an amount beyond this, or one that is not finite, expands to no token.
MOST_TOKENS = 1 << 40

PART_TYPE = "array<struct<kind:string,text:string,ref:string,amount:double>>"
OUT_SCHEMA = (
    "conv_id long, formatted string, n_turns long, n_tokens_expanded long, loss array<struct<start:long,end:long>>, "
    "attachments array<struct<number:int,kind:string,ref:string,tokens:long,start:long>>"
)


def escape(text: str) -> str:
    return ESCAPED.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


class Visitor:
    """Flattens parts to pieces of formatted text; remembers attachments and text spans."""

    def __init__(self, tokens_per_image: int, tokens_per_second: float, tokens_per_page: int) -> None:
        self.rates = {"image": tokens_per_image, "audio": tokens_per_second, "document": tokens_per_page}
        self.out: list[str] = []
        self.at = 0
        self.attachments: list[dict] = []
        self.spans: list[tuple[int, int]] = []

    def write(self, s: str) -> None:
        self.out.append(s)
        self.at += len(s)

    def visit(self, part: dict, masked: bool) -> None:
        kind = part["kind"] or "text"
        getattr(self, f"visit_{kind}", self.visit_other)(part, masked)

    def visit_text(self, part: dict, masked: bool) -> None:
        start = self.at
        self.write(escape(part["text"] or ""))
        if masked and self.at > start:
            self.spans.append((start, self.at))

    def attach(self, part: dict, amount: float) -> None:
        kind = part["kind"]
        count = max(0.0, amount) * self.rates.get(kind, 0)
        tokens = math.ceil(count) if count <= MOST_TOKENS else 0  # not for an amount that is no number or infinite
        self.attachments.append({"number": len(self.attachments), "kind": kind, "ref": part["ref"], "tokens": tokens, "start": self.at})
        self.write(f"<part {len(self.attachments) - 1} {escape(kind)} {tokens}>")

    def visit_image(self, part: dict, masked: bool) -> None:
        self.attach(part, 1.0 if part["amount"] is None else part["amount"])  # tiles

    def visit_audio(self, part: dict, masked: bool) -> None:
        self.attach(part, part["amount"] or 0.0)  # seconds

    def visit_document(self, part: dict, masked: bool) -> None:
        self.attach(part, 1.0 if part["amount"] is None else part["amount"])  # pages

    def visit_other(self, part: dict, masked: bool) -> None:
        self.attach(part, 0.0)


def _format(loss_role: str, rates: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for conv, turns in zip(batch["conv_id"].to_pylist(), batch["turns"].to_pylist(), strict=True):
                v = Visitor(*rates)
                for turn in turns:
                    v.write(f"<turn {escape(turn['role'] or '')}>")
                    for part in turn["parts"] or []:
                        v.visit(part, turn["role"] == loss_role)
                    v.write("</turn>\n")
                loss = [{"start": a, "end": b} for a, b in v.spans]
                for to, x in zip(out, (conv, "".join(v.out), len(turns), sum(a["tokens"] for a in v.attachments), loss, v.attachments), strict=True):
                    to.append(x)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            attachment = pa.list_(pa.struct([("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64()), ("start", pa.int64())]))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), span, attachment]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["conv_id", "formatted", "n_turns", "n_tokens_expanded", "loss", "attachments"])

    return run


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: str | None = None, loss_role: str = "assistant", tokens_per_image: int = 256, tokens_per_second: float = 25.0, tokens_per_page: int = 512) -> DataFrame:
    """One row a conversation: conv_id, formatted, n_turns, n_tokens_expanded, loss spans, attachments.

    A row's content is its `parts` column (PART_TYPE; amount: tiles, seconds or pages) if one is named and
    not null, else its text as one part. A null text is empty, a null role is empty and never under the loss, a null kind is text, an
    unknown kind is an attachment of no tokens, as is one whose amount is not finite or beyond MOST_TOKENS. Rows go by turn (null first), ties by role and
    content, and repeated rows are turns of their own. Rows without a conversation belong to none and
    are left out; other columns are ignored; an empty table gives an empty one. Spans count code points.
    """
    one = F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("amount"))).cast(PART_TYPE)
    content = one if parts is None else F.coalesce(F.col(parts).cast(PART_TYPE), one)
    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), content.alias("parts")).alias("t")).where("conv_id is not null")
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return grouped.mapInArrow(_format(loss_role, (tokens_per_image, tokens_per_second, tokens_per_page)), OUT_SCHEMA)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back from a formatted conversation; placeholders are left out of texts."""
    out: list[tuple[str, str]] = []
    role, text, at = "", [], 0
    for m in TAG.finditer(formatted):
        if m[0][0] == "\\":
            continue
        text.append(formatted[at : m.start()])
        at = m.end()
        if m[0].startswith("<turn "):
            role, text = unescape(m[0][6:-1]), []
        elif m[0] == "</turn>":
            out.append((role, unescape("".join(text))))
    return out


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for formatted, loss in zip(batch["formatted"].to_pylist(), batch["loss"].to_pylist(), strict=True):
            turns = read_turns(formatted)
            said = "".join(unescape(formatted[s["start"] : s["end"]]) for s in loss)
            digests = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(formatted))
            for to, x in zip(out, digests, strict=True):
                to.append(x)
        yield pa.RecordBatch.from_arrays(
            [batch["conv_id"], *(pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True))],
            ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )


def op4_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations and the added one, -7; rows that the table has under -7 are turns of the same conversation."""
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return format_conversations(turns).select("conv_id", "formatted", "loss").mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
