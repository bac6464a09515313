"""Chat formatting with typed content parts.

A message is a list of parts. A visitor flattens them in order: text is escaped, neighbouring text parts as one, and an image, audio or document part
becomes a placeholder with its number in the message; the attachment's reference and the tokens it will expand to are
recorded beside the text. A turn is written as

    <|turn|>role<|text|>content<|end|>

and a conversation is its turns, one behind the other. Inside roles and texts a control string gets a backslash behind its
first character, and one more if backslashes stand there already; so every text can be read back exactly.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table, written

# What follows the first character of the control strings that texts may not hold raw; "<|" begins all markers
# of this template, the others are those of widespread chat templates.
CONTROL = {"<": ("|", "s>", "/s>", "<SYS>>", "</SYS>>"), "[": ("INST]", "/INST]")}

_control = "|".join(f"{re.escape(a)}\\\\*(?:{'|'.join(map(re.escape, b))})" for a, b in CONTROL.items())
_raw = re.compile(f"(?=({_control}))(.)", re.S)
_escaped = re.compile(f"(?=({_control.replace(chr(92) * 2 + '*', chr(92) * 2 + '+')}))(.){re.escape(chr(92))}", re.S)
_turn = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)
_place = re.compile(r"<\|(?:image|audio|document):\d+\|>")

#: Pixels of an image patch, audio tokens a second, tokens a document page.
PATCH, AUDIO, PAGE = 28, 25, 512

PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
ATTACHMENTS = "array<struct<kind:string,ref:string,place:int,tokens:long>>"


def escape(text: str) -> str:
    return _raw.sub(lambda m: m[2] + "\\", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _escaped.sub(lambda m: m[2], text) if "\\" in text else text


class Flatten:
    """Visits the parts of one message."""

    def __init__(self):
        self.out: list[str] = []
        self.text: list[str] = []  # of neighbouring text parts, which are escaped as one
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> None:
        self.text.append(part.get("text") or "")

    def close(self) -> str:
        """The content up to here."""
        self.out.append(escape("".join(self.text)))
        self.text.clear()
        return "".join(self.out)

    def visit_unknown(self, part: dict) -> None:
        """A placeholder that stands for no tokens; the attachment keeps the type's name."""
        self.attach(part, 0, "document")

    def attach(self, part: dict, tokens: int, name: str | None = None) -> None:
        self.close()
        self.attachments.append({"kind": part["type"], "ref": part.get("ref"), "place": len(self.attachments), "tokens": tokens})
        self.out.append(f"<|{name or part['type']}:{len(self.attachments) - 1}|>")

    def visit_image(self, part: dict) -> None:
        self.attach(part, math.ceil((part.get("width") or 0) / PATCH) * math.ceil((part.get("height") or 0) / PATCH))

    def visit_audio(self, part: dict) -> None:
        self.attach(part, math.ceil((part.get("seconds") or 0) * AUDIO))

    def visit_document(self, part: dict) -> None:
        self.attach(part, (part.get("pages") or 0) * PAGE)


def format_turns(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text and, optionally, parts) as conv_id, turn, formatted, attachments, extra_tokens.

    One row per row, also of repeated ones. Null text is empty, null role is empty; texts of any length are kept whole. Where
    parts is not null, it replaces text; a part of an unknown type becomes an attachment of that type, of 0 tokens, with the placeholder of a
    document. Further columns are ignored, of whatever name; an empty table gives an empty result.
    """
    parts = F.col("parts").cast(PARTS) if "parts" in turns.columns else F.lit(None).cast(PARTS)

    def run(batches):
        for b in batches:
            out = []
            for role, text, parts in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                v = Flatten()
                for p in parts if parts is not None else [{"type": "text", "text": text}]:
                    v.visit(p)
                out.append((f"<|turn|>{escape(role or '')}<|text|>{v.close()}<|end|>", v.attachments, sum(a["tokens"] for a in v.attachments)))
            kind = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("place", pa.int32()), ("tokens", pa.int64())]))
            yield pa.RecordBatch.from_pydict(
                {"conv_id": b.column(0), "turn": b.column(1), "formatted": pa.array([x[0] for x in out], pa.string()), "attachments": pa.array([x[1] for x in out], kind), "extra_tokens": pa.array([x[2] for x in out], pa.int64())}
            )

    columns = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"), parts.alias("parts"))
    return columns.mapInArrow(run, f"conv_id long, turn long, formatted string, attachments {ATTACHMENTS}, extra_tokens long")


def parse(formatted: str) -> tuple[str, list[tuple[str, bool]]]:
    """Role and content of one formatted turn; content as (string, is it text) with placeholders between the texts."""
    m = _turn.fullmatch(formatted)
    if not m:
        raise ValueError("not a formatted turn")
    out, at = [], 0
    for p in _place.finditer(m[2]):
        out += [(unescape(m[2][at : p.start()]), True), (p[0], False)]
        at = p.end()
    return unescape(m[1]), [*out, (unescape(m[2][at:]), True)]


def read_back(formatted: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row per conversation of format_turns, read from the formatted text alone.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline of each turn), loss_chars and loss_sha256 (texts under the
    loss mask, which are those of the role `trained`), formatted_chars. Turns are taken by turn, then by their formatted
    text, so ties have an order; rows with a null turn come first, those with a null conv_id are one conversation. A conversation streams through one task in that order with constant memory, however long it is.
    """
    parts = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        key, state = None, None

        def row():
            return pa.RecordBatch.from_pydict(
                {"conv_id": pa.array([key[0]], pa.int64()), "n_turns": pa.array([state[0]], pa.int64()), "turns_sha256": pa.array([state[1].hexdigest()]), "loss_chars": pa.array([state[2]], pa.int64()), "loss_sha256": pa.array([state[3].hexdigest()]), "formatted_chars": pa.array([state[4]], pa.int64())}
            )

        for b in batches:
            done = []
            for conv, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if key != (conv,):
                    if key:
                        done.append(row())
                    key, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, content = parse(text)
                plain = "".join(x for x, is_text in content if is_text)
                state[0] += 1
                state[1].update(f"{role}\n{plain}\n".encode())
                if role == trained:
                    state[2] += len(plain)
                    state[3].update(plain.encode())
                state[4] += len(text)
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if key:
            yield row()

    rows = formatted.select("conv_id", "formatted", "turn").repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "formatted").select("conv_id", "formatted")
    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op7_chat_format(spark, sf_dir):
    probe = "</s>[INST] ok [/INST]"
    turns = table(spark, "conversations", sf_dir).select("conv_id", "turn", "role", "text")
    two = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    return read_back(written(format_turns(turns.unionByName(two)), "chat"))
