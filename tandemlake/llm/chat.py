"""Chat formatting: typed content parts flattened into marked turns, reversibly.

A turn is written as <|im_start|>role, newline, body, <|im_end|>, newline. In
bodies and roles `<`, any backslashes, `|` get one backslash more before the bar,
so no control string can come from a text, and taking one away gives it back.
Attachments become <|kind:n|> placeholders, numbered within their conversation.
Text parts that follow each other are joined before they are escaped, so none can
begin a control string that the next one ends; a placeholder ends in `>`, which
begins none. Reading back cuts at the placeholders before anything is unescaped.

Rows go to their conversation's partition and are sorted there; turns are then
formatted, and read back, as a stream. A conversation never has to be in memory
as a whole, however long it is.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>"
KINDS = ("image", "audio", "document")
_OPEN, _SHUT = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
_MARK = re.compile(r"<\|(image|audio|document):(\d+)\|>")
#: Tokens that an attachment without a stated count stands for.
EXPANDED = {"image": 256, "audio": 128, "document": 512}


def escape(text: str) -> str:
    return _OPEN.sub(lambda m: f"<{m[1]}\\|", text)


def unescape(text: str) -> str:
    return _SHUT.sub(lambda m: f"<{m[1]}|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def text_of(body: str) -> str:
    """The text of a formatted body, without its placeholders."""
    return "".join(unescape(x) for x in _MARK.split(body)[::3])


def parts_of(body: str, attached: list) -> list[tuple]:
    """(type, text, ref, tokens) of a formatted body: texts, and attachments by their number."""
    at = {n: (ref, tokens) for _, n, ref, tokens in attached}
    cut = _MARK.split(body)
    out = []
    for k in range(0, len(cut), 3):
        if cut[k]:
            out.append(("text", unescape(cut[k]), None, None))
        if k + 2 < len(cut):
            out.append((cut[k + 1], None, *at[int(cut[k + 2])]))
    return out


@dataclass
class Visitor:
    """Flattens parts in order; keeps what they refer to."""

    seen: int = 0
    attached: list[tuple] = field(default_factory=list)
    tokens: int = 0
    body: list[str] = field(default_factory=list)
    pending: list[str] = field(default_factory=list)

    def text(self, part: dict) -> None:
        self.pending.append(part.get("text") or "")

    def attachment(self, part: dict) -> None:
        kind, tokens = part["type"], part.get("tokens")
        self.close()
        n, self.seen = self.seen, self.seen + 1
        tokens = EXPANDED[kind] if tokens is None else int(tokens)
        self.attached.append((kind, n, part.get("ref"), tokens))
        self.tokens += tokens
        self.body.append(f"<|{kind}:{n}|>")

    def close(self) -> None:
        """The texts since the last placeholder, joined, then escaped."""
        self.body.append(escape("".join(self.pending)))
        self.pending = []

    def turn(self, parts: list) -> str:
        """The body of one turn; null parts are left out."""
        self.attached, self.tokens, self.body = [], 0, []
        for part in parts:
            if part is None:
                continue
            kind = part.get("type") or "text"
            if kind != "text" and kind not in KINDS:
                raise ValueError(f"unknown content part: {kind}")
            (self.text if kind == "text" else self.attachment)(part)
        self.close()
        return "".join(self.body)


SHAPE = "conv_id long, turn_no long, chunk string, loss_start long, loss_end long, attachments string, attachment_tokens long"


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, visitor, turn, at, fresh = None, Visitor(), 0, 0, True
    for batch in batches:
        out = []
        for c, role, content in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "content"))):
            if fresh or c != conv:
                conv, visitor, turn, at, fresh = c, Visitor(), 0, 0, False
            parts = [{"text": content}] if not isinstance(content, list) else content
            head = f"{START}{escape_role(role or '')}\n"
            body = visitor.turn(parts)
            loss = (at + len(head), at + len(head) + len(body)) if role == "assistant" else (None, None)
            chunk = f"{head}{body}{END}\n"
            out.append((c, turn, chunk, *loss, json.dumps(visitor.attached) if visitor.attached else None, visitor.tokens))
            turn, at = turn + 1, at + len(chunk)
        cols = list(zip(*out)) if out else [[]] * 7
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(cols, kinds)], [x.split()[0] for x in SHAPE.split(", ")])


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content_col: str = "text") -> DataFrame:
    """A row a turn, in order within its conversation: (conv_id, turn_no, chunk, loss_start, loss_end, attachments, attachment_tokens).

    content: a string, or array<struct<type, text, ref, tokens>> of parts. The
    chunks of a conversation, one after the other, are its formatted text;
    loss_start and loss_end (null but for role assistant) are code points in it.
    attachments: JSON list of [kind, number, ref, tokens], or null.
    Null texts, roles and parts' texts are empty, null parts are left out, a part
    without a type is text, one of an unknown type is an error; null turns come
    first; equal turns go by role, then text; a null conversation is one of its own. Empty
    tables give empty ones; other columns aren't read.
    """
    own = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(content_col).alias("content"))
    key = F.to_json(F.struct("content"))
    own = own.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")), F.when(F.lit(dict(own.dtypes)["content"] == "string"), F.coalesce(F.col("content").cast("string"), F.lit(""))).otherwise(key))
    return own.mapInArrow(_format, SHAPE)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, attachment_tokens long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state: list | None = None

    def done():
        conv, n, turns, chars, loss, size, attached, tokens = state
        return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, attached, tokens

    for batch in batches:
        out = []
        cols = (batch.column(k).to_pylist() for k in ("conv_id", "turn_no", "chunk", "loss_start", "loss_end", "attachment_tokens"))
        for conv, turn, chunk, start, end, tokens in zip(*cols):
            if turn == 0:
                if state:
                    out.append(done())
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
            m = _TURN.fullmatch(chunk)
            text = text_of(m[2])
            state[1] += 1
            state[2].update(f"{unescape_role(m[1])}\n{text}\n".encode())
            if start is not None:
                masked = text_of(chunk[start - state[5] : end - state[5]])
                state[3] += len(masked)
                state[4].update(masked.encode())
            state[5] += len(chunk)
            state[6] += len(_MARK.findall(m[2]))
            state[7] += tokens
        yield _digests(out)
    if state:
        yield _digests([done()])


def _digests(out: list) -> pa.RecordBatch:
    cols = list(zip(*out)) if out else [[]] * 8
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in DIGEST.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(cols, kinds)], [x.split()[0] for x in DIGEST.split(", ")])


def read_chats(formatted: DataFrame) -> DataFrame:
    """What the formatted turns of format_chats() hold, a row a conversation: see DIGEST."""
    return formatted.mapInArrow(_read, DIGEST)


TURNS = "conv_id long, turn_no long, role string, content array<struct<type:string,text:string,ref:string,tokens:int>>"


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = pa.struct([("type", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("tokens", pa.int32())])
    for batch in batches:
        roles, contents = [], []
        for chunk, attached in zip(batch.column("chunk").to_pylist(), batch.column("attachments").to_pylist()):
            m = _TURN.fullmatch(chunk)
            roles.append(unescape_role(m[1]))
            contents.append([dict(zip(("type", "text", "ref", "tokens"), p)) for p in parts_of(m[2], json.loads(attached or "[]"))])
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn_no"), pa.array(roles, pa.string()), pa.array(contents, pa.list_(part))], ["conv_id", "turn_no", "role", "content"])


def read_turns(formatted: DataFrame) -> DataFrame:
    """The turns that format_chats() wrote, with their parts: see TURNS.

    Texts that followed each other come back as one part, empty ones as none;
    null roles as empty ones. An empty table gives an empty one.
    """
    return formatted.select("conv_id", "turn_no", "chunk", "attachments").mapInArrow(_turns, TURNS)
