"""Chat formatting: event logs folded into conversations, rendered with a template, and parsed back.

The log has one row per event: conv_id, seq, kind, msg, role, text. Kinds:

* ``message``: opens message ``msg`` with its role and a first text;
* ``delta``: appends text to message ``msg``;
* ``edit``: replaces the text of message ``msg``;
* ``regenerate``: empties message ``msg`` and drops all messages opened after it; deltas then fill it again.

Events that name a message that is not open, and unknown kinds, change nothing. Nulls: a null text or role is empty, a
null conv_id is a conversation of its own, a null seq comes first. Ties of seq are folded in the order of (role, text,
kind); repeated ``message`` rows stay separate messages. An empty log gives an empty result; other columns are ignored.

Events are hash-partitioned by conversation and sorted, so that a task folds one conversation after another from a
sorted stream; it holds one conversation at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import shared

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
RENDERED = "conv_id long, formatted string, loss_spans array<struct<start:int,end:int>>"
_CONTROL = re.compile(r"<\|(\\*)(im_start|im_end)\|>")
_ESCAPED = re.compile(r"<\|\\(\\*)(im_start|im_end)\|>")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    """The text with one backslash more inside each control string, so that none is left."""
    return _CONTROL.sub(r"<|\\\1\2|>", text) if "<|" in text else text


def unescape(text: str) -> str:
    """The inverse of escape()."""
    return _ESCAPED.sub(r"<|\1\2|>", text) if "<|\\" in text else text


def _header(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role(header: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(header))


@dataclass
class Message:
    role: str
    text: list[str]


def fold(events: Iterator[tuple]) -> list[Message]:
    """The final messages after (kind, msg, role, text) events in sequence."""
    messages: list[Message] = []
    at: dict = {}
    for kind, msg, role, text in events:
        if kind == "message":
            at[msg] = len(messages)
            messages.append(Message(role or "", [text or ""]))
        elif msg in at:
            k = at[msg]
            if kind == "delta":
                messages[k].text.append(text or "")
            elif kind == "edit":
                messages[k].text = [text or ""]
            elif kind == "regenerate":
                messages[k].text = []
                del messages[k + 1 :]
                at = {m: i for m, i in at.items() if i <= k}
    return messages


def render(messages: list[Message]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans (code points) under the loss mask: each assistant text as it stands there."""
    parts: list[str] = []
    spans: list[tuple[int, int]] = []
    n = 0
    for m in messages:
        head, body = f"{OPEN}{_header(m.role)}\n", escape("".join(m.text))
        if m.role == "assistant":
            spans.append((n + len(head), n + len(head) + len(body)))
        parts += [head, body, CLOSE, "\n"]
        n += len(head) + len(body) + len(CLOSE) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    return [(_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def _fold_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
    out: list[dict] = []
    held: list[tuple] = []
    current: object = held  # no conv_id is this

    def done() -> None:
        if held:
            formatted, spans = render(fold(iter(held)))
            out.append({"conv_id": current, "formatted": formatted, "loss_spans": [{"start": a, "end": b} for a, b in spans]})
            held.clear()

    size = 0
    for batch in batches:
        for conv, *event in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "msg", "role", "text")), strict=True):
            if conv != current:
                done()
                current = conv
                size += len(out[-1]["formatted"]) if out else 0
                if len(out) >= 512 or size > 1 << 23:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
            held.append(tuple(event))
    done()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def format_chats(log: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans."""
    log = log.select(*(F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("seq", "long"), ("kind", "string"), ("msg", "long"), ("role", "string"), ("text", "string"))))
    return (
        log.repartition(shared.partitions(log.sparkSession), "conv_id")
        .sortWithinPartitions("conv_id", "seq", "role", "text", "kind")
        .select("conv_id", "kind", "msg", "role", "text")
        .mapInArrow(_fold_batches, RENDERED)
    )
