"""Chat formatting by event-sourced reconstruction.

The log is a table of events (conv_id, msg, seq, kind, role, text) dealt by
conversation and sorted by message and sequence. Each message is folded while its
events stream by: ``message`` begins one with its role and text, ``delta`` appends, ``edit`` replaces
the text, ``regenerate`` clears it for the deltas that follow, ``delete`` removes the
message. Finished messages are rendered at once, so a task holds one message and running
digests whatever the length of a conversation.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts every ``<``
followed by backslashes and ``|`` gets one more backslash, so no control string can
appear in them and unescaping gives the text back; roles also have backslashes and line
breaks escaped. The loss mask covers the text of assistant messages.

Defined cases: null role and text are empty; a null conv_id is one conversation of its
own; events with equal (conv_id, msg, seq) are ordered by kind, role and text; a second
``message`` under one number begins another message; an unknown kind is an error; conversations whose messages are all deleted give no row; further
columns are ignored; an empty log gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import bounded_batches

START, END = "<|im_start|>", "<|im_end|>\n"
TURN_SCHEMA = "conv_id long, msg long, formatted string, loss_start long, loss_end long"
DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and the span of the loss mask in it (empty but for assistants)."""
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    start = len(head)
    return f"{head}{body}{END}", start, start + (len(body) if role == "assistant" else 0)


def parse(formatted: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    if not (formatted.startswith(START) and formatted.endswith(END)):
        raise ValueError("not a formatted turn")
    role, _, body = formatted[len(START) : -len(END)].partition("\n")
    return unescape_role(role), unescape(body)


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, msg, role, text) of each surviving message; events come sorted by conversation, message, sequence."""
    at, live, role, parts = None, False, "", []
    for batch in batches:
        for conv, msg, kind, r, t in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5)), strict=True):
            if at is not None and at != (conv, msg):
                if live:
                    yield *at, role, "".join(parts)
                live, role, parts = False, "", []
            at = (conv, msg)
            if kind == "message":
                if live:
                    yield *at, role, "".join(parts)
                live, role, parts = True, r or "", [t or ""]
            elif kind == "delta":
                live, role = True, role or r or ""
                parts.append(t or "")
            elif kind == "edit":
                live, role, parts = True, role or r or "", [t or ""]
            elif kind == "regenerate":
                live, role, parts = True, role or r or "", []
            elif kind == "delete":
                live, parts = False, []
            else:
                raise ValueError(f"unknown event kind {kind!r}")
    if live:
        yield *at, role, "".join(parts)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for row in rows:
        out.append(row)
        if len(out) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _render_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("msg", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
    yield from _batches(((conv, msg, *render(role, text)) for conv, msg, role, text in fold(batches)), schema)


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def rows():
        at, n = None, 0
        for conv, _, role, text in fold(batches):
            if n == 0 or conv != at:
                if n:
                    yield at, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars
                at, n, turns, loss, loss_chars, chars = conv, 0, hashlib.sha256(), hashlib.sha256(), 0, 0
            formatted, low, high = render(role, text)
            n, chars = n + 1, chars + len(formatted)
            role, text = parse(formatted)
            turns.update(f"{role}\n{text}\n".encode())
            masked = unescape(formatted[low:high])
            loss_chars += len(masked)
            loss.update(masked.encode())
        if n:
            yield at, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

    yield from _batches(rows(), schema)


def _dealt(events: DataFrame) -> DataFrame:
    bounded_batches(events.sparkSession)
    slim = events.select(F.col("conv_id").cast("long"), F.col("msg").cast("long"), F.col("seq").cast("long"), "kind", "role", "text")
    return slim.repartition("conv_id").sortWithinPartitions("conv_id", "msg", "seq", "kind", "role", "text")


def format_turns(events: DataFrame) -> DataFrame:
    """Rendered turns with their loss spans (code points); a conversation is its turns' text in order of msg."""
    return _dealt(events).mapInArrow(_render_batches, TURN_SCHEMA)


def format_digests(events: DataFrame) -> DataFrame:
    """One row per conversation, read back from the rendered turns."""
    return _dealt(events).mapInArrow(_digest_batches, DIGEST_SCHEMA)


def turn_events(conversations: DataFrame) -> DataFrame:
    """Events of a finished conversation table (conv_id, turn, role, text).

    Each row is a message of its own; rows that repeat a turn follow one another by role and text.
    """
    return conversations.select("conv_id", F.col("turn").alias("msg"), F.lit(0).alias("seq"), F.lit("message").alias("kind"), "role", "text")
