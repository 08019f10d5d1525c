"""Chat text from event logs.

A conversation is a log of events. The log is dealt out by conversation, sorted by sequence
and folded as it streams by: deltas add to a message, an edit puts a text in its place, a
regeneration drops what the message had so far. The final messages are rendered into one
text per conversation, with the spans that a model is trained on.

Template: ``<|im_start|>role``, a line break, the text, ``<|im_end|>``, a line break. A ``<``
and ``|`` in a text or role would look like one of its signs; between them, after any
backslashes there already, one backslash is put, and taken away when read back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from planes.llm.common import slices

START, END = "<|im_start|>", "<|im_end|>"
DELTA, EDIT, REGENERATE = "delta", "edit", "regenerate"

_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role ends with its line: line breaks in it, and backslashes, are written as two characters."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(messages: list[tuple[str, str]], trained: frozenset[str]) -> tuple[str, list[dict]]:
    """The formatted text, and the spans (code points) of the texts of the roles ``trained``."""
    parts, spans, at = [], [], 0
    for role, text in messages:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role in trained:
            spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
        parts += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The messages of a formatted text."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def fold(events: Iterator[tuple]) -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
    """Conversations and their final messages, from (conv_id, message, op, role, text) in
    order. Messages come in the order of their first event; a later role replaces an earlier."""
    conversation, messages, begun = None, {}, False
    for conv, message, op, role, text in events:
        if begun and conv != conversation:
            yield conversation, [(r, "".join(t)) for r, t in messages.values()]
            messages = {}
        conversation, begun = conv, True
        entry = messages.setdefault(message, [role, []])
        entry[0] = role or entry[0]
        if op != DELTA:
            entry[1].clear()
        entry[1].append(text)
    if begun:
        yield conversation, [(r, "".join(t)) for r, t in messages.values()]


def format_log(events: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, loss_spans (start, end) of each conversation in a log of conv_id,
    seq, message, op, role, text.

    A null conversation is one like others, null roles, texts and ops are empty and a delta,
    events with equal seq go by message, op and text, and repeated events each take effect.
    An empty log gives no rows. Other columns are not read. The row of a conversation is
    made in one task, which holds that conversation and no other.
    """
    log = events.select(
        F.col("conv_id").cast("long").alias("conv_id"), "seq", F.col("message").cast("string").alias("message"),
        F.coalesce("op", F.lit(DELTA)).alias("op"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    ordered = log.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "message", "op", "text", "role")
    roles = frozenset(trained)

    def run(batches):
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "message", "op", "role", "text")))

        out, size = [], 0
        for conv, messages in fold(rows()):
            text, spans = render(messages, roles)
            out.append((conv, text, spans))
            size += len(text)
            if size > 4 << 20:
                yield _batch(out)
                out, size = [], 0
        yield _batch(out)

    return ordered.mapInArrow(run, "conv_id long, formatted string, loss_spans array<struct<start:long,end:long>>")


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _batch(out: list[tuple]) -> pa.RecordBatch:
    conv, text, spans = zip(*out) if out else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(text, pa.string()), pa.array(spans, _SPANS)], ["conv_id", "formatted", "loss_spans"])


def log_of_turns(conversations: DataFrame) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as a log: one delta per turn.
    Rows with the same turn are messages of their own, by role and text; a null turn is first."""
    return conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("seq"),
        F.concat_ws("\n", F.coalesce(F.col("turn").cast("string"), F.lit("-")), F.xxhash64("role", "text").cast("string"), F.monotonically_increasing_id().cast("string")).alias("message"),
        F.lit(DELTA).alias("op"),
        "role",
        "text",
    )


def digests(formatted: DataFrame) -> DataFrame:
    """What a formatted text says when it is read back: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars. The loss is read by the spans alone."""

    def run(batches):
        for batch in slices(batches, "formatted"):
            turns, told, chars, loss, total = [], [], [], [], []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist()):
                messages = read_back(text)
                learned = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                turns.append(len(messages))
                told.append(sha256("".join(f"{r}\n{t}\n" for r, t in messages).encode()).hexdigest())
                chars.append(len(learned))
                loss.append(sha256(learned.encode()).hexdigest())
                total.append(len(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(turns, pa.int64()), pa.array(told, pa.string()), pa.array(chars, pa.int64()), pa.array(loss, pa.string()), pa.array(total, pa.int64())],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
