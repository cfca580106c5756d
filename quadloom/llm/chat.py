"""Chat formatting from event logs.

A log is a table of events: ``delta`` adds text to a message, ``edit`` puts a text in its place,
``regenerate`` drops what was streamed so far, ``delete`` takes the message away until something is
streamed anew. Events are partitioned by conversation, sorted by message and sequence number, and folded
as they pass: a task holds one message at a time, however long its conversation is. Each final message is
rendered at once, so the output of a conversation is the run of its messages' texts.

Template: system ``<<SYS>>..<</SYS>>``, user ``[INST]..[/INST]``, assistant ``<s>..</s>``, any other role
``[ROLE]..[/ROLE][INST]..[/INST]``. A control string inside a text gets a backslash after its first
character, and a backslash is doubled; nothing that looks like a control string is left, and
``unescape`` gives the text back. The loss mask covers what assistants say, between their marks.

Defined cases: null text is empty; a null role is the empty role; events without text change nothing but
their message's existence; messages of equal number are ordered by role, text and place; a null
conversation id is a conversation; an empty table has no messages.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROLS = ["<<SYS>>", "<</SYS>>", "<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]"]
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[/ROLE]")

_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)

FORMATTED = "conv_id long, n long, formatted string, loss_start long, loss_end long"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A message's text, and where in it the loss applies."""
    body = escape(text)
    if role in MARKS:
        first, last = MARKS[role]
        loss = (len(first), len(first) + len(body)) if role == "assistant" else (0, 0)
        return first + body + last, *loss
    (a, b), (first, last) = OTHER, MARKS["user"]
    return a + escape(role) + b + first + body + last, 0, 0


def parse(formatted: str) -> tuple[str, str]:
    """Role and text of a rendered message."""
    role = None
    if formatted.startswith(OTHER[0]):
        at = formatted.index(OTHER[1])
        role, formatted = unescape(formatted[len(OTHER[0]) : at]), formatted[at + len(OTHER[1]) :]
    for name, (first, last) in MARKS.items():
        if formatted.startswith(first) and formatted.endswith(last):
            return name if role is None else role, unescape(formatted[len(first) : len(formatted) - len(last)])
    raise ValueError("no message of this template")


def as_events(conversations: DataFrame) -> DataFrame:
    """Rows ``conv_id, turn, role, text`` as a log: each turn is streamed in two deltas after a start."""
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.xxhash64(text).alias("tie"),
        F.monotonically_increasing_id().alias("place"),
        text.alias("whole"),
        half.alias("half"),
    )
    event = [
        F.struct(F.lit(0).alias("seq"), F.lit("regenerate").alias("kind"), F.lit("").alias("text")),
        F.struct(F.lit(1).alias("seq"), F.lit("delta").alias("kind"), F.expr("substring(whole, 1, half)").alias("text")),
        F.struct(F.lit(2).alias("seq"), F.lit("delta").alias("kind"), F.expr("substring(whole, half + 1)").alias("text")),
    ]
    return rows.select("conv_id", "turn", "role", "tie", "place", F.inline(F.array(*event)))


def format_conversations(events: DataFrame, message: tuple[str, ...] = ("turn", "role", "tie", "place")) -> DataFrame:
    """``conv_id, n, formatted, loss_start, loss_end`` for each final message, n counting from 0.

    ``events``: conv_id, the columns that order and tell messages, role, seq, kind, text. The rows of a
    conversation come out in one partition, in order."""
    keys = [c for c in message if c != "role"]
    named = events.select("conv_id", *keys, F.coalesce("role", F.lit("")).alias("role"), "seq", "kind", F.coalesce("text", F.lit("")).alias("text"))
    logs = named.repartition("conv_id").sortWithinPartitions("conv_id", *message, "seq")
    at = [logs.columns.index(c) for c in message]

    def fold(batches):
        open_, conv, n, role, parts, alive = None, None, 0, "", [], False
        done: list[tuple] = []

        def close():
            nonlocal n
            if open_ is not None and alive:
                done.append((conv, n, *render(role, "".join(parts))))
                n += 1

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                here = (row[0], *(row[i] for i in at))
                if here != open_:
                    close()
                    if open_ is None or row[0] != conv:
                        n = 0
                    open_, conv, role, parts, alive = here, row[0], row[-4], [], False
                kind, text = row[-2], row[-1]
                if kind != "delta":
                    parts = []
                parts.append(text)
                alive = kind != "delete"
            yield _batch(done, FORMATTED)
            done.clear()
        close()
        if done:
            yield _batch(done, FORMATTED)

    return logs.mapInArrow(fold, FORMATTED)


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in ddl.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    kinds = [pa.int64() if k == "long" else pa.string() for k in kinds]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], list(names))


def read_back(formatted: DataFrame, arranged: bool = False) -> DataFrame:
    """Digests of each conversation, from the rendered texts alone, as they pass in order.

    ``arranged``: the rows of a conversation already stand together in order."""
    if not arranged:
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "n")

    def read(batches):
        conv, state = None, None
        done: list[tuple] = []

        def close():
            if state is not None:
                n, turns, chars, loss, length = state
                done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), length))

        for batch in batches:
            for c, text, a, b in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if state is None or c != conv:
                    close()
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, said = parse(text)
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
                if b > a:
                    learnt = unescape(text[a:b])
                    state[2] += len(learnt)
                    state[3].update(learnt.encode())
                state[4] += len(text)
            yield _batch(done, DIGESTS)
            done.clear()
        close()
        if done:
            yield _batch(done, DIGESTS)

    return formatted.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(read, DIGESTS)
