"""Chat formatting with a grammar round trip (operator 2).

A conversation is rendered as

    turn  := "### " Role ": " text "\\n</turn>\\n"

and parsed back by a deterministic parser.  Inside texts, whatever reads as a
control string (a role header or the turn's end, after any number of
backslashes) gets one backslash more until the parser returns the source
turns; the parser takes one backslash away.  Most texts hold none and stay as
they are.  Roles other than the three known ones are written with ``~`` and
percent escapes.

Rows are dealt by conversation and streamed in turn order, so memory is
bounded by one part of a conversation (``PART`` characters), not by the
conversation: a long one becomes several parts of whole turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: The names of the known roles in the template.
ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
NAMES = {v: k for k, v in ROLES.items()}
HEAD = r"### (?:System|User|Assistant|~[A-Za-z0-9_.~%-]*): "
END = "</turn>"
CONTROL = re.compile(rf"(\\*)({HEAD}|### [A-Za-z]+:|{END})")
ESCAPED = re.compile(rf"\\(\\*)({HEAD}|### [A-Za-z]+:|{END})")
TURN = re.compile(rf"### (System|User|Assistant|~[A-Za-z0-9_.~%-]*): (.*?)\n(?<!\\){END}\n", re.DOTALL)
PART = 1 << 20
PARTS = "conv_id long, part long, text string, loss array<struct<start:int,end:int>>"


def role_name(role: str) -> str:
    return ROLES.get(role) or "~" + quote(role, safe="")


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The rendered turn and the span of its text in it.  The text is escaped
    until the parser gives back exactly this turn."""
    body = text
    for _ in range(3):
        out = f"### {role_name(role)}: {body}\n{END}\n"
        if parse_turns(out) == [(role, text)]:
            return out, len(out) - len(body) - len(END) - 2, len(out) - len(END) - 2
        body = CONTROL.sub(r"\\\1\2", body)
    raise ValueError("this turn does not survive the round trip")


def parse_turns(text: str) -> list[tuple[str, str]] | None:
    """The turns of a rendered text; None if it is not one."""
    turns, at = [], 0
    while at < len(text):
        found = TURN.match(text, at)
        if not found:
            return None
        name, body = found.groups()
        role = NAMES.get(name) if name in NAMES else unquote(name[1:])
        if any(not m[1] for m in CONTROL.finditer(body)):
            return None  # a bare control string inside a text
        turns.append((role, unescape(body)))
        at = found.end()
    return turns


def unescape(body: str) -> str:
    return ESCAPED.sub(r"\1\2", body)


def _by_conversation(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def format_conversations(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``conv_id, part, text, loss`` of every conversation: its rendered turns
    in parts of whole turns, and the character spans under the loss mask.

    Turns are ordered by ``turn`` (NULL first), role and text; repeated rows
    are turns of their own.  NULL texts and roles count as empty ones, rows
    with a NULL conv_id form one conversation.  An empty table gives an empty
    result.
    """
    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, size, pieces, loss, done = None, 0, 0, [], [], []
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if pieces and (conv != now or size >= PART):
                    done.append((now, part, "".join(pieces), loss))
                    part, size, pieces, loss = part + 1 if conv == now else 0, 0, [], []
                elif conv != now:
                    part = 0
                now = conv
                out, start, end = render_turn(role, text)
                if role == loss_role and end > start:
                    loss.append({"start": size + start, "end": size + end})
                pieces.append(out)
                size += len(out)
                if len(done) >= 1000 or sum(len(d[2]) for d in done[-8:]) > 4 * PART:
                    yield _parts(done)
                    done = []
        if pieces:
            done.append((now, part, "".join(pieces), loss))
        yield _parts(done)

    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return _by_conversation(rows, "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(render, PARTS)


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
         pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.list_(span))],
        names=["conv_id", "part", "text", "loss"])


def read_conversations(parts: DataFrame) -> DataFrame:
    """Digests of formatted conversations, parsed back from their parts:
    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars``.  Hashes are fed turn by turn."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        for batch in batches:
            for conv, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss"))):
                if state is None or conv != now:
                    if state is not None:
                        done.append(_digest(now, state))
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in parse_turns(text) or []:
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    masked = unescape(text[span["start"]:span["end"]])
                    state[2] += len(masked)
                    state[3].update(masked.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            yield _digests(done)
            done = []
        if state is not None:
            yield _digests([_digest(now, state)])

    return _by_conversation(parts, "part").select("conv_id", "text", "loss").mapInArrow(
        read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digest(conv, state) -> tuple:
    return conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def format_and_read(conversations: DataFrame) -> DataFrame:
    """Writes the formatted conversations to the shared folder and reads their
    digests back."""
    return read_conversations(staged(format_conversations(conversations), "conversations"))
