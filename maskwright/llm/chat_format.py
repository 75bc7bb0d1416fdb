"""Chat formatting by columnar byte assembly.

A turn is written as ``### <role>: <text></turn>`` and a line feed. Backslash, ``###`` and
``</turn>`` inside texts (and ``:`` inside roles) get a backslash before them, so a format
can be read back exactly. Each Arrow batch is escaped with vectorised string kernels;
segment lengths, cumulative offsets and scatter indices are computed in numpy and the
bytes of headers, texts and footers are copied into one preallocated Arrow buffer.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean

#: The role whose texts the loss counts.
TRAINED_ROLE = "assistant"
#: A conversation that goes on behind this many bytes of text is written in parts.
PART_BYTES = 16 << 20
#: Bytes that are scattered at once; bounds the index arrays.
_STEP = 1 << 20

_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)


def _escape(texts: pa.Array, role: bool = False) -> pa.Array:
    out = pc.replace_substring(texts, "\\", "\\\\")
    out = pc.replace_substring(out, "###", "\\###")
    out = pc.replace_substring(out, "</turn>", "\\</turn>")
    return pc.replace_substring(out, ":", "\\:") if role else out


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def _bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string array without nulls."""
    strings = strings.cast(pa.large_string())
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def _scatter(out: np.ndarray, target: np.ndarray, offsets: np.ndarray, data: np.ndarray) -> None:
    """Copy segment k, ``data[offsets[k]:offsets[k+1]]``, to ``out[target[k]:]``, in steps of bounded size."""
    lengths = np.diff(offsets)
    done = np.concatenate([[0], np.cumsum(lengths)])
    k = 0
    while k < len(lengths):
        if lengths[k] > _STEP:
            out[target[k] : target[k] + lengths[k]] = data[offsets[k] : offsets[k + 1]]
            k += 1
            continue
        e = max(k + 1, int(np.searchsorted(done, done[k] + _STEP, "right")) - 1)
        shift = np.repeat(target[k:e] - offsets[k:e], lengths[k:e])
        index = np.arange(offsets[k], offsets[e])
        out[index + shift] = data[index]
        k = e


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, pa.Buffer, np.ndarray, np.ndarray]:
    """Start of each turn (and the end), the formatted bytes, and start and end of each turn's text in them."""
    n = len(roles)
    roles, texts = _escape(roles, role=True), _escape(texts)
    headers = pc.binary_join_element_wise(pa.scalar("### "), roles, pa.scalar(": "), "")
    parts = [_bytes_of(headers), _bytes_of(texts), _bytes_of(pa.array(["</turn>\n"] * n, pa.string()))]
    lengths = np.stack([np.diff(at) for at, _ in parts], axis=1) if n else np.zeros((0, 3), np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths.ravel())]).astype(np.int64)
    buffer = pa.allocate_buffer(int(starts[-1]))
    out = np.frombuffer(buffer, np.uint8)
    for j, (at, data) in enumerate(parts):
        _scatter(out, starts[j:-1:3], at, data)
    return starts[::3], buffer, starts[1:-1:3], starts[2::3]


def _runs(conv: pa.Array) -> np.ndarray:
    """Starts of the runs of equal conversation ids (null is an id of its own), and the end."""
    n = len(conv)
    if n < 2:
        return np.array([0, n][: n + 1])
    null = pc.is_null(conv).to_numpy(zero_copy_only=False)
    value = pc.fill_null(conv, 0).to_numpy(zero_copy_only=False)
    change = (value[1:] != value[:-1]) | (null[1:] != null[:-1])
    return np.concatenate([[0], np.flatnonzero(change) + 1, [n]])


_SCHEMA = pa.schema([("conv", pa.int64()), ("part", pa.int32()), ("n_turns", pa.int64()), ("formatted", pa.large_string()), ("loss_starts", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64()))])


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    written: tuple | None = None  # the conversation that goes on, and its next part

    def made(rows: pa.Table, first_part: int) -> pa.RecordBatch:
        conv = rows.column(0).combine_chunks()
        roles, texts = (pc.fill_null(rows.column(i).combine_chunks(), "") for i in (2, 3))
        at, buffer, text_start, text_end = assemble(roles, texts)
        runs = _runs(conv)
        cuts = at[runs]
        formatted = pa.Array.from_buffers(pa.large_string(), len(runs) - 1, [None, pa.py_buffer(np.ascontiguousarray(cuts)), buffer])
        trained = pc.equal(roles, TRAINED_ROLE).to_numpy(zero_copy_only=False)
        mine = np.flatnonzero(trained)
        owner = np.searchsorted(runs, mine, "right") - 1
        offsets = pa.array(np.searchsorted(owner, np.arange(len(runs))), pa.int32())
        starts = pa.ListArray.from_arrays(offsets, pa.array(text_start[mine] - cuts[owner], pa.int64()))
        ends = pa.ListArray.from_arrays(offsets, pa.array(text_end[mine] - cuts[owner], pa.int64()))
        parts = np.zeros(len(runs) - 1, np.int32)
        parts[0] = first_part
        return pa.RecordBatch.from_arrays([conv.take(pa.array(runs[:-1])), pa.array(parts), pa.array(np.diff(runs), pa.int64()), formatted, starts, ends], schema=_SCHEMA)

    def first_part(rows: pa.Table) -> int:
        return written[1] if written and rows.num_rows and written[0] == rows.column(0)[0].as_py() else 0

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows = pa.Table.from_batches(held)
        # the last conversation may go on in the next batch, so it is held back
        last = int(_runs(rows.column(0).combine_chunks())[-2])
        if last:
            yield made(rows.slice(0, last), first_part(rows))
            written = None
            rows = rows.slice(last)
            held = rows.to_batches()
        if rows.nbytes >= PART_BYTES:
            part = first_part(rows)
            yield made(rows, part)
            written, held = (rows.column(0)[0].as_py(), part + 1), []
    if held:
        rows = pa.Table.from_batches(held)
        yield made(rows, first_part(rows))


def format_conversations(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``<conv_col>, part, n_turns, formatted, loss_starts, loss_ends``.

    ``loss_starts`` and ``loss_ends`` are byte places in ``formatted`` of the trained role's texts.
    Only a conversation of more than PART_BYTES has further parts, in order and next to each other.

    * Turns are ordered by turn number, ties by role and text; null turns come first. Repeated rows are
      turns of their own.
    * Null roles and texts count as empty; rows of a null conversation id form one conversation.
    * An empty table gives no rows; other columns are not looked at.
    """
    lean(conversations)
    rows = conversations.select(F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), F.col(f"`{role_col}`").alias("role"), F.col(f"`{text_col}`").alias("text"))
    dealt = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    schema = T.StructType([T.StructField("conv", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("n_turns", T.LongType()), T.StructField("formatted", T.StringType()), T.StructField("loss_starts", T.ArrayType(T.LongType())), T.StructField("loss_ends", T.ArrayType(T.LongType()))])
    return dealt.mapInArrow(_format, schema).withColumnRenamed("conv", conv_col)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The ``(role, text)`` turns of a formatted conversation."""
    turns, done = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != done:
            break
        turns.append((unescape(m[1]), unescape(m[2])))
        done = m.end()
    if done != len(formatted):
        raise ValueError(f"not a formatted conversation from {done} on")
    return turns


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state: list | None = None
    done: list[list] = []

    def taken() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True))
        made = pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array([h.hexdigest() for h in columns[2]]), pa.array(columns[3], pa.int64()), pa.array([h.hexdigest() for h in columns[4]]), pa.array(columns[5], pa.int64())], names=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        done.clear()
        return made

    for batch in batches:
        for conv, part, formatted, starts, ends in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if part == 0:
                if state:
                    done.append(state)
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            turns = parse(formatted)
            state[1] += len(turns)
            for role, text in turns:
                state[2].update(f"{role}\n{text}\n".encode())
            raw = formatted.encode()
            for a, b in zip(starts, ends, strict=True):
                text = unescape(raw[a:b].decode())
                state[3] += len(text)
                state[4].update(text.encode())
            state[5] += len(formatted)
        if len(done) >= 1000:
            yield taken()
    if state:
        done.append(state)
    if done:
        yield taken()


def read_back(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Digest columns of each conversation, from what :func:`format_conversations` wrote."""
    lean(formatted)
    rows = formatted.select(F.col(conv_col).alias("conv"), "part", "formatted", "loss_starts", "loss_ends")
    return rows.mapInArrow(_read_back, "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("conv", conv_col)


_ESCAPED_SQL = r"replace(replace(replace({0}, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')"

ORACLE_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, {_ESCAPED_SQL.format("text")} AS written, replace({_ESCAPED_SQL.format("role")}, ':', '\:') AS named FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(14 + length(named) + length(written)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
