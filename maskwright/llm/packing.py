"""Cost-balanced packing of tokenised documents into fixed-length sequences.

Documents are encoded where they lie and gathered into blocks of bounded size; each
block is packed on its own, so nothing is shuffled and no task holds more than one
block. Within a block, pieces of whole sequences are cut off long documents first.
The rest is taken in descending length, each going to the sequence of the lowest
estimated cost (linear plus quadratic attention cost) that still has room. What fits
nowhere is cut to fill the gaps, and the last tokens of a block form sequences whose
lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean
from .word_tokens import encoder

#: Tokens of a sequence.
SEQUENCE_TOKENS = 2048
#: A block is packed when it holds so many tokens or documents.
BLOCK_TOKENS, BLOCK_DOCS = 1 << 20, 8192
#: The id that ends a document.
END_ID = 1
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 512


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def pack(lengths: list[int], size: int = SEQUENCE_TOKENS) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` of documents of the given token counts.

    Every token lies in exactly one piece and offsets in a sequence have no gaps. All sequences are
    full except at most one for each power of two below ``size``, which holds just that many tokens.
    """
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    rest: list[tuple[int, int, int]] = []  # length, document, start
    for d, n in enumerate(lengths):
        start = 0
        while n - start >= size:
            pieces.append((d, start, size, sequence, 0))
            sequence, start = sequence + 1, start + size
        if n > start:
            rest.append((n - start, d, start))
    rest.sort(key=lambda x: (-x[0], x[1]))
    total = sum(x[0] for x in rest)
    full = total // size
    used, load = np.zeros(full, np.int64), np.zeros(full)

    def put(s: int, d: int, start: int, n: int) -> None:
        pieces.append((d, start, n, sequence + s, int(used[s])))
        used[s] += n
        load[s] += cost(n)

    homeless: list[tuple[int, int, int]] = []
    for n, d, start in rest:
        if full:
            s = int(np.argmin(np.where(used + n <= size, load, np.inf)))
            if used[s] + n <= size:
                put(s, d, start, n)
                continue
        homeless.append((n, d, start))
    gaps = [(float(load[s]), s) for s in range(full) if used[s] < size]
    heapq.heapify(gaps)
    left: list[tuple[int, int, int]] = []
    for n, d, start in homeless:
        while n and gaps:
            s = gaps[0][1]
            m = min(n, size - int(used[s]))
            put(s, d, start, m)
            n, start = n - m, start + m
            heapq.heappop(gaps)
            if used[s] < size:
                heapq.heappush(gaps, (float(load[s]), s))
        if n:
            left.append((n, d, start))
    sequence += full
    tail = total - full * size
    for bit in reversed(range(max(size.bit_length() - 1, 0))):
        room = tail & (1 << bit)
        offset = 0
        while room > offset:
            n, d, start = left.pop()
            m = min(n, room - offset)
            pieces.append((d, start, m, sequence, offset))
            offset += m
            if n > m:
                left.append((n - m, d, start + m))
        sequence += room > 0
    return pieces


_SCHEMA = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _packer(path: str, size: int, block_tokens: int, block_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(path).ids
        end = np.asarray([END_ID], "<u4").tobytes()
        first = TaskContext.get().partitionId() << 36
        docs: list[int | None] = []
        held: list[bytes] = []
        tokens = 0

        def packed() -> pa.RecordBatch:
            nonlocal first
            lengths = [len(x) // 4 for x in held]
            pieces = pack(lengths, size)
            made = pa.RecordBatch.from_arrays(
                [
                    pa.array([docs[p[0]] for p in pieces], pa.int64()),
                    pa.array([p[1] for p in pieces], pa.int64()),
                    pa.array([p[2] for p in pieces], pa.int64()),
                    pa.array([held[p[0]][4 * p[1] : 4 * (p[1] + p[2])] for p in pieces], pa.binary()),
                    pa.array([lengths[p[0]] for p in pieces], pa.int64()),
                    pa.array([first + p[3] for p in pieces], pa.int64()),
                    pa.array([p[4] for p in pieces], pa.int64()),
                ],
                schema=_SCHEMA,
            )
            first += max((p[3] for p in pieces), default=-1) + 1
            docs.clear()
            held.clear()
            return made

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                docs.append(doc)
                held.append(ids)
                tokens += len(ids) // 4
                if tokens >= block_tokens or len(docs) >= block_docs:
                    yield packed()
                    tokens = 0
        if docs:
            yield packed()

    return run


def pack_documents(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE_TOKENS,
    block_tokens: int = BLOCK_TOKENS, block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """One row per piece: ``<id_col>, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` are the piece's token ids as little-endian unsigned 32-bit integers; ``size`` is a power of two.

    * Null and empty texts are the end id alone; a document of any length is cut into whole sequences.
    * Repeated rows are packed once per row, a null id stays null.
    * An empty table gives no pieces. Other columns of ``docs`` are not looked at.
    * ``sequence_id`` holds the partition's number in its high bits, so ids are unique and a task that
      is run again over the same rows makes the same sequences.
    """
    lean(docs)
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return rows.mapInArrow(_packer(tokenizer_path, size, block_tokens, block_docs), schema).withColumnRenamed("id", id_col)
