"""Byte-level BPE encoding and decoding with overlapping chunks.

A long text is cut in chunks, each reading on into the next by an overlap, which are dealt
over the tasks and pre-tokenised there. Scanning depends only on where it starts, so once two
neighbouring scans share a pre-token boundary they agree from there on. Each task looks for the
first such boundary of its chunk and the next one's first words, and encodes its pieces up to it
(each distinct piece once); the chunks of a text are then stitched, each without the ids
before the boundary that the one before it ended at. Decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, lean

#: Code points of a chunk and of its overlap with the next.
CHUNK, OVERLAP = 1 << 16, 1 << 9
#: A piece cache starts anew when it holds this many bytes of pieces and ids, with what Python needs for each entry, and keeps the
#: one before it to take from; it only saves time.
CACHE_BYTES, ENTRY_BYTES = 32 << 20, 200


def _ends(scan, text: str, start: int, stop: int) -> list[int]:
    """Ends of the pre-tokens of ``text[start:stop]``, scanned as if the text ended at ``stop``."""
    return [m.end() for m in scan(text, start, stop)]


def _trusted(ends: list[int], whole: bool) -> list[int]:
    """The ends that hold whatever follows: a scan's last pre-token, and a run of blanks before it, may go on behind its end."""
    return ends if whole else ends[:-2]


def piece_bounds(scan, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """The ends of all pre-tokens of ``text``, from chunks that are scanned independently and stitched.

    Where neighbours share no boundary in the overlap, the scan goes on from
    the last boundary that is known, with a window twice as long.
    """
    n = len(text)
    if n <= chunk:
        return _ends(scan, text, 0, n)
    scans = [(a, _ends(scan, text, a, min(n, a + chunk + overlap)), min(n, a + chunk + overlap)) for a in range(0, n, chunk)]

    out = _trusted(scans[0][1], scans[0][2] == n)
    for a, ends, stop in scans[1:]:
        ends = _trusted(ends, stop == n)
        at, width = (out[-1] if out else 0), chunk
        while True:
            here = set(ends)
            here.add(a)
            k = len(out)
            while k and out[k - 1] >= a and out[k - 1] not in here:
                k -= 1
            # the first shared boundary decides; all later ones agree with it
            if k and out[k - 1] >= a or (k == 0 and a == 0):
                meet = out[k - 1] if k else 0
                del out[k:]
                out.extend(e for e in ends if e > meet)
                break
            if at >= stop or (ends and at >= ends[-1]):
                break
            more_stop = min(n, at + width + overlap)
            more = _trusted(_ends(scan, text, at, more_stop), more_stop == n)
            out.extend(more)
            if more_stop == n:
                break
            if out and out[-1] > at:
                at = out[-1]
            else:
                width *= 2
    at, width = (out[-1] if out else 0), chunk
    while at < n:
        stop = min(n, at + width)
        more = _trusted(_ends(scan, text, at, stop), stop == n)
        out.extend(more)
        if more:
            at = more[-1]
        else:
            width *= 2
    return out


class _Pieces(dict):
    def __init__(self, core):
        super().__init__()
        self.core = core
        self.held, self.old = 0, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = np.asarray(self.core.encode_single_piece(piece.encode()), "<u4").tobytes()
        if len(piece) <= 64:
            if self.held > CACHE_BYTES:
                self.held, self.old = 0, dict(self)
                self.clear()
            self[piece] = ids
            self.held += ENTRY_BYTES + 2 * len(piece) + len(ids)
        return ids


class Codec:
    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        # the library's \s is the White_Space property, which U+001C to U+001F do not have
        self.scan = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).finditer
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, k in ranks.items():
            self.bytes_of[k] = token
        self.pieces = _Pieces(self.core)

    def encode(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        ends = piece_bounds(self.scan, text, chunk, overlap)
        starts = [0, *ends[:-1]]
        return b"".join(map(self.pieces.__getitem__, [text[a:b] for a, b in zip(starts, ends, strict=False)]))

    def encode_chunk(self, text: str, chunk: int, last: bool, overlap: int) -> tuple[bytes, list[int], list[int], int | None]:
        """One chunk and what it reads on: ids up to where it meets the next chunk, places in the overlap with the chunk before where
        pieces end and how many ids come before each, and where it meets the next one (None if it does not, or is the last)."""
        n = len(text)
        ends = _trusted(_ends(self.scan, text, 0, n), last)
        meet = None
        if not last:
            ahead = {chunk, *_trusted([chunk + e for e in _ends(self.scan, text[chunk:], 0, n - chunk)], False)}
            meet = next((e for e in ends if e >= chunk and e in ahead), None)
            ends = ends if meet is None else [e for e in ends if e <= meet]
        ids = [self.pieces[text[a:b]] for a, b in zip([0, *ends[:-1]], ends, strict=False)]
        places, counts, done = [0], [0], 0
        for end, piece in zip(ends, ids, strict=True):
            done += len(piece) // 4
            if end > overlap:
                break
            places.append(end)
            counts.append(done)
        return b"".join(ids), places, counts, meet

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _mapped(schema: T.StructType, kind: str, path: str, pattern: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            if kind == "encode":
                ids = [c.encode(x.as_py() or "", chunk, overlap) for x in batch.column(1)]
                made = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            else:
                made = [pa.array([c.decode(x.as_py() or b"") for x in batch.column(1)], pa.binary())]
            keep = [batch.column(i) for i in range(batch.num_columns) if i != 1 or kind == "decode"]
            yield pa.RecordBatch.from_arrays([*keep, *made], names=schema.names)

    return run


_SLICE = T.StructType([T.StructField("row", T.LongType()), T.StructField("k", T.LongType()), T.StructField("last", T.BooleanType()), T.StructField("text", T.StringType())])
_CODED = T.StructType([*_SLICE.fields[:3], T.StructField("body", T.StringType()), T.StructField("ids", T.BinaryType()), T.StructField("places", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("meet", T.LongType())])


def _slicer(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for doc, x in zip(batch.column(0), batch.column(1), strict=True):
                text = x.as_py()
                row += 1
                for a in range(0, len(text), chunk):
                    yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([a // chunk]), pa.array([a + chunk >= len(text)]), pa.array([text[a : a + chunk + overlap]], pa.string()), pa.array([doc.as_py()], batch.schema.field(0).type)], names=[*_SLICE.names, "id"])

    return run


def _chunk_coder(path: str, pattern: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for n in range(batch.num_rows):
                last, text = batch.column(2)[n].as_py(), batch.column(3)[n].as_py()
                ids, places, counts, meet = c.encode_chunk(text, chunk, last, overlap)
                made = [pa.array([text if last else text[:chunk]], pa.string()), pa.array([ids], pa.binary()), pa.array([places], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([meet], pa.int64())]
                one = batch.slice(n, 1)
                yield pa.RecordBatch.from_arrays([*one.columns[:3], *made, one.column(4)], names=[*_CODED.names, "id"])

    return run


def stitched(parts: list[dict], codec_: Codec, chunk: int, overlap: int) -> bytes:
    """The ids of a text from those of its chunks in order; where two chunks did not meet, the text is encoded as a whole."""
    out, meet = [], 0
    for part in parts:
        # a chunk begins ``chunk`` behind the one before it
        at = meet if part["k"] == 0 else None if meet is None else meet - chunk
        if at is None or at not in part["places"]:
            return codec_.encode("".join(p["body"] for p in parts), chunk, overlap)
        out.append(part["ids"][4 * part["counts"][part["places"].index(at)] :])
        meet = part["meet"]
    return b"".join(out)


def _stitcher(path: str, pattern: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for n in range(batch.num_rows):
                held.append({name: batch.column(c)[n].as_py() for c, name in enumerate(batch.schema.names)})
                if held[-1]["last"]:
                    ids = stitched(held, codec(path, pattern), chunk, overlap)
                    doc = held[0]["id"]
                    held = []
                    yield pa.RecordBatch.from_arrays([pa.array([doc], batch.schema.field("id").type), pa.array([len(ids) // 4], pa.int64()), pa.array([ids], pa.binary())], names=["id", "n_tokens", "ids"])

    return run


def encode_documents(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per input row: ``<id_col>, n_tokens, ids`` (little-endian unsigned 32-bit integers).

    Null and empty texts have no ids. Repeated rows and null ids are encoded like any other; an empty
    table gives no rows; other columns are not looked at. A text of any length is encoded as a whole: if it is
    longer than ``chunk`` code points, its chunks are encoded in different tasks.
    """
    lean(docs)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = T.StructField("id", rows.schema["id"].dataType)
    schema = T.StructType([kind, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    long = F.coalesce(F.length("text") > chunk, F.lit(False))
    short = rows.filter(~long).mapInArrow(_mapped(schema, "encode", vocabulary_path, pattern, chunk, overlap), schema)
    # written, so that the numbers of the rows hold whatever is done again
    slices = cut(rows.filter(long).mapInArrow(_slicer(chunk, overlap), T.StructType([*_SLICE.fields, kind])))
    coded = slices.repartition("row", "k").mapInArrow(_chunk_coder(vocabulary_path, pattern, chunk, overlap), T.StructType([*_CODED.fields, kind]))
    whole = coded.repartition("row").sortWithinPartitions("row", "k").mapInArrow(_stitcher(vocabulary_path, pattern, chunk, overlap), schema)
    return short.unionByName(whole).withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``encode_documents``: ``<id_col>, ids, n_tokens, decoded`` (raw bytes)."""
    lean(encoded)
    rows = encoded.select(F.col(f"`{id_col}`").alias("id"), "ids", "n_tokens")
    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.BinaryType())])
    return rows.mapInArrow(_mapped(schema, "decode", vocabulary_path, pattern, 0, 0), schema).withColumnRenamed("id", id_col)
