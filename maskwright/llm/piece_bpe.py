"""SentencePiece encoding by a table of distinct chunks, and decoding.

No piece of the vocabularies taken here has a white-space marker behind another character, so no merge crosses the place before
a run of markers, and a marked word (markers and what follows them) is segmented alike wherever it stands. The same holds
between two characters that stand side by side in no piece, where overlong words are cut too. Texts become the numbers
of their words in a task's table of distinct words, each of which is segmented once, and the ids are joined back by place.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean

#: The white-space marker of the vocabularies.
MARK = "▁"
#: Longer words are also cut between characters that no piece holds side by side.
LONG = 32
#: A task's table of distinct words starts anew when it holds more than so many, or 16 ids for each of so many.
DISTINCT = 200_000
#: Code points of a text that are split at a time, and ids that are decoded at a time.
PART, IDS = 1 << 20, 1 << 18


class Codec:
    """A model of the library with the places where its pieces cannot cross; raises ValueError for a vocabulary that
    has markers inside of pieces, or a normaliser that does more than mark blanks."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]
        pieces = [model.id_to_piece(k) for k in plain]
        probe = " AÅﬁｱ  é "
        if any(MARK in p.lstrip(MARK) for p in pieces) or model.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("words of this vocabulary cannot be segmented apart")
        self.pairs = {a + b for p in pieces for a, b in zip(p, p[1:], strict=False)}
        inside = {c for pair in self.pairs for c in pair}
        alone = "".join(c for c in map(chr, range(128)) if c not in inside and c != " ")
        if not alone:
            raise ValueError("no character to encode a word behind")
        #: A character that no other joins: what stands behind it is encoded without the marker that the library puts before a text.
        self.guard = alone[0]
        self.skip = len(model.encode(self.guard))
        apart = re.escape(alone)
        self.words = re.compile(f"{MARK}+[^{MARK}{apart}]*|[^{MARK}{apart}]+|[{apart}]")
        self.gap = re.compile(f"(?<!{MARK}){MARK}")
        byte = re.compile("<0x([0-9A-F]{2})>")
        self.follows = np.zeros(model.get_piece_size(), bool)  # pieces of a byte inside a character
        for k in range(len(self.follows)):
            if model.is_byte(k):
                self.follows[k] = 0x80 <= int(byte.fullmatch(model.id_to_piece(k))[1], 16) < 0xC0
        self.letter = next(k for k in plain if len(model.id_to_piece(k)) == 1 and model.id_to_piece(k) != MARK)

    def cut(self, word: str) -> list[str]:
        """``word`` cut between characters that no piece holds side by side."""
        if len(word) <= LONG:
            return [word]
        at = [0, *(k for k in range(1, len(word)) if word[k - 1 : k + 1] not in self.pairs), len(word)]
        return [word[a:b] for a, b in zip(at, at[1:], strict=False)]

    def split(self, text: str) -> Iterator[list[str]]:
        """The marked words of a text in order, some at a time."""
        if not text:
            return
        text = MARK + text.replace(" ", MARK)
        a = 0
        while a < len(text):
            gap = self.gap.search(text, a + PART) if a + PART < len(text) else None
            b = gap.start() if gap else len(text)
            found = self.words.findall(text, a, b)
            if max(map(len, found)) > LONG:
                found = [c for w in found for c in self.cut(w)]
            yield found
            a = b

    def segment(self, word: str) -> list[int]:
        """The ids of one word."""
        return self.model.encode(word[1:]) if word[0] == MARK and len(word) > 1 else self.model.encode(self.guard + word)[self.skip :]

    def decode(self, ids: bytes) -> str:
        """The library's decoding, for many ids in parts: a part begins no character in the middle, and a letter before
        it keeps its first marker from being taken for that of a text's start."""
        ids = np.frombuffer(ids, "<u4")
        out, a = [], 0
        while a < len(ids):
            b = min(a + IDS, len(ids))
            while b < len(ids) and self.follows[ids[b]]:
                b += 1
            out.append(self.model.decode([self.letter, *ids[a:b].tolist()])[1:] if a else self.model.decode(ids[:b].tolist()))
            a = b
        return "".join(out)


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


class Table(dict):
    """Distinct words -> their numbers; each is segmented when it is first seen, and its ids lie in one array for all."""

    def __init__(self, codec_: Codec, most: int):
        super().__init__()
        self.codec, self.most = codec_, most
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.flat, self.starts, self.lengths = array("I"), array("Q"), array("I")

    def __missing__(self, word: str) -> int:
        ids = self.codec.segment(word)
        self.starts.append(len(self.flat))
        self.lengths.append(len(ids))
        self.flat.extend(ids)
        n = len(self)
        self[word] = n
        return n

    def ids(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers, joined back by the places of its words."""
        out = []
        for words in self.codec.split(text):
            if len(self) > self.most or len(self.flat) > 16 * self.most:
                self.reset()
            places = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
            starts, many = np.frombuffer(self.starts, "<u8")[places].astype(np.int64), np.frombuffer(self.lengths, "<u4")[places].astype(np.int64)
            ends = np.cumsum(many)
            out.append(np.frombuffer(self.flat, "<u4")[np.arange(ends[-1]) + np.repeat(starts - ends + many, many)].tobytes())
        return b"".join(out)


def _encoded(path: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(codec(path), most)
        for batch in batches:
            ids = [table.ids(text.as_py() or "") for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["id", "n_tokens", "ids"])

    return run


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", distinct: int = DISTINCT) -> DataFrame:
    """One row per input row: ``<id_col>, n_tokens, ids`` (little-endian unsigned 32-bit integers), as the library encodes the whole
    text without begin and end ids.

    Null and empty texts have no ids. Repeated rows and null ids are encoded like any other; an empty table gives no rows;
    other columns are not looked at. Texts of any length are taken whole. A task's table starts anew beyond ``distinct`` words.
    """
    lean(docs)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return rows.mapInArrow(_encoded(model_path, distinct), schema).withColumnRenamed("id", id_col)


def decimal_sha256(ids: bytes) -> str:
    """Lowercase hex digest of the ids as decimal numbers joined by commas."""
    made, numbers = hashlib.sha256(), np.frombuffer(ids, "<u4")
    for a in range(0, len(numbers), IDS):
        made.update((("," if a else "") + ",".join(map(str, numbers[a : a + IDS].tolist()))).encode())
    return made.hexdigest()


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            ids = [x.as_py() or b"" for x in batch.column("ids")]
            made = [pa.array(map(c.decode, ids), pa.string()), pa.array(map(decimal_sha256, ids), pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "decoded", "ids_sha256"])

    return run


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``encode_documents``: ``<id_col>, n_tokens, ids, decoded, ids_sha256`` (the library's text of the ids, and the digest of
    the ids as decimal numbers joined by commas; null ids have the empty text)."""
    lean(encoded)
    rows = encoded.select(F.col(f"`{id_col}`").alias("id"), "n_tokens", "ids")
    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType()), T.StructField("ids_sha256", T.StringType())])
    return rows.mapInArrow(_decoded(model_path), schema).withColumnRenamed("id", id_col)
