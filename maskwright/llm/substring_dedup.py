"""Substring dedup by content-defined chunking with a gear rolling hash.

Texts are read as words. A text is cut before the words where the gear hash of the 16 bytes
before them is the smallest of some window of neighbouring words, so cuts depend on nearby
content only, move along with insertions, and are never far apart. Chunks are
deduplicated by digest. A passage that documents share has whole chunks in common: its first cut that
depends on the passage alone comes after EDGE words at most, its last one is at most CUT_WORDS
words from its end, and all chunks between are shared. That leaves stretches of shared chunks as candidates,
which are verified by 96-bit digests of word windows:

* at each cut, a window of PASSAGE_WORDS words, which other documents have as well (a passage, for sure),
* and the SEED_WORDS words behind it. Every passage has such a seed that all its documents share. Seeds that
  documents share away from sure passages are looked at again, with all windows around them, in all documents that have them.

So a document is reported if and only if another one has PASSAGE_WORDS words of it in a row. What is reported is always shared
word for word; the ends of a passage of more than PASSAGE_WORDS + EDGE words can lie up to EDGE words further out.
The copy of the smallest id stays.

Digests are counted with map-side aggregation, and joins bring counts back to rows that
adaptive execution can split, so a passage that very many documents share does not end in
one task. Only what belongs to one document is gathered. Texts stay where they are as long as the
candidates, which are counted, are few enough to broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, broadcast_if_small, cut, lean, written

#: A repeated passage has at least so many words.
PASSAGE_WORDS = 50
#: Words of which the one with the smallest hash is cut at; bytes that the rolling hash looks back on.
CUT_WORDS, WINDOW = 15, 16
#: From a passage's first word to its first sure cut: the looked-back bytes fill at most 8 words, and a window follows.
EDGE = 8 + CUT_WORDS - 1
#: Words of a seed, with which a passage goes on behind its first sure cut; words that a passage's shared chunks have at least.
SEED_WORDS, SURE_WORDS = PASSAGE_WORDS - EDGE, PASSAGE_WORDS - EDGE - CUT_WORDS
#: The gear table: one fixed pseudo-random 32-bit value for each byte; U+0000, which parts texts, counts as nothing.
GEAR = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 32, 256, np.uint32)
GEAR[0] = 0
#: Values of bytes and multiplier of the chunks' digests: sums of values times powers, which can be taken for all chunks at once.
_VALUES = np.random.Generator(np.random.PCG64(20240301)).integers(0, 1 << 64, 256, np.uint64)
_POWER = 0x9E3779B97F4A7C15
_STEP = 1 << 22
#: Places of candidates, four bytes each, that are broadcast at most; bitmaps of 4 KB that tell which texts have any.
BROADCAST_NUMBERS, BITMAPS = 8_000_000, 2048
#: Rows of a batch that is handed on.
_BATCH = 50_000
#: The place of a null id: after all others.
_LAST = 2**63 - 1


def _gear(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rolling hash of the WINDOW bytes before each place."""
    found = []
    for start in range(0, len(data), _STEP):
        low = max(0, start - WINDOW)
        h = GEAR[data[low : start + _STEP]]
        width = 1
        while width < WINDOW:  # hash of the last 2n bytes from two of the last n
            wider = h.copy()
            wider[width:] += h[:-width] << np.uint32(width)
            h, width = wider, 2 * width
        mine = at[np.searchsorted(at, start + 1) : np.searchsorted(at, start + _STEP, "right")]
        found.append(h[mine - 1 - low])
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


_UP, _DOWN = _powers(_POWER, 1 << 16), _powers(pow(_POWER, -1, 1 << 64), 1 << 16)


def _power(table: np.ndarray, base: int, at: np.ndarray) -> np.ndarray:
    """``base`` to the power of each place."""
    coarse = _powers(pow(base, 1 << 16, 1 << 64), int(at.max(initial=0) >> 16) + 1)
    return coarse[at >> 16] * table[at & 0xFFFF]


def _digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit digests of ``data[start:end]``, from differences of running sums; they choose candidates only."""
    edges = np.unique(np.concatenate([starts, ends]))
    sums = np.zeros(len(edges), np.uint64)
    carry = np.uint64(0)
    for low in range(0, len(data), 1 << 16):
        part = data[low : low + (1 << 16)]
        run = np.cumsum(_VALUES[part] * _UP[: len(part)], dtype=np.uint64) * np.uint64(pow(_POWER, low, 1 << 64)) + carry
        i, j = np.searchsorted(edges, (low + 1, low + len(part) + 1))
        sums[i:j] = run[edges[i:j] - 1 - low]
        carry = run[-1]
    x = (sums[np.searchsorted(edges, ends)] - sums[np.searchsorted(edges, starts)]) * _power(_DOWN, pow(_POWER, -1, 1 << 64), starts)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def _texts(words: list[list[bytes]]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of texts, each followed by a blank, where they begin (and the end), and the number of the word before each
    text: one of bytes that the rolling hash does not see parts texts."""
    every: list[bytes] = []
    before = []
    for text in words:
        before.append(len(every))
        every.append(b"\0" * WINDOW)
        every += text
    before.append(len(every))
    every.append(b"\0" * WINDOW)
    at = np.zeros(len(every) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, every), np.int64, len(every)) + 1, out=at[1:])
    return b" ".join(every) + b" ", at, np.array(before, np.int64)


def cuts(data: np.ndarray, at: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Numbers of the words before which texts are cut, and of their first words."""
    n = len(at) - 1
    h = np.empty(n, np.int64)
    h[1:] = _gear(data, at[1:-1])
    h[(before + 1)[:-1]] = 1 << 32
    h[before] = -1  # no window of a text goes beyond it
    # a word is cut at if a window of neighbours holds no smaller hash, and no equal one behind it
    reach = np.ones(n, np.int8)
    left, right = np.ones(n, bool), np.ones(n, bool)
    for k in range(1, CUT_WORDS):
        left[:k], right[n - k :] = False, False
        left[k:] &= h[:-k] >= h[k:]
        right[:-k] &= h[k:] > h[:-k]
        reach += left
        reach += right
    chosen = reach >= CUT_WORDS
    chosen[(before + 1)[:-1]] = True
    chosen[before] = False
    return np.flatnonzero(chosen)


class Words:
    """The words of a text, joined by one blank each: ``line`` and the bytes where they begin (and the end)."""

    def __init__(self, text: str):
        self.raw = text.encode("utf-8", "surrogatepass")
        words = self.raw.split()
        self.line = b" ".join(words) + b" " if words else b""
        self.at = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=self.at[1:])

    def __len__(self) -> int:
        return len(self.at) - 1

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """First code point of each word in the text, and the one behind it."""
        data = np.frombuffer(self.raw, np.uint8)
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]])))
        if self.raw.isascii():
            return edge[::2], edge[1::2]
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        return chars[edge[::2]], chars[edge[1::2]]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``key, owner, text``: a document is a text under an id. Repeated rows are one; a null id comes after all others."""
    owner = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LAST))
    return docs.select(F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("key"), owner.alias("owner"), F.col(f"`{text_col}`").alias("text"))


def chunks(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``text, place, digest`` of all chunks of texts (lists of words): number of the text, ``first word << 8 | words``, digest."""
    line, at, before = _texts(texts)
    data = np.frombuffer(line, np.uint8)
    starts = cuts(data, at, before)
    text = np.searchsorted(before, starts) - 1
    ends = np.minimum(np.append(starts[1:], before[-1]), before[text + 1])
    return text, ((starts - before[text] - 1) << 8) | (ends - starts), _digests(data, at[starts], at[ends])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys: list[int] = []
    held: list[list[bytes]] = []
    size = 0

    def made() -> pa.RecordBatch:
        text, place, digest = chunks(held)
        out = pa.RecordBatch.from_arrays([pa.array(digest), pa.array(np.array(keys, np.int64)[text]), pa.array(place)], names=["digest", "key", "place"])
        keys.clear()
        held.clear()
        return out

    for batch in batches:
        for key, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = (x.as_py() or "").encode("utf-8", "surrogatepass").split()
            if len(words) < PASSAGE_WORDS:
                continue
            keys.append(key)
            held.append(words)
            size += len(words)
            if size >= _BATCH:
                yield made()
                size = 0
    if held:
        yield made()


def spots(owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``owner``, first word and word behind of the runs of neighbouring chunks that are long enough for a passage; chunks are ordered by owner and place."""
    start, end = place >> 8, (place >> 8) + (place & 255)
    opens = np.ones(len(place), bool)
    opens[1:] = (owner[1:] != owner[:-1]) | (start[1:] != end[:-1])
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(place))[: len(first)] - 1
    long = end[last] - start[first] >= SURE_WORDS
    return owner[first][long], start[first][long], end[last][long]


def _lists(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Number of the row of each element, and the elements."""
    return np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy())), column.flatten()


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        owner, place = _lists(batch.column(1))
        place = place.to_numpy()
        order = np.lexsort((place, owner))
        owner, place = owner[order], place[order]
        owner, first, last = spots(owner, place)
        rows = np.unique(owner)
        offsets = pa.array(2 * np.searchsorted(owner, np.append(rows, batch.num_rows)), pa.int32())
        ranges = pa.ListArray.from_arrays(offsets, pa.array(np.stack([first, last], axis=1).ravel(), pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), ranges], names=["key", "spots"])


_WINDOW = T.StructType([T.StructField("w", T.LongType()), T.StructField("v", T.IntegerType()), T.StructField("owner", T.LongType()), T.StructField("key", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("words", T.IntegerType()), T.StructField("place", T.LongType()), T.StructField("chars", T.IntegerType())])


def _digested(words: Words, starts: np.ndarray, size: int, owner: int, key: int, places) -> tuple[np.ndarray, ...]:
    """The columns of _WINDOW for windows of ``size`` words."""
    from xxhash import xxh3_128_digest as digest

    line, n = words.line, len(starts)
    sums = np.frombuffer(b"".join([digest(line[a:b]) for a, b in zip(words.at[starts].tolist(), words.at[starts + size].tolist(), strict=True)]), np.dtype([("w", "<i8"), ("v", "<i4"), ("rest", "<i4")]))
    place, end = places[0][starts], places[1][starts + size - 1]
    return sums["w"], sums["v"], np.full(n, owner, np.int64), np.full(n, key, np.int64), starts.astype(np.int32), np.full(n, size, np.int32), place.astype(np.int64), (end - place).astype(np.int32)


def _window_batches(windows: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for columns in windows:
        held.append(columns)
        size += len(columns[0])
        if size >= _BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=_WINDOW.names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=_WINDOW.names)


def _at_cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of PASSAGE_WORDS and of SEED_WORDS words at the cuts of the stretches."""

    def windows():
        for batch in batches:
            for k in range(batch.num_rows):
                key, owner, words = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), Words(batch.column(2)[k].as_py() or "")
                spot = batch.column(3)[k].values.to_numpy().astype(np.int64)
                line, at, before = _texts([words.line.split()])
                starts = cuts(np.frombuffer(line, np.uint8), at, before) - 1
                run = np.searchsorted(spot, starts, "right")  # odd inside a run
                starts, behind = starts[run % 2 == 1], np.append(spot, 0)[run][run % 2 == 1]
                places, most = words.places(), np.minimum(behind + CUT_WORDS, len(words))
                for size in (SEED_WORDS, PASSAGE_WORDS):
                    mine = starts[starts + size <= most]
                    if size == PASSAGE_WORDS and spot[-1] == len(words):  # a text's end is a bound as well
                        mine = np.union1d(mine, [len(words) - size])
                    yield _digested(words, mine, size, owner, key, places)

    return _window_batches(windows())


def _around_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of PASSAGE_WORDS words around the seeds that begin at the given words."""

    def windows():
        for batch in batches:
            for k in range(batch.num_rows):
                key, owner, words = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), Words(batch.column(2)[k].as_py() or "")
                starts = np.unique(np.array(batch.column(3)[k].as_py(), np.int64)[:, None] - np.arange(EDGE + 1))
                yield _digested(words, starts[(starts >= 0) & (starts + PASSAGE_WORDS <= len(words))], PASSAGE_WORDS, owner, key, words.places())

    return _window_batches(windows())


def open_seeds(owner: np.ndarray, start: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which shared windows are seeds that no shared window of PASSAGE_WORDS words of the same ``owner`` overlaps."""
    far = np.int64(1) << 40
    sure = np.sort(owner[words == PASSAGE_WORDS] * far + start[words == PASSAGE_WORDS])
    at = owner * far + start
    # no sure window begins in between
    return (words == SEED_WORDS) & (np.searchsorted(sure, at + SEED_WORDS) == np.searchsorted(sure, np.maximum(at - PASSAGE_WORDS + 1, owner * far)))


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        owner, found = _lists(batch.column(1))
        keep = open_seeds(owner, *(found.field(c).to_numpy().astype(np.int64) for c in ("start", "words")))
        yield pa.RecordBatch.from_arrays([found.field(c).filter(pa.array(keep)) for c in ("w", "v")], names=["w", "v"])


def passages(owner: np.ndarray, start: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last windows of passages: of windows ordered by ``owner`` and start, the runs that overlap or touch and have one source."""
    opens = np.ones(len(start), bool)
    opens[1:] = (owner[1:] != owner[:-1]) | (source[1:] != source[:-1]).any(axis=1) | (start[1:] > start[:-1] + PASSAGE_WORDS)
    first = np.flatnonzero(opens)
    return first, np.append(first[1:], len(start)) - 1 if len(start) else first


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, found = _lists(batch.column(2))
        start, place, chars, keep, keep_key = (found.field(c).to_numpy().astype(np.int64) for c in ("start", "place", "chars", "keep", "keep_key"))
        order = np.lexsort((start, row))
        row, start, place, chars, keep, keep_key = (c[order] for c in (row, start, place, chars, keep, keep_key))
        a, b = passages(row, start, np.stack([keep, keep_key], axis=1))
        owner, key = (batch.column(c).to_numpy()[row[a]] for c in (0, 1))
        columns = [owner, key, place[a], place[b] + chars[b], start[b] + PASSAGE_WORDS - start[a], keep[a], (keep[a] == owner) & (keep_key[a] == key)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["owner", "key", "start", "end", "n_words", "keep", "kept"])


def _shared(windows: DataFrame) -> DataFrame:
    """``windows`` that more than one document has, with the document that keeps them."""
    one = F.struct("owner", "key")
    repeated = windows.groupBy("w", "v").agg(F.min(one).alias("first"), F.max(one).alias("last")).filter("first < last")
    # written, so that a hot window's rows can be split in the join
    return windows.join(written(repeated.select("w", "v", F.col("first.owner").alias("keep"), F.col("first.key").alias("keep_key")), "repeated"), ["w", "v"])


def _joined(texts: DataFrame, places: DataFrame, column: str) -> DataFrame:
    """``texts`` with their (materialised) ``places``: broadcast if they are few enough, rows and numbers counted. Else both are
    dealt by key, but only those texts whose key is set in a bitmap of all keys, which has BITMAPS * 4 KB at most."""
    rows, numbers = places.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(column)), F.lit(0))).first()
    if rows <= BROADCAST_ROWS and numbers <= BROADCAST_NUMBERS:
        return texts.join(F.broadcast(places), "key")
    at = F.pmod("key", F.lit(BITMAPS * 32768))
    maps = places.select(at.alias("at")).groupBy(F.floor(F.col("at") / 32768).alias("map")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bits"))
    placed = texts.withColumn("at", at).withColumn("map", F.floor(F.col("at") / 32768))
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(F.col("at") % 32768 / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    some = placed.join(F.broadcast(maps), "map").filter(F.pmod(F.floor(byte / F.pow(F.lit(2), F.col("at") % 8)), F.lit(2)) == 1)
    return some.select(*texts.columns).join(places, "key")


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``owner, key, start, end, n_words, keep, kept`` of every repeated passage."""
    lean(docs)
    texts = _keyed(docs, id_col, text_col)
    pieces = texts.select("key", "text").mapInArrow(_chunks, "digest long, key long, place long")
    shared = cut(pieces.groupBy("digest").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low < high").select("digest"))
    spotted = pieces.join(shared, "digest").groupBy("key").agg(F.collect_set("place").alias("places")).mapInArrow(_stretches, "key long, spots array<int>")
    first = _joined(texts, cut(spotted), "spots").select("key", "owner", "text", "spots").mapInArrow(_at_cuts, _WINDOW)
    first = written(first, "windows")
    mine = written(_shared(first), "shared")
    seeds = mine.groupBy("key").agg(F.collect_set(F.struct("w", "v", "start", "words")).alias("windows")).mapInArrow(_open, "w long, v int").distinct()
    again = first.join(broadcast_if_small(cut(seeds)), ["w", "v"], "left_semi").groupBy("key").agg(F.collect_set("start").alias("seeds"))
    second = _joined(texts, cut(again), "seeds").select("key", "owner", "text", "seeds").mapInArrow(_around_seeds, _WINDOW)
    every = mine.filter(F.col("words") == PASSAGE_WORDS).unionByName(_shared(written(second, "windows")))
    each = every.groupBy("owner", "key").agg(F.collect_set(F.struct("start", "place", "chars", "keep", "keep_key")).alias("windows"))
    return each.mapInArrow(_passages, "owner long, key long, start long, end long, n_words long, keep long, kept boolean")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages of PASSAGE_WORDS or more words that other documents have too: ``<id_col>, start, end, n_words, keep_id, kept``.

    ``start`` and ``end`` (exclusive) count code points. ``kept`` tells whether this copy stays: it does in the document
    of the smallest id (``keep_id``). A document without repeated passages has no row. Words are what blanks
    (U+0009 to U+000D, space) part; how many blanks part them does not matter.

    * Null and empty texts have no passage. A passage that is repeated within one document only does not count.
    * A document is a text under an id: repeated rows are one document and reported once; rows of one id with other texts
      are other documents, and so are rows of a null id, which come after all others.
    * An empty table gives no rows; other columns are not looked at.
    """
    ids = docs.schema[id_col].dataType
    found = _found(docs, id_col, text_col)
    return found.select(F.nullif("owner", F.lit(_LAST)).cast(ids).alias(id_col), "start", "end", "n_words", F.nullif("keep", F.lit(_LAST)).cast(ids).alias("keep_id"), "kept")


def without_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the passages that do not stay; rows without such passages are as they were."""
    gone = _found(docs, id_col, text_col).filter("not kept").groupBy(F.col("key").alias("__key")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("__cuts"))
    joined = docs.join(cut(gone), F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")) == F.col("__key"), "left")
    text = F.col(f"`{text_col}`")
    # passages may overlap: what stays lies between the furthest end so far and the next start
    state = F.aggregate(
        "__cuts", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("kept")),
        lambda s, c: F.struct(F.greatest(s["at"], c["end"]).alias("at"), F.concat(s["kept"], F.when(c["start"] > s["at"], F.substring(text, (s["at"] + 1).cast("int"), (c["start"] - s["at"]).cast("int"))).otherwise("")).alias("kept")),
    )
    rest = F.concat(state["kept"], F.substring(text, (state["at"] + 1).cast("int"), F.length(text)))
    return joined.withColumn(text_col, F.when(F.col("__cuts").isNull(), text).otherwise(rest)).select(*[f"`{c}`" for c in docs.columns])
