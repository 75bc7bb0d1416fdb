"""Resampling of documents towards a target distribution by importance weights of hashed word runs.

Texts are cut in chunks at word boundaries; a chunk owns the runs that start in it and carries the next n-1 words to see them
whole. Counts of buckets are added up inside a task first (one vector each), and chunk sums by document. The
draw is without replacement, by the greatest perturbed weights.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, lean, order_numbers

#: Runs of up to so many words, and the buckets they are hashed to; one vector of BUCKETS whole numbers is all that the driver sees.
RUN, BUCKETS = 2, 10_000
#: Code points of a chunk; it goes on to the end of its last word.
CHUNK = 1 << 16
#: Words of fewer bytes (with a space) are hashed behind each other by tables that are at hand.
SHORT = 64
#: A task remembers the hashes of so many words.
WORDS = 200_000
#: Words of lower-cased bytes (every byte of a character beyond ASCII belongs to one), and of a text as it is.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_RAW = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

_PIECE = T.StructType([T.StructField("row", T.LongType()), T.StructField("text", T.StringType()), T.StructField("own", T.LongType())])


@functools.lru_cache(maxsize=1024)
def _shift(length: int) -> np.ndarray:
    """Four tables of 256: what each byte of a crc32 becomes when ``length`` bytes follow; crc32(a + b) is the shifted crc32(a) xor crc32(b)."""
    bits = np.array([zlib.crc32(bytes(length), 1 << k) ^ zlib.crc32(bytes(length)) for k in range(32)], np.uint32)
    tables = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for k in range(8):
            has = (np.arange(256) >> k & 1).astype(bool)
            tables[byte][has] ^= bits[8 * byte + k]
    return tables


@functools.cache
def _shifts() -> np.ndarray:
    """The tables of all lengths below SHORT, one behind the other."""
    return np.concatenate([_shift(n).ravel() for n in range(SHORT)])


def joined_crc(first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 of pairs of byte strings put together, from their own and the lengths of the second ones."""

    def shifted(tables: np.ndarray, at, c: np.ndarray) -> np.ndarray:
        return tables[at + (c & 255)] ^ tables[at + 256 + (c >> 8 & 255)] ^ tables[at + 512 + (c >> 16 & 255)] ^ tables[at + 768 + (c >> 24)]

    out = shifted(_shifts(), np.where(lengths < SHORT, lengths, 0) * 1024, first)
    for n in np.unique(lengths[lengths >= SHORT]):
        at = lengths == n
        out[at] = shifted(_shift(int(n)).ravel(), 0, first[at])
    return out ^ second


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().lower())


class Words(dict):
    """Words -> their numbers; crc32 of each and of a space and it, and their lengths with the space, lie in arrays. It starts anew beyond WORDS words."""

    def __init__(self):
        super().__init__()
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.crc, self.spaced, self.length = array("I"), array("I"), array("i")

    def __missing__(self, word: bytes) -> int:
        self.crc.append(zlib.crc32(word))
        self.spaced.append(zlib.crc32(b" " + word))
        self.length.append(len(word) + 1)
        n = len(self)
        self[word] = n
        return n

    def buckets(self, words: list[bytes], own: int, run: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
        """The bucket of every run of 1 to ``run`` of the words that starts at one of the first ``own``."""
        if len(self) > WORDS:
            self.reset()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        current, spaced = np.frombuffer(self.crc, np.uint32)[at], np.frombuffer(self.spaced, np.uint32)[at]
        length = np.frombuffer(self.length, np.int32)[at]
        found = [current[:own]]
        for k in range(1, run):
            current = joined_crc(current[: max(len(words) - k, 0)], spaced[k:], length[k:])
            found.append(current[:own])
        return np.concatenate(found).astype(np.int64) % buckets


def cut_text(text: str, chunk: int = CHUNK, run: int = RUN) -> Iterator[tuple[str, int]]:
    """``text`` in chunks that end at word boundaries, each with the next ``run`` - 1 words behind it, and its own length without them."""
    a = 0
    while a < len(text) or a == 0:
        # a word that holds place a + chunk - 1 is not cut
        b = min(a + chunk, len(text))
        if 0 < b < len(text) and _RAW.fullmatch(text, b - 1, b) and (inside := _RAW.match(text, b)):
            b = inside.end()
        carry = [m.end() for m in itertools.islice(_RAW.finditer(text, b), run - 1)]
        yield text[a : carry[-1] if carry else b], b - a
        a = b
        if not text:
            break


def _sliced(chunk: int, run: int):
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                row += 1
                for part, own in cut_text(text.as_py(), chunk, run):
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([part], pa.string()), pa.array([own], pa.int64()), pa.array([doc.as_py()], batch.schema.field(0).type)], names=[*_PIECE.names, "id"])

    return mapped


def features(known: Words, text: str | None, own: int | None, run: int, buckets: int) -> tuple[int, np.ndarray]:
    """How many words a chunk owns, and the buckets of the runs that start at them."""
    words = words_of(text or "")
    n = len(words) if own is None else len(words_of((text or "")[:own]))
    return n, known.buckets(words, n, run, buckets)


def pieces(docs: DataFrame, id_col: str, text_col: str, chunk: int = CHUNK, run: int = RUN) -> DataFrame:
    """``row, text, own, id``: short texts as they are (no row number), longer ones as chunks that are dealt over the tasks."""
    lean(docs)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    long = F.coalesce(F.length("text") > chunk, F.lit(False))
    short = rows.filter(~long).select(F.lit(None).cast("long").alias("row"), "text", F.lit(None).cast("long").alias("own"), "id")
    # written, so that the numbers of the rows hold whatever is done again
    slices = cut(rows.filter(long).mapInArrow(_sliced(chunk, run), T.StructType([*_PIECE.fields, rows.schema["id"]])))
    return short.unionByName(slices.repartition("row", "own", F.xxhash64("text")))


def bucket_counts(parts: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """How many runs of all the pieces fall in each bucket: one vector from each task, added up by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = np.zeros(buckets, np.int64), Words()
        for batch in batches:
            for text, own in zip(batch.column(0), batch.column(1), strict=True):
                total += np.bincount(features(known, text.as_py(), own.as_py(), run, buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    found = parts.select("text", "own").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most one row for each bucket
    counts = np.zeros(buckets, np.int64)
    counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return counts


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target, both smoothed by one."""
    t, s, n = target.astype(float), source.astype(float), len(target)
    return np.floor(1000 * np.log((t + 1) * (source.sum() + float(n)) / ((s + 1) * (target.sum() + float(n))))).astype(np.int64)


def _weigher(gain: np.ndarray, run: int):
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            made = [features(known, text.as_py(), own.as_py(), run, len(gain)) for text, own in zip(batch.column(1), batch.column(2), strict=True)]
            sums = [[n for n, _ in made], [len(b) for _, b in made], [int(gain[b].sum()) for _, b in made]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), *[pa.array(x, pa.int64()) for x in sums]], names=["row", "id", "n_words", "n_features", "gain"])

    return mapped


def weights(parts: DataFrame, gain: np.ndarray, run: int = RUN) -> DataFrame:
    """``id, n_words, n_features, weight``, a row for each text; weight is the mean gain, rounded down (0 without runs)."""
    schema = T.StructType([T.StructField("row", T.LongType()), parts.schema["id"], *[T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "gain")]])
    # written, as it is looked at more than once
    each = cut(parts.select("row", "text", "own", "id").mapInArrow(_weigher(gain, run), schema))
    sums = [F.sum(c).alias(c) for c in ("n_words", "n_features", "gain")]
    whole = each.filter("row is null").drop("row").unionByName(each.filter("row is not null").groupBy("row").agg(F.first("id").alias("id"), *sums).drop("row"))
    return whole.select("id", "n_words", "n_features", F.when(F.col("n_features") == 0, F.lit(0).cast("long")).otherwise(F.expr("(gain - pmod(gain, n_features)) div n_features")).alias("weight"))


def perturbation(stream: str, key: Column) -> Column:
    """floor(1000 g) for a Gumbel number g of 32 bits of sha256(``stream``:key)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{stream}:"), key.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (25, 100), least_words: int = 20, stream: str = "7", run: int = RUN, buckets: int = BUCKETS, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``<id_col>, n_words, n_features, weight, score, rank``.

    Of the rows with at least ``least_words`` words, floor(share) of greatest score are drawn: rank 1, 2, ... in falling order, ties to the
    smaller id (a null id comes last); all others have a null rank. A null text has no words, weight 0 and is never drawn; a null
    id's perturbation is that of an empty one. Repeated rows are rows of their own, ranked side by side. An empty table of documents
    gives no rows, an empty target counts nothing in every bucket. Other columns of either table are not looked at.
    """
    parts = pieces(docs, id_col, text_col, chunk, run)
    wanted = pieces(target.select(F.lit(0).alias("id"), F.col(f"`{target_text}`").alias("text")), "id", "text", chunk, run)
    gain = gains(bucket_counts(wanted, run, buckets), bucket_counts(parts, run, buckets))
    score = F.col("weight") + perturbation(stream, F.coalesce(F.col("id").cast("string"), F.lit("")))
    scored = weights(parts, gain, run).withColumn("score", score)
    fit = F.col("n_words") >= least_words
    placed = order_numbers(scored.withColumn("__fit", fit), [F.desc("__fit"), F.desc("score"), F.asc_nulls_last("id")], "rank")
    drawn = placed.agg(F.count_if("__fit").alias("n")).first()["n"] * share[0] // share[1]
    return placed.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))


def _crc32_sql(text: str) -> str:
    """crc32 of the UTF-8 bytes of an expression, byte by byte through the table of the reversed polynomial."""
    table = "(SELECT list(c ORDER BY b) FROM (SELECT b, list_reduce(list_prepend(CAST(b AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(b)))"
    codes = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda k: CAST('0x' || substr(hex(encode({text})), 2 * k - 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(t.v[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)", table


_CRC, _TABLE = _crc32_sql("f")
ORACLE_SQL = f"""
WITH t AS (SELECT {_TABLE} AS v),
words AS (
  SELECT 'd' AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
  UNION ALL SELECT 'b', NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark
), runs AS (
  SELECT side, doc_id, unnest(w) AS f FROM words
  UNION ALL SELECT side, doc_id, unnest(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) FROM words
), counted AS (SELECT side, doc_id, f, count(*) AS n FROM runs GROUP BY ALL),
bucket AS (SELECT f, {_CRC} % 10000 AS bucket FROM (SELECT DISTINCT f FROM counted), t),
sides AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 'd'), 0)::DOUBLE AS in_docs, coalesce(sum(n) FILTER (WHERE side = 'b'), 0)::DOUBLE AS in_target FROM counted JOIN bucket USING (f) GROUP BY 1),
totals AS (SELECT coalesce(sum(n) FILTER (WHERE side = 'd'), 0)::DOUBLE AS all_docs, coalesce(sum(n) FILTER (WHERE side = 'b'), 0)::DOUBLE AS all_target FROM counted),
gain AS (SELECT bucket, floor(1000 * ln((in_target + 1) * (all_docs + 10000) / ((in_docs + 1) * (all_target + 10000))))::BIGINT AS g FROM sides, totals),
weighed AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS g FROM counted JOIN bucket USING (f) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY 1),
scored AS (
  SELECT words.doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, CASE WHEN n_features IS NULL THEN 0 ELSE (g - ((g % n_features) + n_features) % n_features) // n_features END AS weight,
    floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || words.doc_id), 1, 8) AS BIGINT)::DOUBLE + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS noise
  FROM words LEFT JOIN weighed USING (doc_id) WHERE side = 'd'
), ranked AS (SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS rank FROM scored WHERE n_words >= 20)
SELECT scored.doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, (weight + noise)::BIGINT AS score,
  CASE WHEN rank <= (SELECT count(*) * 25 // 100 FROM ranked) THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""
