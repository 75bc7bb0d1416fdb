"""Maximal periodic runs of words: divide and conquer on interned word ids.

A run that crosses the middle of a segment has two periods or more on one side of it, so it shows in the Z-functions of the two
halves; those that do are extended over the middle and must not go on beyond the segment (a run lies whole in the first segment whose
middle it crosses). Segments without a word sequence that comes again in the text hold no run and are not entered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean

#: A run has at least so many words and so many periods.
LEAST, TIMES = 6, 4
#: Every run has a sequence of so many words that comes again within it, as it has LEAST words and TIMES periods at least.
GRAM = 5
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def z_function(s: list[int]) -> list[int]:
    """How many elements from each place on equal those from the start on; the first entry is the length."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    first = s[0] if n else None
    for i in range(1, n):
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        elif s[i] != first:
            continue
        else:
            k = 1
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        left, right = i, i + k
    return z


def _recurring(ids: np.ndarray) -> np.ndarray:
    """How many of the places before each one start a sequence of GRAM words that comes again later (or may, by its hash)."""
    n = len(ids) - GRAM + 1
    h = np.zeros(n, np.uint64)
    for k in range(GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64) + np.uint64(1)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    again = np.zeros(len(ids) + 1, np.int64)
    same = h[order][1:] == h[order][:-1]
    again[order[:-1][same] + 1] = 1
    return np.cumsum(again)


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """``start, length, period`` of every maximal run with its smallest period, by start and period."""
    n = len(ids)
    if n < LEAST:
        return []
    again = _recurring(ids)
    if not again[-1]:
        return []
    s = ids.tolist()
    found: dict[tuple[int, int], int] = {}
    segments = [(0, n)]
    while segments:
        a, b = segments.pop()
        if b - a < LEAST or again[b] == again[a]:
            continue
        m = (a + b) // 2
        segments += [(a, m), (m, b)]
        most = (b - a) // TIMES
        # to the right: words m and m + p begin a square of period p there; to the left likewise, read backwards
        for ahead in (True, False):
            near, far = (s[m:b], s[a:m][::-1]) if ahead else (s[a:m][::-1], s[m:b])
            z = z_function(near)
            periods = [p for p in range(1, min(most, len(z) - 1) + 1) if z[p] >= p]
            if not periods:
                continue
            back = _backwards(near, far, periods)
            for p in periods:
                inside, over = p + z[p], back[p]
                if inside + over < max(LEAST, TIMES * p):
                    continue
                start, end = (m - over, m + inside) if ahead else (m - inside, m + over)
                if (start > 0 and s[start - 1] == s[start - 1 + p]) or (end < n and s[end] == s[end - p]):
                    continue  # goes on beyond the segment: found where it lies whole
                if found.get((start, end), p) >= p:
                    found[start, end] = p
    return sorted((start, end - start, p) for (start, end), p in found.items())


def _backwards(near: list[int], far: list[int], periods: list[int]) -> dict[int, int]:
    """For each period how far the match of near[p - 1], near[p - 2] ... and on over the middle goes: how many of ``far`` (from the
    middle on) equal what stands a period nearer, that is near[p - 1 - k] and, behind those, far[k - p]."""
    out = {}
    if len(periods) * 4 <= len(near):
        budget = 4 * (len(near) + len(far))
        for p in periods:
            k = 0
            while k < len(far) and budget and far[k] == (near[p - 1 - k] if k < p else far[k - p]):
                k += 1
                budget -= 1
            if not budget:
                break
            out[p] = k
        else:
            return out
    most = periods[-1]
    # far against near[:most] backwards and far itself, at every place
    z = z_function([*far, -1, *near[:most][::-1], *far])
    return {p: min(z[len(far) + 1 + most - p], len(far)) for p in periods}


def collapsed(words: list[str], found: list[tuple[int, int, int]]) -> str:
    """The words without those that a run has behind its first period, joined by one space."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    return " ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k)


_RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def _mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    for batch in batches:
        all_runs, texts, counts = [], [], []
        for text in batch.column(1):
            words = _WORD.findall(text.as_py() or "")
            numbers: dict[str, int] = {}
            found = runs(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)))
            all_runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
            texts.append(collapsed(words, found))
            counts.append(len(words))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(all_runs, kind), pa.array(texts, pa.string())], names=["id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``<id_col>, n_words, runs, collapsed``.

    ``runs`` are the stretches of consecutive words (numbered from 0) with a smallest period q and at least max(6, 4 q) words that no
    neighbouring word extends, by start and period. ``collapsed`` is the text without the words that a run has behind its first
    period, joined by one space. A null or empty text has no words, no runs and the empty text. Repeated rows
    and null ids are treated like any other; an empty table gives no rows; other columns are not looked at.
    """
    lean(docs)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("runs", _RUNS), T.StructField("collapsed", T.StringType())])
    return rows.mapInArrow(_mapped, schema).withColumnRenamed("id", id_col)
