"""Hierarchical language identification.

A text is a vector of hashed byte n-gram counts (square roots, unit length). Languages
whose training centroids are close form families, which are found from the training
texts themselves. One-against-the-rest linear support vector machines choose the family;
within it, one-versus-one machines for each pair of languages vote on the language.

The score compares known languages with each other, so a text of none of them can have a high
one. Texts are therefore also held against the smallest margin of sample texts of like length,
each measured by machines that did not see it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, lean

#: log2 of the number of hashed n-gram features; lengths of the n-grams in bytes.
BITS, GRAMS = 13, (1, 2, 3, 4)
#: Training texts of each language: those with the smallest hash of their id. The bound of the fit.
SAMPLE_PER_LANGUAGE = 300
#: Cost of a training error; slope of the margins' logistic function.
C, SLOPE = 10.0, 4.0
UNDETERMINED = "und"
#: Below this score :func:`keep_identified` rejects a text: with four languages, those that the floors below give score 0.
MIN_SCORE = 0.25
#: A text whose smallest deciding margin is below this share of the sample's smallest has score 0. The sample's is
#: found by so many folds, for each length only if so many texts show it, and past one odd text in so many (mixed or junk).
FLOOR_SHARE, FOLDS, LEAST_SHOWN, ODD_ONE_IN = 0.5, 4, 30, 400
_STEP = 1 << 20
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)


def features(text: str) -> np.ndarray:
    """Unit-length vector of the whole text."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.zeros(1 << BITS, np.int64)
    for start in range(0, len(data), _STEP):
        part = data[start : start + _STEP + max(GRAMS) - 1].astype(np.uint32)
        own = min(_STEP, len(data) - start)  # n-grams that begin here
        code = np.zeros(0, np.uint32)
        for n in range(1, max(GRAMS) + 1):
            k = len(part) - n + 1
            if k <= 0:
                break
            fresh = part[n - 1 :] * _MULTIPLIERS[n - 1]
            code = fresh if n == 1 else (code[:k] ^ (code[:k] >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + fresh
            if n in GRAMS:
                counts += np.bincount((code[:own] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    x = np.sqrt(counts.astype(np.float32))
    norm = float(np.sqrt((x * x).sum()))
    return x / norm if norm else x


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _svm(gram: np.ndarray, y: np.ndarray, epochs: int = 30) -> np.ndarray:
    """Dual coordinate descent for the squared hinge loss: coefficients of the training texts."""
    n = len(y)
    alpha, f = np.zeros(n), np.zeros(n)
    weight = np.where(y > 0, n / (2 * max((y > 0).sum(), 1)), n / (2 * max((y < 0).sum(), 1)))
    ridge = 1 / (2 * C * weight)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(n):
            slope = y[i] * f[i] - 1 + ridge[i] * alpha[i]
            new = max(alpha[i] - slope / (gram[i, i] + ridge[i]), 0.0)
            if abs(new - alpha[i]) > 1e-12:
                f += (new - alpha[i]) * y[i] * gram[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-5:
            break
    return alpha * y


@dataclass
class Model:
    families: list[list[str]]
    #: For each family, then for each pair ``(family, a, b)``: a column of weights, its last entry the offset.
    pairs: list[tuple[int, int, int]]
    weights: np.ndarray
    #: By the bit length of a text's number of bytes (the last holds for longer ones too): the smallest margin that counts.
    floors: tuple[float, ...] = (0.0,)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.families or not has_letter(text):
            return UNDETERMINED, 0.0
        margins = features(text) @ self.weights[:-1] + self.weights[-1]
        language, score = self._vote(margins)
        lowest = self.lowest(margins)
        if lowest is not None and lowest < self.floors[min(_size(text), len(self.floors) - 1)]:
            score = 0.0
        return language, score

    def lowest(self, margins: np.ndarray) -> float | None:
        """The smallest of the margins that decide: the family's and those of the language chosen in it. One language has none."""
        k = len(self.families)
        if k < 2:
            return None
        family = int(margins[:k].argmax())
        languages = self.families[family]
        language = languages.index(self._vote(margins)[0])
        sides = [(1 if a == language else -1) * float(margins[c]) for c, (f, a, b) in enumerate(self.pairs, k) if f == family and language in (a, b)]
        return min(float(margins[family]), *sides) if sides else float(margins[family])

    def _vote(self, margins: np.ndarray) -> tuple[str, float]:
        k = len(self.families)
        if k > 1:
            raw = np.exp(SLOPE * (margins[:k] - margins[:k].max()))
            raw /= raw.sum()
            family, sure = int(raw.argmax()), float(raw.max())
        else:
            family, sure = 0, 1.0
        languages = self.families[family]
        votes = np.zeros(len(languages))
        for column, (f, a, b) in enumerate(self.pairs, k):
            if f == family:
                p = 1 / (1 + math.exp(-max(min(SLOPE * float(margins[column]), 30.0), -30.0)))
                votes[a] += p
                votes[b] += 1 - p
        if len(languages) == 1:
            return languages[0], sure
        best = int(votes.argmax())
        return languages[best], sure * float(votes[best]) / (len(languages) - 1)


def _size(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass")).bit_length()


def _floors(shown: list[tuple[int, float]]) -> tuple[float, ...]:
    """The floors from ``size, margin`` of sample texts: for each size by texts of half that size or more, as short
    texts have small margins; where too few are as long, the floor of the size below."""
    floors = [0.0]
    for size in range(1, max((s for s, _ in shown), default=0) + 1):
        margins = sorted(m for s, m in shown if s >= size - 1)
        floors.append(max(FLOOR_SHARE * margins[len(margins) // ODD_ONE_IN], 0.0) if len(margins) >= LEAST_SHOWN else floors[-1])
    return tuple(floors)


def fit(texts: list[str], languages: list[str]) -> Model:
    names = sorted(set(languages))
    if not names:
        return Model([], [], np.zeros(((1 << BITS) + 1, 0), np.float32))
    x = np.stack([features(t) for t in texts])
    lang = np.array([names.index(v) for v in languages])
    centre = np.stack([x[lang == k].mean(axis=0) for k in range(len(names))])
    centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    near = centre @ centre.T
    groups = [[k] for k in range(len(names))]
    while len(groups) > math.ceil(math.sqrt(len(names))):  # join the two closest groups (average linkage)
        _, i, j = max((near[np.ix_(a, b)].mean(), -i, -j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        groups[-i] = groups[-i] + groups[-j]
        del groups[-j]
    x1 = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    gram = x1.astype(np.float64) @ x1.T
    family = np.empty(len(names), int)
    for f, group in enumerate(groups):
        family[group] = f
    pairs = [(f, a, b) for f, group in enumerate(groups) for a in range(len(group)) for b in range(a + 1, len(group))]

    def machines(seen: np.ndarray) -> np.ndarray:
        columns = []
        for f in range(len(groups)):
            y = np.where(family[lang[seen]] == f, 1.0, -1.0)
            columns.append(x1[seen].T @ _svm(gram[np.ix_(seen, seen)], y) if len(groups) > 1 else np.zeros(x1.shape[1]))
        for f, a, b in pairs:
            rows = seen[(lang[seen] == groups[f][a]) | (lang[seen] == groups[f][b])]
            y = np.where(lang[rows] == groups[f][a], 1.0, -1.0)
            columns.append(x1[rows].T @ _svm(gram[np.ix_(rows, rows)], y))
        return np.stack(columns, axis=1).astype(np.float32)

    every = np.arange(len(lang))
    model = Model([[names[k] for k in group] for group in groups], pairs, machines(every))
    if len(groups) > 1:
        shown = []
        for fold in range(FOLDS):
            seen = every[every % FOLDS != fold]
            if len(set(lang[seen])) < len(names):
                continue
            rows = every[every % FOLDS == fold]
            for row, margins in zip(rows, x1[rows] @ machines(seen), strict=True):
                if model._vote(margins)[0] == languages[row]:  # texts under a wrong label say nothing of clean ones
                    shown.append((_size(texts[row]), model.lowest(margins)))
        model.floors = _floors(shown)
    return model


def held_out(id_col: str):
    """The rows that a fit never looks at: crc32 of the id as text leaves 2 when divided by 4. Null ids do not."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on at most ``per_language`` labelled texts of each language that are not held out.

    Empty and null texts, null languages and null ids teach nothing. The sample is chosen by the hash of ids, before any text is
    brought together; repeated rows are one text, so at most ``per_language`` texts of each language reach the driver.
    """
    id_, lang, text = F.col(f"`{id_col}`"), F.col(f"`{lang_col}`"), F.col(f"`{text_col}`")
    rows = docs.filter(~held_out(id_col) & lang.isNotNull() & id_.isNotNull() & (F.length(F.trim(text)) > 0))
    slim = rows.select(id_.alias("id"), lang.alias("lang"), F.xxhash64(id_).alias("order"), F.xxhash64(text).alias("same"))
    totals = {r["lang"]: r["n"] for r in slim.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each language
    order = Window.partitionBy("lang").orderBy("order", "id", "same")
    ahead = 16
    while True:
        # only rows of the smallest hashes are ranked, some times as many as are asked for; more if ids are repeated
        low = [F.when(F.col("lang") == k, F.pmod("order", F.lit(1 << 30)) <= math.ceil((1 << 30) * ahead * per_language / n)) for k, n in totals.items()]
        near = slim.filter(F.coalesce(*low, F.lit(False))).distinct()
        ranked = near.withColumn("order", F.pmod("order", F.lit(1 << 30))).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_language)
        chosen = cut(ranked.select("id", "lang", "same"))
        got = {r["lang"]: r["n"] for r in chosen.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
        if all(got.get(k, 0) >= per_language or ahead * per_language >= n for k, n in totals.items()):
            break
        ahead *= 64
    named = rows.select(id_.alias("id"), text.alias("text"), lang.alias("lang"), F.xxhash64(text).alias("same"))
    # bounded by per_language for each language
    texts = named.join(F.broadcast(chosen), ["id", "lang", "same"], "left_semi").groupBy("id", "lang", "same").agg(F.first("text").alias("text"))
    sample = sorted((tuple(r) for r in texts.select("lang", "id", "same", "text").collect()))
    return fit([r[3] for r in sample], [r[0] for r in sample])


def _predicting(model: Model, text_col: str, names: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [model.predict(x.as_py()) for x in batch.column(batch.schema.get_field_index(text_col))]
            columns = [*batch.columns, pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *names])

    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``<id_col>, held_out, lang_pred, score`` (0 to 1), from the text alone.

    * Null texts and texts without a letter are ``und`` with score 0, and so is everything if the model
      has no language. Texts like none of the model's two or more languages have the nearest and score 0. Repeated rows and null ids are handled like any other; a null id is not held out.
    * An empty table gives no rows; other columns are not looked at.
    """
    lean(docs)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), held_out(id_col).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_predicting(model, "text", ("lang_pred", "score")), schema).drop("text").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is told with at least ``min_score``; a null language is filled in."""
    lean(docs)
    schema = T.StructType([*docs.schema.fields, T.StructField("__lang", T.StringType()), T.StructField("__score", T.DoubleType())])
    told = docs.mapInArrow(_predicting(model, text_col, ("__lang", "__score")), schema)
    kept = told.filter((F.col("__lang") != UNDETERMINED) & (F.col("__score") >= min_score))
    return kept.withColumn(lang_col, F.coalesce(lang_col, "__lang")).drop("__lang", "__score")
