"""Logistic models fitted by Newton steps that are one aggregation for all models.

A step reads the weighted cells (distinct category combinations) of every model, adds up gradient, curvature and loss by model with
map-side combine, and solves each model's small system on the driver. Sums are exact decimals, so a fit does not
depend on how the cells are dealt. What reaches the driver is bounded by the square of the declared categories.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Hashable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.writers import shared
from .schema import require

#: Categories of all attributes together; an attribute of more values is no quasi-identifier.
CATEGORIES = 4096
_SUM = "decimal(38,18)"


@dataclass
class Fits:
    """Fitted models by key: coefficients (intercept first), whether they converged, after how many evaluations, and the penalised loss."""

    by: list[str]
    features: dict[str, dict[str, int]]
    beta: dict[Hashable, np.ndarray]
    converged: dict[Hashable, bool] = field(default_factory=dict)
    evaluations: dict[Hashable, int] = field(default_factory=dict)
    loss: dict[Hashable, float] = field(default_factory=dict)

    def ids(self) -> Column:
        return _ids(self.features)

    def frame(self, like: DataFrame, digits: int | None = None) -> DataFrame:
        """``<by>, beta``: one row for each model."""
        return _table(like, self.by, {m: b if digits is None else np.round(b, digits) for m, b in self.beta.items()})

    def coefficients(self, like: DataFrame, digits: int = 9) -> DataFrame:
        """``<by>, attr, label, coefficient`` of every category, and the intercept (attr and label null)."""
        names = [(None, None), *((a, v) for a, each in self.features.items() for v in each)]
        rows = [(*m, a, v, round(float(b[k]), digits) + 0.0) for m, b in sorted(self.beta.items()) for k, (a, v) in enumerate(names)]
        head = self.frame(like).select(*self.by).schema
        return like.sparkSession.createDataFrame(rows, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in head)}, attr string, label string, coefficient double")

    def score(self, cells: DataFrame) -> DataFrame:
        """``cells`` (with ``<by>`` and the attributes) with ``p``; categories that the fit has not seen add nothing."""
        models = F.broadcast(self.frame(cells))  # a row for each model
        scored = cells.withColumn("__f", self.ids()).join(models, self.by)
        return scored.withColumn("p", F.round(_probability(_linear()), 12)).drop("__f", "beta")

    def digest(self, digits: int = 12) -> dict[Hashable, str]:
        """SHA-256 of each model's rounded coefficients; two fits of the same rows have the same."""
        return {m: hashlib.sha256(np.round(b, digits).tobytes()).hexdigest() for m, b in self.beta.items()}


def _table(like: DataFrame, by: list[str], beta: dict) -> DataFrame:
    columns = {b: pa.array([m[k] for m in beta]) for k, b in enumerate(by)}
    return like.sparkSession.createDataFrame(pa.table({**columns, "beta": pa.array([b.tolist() for b in beta.values()], pa.list_(pa.float64()))}))


def _ids(features: dict[str, dict[str, int]]) -> Column:
    """The coefficients' places of a row: 0 for the intercept, then one for each attribute; the last place (always 0.0) for what is unknown."""
    unknown = 1 + sum(map(len, features.values()))
    places = [F.lit(0)]
    for attr, each in features.items():
        known = F.create_map(*[F.lit(x) for item in each.items() for x in item]) if each else F.create_map().cast("map<string,int>")
        places.append(F.coalesce(F.try_element_at(known, F.col(attr).cast("string")), F.lit(unknown)))
    return F.array(*places)


def _linear() -> Column:
    return F.aggregate("__f", F.lit(0.0), lambda total, k: total + F.get("beta", k))


def _probability(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def categories(cells: DataFrame, attrs: list[str], most: int = CATEGORIES) -> dict[str, dict[str, int]]:
    """Attribute -> category -> place of its coefficient, in the attributes' order and then by name."""
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("label")) for a in attrs])).alias("c")
    rows = cells.select(pairs).select("c.*").filter("label is not null").distinct().limit(most + 1).collect()
    require(len(rows) <= most, "FIT_CATEGORIES", f"more than {most} categories")
    out: dict[str, dict[str, int]] = {a: {} for a in attrs}
    place = 0
    for a in attrs:
        for label in sorted(r["label"] for r in rows if r["attr"] == a):
            place += 1
            out[a][label] = place
    return out


def _sums(cells: DataFrame, by: list[str], beta: dict, width: int) -> dict:
    """For each model loss, gradient and curvature of the unpenalised loss at its coefficients."""
    rows = cells.join(F.broadcast(_table(cells, by, beta)), by).withColumn("z", _linear())  # a row for each model
    rows = rows.withColumn("q", _probability(F.col("z")))
    softplus = F.greatest(F.col("z"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("z")))
    slope, bend = F.col("n") * F.col("q") - F.col("pos"), F.col("n") * F.col("q") * (F.lit(1.0) - F.col("q"))

    def term(i: Column, j: Column, v: Column) -> Column:
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), v.cast(_SUM).alias("v"))

    n_places = F.size("__f")
    first = F.array(term(F.lit(-1), F.lit(-1), F.col("n") * softplus - F.col("pos") * F.col("z")))
    slopes = F.transform("__f", lambda k: term(k, F.lit(-1), slope))
    # places rise from attribute to attribute, so each pair comes in one order
    bends = F.flatten(F.transform("__f", lambda a, at: F.transform(F.slice("__f", at + 1, n_places), lambda b: term(a, b, bend))))
    summed = rows.select(*by, F.explode(F.concat(first, slopes, bends)).alias("t")).groupBy(*by, "t.i", "t.j").agg(F.sum("t.v").cast("double").alias("v")).toPandas()
    out = {}
    for m in beta:
        out[m] = [0.0, np.zeros(width), np.zeros((width, width))]
    keys = list(map(tuple, summed[by].itertuples(index=False, name=None)))
    for m, i, j, v in zip(keys, summed["i"].tolist(), summed["j"].tolist(), summed["v"].tolist(), strict=True):
        if i < 0:
            out[m][0] = v
        elif j < 0:
            if i < width:
                out[m][1][i] = v
        elif i < width and j < width:
            out[m][2][i, j] = out[m][2][j, i] = v
    return out


def fit(cells: DataFrame, by: list[str], attrs: list[str], c: float | Callable[[tuple], float] = 1.0, penalised_intercept: bool = True, evaluations: int = 30, tolerance: float = 1e-9) -> Fits:
    """Logistic regression on one-hot categories for every model, with loss ``c`` times the weighted log loss plus half the squared coefficients.

    ``cells`` has ``<by>, <attrs>, n, pos``: how many rows a category combination stands for, and how many of them are positive;
    ``c`` may depend on the model's key. The intercept is penalised like the others unless ``penalised_intercept`` is false. A model without any
    row has no fit. All models take Newton steps side by side, each halved while it does not lower the loss, until it is below ``tolerance``.
    """
    base = shared(cells.select(*by, *[F.col(a).cast("string").alias(a) for a in attrs], F.col("n").cast("double").alias("n"), F.col("pos").cast("double").alias("pos")))
    features = categories(base, attrs)
    width = 1 + sum(map(len, features.values()))
    coded = base.select(*by, "n", "pos", _ids(features).alias("__f"))
    models = [tuple(r) for r in base.select(*by).distinct().collect()]  # a row for each model
    cost = c if callable(c) else lambda _: c
    ridge = np.r_[1.0 if penalised_intercept else 0.0, np.ones(width - 1)]
    zero = np.zeros(width + 1)
    result = Fits(by, features, {m: zero.copy() for m in sorted(models)}, dict.fromkeys(models, False), dict.fromkeys(models, 0))
    trial = dict(result.beta)
    step: dict[Hashable, np.ndarray] = {}
    for _ in range(evaluations):
        if not trial:
            break
        sums = _sums(coded, by, trial, width)
        following = {}
        for m, beta in trial.items():
            loss, slope, bend = sums[m]
            result.evaluations[m] += 1
            total = cost(m) * loss + 0.5 * float(ridge @ beta[:-1] ** 2)
            if m in step and total > result.loss[m] + 1e-12 * abs(result.loss[m]):
                step[m] = step[m] / 2
                if np.abs(step[m]).max() < tolerance:
                    result.converged[m] = True
                    continue
            else:
                result.beta[m], result.loss[m] = beta, total
                curve = cost(m) * bend + np.diag(ridge)
                if not penalised_intercept:
                    curve[0, 0] += 1e-12  # keeps a model without rows of both classes solvable
                step[m] = np.linalg.solve(curve, cost(m) * slope + ridge * beta[:-1])
                if np.abs(step[m]).max() < tolerance:
                    result.converged[m] = True
                    continue
            following[m] = np.r_[result.beta[m][:-1] - step[m], 0.0]
        trial = following
    return result


def selected(train: DataFrame, attrs: list[str], grid: tuple[float, ...], folds: int, penalised_intercept: bool = True) -> tuple[Fits, DataFrame]:
    """The fits of every value of ``grid`` on each fold's complement, and the scored rows of the folds: ``c, k, y, w, p``.

    ``train`` has ``fold, y, w, <attrs>``.
    """
    cells = shared(train.groupBy("fold", *attrs).agg(F.sum("w").alias("n"), F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0)).alias("pos")))
    tasks = F.explode(F.array(*[F.struct(F.lit(float(c)).alias("c"), F.lit(k).alias("k")) for c in grid for k in range(folds)])).alias("task")
    each = cells.select("*", tasks).select("task.c", "task.k", "fold", *attrs, "n", "pos")
    fitted = fit(each.filter("fold <> k").groupBy("c", "k", *attrs).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")), ["c", "k"], attrs, lambda m: m[0], penalised_intercept)
    held = fitted.score(each.filter("fold = k"))
    sides = F.explode(F.array(F.struct(F.lit(1).alias("y"), F.col("pos").alias("w")), F.struct(F.lit(0).alias("y"), (F.col("n") - F.col("pos")).alias("w")))).alias("s")
    return fitted, held.select("c", "k", "p", sides).select("c", "k", "s.y", "s.w", "p").filter("w > 0")

