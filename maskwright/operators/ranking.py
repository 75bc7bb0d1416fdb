"""Ranking metrics from prefix sums over ranges of the scores, for any number of models and distinct scores.

Distinct scores are parted at boundaries that are the same for every model. Running sums are taken inside a range, and the ranges'
totals, a bounded list for each model, are added on top: no task sees all scores of a model.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..sources.writers import shared

#: Ranges of the scores; a model's list of totals has so many entries.
RANGES = 128


def boundaries(groups: DataFrame, score: str = "p", n: int = RANGES) -> list[float]:
    """Scores that part the rows of ``groups`` in about ``n`` ranges. Taken once, so that whatever is done again uses the same."""
    if n < 2:
        return []
    found = groups.agg(F.percentile_approx(score, [k / n for k in range(1, n)], 10_000).alias("b")).first()["b"]
    return sorted(set(found or []))


def prefix_sums(groups: DataFrame, by: list[str], values: list[str], score: str = "p", n: int = RANGES) -> DataFrame:
    """``groups`` with ``below_<value>`` (the sum over all rows of the same ``by`` with a smaller score) and ``all_<value>``.

    ``groups`` has one row for each ``by`` and score. It is read three times, so it should be written or cheap.
    """
    bounds = boundaries(groups, score, n)
    place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(score))) if bounds else F.lit(0)
    parted = groups.withColumn("__range", place)
    totals = parted.groupBy(*by, "__range").agg(*[F.sum(v).alias(f"__t_{v}") for v in values])
    # at most n entries for each model
    listed = totals.groupBy(*by).agg(F.collect_list(F.struct("__range", *[f"__t_{v}" for v in values])).alias("__all"))

    def total(of: Column, v: str) -> Column:
        return F.aggregate(of, F.lit(0).cast(groups.schema[v].dataType), lambda a, x: (a + x[f"__t_{v}"]).cast(groups.schema[v].dataType))

    offsets = listed.select(*by, "__all", F.explode("__all.__range").alias("__range"))
    before = F.filter("__all", lambda x: x["__range"] < F.col("__range"))
    offsets = offsets.select(*by, "__range", *[total(before, v).alias(f"__b_{v}") for v in values], *[total(F.col("__all"), v).alias(f"all_{v}") for v in values])
    run = Window.partitionBy(*by, "__range").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    inside = parted.withColumns({f"__i_{v}": F.coalesce(F.sum(v).over(run), F.lit(0)) for v in values})
    keys = [*by, "__range"]
    met = inside.join(offsets.withColumnsRenamed({k: f"__k_{k}" for k in keys}), functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]))
    return met.select(*groups.columns, *[(F.col(f"__i_{v}") + F.col(f"__b_{v}")).alias(f"below_{v}") for v in values], *[f"all_{v}" for v in values])


def _whole(column: Column) -> Column:
    return column.cast("decimal(19,0)")


def metrics(groups: DataFrame, by: list[str], threshold: float = 0.5, n: int = RANGES) -> DataFrame:
    """``<by>, auroc, average_precision, tp, fp, tn, fn, accuracy, balanced_accuracy`` in one pass over ``<by>, p, pos, neg``.

    AUROC by average ranks of complete tie groups, in whole numbers up to the division; null without both classes. Average precision: over
    falling scores the recall that a tie group adds times the precision at its end. The threshold is inclusive.
    """
    each = prefix_sums(shared(groups), by, ["pos", "neg"], n=n)
    tp, everything = F.col("all_pos") - F.col("below_pos"), F.col("all_pos") + F.col("all_neg") - F.col("below_pos") - F.col("below_neg")
    up = F.col("p") >= threshold

    def count(name: str, condition: Column) -> Column:
        return F.sum(F.when(condition, F.col(name)).otherwise(0))

    got = each.groupBy(*by).agg(
        F.sum(_whole(F.col("pos")) * _whole(2 * F.col("below_neg") + F.col("neg"))).alias("twice"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"),
        F.sum(F.col("pos").cast("double") * ratio(tp, everything)).alias("precision"),
        count("pos", up).alias("tp"), count("neg", up).alias("fp"), count("neg", ~up).alias("tn"), count("pos", ~up).alias("fn"),
    )
    balanced = (ratio(F.col("tp"), F.col("tp") + F.col("fn")) + ratio(F.col("tn"), F.col("tn") + F.col("fp"))) / 2.0
    return got.select(
        *by, ratio(F.col("twice"), 2 * _whole(F.col("pos")) * _whole(F.col("neg"))).alias("auroc"), F.round(ratio(F.col("precision"), F.col("pos")), 9).alias("average_precision"),
        "tp", "fp", "tn", "fn", ratio(F.col("tp") + F.col("tn"), F.col("pos") + F.col("neg")).alias("accuracy"), F.round(balanced, 9).alias("balanced_accuracy"),
    )
