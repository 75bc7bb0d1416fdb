"""Checks as tables: ``code, violations``, and comparisons of rows by identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cell_is_clean
from .schema import ContractError


def complete_cases(rows: DataFrame, columns: list[str], missing: str = "?") -> DataFrame:
    """Rows without the missing mark in any of the columns; to be applied before any projection."""
    return rows.filter(~F.exists(F.array(*[F.col(c).cast("string") for c in columns]), lambda x: x == missing))


def missing_profile(rows: DataFrame, columns: list[str], missing: str = "?") -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    each = rows.select(F.explode(pairs).alias("p"))
    return each.groupBy("p.field").agg(F.count(F.lit(1)).alias("rows"), F.sum((F.col("p.value") == missing).cast("long")).alias("missing"))


def strip_period(label):
    """Exactly one full stop at the end goes."""
    return F.regexp_replace(label, r"\.$", "")


def cell_violations(rows: DataFrame, columns: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns])
    each = rows.select(F.explode(pairs).alias("p"))
    return each.groupBy("p.field").agg(F.sum((~cell_is_clean(F.col("p.value"))).cast("long")).alias("violations"))


def rid_order(rows: DataFrame, rid: str, place: str, part: str) -> DataFrame:
    """Row ids whose number does not exceed that of the row before, within each part (file)."""
    number = F.regexp_extract(F.col(rid), r":([0-9]+)$", 1).cast("long")
    before = F.lag(number).over(Window.partitionBy(part).orderBy(place))
    marked = rows.select(part, rid, (number <= before).alias("falls"), F.col(rid).rlike(r"^[a-z]+:[1-9][0-9]*$").alias("formed"))
    return marked.groupBy(part).agg(F.sum(F.coalesce(F.col("falls"), F.lit(False)).cast("long")).alias("not_increasing"), F.sum((~F.col("formed")).cast("long")).alias("malformed"))


def alignment(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Counts of ids on one side only, of repeated ids, and of differing values."""
    x = a.groupBy(key).agg(F.count(F.lit(1)).alias("na"), F.min(value).alias("va"))
    y = b.groupBy(key).agg(F.count(F.lit(1)).alias("nb"), F.min(value).alias("vb"))
    both = x.join(y, key, "full_outer")

    def n(condition):
        return F.coalesce(F.sum(condition.cast("long")), F.lit(0))

    return both.agg(
        n(F.col("nb").isNull()).alias("only_a"), n(F.col("na").isNull()).alias("only_b"), n((F.col("na") > 1) | (F.col("nb") > 1)).alias("repeated"),
        n(F.col("na").isNotNull() & F.col("nb").isNotNull() & ~F.col("va").eqNullSafe(F.col("vb"))).alias("differing"),
    )


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """``only_a, only_b``: rows of either side without a partner, repeats counted; order does not matter."""
    x, y = (f.exceptAll(g).agg(F.count(F.lit(1)).alias("n")) for f, g in ((a, b), (b, a)))
    return x.select(F.col("n").alias("only_a")).join(F.broadcast(y.select(F.col("n").alias("only_b"))))


def bijection(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Whether two sides hold the same ids once each."""
    return alignment(a.withColumn("__v", F.lit(0)), b.withColumn("__v", F.lit(0)), key, "__v").drop("differing")


def report(checks: list[tuple[str, DataFrame]]) -> DataFrame:
    """``code, violations`` from frames of one count each."""
    out = None
    for code, frame in checks:
        one = frame.select(F.lit(code).alias("code"), F.col(frame.columns[0]).cast("long").alias("violations"))
        out = one if out is None else out.unionByName(one)
    return out


def enforce(found: DataFrame) -> None:
    """Raise the first violated code of a report (a row for each check)."""
    bad = found.filter("violations > 0").orderBy("code").first()
    if bad is not None:
        raise ContractError(bad["code"], f"{bad['violations']} rows break it")


def binding(released: DataFrame, configs: DataFrame, source: DataFrame, row_id: str, target: str) -> DataFrame:
    """One row for each configuration that is declared or there: whether each release holds the source's rows, once each, with
    their targets, and the levels that its configuration declares.

    ``unbound`` counts rows that the source lacks, ``lacking`` the source's rows that the release lacks.
    """
    levels = [c for c in configs.columns if c.startswith("lv_") and c in released.columns]
    mine = released.select("config_id", F.col(row_id).alias("__id"), F.col(target).alias("__target"), *levels)
    truth = source.select(F.col(row_id).alias("__id"), F.col(target).alias("__truth"))
    declared = configs.select("config_id", *[F.col(c).alias(f"__{c}") for c in levels], F.lit(True).alias("declared"))  # a dimension

    def n(condition):
        return F.coalesce(F.sum(condition.cast("long")), F.lit(0))

    rows = mine.join(truth, "__id", "left").join(F.broadcast(declared), "config_id", "left")
    differs = F.lit(False)
    for c in levels:
        differs = differs | (F.col(c) != F.col(f"__{c}"))
    found = rows.groupBy("config_id").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("__id").alias("ids"), F.count(F.when(F.col("__truth").isNotNull(), 1)).alias("bound"),
        n(~F.col("__truth").eqNullSafe(F.col("__target")) & F.col("__truth").isNotNull()).alias("target_mismatches"), n(F.col("declared") & differs).alias("vector_mismatches"),
    )
    total = source.agg(F.countDistinct(row_id).alias("total"))
    both = found.withColumn("present", F.lit(True)).join(declared.select("config_id", "declared"), "config_id", "full_outer").join(F.broadcast(total))
    zero = {c: 0 for c in ("rows", "ids", "bound", "target_mismatches", "vector_mismatches")}
    both = both.fillna(zero).fillna({"present": False, "declared": False})
    return both.select(
        "config_id", "declared", "present", (F.col("rows") - F.col("bound")).alias("unbound"), (F.col("rows") - F.col("ids")).alias("repeated"),
        F.greatest(F.col("total") - F.col("ids"), F.lit(0)).alias("lacking"), "target_mismatches", "vector_mismatches",
    )


def admission(predictions: DataFrame, holdout: DataFrame, by: str, key: str) -> DataFrame:
    """One row for each model of ``predictions`` (``<by>, <key>, y, p``): ids it lacks, has too many or twice, labels that differ from the
    holdout's (``<key>, y``), and probabilities that are null or outside [0, 1]. Only a model with zeros everywhere may be evaluated."""
    truth = holdout.select(key, F.col("y").alias("__y"))
    models = predictions.select(by).distinct()
    each = predictions.groupBy(by, key).agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("y"), F.sum((~F.coalesce(F.col("p").between(0, 1), F.lit(False))).cast("long")).alias("bad"))
    # a row for each model and holdout row; the models are a dimension
    met = truth.join(F.broadcast(models)).join(each, [by, key], "full_outer")

    def n(condition):
        return F.coalesce(F.sum(condition.cast("long")), F.lit(0))

    return met.groupBy(by).agg(
        n(F.col("n").isNull()).alias("lacking"), n(F.col("__y").isNull()).alias("unknown"), n(F.col("n") > 1).alias("repeated"),
        n(F.col("y") != F.col("__y")).alias("relabelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("out_of_range"),
    )
