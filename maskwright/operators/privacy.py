"""Releases, equivalence classes and privacy measures, for many configurations in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from .hierarchy import at_level, with_paths
from .schema import QuasiIdentifierSpec


#: A configuration's columns beside its levels.
MODEL = ("config_id", "k", "lim", "l", "t")
#: Declared sensitive domains of at most so many values are counted in columns.
VALUES = 64


def generalized(rows: DataFrame, hier: DataFrame, configs: DataFrame, spec: QuasiIdentifierSpec) -> DataFrame:
    """Every row once for each configuration, recoded: ``config_id, k, lim, l, t, <raw>, lv_<qi>, g_<qi>``.

    ``w`` says how many table rows a row stands for. Measures work on :func:`signature`, whose length is
    bounded by the domain's value combinations however long the table is.

    The configurations are a dimension of a few rows; they are attached as an array and exploded, so the
    rows are not shuffled.
    """
    listed = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in configs.columns]) for r in sorted(configs.collect(), key=lambda r: r["config_id"])])
    each = with_paths(rows, hier, spec).withColumn("c", F.explode(listed))
    return each.select(*[f"c.{c}" for c in MODEL], *rows.columns, *[F.col(f"c.lv_{q}").alias(f"lv_{q}") for q in spec.names], *[at_level(q, F.col(f"c.lv_{q}")).alias(f"g_{q}") for q in spec.names])


def signature(rows: DataFrame, spec: QuasiIdentifierSpec, *extra: str) -> DataFrame:
    """Distinct combinations of quasi-identifiers, sensitive value and ``extra``, with their number ``w``."""
    return rows.groupBy(*spec.names, spec.sensitive, *extra).agg(F.count(F.lit(1)).alias("w"))


def labels(spec: QuasiIdentifierSpec) -> list[str]:
    return [f"g_{q}" for q in spec.names]


def classes(rows: DataFrame, spec: QuasiIdentifierSpec) -> DataFrame:
    """Equivalence classes: ``config_id, k, lim, l, t, lv_<qi>, <labels>, n, n_pos, n_sens`` (distinct sensitive values), ``fails``.

    A class fails if it breaks its configuration's k-anonymity, distinct l-diversity or equal-distance t-closeness (against
    the whole table, as it was before suppression).
    """
    if spec.values is not None:
        return _classes_of_values(rows, spec)
    positive = F.col(spec.sensitive) == spec.positive
    # the model and levels are the configuration's; a binary sensitive column: two values occur if both counts are positive
    by = [*MODEL, *[f"lv_{q}" for q in spec.names]]
    got = rows.groupBy(*by, *labels(spec)).agg(F.sum("w").alias("n"), F.sum(F.when(positive, F.col("w")).otherwise(0)).alias("n_pos"))
    got = got.withColumn("n_sens", F.when((F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n")), 2).otherwise(1).cast("long"))
    whole = totals(got).withColumnsRenamed({"total": "whole_n", "positive": "whole_pos"})
    got = got.join(F.broadcast(whole), "config_id")  # one row for each configuration
    gap = F.abs(F.col("n_pos") * F.col("whole_n") - F.col("whole_pos") * F.col("n")).cast("double")
    close = (F.col("t") + 1e-9) * F.col("n").cast("double") * F.col("whole_n")
    bad = (F.col("n") < F.col("k")) | F.coalesce(F.col("n_sens") < F.col("l"), F.lit(False)) | F.coalesce(gap > close, F.lit(False))
    return got.withColumn("fails", bad).drop("whole_n", "whole_pos")


def frequencies(rows: DataFrame, by: list[str], spec: QuasiIdentifierSpec, values: tuple[str, ...] | None = None) -> DataFrame:
    """``<by>, n, freq``: classes with the numbers of their sensitive values, ``freq`` an array of ``value, n`` by value without zeros.

    Values of a declared domain are added up side by side in one aggregation with map-side combine; any other column is counted by class
    and value first, so a class's list is as long as it has values.
    """
    if values is not None and len(values) <= VALUES:
        sums = [F.sum(F.when(F.col(spec.sensitive) == v, F.col("w")).otherwise(0)).alias(f"__c{k}") for k, v in enumerate(sorted(values))]
        got = rows.groupBy(*by).agg(F.sum("w").alias("n"), *sums)
        listed = F.array(*[F.struct(F.lit(v).alias("value"), F.col(f"__c{k}").alias("n")) for k, v in enumerate(sorted(values))])
        return got.select(*by, "n", F.filter(listed, lambda x: x["n"] > 0).alias("freq"))
    each = rows.groupBy(*by, F.col(spec.sensitive).alias("value")).agg(F.sum("w").alias("m"))
    return each.groupBy(*by).agg(F.sum("m").alias("n"), F.array_sort(F.collect_list(F.struct("value", F.col("m").alias("n")))).alias("freq"))


def whole_frequencies(found: DataFrame, by: tuple[str, ...] = ("config_id",)) -> DataFrame:
    """``<by>, whole_n, whole``: of all rows of the given classes together, ``whole`` a map from value to number."""
    each = found.select(*by, F.explode("freq").alias("x")).groupBy(*by, "x.value").agg(F.sum("x.n").alias("n"))
    return each.groupBy(*by).agg(F.sum("n").alias("whole_n"), F.map_from_entries(F.collect_list(F.struct("value", "n"))).alias("whole"))


def doubled_distance(freq: Column, n: Column, whole: Column, whole_n: Column) -> Column:
    """Twice n times whole_n times the equal-distance (variational) distance of a class to the whole, a whole number.

    Values that the class lacks add their whole number each; only those that it has are looked at.
    """
    zero, n, whole_n = F.lit(0).cast("decimal(38,0)"), n.cast("decimal(19,0)"), whole_n.cast("decimal(19,0)")

    def add(total: Column, x: Column) -> Column:
        there = F.element_at(whole, x["value"]).cast("decimal(19,0)")
        return (total + F.abs(x["n"].cast("decimal(19,0)") * whole_n - there * n) - there * n).cast("decimal(38,0)")

    return F.aggregate(freq, zero, add) + n * whole_n


def with_distance(found: DataFrame, whole: DataFrame, by: tuple[str, ...] = ("config_id",)) -> DataFrame:
    """Classes with ``distance``, their equal-distance to ``whole`` (:func:`whole_frequencies`)."""
    joined = found.join(F.broadcast(whole), [*by])  # one row for each configuration
    twice = doubled_distance(F.col("freq"), F.col("n"), F.col("whole"), F.col("whole_n"))
    return joined.withColumn("distance", ratio(twice, 2 * F.col("n").cast("decimal(19,0)") * F.col("whole_n").cast("decimal(19,0)"))).drop("whole", "whole_n")


def _classes_of_values(rows: DataFrame, spec: QuasiIdentifierSpec) -> DataFrame:
    """:func:`classes` for a sensitive column of any number of values: ``freq`` and ``distance`` stand in the place of ``n_pos``."""
    by = [*MODEL, *[f"lv_{q}" for q in spec.names], *labels(spec)]
    got = frequencies(rows, by, spec, spec.values)
    got = with_distance(got, whole_frequencies(got)).withColumn("n_sens", F.size("freq").cast("long"))
    bad = (F.col("n") < F.col("k")) | F.coalesce(F.col("n_sens") < F.col("l"), F.lit(False)) | F.coalesce(F.col("distance") > F.col("t") + 1e-9, F.lit(False))
    return got.withColumn("fails", bad)


def with_outliers(rows: DataFrame, found: DataFrame, spec: QuasiIdentifierSpec) -> DataFrame:
    """``rows`` of :func:`generalized` with ``class_n`` and ``is_outlier`` (their class fails).

    ``found`` are the classes of the whole table.
    """
    sizes = found.select("config_id", *labels(spec), F.col("n").alias("class_n"), F.col("fails").alias("is_outlier"))
    return rows.join(sizes, ["config_id", *labels(spec)])


def retained(found: DataFrame) -> DataFrame:
    """The classes that are published."""
    return found.filter(~F.col("fails"))


def summary(found: DataFrame) -> DataFrame:
    """``config_id, n_classes, rows, k_hat, max_class, l_hat, singles`` from classes."""
    return found.groupBy("config_id").agg(
        F.count(F.lit(1)).alias("n_classes"), F.sum("n").alias("rows"), F.min("n").alias("k_hat"), F.max("n").alias("max_class"),
        F.min("n_sens").alias("l_hat"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("singles"),
    )


def t_hat(found: DataFrame, totals: DataFrame) -> DataFrame:
    """``config_id, t_hat``: largest distance of a class's positive share to that of ``totals``.

    ``totals`` has ``config_id, total, positive``. Numerators are whole; the division comes last.
    """
    joined = found.join(F.broadcast(totals), "config_id")  # one row for each configuration
    gap = ratio(F.abs(F.col("n_pos") * F.col("total") - F.col("positive") * F.col("n")), F.col("n") * F.col("total"))
    return joined.groupBy("config_id").agg(F.max(gap).alias("t_hat"))


def totals(found: DataFrame) -> DataFrame:
    """``config_id, total, positive`` of all rows of the given classes."""
    return found.groupBy("config_id").agg(F.sum("n").alias("total"), F.sum("n_pos").alias("positive"))


def histogram(found: DataFrame, by: tuple[str, ...] = ("config_id",)) -> DataFrame:
    return found.groupBy(*by, "n").agg(F.count(F.lit(1)).alias("frequency"))


def size_quantiles(found: DataFrame) -> DataFrame:
    """Type-7 quantiles of class sizes, one observation per class."""
    both = F.percentile("n", F.array(F.lit(0.5), F.lit(0.95)))
    return found.groupBy("config_id").agg(both[0].alias("median"), both[1].alias("p95"))


def nearest_rank(found: DataFrame, percent: int) -> DataFrame:
    """Nearest-rank quantile from the size histogram: the least size that reaches ceil(percent/100 * classes)."""
    hist = histogram(found)
    of = hist.groupBy("config_id").agg(F.sum("frequency").alias("classes"))
    from pyspark.sql import Window

    run = F.sum("frequency").over(Window.partitionBy("config_id").orderBy("n"))
    reached = hist.withColumn("run", run).join(F.broadcast(of), "config_id").filter(F.col("run") * 100 >= F.col("classes") * percent)
    return reached.groupBy("config_id").agg(F.min("n").alias(f"p{percent}"))


def gate_of_values(found: DataFrame) -> DataFrame:
    """:func:`gate` for classes of a sensitive column of any number of values, against each configuration's own k, l and t."""
    kept = retained(found)
    base = found.groupBy("config_id", "k", "l", "t", "lim").agg(F.sum("n").alias("rows_in"), F.sum(F.when(F.col("fails"), F.col("n")).otherwise(0)).alias("suppressed"))
    whole = whole_frequencies(found)
    seen = with_distance(kept.drop("distance"), whole).groupBy("config_id").agg(F.min("n").alias("k_hat"), F.min("n_sens").alias("l_hat"), F.max("distance").alias("t_hat"))
    budget = F.floor(F.col("rows_in") * F.round(F.col("lim") * 1000000).cast("long") / 1000000).cast("long")
    return base.join(seen, "config_id", "left").select(
        "config_id", "rows_in", "suppressed", (F.col("suppressed") <= budget).alias("within_budget"), "k_hat", "l_hat", F.round("t_hat", 12).alias("t_hat"),
        (F.coalesce("k_hat", F.lit(0)) >= F.col("k")).alias("k_ok"), (F.coalesce("l_hat", F.lit(0)) >= F.coalesce("l", F.lit(1))).alias("l_ok"),
        (F.coalesce("t_hat", F.lit(1.0)) <= F.coalesce("t", F.lit(1.0)) + 1e-9).alias("t_ok"),
    )


def gate(found: DataFrame, l: int, t: float) -> DataFrame:  # noqa: E741
    """One row per configuration: counts, budget, k, l and t of the release, and which hold.

    t is measured against the full input, as it was before suppression; its tolerance is 1e-9.
    """
    kept = retained(found)
    base = found.groupBy("config_id", "k", "lim").agg(F.sum("n").alias("rows_in"), F.sum(F.when(F.col("fails"), F.col("n")).otherwise(0)).alias("suppressed"))
    budget = F.floor(F.col("rows_in") * F.round(F.col("lim") * 1000000).cast("long") / 1000000).cast("long")
    s = summary(kept).select("config_id", "k_hat", "l_hat")
    th = t_hat(kept, totals(found))
    out = base.join(s, "config_id", "left").join(th, "config_id", "left").withColumn("budget", budget)
    return out.select(
        "config_id", "rows_in", "suppressed", "budget", (F.col("suppressed") <= F.col("budget")).alias("within_budget"),
        "k_hat", (F.coalesce("k_hat", F.lit(0)) >= F.col("k")).alias("k_ok"), "l_hat", (F.coalesce("l_hat", F.lit(0)) >= l).alias("l_ok"),
        "t_hat", (F.coalesce("t_hat", F.lit(1.0)) <= t + 1e-9).alias("t_ok"),
    )
