"""What suppression and generalisation change: composition, profiles, distances, loss."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from .schema import QuasiIdentifierSpec


def suppression_profile(released: DataFrame, spec: QuasiIdentifierSpec) -> DataFrame:
    positive = F.when(F.col(spec.sensitive) == spec.positive, F.col("w")).otherwise(0)
    kept = (~F.col("is_outlier")).cast("long")
    c = released.groupBy("config_id").agg(F.sum("w").alias("n"), F.sum(kept * F.col("w")).alias("n_ret"), F.sum(positive).alias("pos"), F.sum(positive * kept).alias("pos_ret"))
    p0, pr = ratio(F.col("pos"), F.col("n")), ratio(F.col("pos_ret"), F.col("n_ret"))
    ps = ratio(F.col("pos") - F.col("pos_ret"), F.col("n") - F.col("n_ret"))
    return c.select(
        "config_id", "n", "n_ret", ratio(F.col("n") - F.col("n_ret"), F.col("n")).alias("suppression_rate"), p0.alias("p0"), pr.alias("pr"), ps.alias("ps"), (pr - p0).alias("pr_minus_p0"),
        F.when(F.col("n") == F.col("n_ret"), "NA_NO_SUPPRESSED_ROWS").otherwise("OK").alias("suppressed_prevalence_status"),
    )


def class_counts(released: DataFrame, spec: QuasiIdentifierSpec) -> DataFrame:
    """Sensitive counts of source, retained and suppressed rows, one column each."""
    kept = (~F.col("is_outlier")).cast("long")
    return released.groupBy("config_id", spec.sensitive).agg(F.sum("w").alias("source"), F.sum(kept * F.col("w")).alias("retained"), F.sum((1 - kept) * F.col("w")).alias("suppressed"))


def _long(rows: DataFrame, columns: dict[str, str], keep: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(name).alias("attr"), F.col(c).cast("string").alias("value")) for name, c in columns.items()])
    return rows.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.attr", "p.value")


def marginal_profiles(released: DataFrame, spec: QuasiIdentifierSpec) -> DataFrame:
    """Counts and shares of each raw value among source and retained rows."""
    rows = _long(released, {q: q for q in spec.names}, ["config_id", "is_outlier", "w"])
    kept = (~F.col("is_outlier")).cast("long") * F.col("w")
    got = rows.groupBy("config_id", "attr", "value").agg(F.sum("w").alias("source"), F.sum(kept).alias("retained"))
    size = released.groupBy("config_id").agg(F.sum("w").alias("n"), F.sum(kept).alias("n_ret"))
    p0, pr = ratio(F.col("source"), F.col("n")), ratio(F.col("retained"), F.col("n_ret"))
    return got.join(F.broadcast(size), "config_id").select("config_id", "attr", "value", "source", "retained", (F.col("source") - F.col("retained")).alias("suppressed"), (pr - p0).alias("share_difference"))


def tvd(released: DataFrame, spec: QuasiIdentifierSpec, joint: bool = False) -> DataFrame:
    """``config_id, attr, tvd``: half the summed absolute differences of label shares, all rows against retained.

    With ``joint``, of pairs (label, sensitive value).
    """
    keep = ["config_id", "is_outlier", "w", spec.sensitive]
    rows = _long(released, {q: f"g_{q}" for q in spec.names}, keep)
    kept = (~F.col("is_outlier")).cast("long") * F.col("w")
    keys = ["config_id", "attr", "value", *([spec.sensitive] if joint else [])]
    got = rows.groupBy(*keys).agg(F.sum("w").alias("a"), F.sum(kept).alias("b"))
    size = released.groupBy("config_id").agg(F.sum("w").alias("n"), F.sum(kept).alias("n_ret"))
    # whole numerators: |a * n_ret - b * n| over 2 * n * n_ret
    gap = F.sum(F.abs(F.col("a") * F.col("n_ret") - F.col("b") * F.col("n")).cast("decimal(38,0)"))
    joined = got.join(F.broadcast(size), "config_id")
    return joined.groupBy("config_id", "attr", "n", "n_ret").agg(gap.alias("gap")).select("config_id", "attr", F.try_divide(F.col("gap").cast("double"), 2.0 * F.col("n").cast("double") * F.col("n_ret").cast("double")).alias("tvd"))


def tvd_summary(distances: DataFrame) -> DataFrame:
    return distances.groupBy("config_id").agg(F.round(F.avg("tvd"), 9).alias("tvd_mean"), F.max("tvd").alias("tvd_max"))


def info_loss(found: DataFrame, cells: DataFrame, spec: QuasiIdentifierSpec) -> DataFrame:
    """``config_id, loss``: mean over quasi-identifiers of the mean cell loss; a suppressed row costs 1.

    ``found`` are the classes of the whole table, ``cells`` the (bounded) cell losses.
    """
    each = F.array(*[F.struct(F.lit(q).alias("attr"), F.col(f"lv_{q}").alias("level"), F.col(f"g_{q}").alias("label")) for q in spec.names])
    long = found.select("config_id", "n", F.col("fails").alias("bad"), F.explode(each).alias("c")).select("config_id", "n", "bad", "c.*")
    per = long.join(cells, ["attr", "level", "label"]).groupBy("config_id", "attr", "den").agg(F.sum(F.when(F.col("bad"), F.col("n") * F.col("den")).otherwise(F.col("n") * F.col("num"))).alias("s"), F.sum("n").alias("n"))
    loss = per.select("config_id", (F.col("s").cast("double") / (F.col("n") * F.col("den")).cast("double")).alias("loss"))
    return loss.groupBy("config_id").agg(F.round(F.avg("loss"), 9).alias("loss"))


def intensity(configs: DataFrame, spec: QuasiIdentifierSpec) -> DataFrame:
    """Mean of level / height over the quasi-identifiers."""
    total = sum((F.col(f"lv_{q}") / F.lit(float(spec.heights[q])) for q in spec.names), F.lit(0.0))
    return configs.select("config_id", F.round(total / float(len(spec.names)), 9).alias("intensity"))


def rare_value_fate(rows: DataFrame, released: DataFrame, attr: str, most: int) -> DataFrame:
    """What becomes of values that occur at most ``most`` times: suppressed, generalised or exposed rows."""
    rare = rows.groupBy(attr).agg(F.sum("w").alias("occurs")).filter(F.col("occurs") <= most)
    fate = F.when(F.col("is_outlier"), "suppressed").when(F.col(f"lv_{attr}") >= 1, "generalised").otherwise("exposed")
    return released.join(rare, attr).select("config_id", "w", fate.alias("fate")).groupBy("config_id", "fate").agg(F.sum("w").alias("rows"))


def pareto_front(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Points that no other dominates (both minimised, weakly). A dimension of configurations, not of rows."""
    a, b = points.alias("a"), points.alias("b")
    better = (F.col(f"b.{x}") <= F.col(f"a.{x}")) & (F.col(f"b.{y}") <= F.col(f"a.{y}")) & ((F.col(f"b.{x}") < F.col(f"a.{x}")) | (F.col(f"b.{y}") < F.col(f"a.{y}")))
    return a.join(F.broadcast(b), better, "left_anti").select(key, x, y)
