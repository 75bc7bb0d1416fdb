"""Cluster and stratified bootstrap as joins of sparse resampling plans with pre-aggregated data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prng import uniform
from ..functions.scalars import ratio


def clusters(targets: DataFrame, keys: list[str]) -> DataFrame:
    """``<keys>, cluster_id, n``: clusters of equal raw values, numbered by first appearance among the targets.

    The targets are a sample of fixed size, so the ranking is small whatever the table.
    """
    got = targets.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("target_pos").alias("first_pos"))
    return got.withColumn("cluster_id", F.dense_rank().over(Window.orderBy("first_pos")).cast("long")).drop("first_pos")


def plan(units: int, replicates: int, stream: str = "11005") -> str:
    """SQL of the sparse plan ``replicate, unit, mult``: ``units`` draws with replacement in each replicate."""
    u = f"CAST(conv(substr(md5(concat('{stream}|', CAST(r.id AS STRING), '|', CAST(d.id AS STRING))), 1, 8), 16, 10) AS DOUBLE) / 4294967296.0D"
    return f"SELECT r.id AS replicate, CAST(floor({u} * {units}) AS BIGINT) + 1 AS unit, count(*) AS mult FROM range(1, {replicates + 1}) r JOIN range(1, {units + 1}) d GROUP BY 1, 2"


def resampling_plan(like: DataFrame, units: int, replicates: int, stream: str = "11005") -> DataFrame:
    """``replicate, unit, mult`` with zeros left out; multiplicities of a replicate sum to ``units``."""
    spark = like.sparkSession
    draws = spark.range(1, replicates + 1).withColumnRenamed("id", "replicate").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(max(units, 1)))))
    drawn = draws.withColumn("unit", F.floor(uniform(stream, F.col("replicate"), F.col("draw")) * units).cast("long") + 1)
    return drawn.groupBy("replicate", "unit").agg(F.count(F.lit(1)).alias("mult"))


def cluster_success(means: DataFrame, targets: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """``scenario, config_id, cluster_id, n, s``: aggregated by cluster before any replicate touches it."""
    which = targets.join(F.broadcast(found.select(*keys, "cluster_id")), keys).select("target_pos", "cluster_id")
    return means.join(F.broadcast(which), "target_pos").groupBy("scenario", "config_id", "cluster_id").agg(F.count(F.lit(1)).alias("n"), F.sum("mean_success").alias("s"))


def bootstrap_risk(per_cluster: DataFrame, resampled: DataFrame, cells: list[tuple[str, str]]) -> DataFrame:
    """``scenario, config_id, replicate, r_all``: record-weighted risk of each replicate, for each of ``cells`` (scenario, configuration).

    Clusters become one row with two columns for each cell before the plan is joined, so the join has a row for each
    replicate and drawn cluster, however many cells there are. Cells without any target have no row.
    """
    one = [(F.col("scenario") == s) & (F.col("config_id") == c) for s, c in cells]
    wide = per_cluster.groupBy("cluster_id").agg(*[F.sum(F.when(x, F.col(v))).alias(f"{v}{k}") for k, x in enumerate(one) for v in "sn"])
    joined = resampled.withColumnRenamed("unit", "cluster_id").join(wide, "cluster_id")
    got = joined.groupBy("replicate").agg(*[F.sum(F.col("mult") * F.col(f"{v}{k}")).alias(f"{v}{k}") for k in range(len(cells)) for v in "sn"])
    each = F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit(c).alias("config_id"), F.col(f"s{k}").cast("double").alias("s"), F.col(f"n{k}").cast("long").alias("n")) for k, (s, c) in enumerate(cells)])
    rows = got.select("replicate", F.explode(each).alias("x")).select("x.*", "replicate").filter("n is not null")
    return rows.select("scenario", "config_id", "replicate", F.round(ratio(F.col("s"), F.col("n")), 9).alias("r_all"))


def against(values: DataFrame, reference: str, value: str, keys: list[str]) -> DataFrame:
    """Paired differences to the reference configuration, replicate by replicate."""
    ref = values.filter(F.col("config_id") == reference).select(*keys, F.col(value).alias("ref"))
    return values.filter(F.col("config_id") != reference).join(ref, keys).select(*keys, "config_id", F.round(F.col(value) - F.col("ref"), 9).alias("difference"))


def paired(values: DataFrame, pairs: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Differences of predeclared pairs ``config_id, other``."""
    a = values.join(F.broadcast(pairs), "config_id")
    b = values.select(*keys, F.col("config_id").alias("other"), F.col(value).alias("ref"))
    return a.join(b, [*keys, "other"]).select(*keys, "config_id", "other", F.round(F.col(value) - F.col("ref"), 9).alias("difference"))


def intervals(values: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Type-7 percentile intervals at 1/40 and 39/40."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return values.groupBy(*by).agg(F.round(q[0], 9).alias("low"), F.round(q[1], 9).alias("high"))
