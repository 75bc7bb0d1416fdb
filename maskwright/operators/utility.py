"""Predictive utility: scores, ranking metrics, folds, encoders, bootstrap of differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prng import keyed_hash, uniform
from ..functions.scalars import ratio
from . import fits, ranking, resampling


def rate_scores(train: DataFrame, holdout: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """``<by>, row_id, y, w, p``: the positive rate of a row's cell in training, or the prior where it has none."""
    cells = train.groupBy(*by, *keys).agg(F.sum(F.col("y") * F.col("w")).alias("h"), F.sum("w").alias("n"))
    prior = cells.groupBy(*by).agg(ratio(F.sum("h"), F.sum("n")).alias("prior"))
    joined = holdout.join(cells, [*by, *keys], "left").join(F.broadcast(prior), by)
    carried = [c for c in ("row_id", "key", "y", "w") if c in holdout.columns]
    return joined.select(*by, *carried, F.coalesce(ratio(F.col("h"), F.col("n")), F.col("prior")).alias("p"))


def tie_groups(scores: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """``<by>, p, pos, neg``: counts for each distinct score; ranking works on these only."""
    w = F.col(weight) if weight else F.col("w") if "w" in scores.columns else F.lit(1).cast("long")
    return scores.groupBy(*by, "p").agg(F.sum(F.when(F.col("y") == 1, w).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") == 0, w).otherwise(0)).alias("neg"))


def auroc(groups: DataFrame, by: list[str]) -> DataFrame:
    """Area under the ROC curve by average ranks of complete tie groups."""
    return ranking.metrics(groups, by).select(*by, "auroc")


def average_precision(groups: DataFrame, by: list[str]) -> DataFrame:
    """Sum over descending tie groups of the recall they add times the precision at their end."""
    return ranking.metrics(groups, by).select(*by, "average_precision")


def confusion(scores: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """Counts at an inclusive threshold, accuracy and balanced accuracy."""
    up = F.col("p") >= threshold

    w = F.col("w") if "w" in scores.columns else F.lit(1).cast("long")

    def n(condition):
        return F.sum(F.when(condition, w).otherwise(0))

    c = scores.groupBy(*by).agg(n(up & (F.col("y") == 1)).alias("tp"), n(up & (F.col("y") == 0)).alias("fp"), n(~up & (F.col("y") == 0)).alias("tn"), n(~up & (F.col("y") == 1)).alias("fn"))
    total = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    balanced = (ratio(F.col("tp"), F.col("tp") + F.col("fn")) + ratio(F.col("tn"), F.col("tn") + F.col("fp"))) / 2.0
    return c.select(*by, "tp", "fp", "tn", "fn", ratio(F.col("tp") + F.col("tn"), total).alias("accuracy"), F.round(balanced, 9).alias("balanced_accuracy"))


def point_metrics(scores: DataFrame, by: list[str]) -> DataFrame:
    got = ranking.metrics(tie_groups(scores, by), by)
    return got.select(*by, F.round("auroc", 9).alias("auroc"), "average_precision", "accuracy", "balanced_accuracy")


#: Distinct score vectors that a bootstrap keeps in memory; beyond, they stay distributed in so many blocks.
CELLS, BLOCKS = 200_000, 1024


def score_cells(scores: DataFrame, by: str) -> DataFrame:
    """``y, scores, n``: the distinct vectors of scores (one for each value of ``by``, in their order) with their numbers of rows.

    ``scores`` has ``<by>, y, w, p`` and the columns ``key`` that tell the rows (or value combinations) apart.
    """
    vectors = scores.groupBy("key", "y").agg(F.array_sort(F.collect_list(F.struct(by, "p"))).alias("v"), F.max("w").alias("w"))
    return vectors.groupBy("y", F.col("v.p").alias("scores")).agg(F.sum("w").alias("n"))


def _weighted_auroc(p, pos, neg):
    """AUROC by average ranks of each row of ``pos`` and ``neg`` (replicates x cells) for the cells' scores ``p``; NaN without both classes."""
    import numpy as np

    order = np.argsort(p, kind="stable")
    starts = np.flatnonzero(np.r_[True, p[order][1:] != p[order][:-1]]) if len(p) else np.zeros(0, int)
    pos, neg = (np.add.reduceat(x[:, order], starts, axis=1) if len(p) else np.zeros((len(x), 0)) for x in (pos, neg))
    below = np.cumsum(neg, axis=1) - neg
    twice, both = (pos * (2 * below + neg)).sum(axis=1), pos.sum(axis=1) * neg.sum(axis=1)
    return np.where(both > 0, twice / (2 * np.maximum(both, 1)), np.nan)


def bootstrap_auroc(cells: DataFrame, names: list[str], by: str, replicates: int, stream: str = "11006", limit: int = CELLS) -> DataFrame:
    """``<by>, replicate, auroc``: stratified paired bootstrap; each class is resampled to its own size, with the same draws for
    every one of ``names``, the values of ``by`` in the order of the cells' scores.

    ``cells`` come from :func:`score_cells`: drawing rows and counting them by cell is drawing multinomial counts of cells
    (:mod:`resampling`), so the work does not grow with the rows. Up to ``limit`` cells are handed to the tasks, which share the replicates and take
    a bounded block of them at a time; more stay distributed in blocks, among which each replicate's draws are parted first.
    """
    import numpy as np
    import pandas as pd

    spark = cells.sparkSession
    kept = cells.limit(limit + 1).toPandas()
    schema = f"{by} string, replicate long, auroc double"
    if len(kept) <= limit:
        kept = kept.assign(order=kept["scores"].map(tuple)).sort_values(["y", "order"]).reset_index(drop=True)
        y, n = kept["y"].to_numpy(), kept["n"].to_numpy(np.int64)
        p = np.array(kept["scores"].tolist()).reshape(len(kept), len(names))

        def run(batches):
            for batch in batches:
                replicate = batch["id"].to_numpy()
                for part in resampling.blocks(replicate, 4 * len(n)):
                    mult = np.zeros((len(replicate[part]), len(n)), np.int64)
                    for side in (0, 1):
                        mine = n[y == side]
                        seeds = np.array([resampling.seed(stream, int(r), side) for r in replicate[part]], np.uint64)
                        mult[:, y == side] = resampling.split(mine, np.full(len(seeds), mine.sum()), seeds)
                    for c, name in enumerate(names):
                        yield pd.DataFrame({by: name, "replicate": replicate[part], "auroc": np.round(_weighted_auroc(p[:, c], mult * (y == 1), mult * (y == 0)), 9)})

        return spark.range(1, replicates + 1).mapInPandas(run, schema)

    blocked = cells.withColumn("block", F.pmod(F.xxhash64("scores"), F.lit(BLOCKS)).cast("int"))
    sizes = blocked.groupBy("y", "block").agg(F.sum("n").alias("n")).toPandas()  # BLOCKS rows for each class
    totals = {side: sizes[sizes["y"] == side].set_index("block")["n"].reindex(range(BLOCKS), fill_value=0).to_numpy(np.int64) for side in (0, 1)}
    every = np.arange(1, replicates + 1)
    shares = {side: resampling.split(t, np.full(replicates, t.sum()), np.array([resampling.seed(stream, int(r), side, "blocks") for r in every], np.uint64)) for side, t in totals.items()}

    def part(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(order=group["scores"].map(tuple)).sort_values("order")
        n, p = group["n"].to_numpy(np.int64), np.array(group["scores"].tolist())
        side, block = int(key[0]), int(key[1])
        out = []
        for r in every:
            seeds = np.array([resampling.seed(stream, int(r), side, block)], np.uint64)
            mult = resampling.split(n, shares[side][r - 1, block : block + 1], seeds)[0]
            for c, name in enumerate(names):
                values, where = np.unique(p[:, c], return_inverse=True)
                count = np.bincount(where, mult, len(values)).astype(np.int64)
                out.append(pd.DataFrame({by: name, "replicate": r, "p": values, "y": side, "w": count})[count > 0])
        return pd.concat(out)

    drawn = blocked.groupBy("y", "block").applyInPandas(part, f"{by} string, replicate long, p double, y int, w long")
    return auroc(tie_groups(drawn, [by, "replicate"]), [by, "replicate"]).withColumn("auroc", F.round("auroc", 9))


def ranked(rows: DataFrame, stream: str, digits: int = 3) -> DataFrame:
    """``rows`` with ``place``, from 0 within each ``y`` in the order of a keyed hash of ``row_id``.

    Rows are numbered within buckets of leading hash digits, on top of the buckets before: 16 ** ``digits`` tasks for each class.
    """
    hashed = rows.withColumn("__h", keyed_hash(stream, F.col("row_id"))).withColumn("__b", F.substring("__h", 1, digits))
    counts = hashed.groupBy("y", "__b").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("n").over(Window.partitionBy("y").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("y", "__b").orderBy("__h", "row_id"))
    # 16 ** digits rows for each class
    return hashed.withColumn("__i", inside).join(F.broadcast(before), ["y", "__b"]).withColumn("place", F.col("__before") + F.col("__i") - 1).drop("__h", "__b", "__i", "__before")


def folds(rows: DataFrame, n: int = 5) -> DataFrame:
    """``row_id, y, fold``: stratified folds whose class counts differ by one at most."""
    return ranked(rows.select("row_id", "y"), "11004").select("row_id", "y", (F.col("place") % n).cast("int").alias("fold"))


def prior_baseline(train: DataFrame, holdout: DataFrame) -> DataFrame:
    """Metrics of the constant predictor, in closed form."""
    t = train.agg(F.sum("y").alias("tp"), F.count(F.lit(1)).alias("tn"))
    h = holdout.agg(F.sum("y").alias("hp"), F.count(F.lit(1)).alias("hn"))
    prior, prevalence = ratio(F.col("tp"), F.col("tn")), ratio(F.col("hp"), F.col("hn"))
    return t.join(F.broadcast(h)).select(
        prior.alias("prior"), F.lit(0.5).alias("auroc"), prevalence.alias("average_precision"), F.lit(0.5).alias("balanced_accuracy"),
        F.when(prior >= 0.5, prevalence).otherwise(ratio(F.col("hn") - F.col("hp"), F.col("hn"))).alias("accuracy"),
    )


def unknown_by_attribute(train: DataFrame, holdout: DataFrame, attrs: list[str], by: list[str]) -> DataFrame:
    """Per attribute: fitted categories, unknown ones, holdout rows that have one, and their share."""

    def long(rows: DataFrame) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("value")) for a in attrs])
        return rows.select(*by, F.explode(pairs).alias("p")).groupBy(*by, "p.attr", "p.value").agg(F.count(F.lit(1)).alias("n"))

    fitted, seen = long(train), long(holdout)
    known = fitted.groupBy(*by, "attr").agg(F.count(F.lit(1)).alias("fitted"))
    marked = seen.join(fitted.select(*by, "attr", "value", F.lit(True).alias("is_known")), [*by, "attr", "value"], "left")
    new = F.col("is_known").isNull()
    got = marked.groupBy(*by, "attr").agg(F.sum(new.cast("long")).alias("unknown_categories"), F.sum(F.when(new, F.col("n")).otherwise(0)).alias("unknown_rows"), F.sum("n").alias("rows"))
    return got.join(known, [*by, "attr"], "left").select(*by, "attr", F.coalesce("fitted", F.lit(0)).alias("fitted"), "unknown_categories", "unknown_rows", ratio(F.col("unknown_rows"), F.col("rows")).alias("unknown_rate"))


def encoder_summary(per_attribute: DataFrame, attrs: list[str], by: list[str]) -> DataFrame:
    """One row per model; attributes with unknown categories as ``name: count``, in the attributes' order."""
    place = F.array_position(F.array(*[F.lit(a) for a in attrs]), F.col("attr"))
    item = F.when(F.col("unknown_categories") > 0, F.struct(place.alias("place"), F.concat_ws(": ", "attr", F.col("unknown_categories").cast("string")).alias("text")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["text"]), "; ")
    got = per_attribute.groupBy(*by).agg(F.sum("fitted").alias("fitted"), F.sum("unknown_rows").alias("unknown_rows"), text.alias("t"))
    return got.select(*by, "fitted", "unknown_rows", F.when(F.col("t") == "", "0").otherwise(F.col("t")).alias("unknown"))


def logistic(train: DataFrame, holdout: DataFrame, attrs: list[str], c: float = 1.0):
    """Fitted pipeline and holdout scores of L2 logistic regression on one-hot categories.

    Unknown categories become all-zero blocks. The penalty does not cover the intercept.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    n = max(train.count(), 1)
    index = StringIndexer(inputCols=attrs, outputCols=[f"i_{a}" for a in attrs], handleInvalid="keep", stringOrderType="alphabetAsc")
    hot = OneHotEncoder(inputCols=[f"i_{a}" for a in attrs], outputCols=[f"v_{a}" for a in attrs], dropLast=True)
    wide = VectorAssembler(inputCols=[f"v_{a}" for a in attrs], outputCol="features")
    fit = LogisticRegression(featuresCol="features", labelCol="y", regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=60)
    model = Pipeline(stages=[index, hot, wide, fit]).fit(train)
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(holdout).withColumn("p", vector_to_array("probability")[1])
    return model, scored


def select_c(train: DataFrame, attrs: list[str], grid: tuple[float, ...] = (0.1, 1.0, 10.0), n: int = 5) -> DataFrame:
    """``c, mean_auroc, folds``: for each value of the grid, mean AUROC over the stratified folds of ``train`` (``row_id, y,
    <attrs>``): one fit for each value and fold, on the weighted category combinations of the other folds.
    """
    parted = train.join(folds(train, n).select("row_id", "fold"), "row_id").withColumn("w", F.lit(1).cast("long"))
    _, held = fits.selected(parted, attrs, grid, n)
    one = auroc(tie_groups(held, ["c", "k"]), ["c", "k"])
    return one.groupBy("c").agg(F.round(F.avg(F.round("auroc", 12)), 9).alias("mean_auroc"), F.count("auroc").alias("folds"))


def best_c(means: DataFrame) -> DataFrame:
    """The value of greatest mean; ties go to the smaller."""
    return means.orderBy(F.desc("mean_auroc"), "c").limit(1)
