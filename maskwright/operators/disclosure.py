"""Record-linkage attack on releases: candidates, scores, winners, success and risk.

Candidate rows that look alike are collapsed to groups with a size before any join, and
targets meet only groups of the same categorical labels. Scores are complete before the
ground truth is joined: score tables carry no row id of the release.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.prng import keyed_hash, uniform
from ..functions.exact import exact_sums
from ..functions.scalars import ratio
from ..sources.writers import shared
from .schema import QuasiIdentifierSpec, Scenario

#: Scores this close to the best win with it.
TOLERANCE = 1e-12


def scenario_pmf(spark: SparkSession, scenarios: list[Scenario]) -> DataFrame:
    return spark.createDataFrame([(s.scenario, d, q) for s in scenarios for d, q in sorted(s.errors.items())], "scenario string, err int, q double")


def target_sample(rows: DataFrame, row_id: str, size: int) -> DataFrame:
    """``size`` rows without replacement, in an order given by a keyed hash; ``target_pos`` from 1."""
    h = keyed_hash("11001", F.col(row_id))
    picked = rows.withColumn("h", h).orderBy("h", row_id).limit(size)
    # of the sample only, which is of fixed size
    return picked.withColumn("target_pos", F.row_number().over(Window.orderBy("h", row_id))).drop("h")


def publish_order(rows: DataFrame, row_id: str) -> DataFrame:
    """A random permutation of the rows: ``row_id, perm_hash``; sorting by it (then the id) publishes them.

    The hash itself is the place, so nothing has to be numbered in one task.
    """
    return rows.select(row_id, keyed_hash("11002", F.col(row_id)).alias("perm_hash"))


def age_noise(targets: DataFrame, scenarios: list[Scenario], draws: int) -> DataFrame:
    """``scenario, target_pos, draw, err`` by inverse cumulative probability of a keyed uniform number."""
    parts = None
    for s in scenarios:
        each = targets.select("target_pos", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
        u = uniform(s.stream, F.col("target_pos"), F.col("draw"))
        errors = sorted(s.errors)
        err: Column = F.lit(errors[-1])
        total = sum(s.errors.values())
        run = total
        for d, after in zip(reversed(errors[:-1]), reversed(errors[1:]), strict=True):
            run -= s.errors[after]
            err = F.when(u < F.lit(round(run, 12)), F.lit(d)).otherwise(err)
        each = each.select(F.lit(s.scenario).alias("scenario"), "target_pos", "draw", err.alias("err"))
        parts = each if parts is None else parts.unionByName(each)
    return parts


def age_compat(hier: DataFrame, pmf: DataFrame, attr: str) -> DataFrame:
    """``scenario, level, label, z, q``: the greatest probability of observing z over a label's leaves."""
    leaves = hier.filter(F.col("attr") == attr).select(F.col("leaf").cast("int").alias("leaf"), "level", "label")
    each = leaves.join(F.broadcast(pmf)).select("scenario", "level", "label", (F.col("leaf") + F.col("err")).alias("z"), "q")
    return each.groupBy("scenario", "level", "label", "z").agg(F.max("q").alias("q"))


def known_key(spec: QuasiIdentifierSpec, scenario: Scenario, numeric: str) -> list[Column]:
    """The labels an attacker can compare exactly; ``-`` where the scenario does not know the attribute."""
    return [(F.col(f"g_{q}") if q in scenario.known else F.lit("-")).alias(f"k_{q}") for q in spec.names if q != numeric]


def key_columns(spec: QuasiIdentifierSpec, numeric: str) -> list[str]:
    return [f"k_{q}" for q in spec.names if q != numeric]


def per_scenario(rows: DataFrame, spec: QuasiIdentifierSpec, scenarios: list[Scenario], numeric: str, *extra: str) -> DataFrame:
    """Rows with ``scenario`` and the known key; the scenarios are exploded from a literal, without a shuffle."""
    listed = F.array(*[F.struct(F.lit(s.scenario).alias("scenario"), *known_key(spec, s, numeric)) for s in scenarios])
    return rows.select(*extra, F.explode(listed).alias("s")).select("s.*", *extra)


def groups(published: DataFrame, spec: QuasiIdentifierSpec, scenarios: list[Scenario], numeric: str) -> DataFrame:
    """Candidate groups: ``scenario, config_id, <key>, g_<numeric>, lv_<numeric>, size``, from published classes."""
    rows = per_scenario(published, spec, scenarios, numeric, "config_id", "n", f"g_{numeric}", f"lv_{numeric}")
    return rows.groupBy("scenario", "config_id", *key_columns(spec, numeric), f"g_{numeric}", f"lv_{numeric}").agg(F.sum("n").alias("size"))


def observations(mine: DataFrame, noise: DataFrame, spec: QuasiIdentifierSpec, scenarios: list[Scenario], numeric: str) -> DataFrame:
    """What the attacker sees: ``scenario, config_id, target_pos, draw, <key>, z``; no row id.

    ``mine`` are the targets' own rows, recoded for each configuration.
    """
    seen = per_scenario(mine, spec, scenarios, numeric, "config_id", "target_pos", numeric)
    return seen.join(noise, ["scenario", "target_pos"]).withColumn("z", F.col(numeric) + F.col("err")).drop(numeric, "err")


def scores(seen: DataFrame, candidate_groups: DataFrame, compat: DataFrame, spec: QuasiIdentifierSpec, numeric: str) -> DataFrame:
    """Groups of positive score for each attempt: ``..., g_<numeric>, size, score``."""
    key = key_columns(spec, numeric)
    met = seen.join(candidate_groups, ["scenario", "config_id", *key])
    q = compat.select("scenario", F.col("level").alias(f"lv_{numeric}"), F.col("label").alias(f"g_{numeric}"), "z", F.col("q").alias("score"))
    return met.join(F.broadcast(q), ["scenario", f"lv_{numeric}", f"g_{numeric}", "z"])  # bounded by the hierarchy


def winners(scored: DataFrame, seen: DataFrame, spec: QuasiIdentifierSpec, numeric: str) -> DataFrame:
    """Each attempt with its best score, winning labels, and the size of the tie (0: abstained)."""
    attempt = ["scenario", "config_id", "target_pos", "draw"]
    best = Window.partitionBy(*attempt)
    top = scored.withColumn("best", F.max("score").over(best)).filter(F.col("score") >= F.col("best") - TOLERANCE)
    won = top.groupBy(*attempt).agg(F.max("best").alias("best"), F.sum("size").alias("tie_size"), F.array_sort(F.collect_list(f"g_{numeric}")).alias("winning"))
    return seen.join(won, attempt, "left").select(*attempt, *key_columns(spec, numeric), "z", F.coalesce("best", F.lit(0.0)).alias("best"), F.coalesce("tie_size", F.lit(0)).alias("tie_size"), F.coalesce("winning", F.array().cast("array<string>")).alias("winning"))


def success(won: DataFrame, truth: DataFrame, numeric: str) -> DataFrame:
    """Fractional success of each attempt: 1 / tie size if the true row's group is among the winners, else 0.

    ``truth`` has ``config_id, target_pos, true_label, retained``; a suppressed target never succeeds.
    """
    joined = won.join(truth, ["config_id", "target_pos"], "left")
    hit = F.coalesce("retained", F.lit(False)) & F.array_contains("winning", F.col("true_label"))
    return joined.select("scenario", "config_id", "target_pos", "draw", "tie_size", F.coalesce("retained", F.lit(False)).alias("retained"), F.coalesce(hit, F.lit(False)).alias("hit"), F.when(hit, ratio(F.lit(1), F.col("tie_size"))).otherwise(0.0).alias("success"))


def truth_of(mine: DataFrame, numeric: str) -> DataFrame:
    return mine.select("config_id", "target_pos", F.col(f"g_{numeric}").alias("true_label"), (~F.col("is_outlier")).alias("retained"))


def counts(done: DataFrame) -> DataFrame:
    return done.groupBy("scenario", "config_id").agg(F.count(F.lit(1)).alias("attempts"), F.sum((F.col("tie_size") == 0).cast("long")).alias("abstained"), F.sum(F.col("hit").cast("long")).alias("true_in_best"))


def coverage(done: DataFrame, sizes: tuple[int, ...] = (1, 2, 5, 10)) -> DataFrame:
    """Share of attempts whose tie has 1 to m rows, and the mean success among them (null if there are none)."""
    each = done.withColumn("m", F.explode(F.array(*[F.lit(m) for m in sizes])))
    within = (F.col("tie_size") >= 1) & (F.col("tie_size") <= F.col("m"))
    got = each.groupBy("scenario", "config_id", "m").agg(F.count(F.lit(1)).alias("attempts"), F.sum(within.cast("long")).alias("covered"), F.sum(F.when(within, F.col("success")).otherwise(0.0)).alias("s"))
    return got.select("scenario", "config_id", "m", "covered", ratio(F.col("covered"), F.col("attempts")).alias("coverage"), F.round(ratio(F.col("s"), F.col("covered")), 9).alias("conditional_success"), F.when(F.col("covered") == 0, "NA_NO_COVERED").otherwise("OK").alias("conditional_success_status"))


def tie_summary(done: DataFrame) -> DataFrame:
    made = done.filter("tie_size > 0")
    q = F.percentile("tie_size", F.array(F.lit(0.5), F.lit(0.95)))
    return made.groupBy("scenario", "config_id").agg(F.count(F.lit(1)).alias("attempted"), F.min("tie_size").alias("tie_min"), F.max("tie_size").alias("tie_max"), F.sum("tie_size").alias("tie_sum"), q[0].alias("tie_median"), q[1].alias("tie_p95"))


def tie_histogram(done: DataFrame) -> DataFrame:
    return done.filter("tie_size > 0").groupBy("scenario", "config_id", "tie_size").agg(F.count(F.lit(1)).alias("frequency"))


def target_means(done: DataFrame) -> DataFrame:
    """Mean success over a target's draws: an exact sum, divided once."""
    by = ["scenario", "config_id", "target_pos"]
    counted = done.groupBy(*by).agg(F.count("success").alias("draws"), F.max(F.col("retained").cast("int")).alias("kept"))
    return exact_sums(done, by, {"s": F.col("success")}).join(counted, by).select(*by, ratio(F.col("s"), F.col("draws")).alias("mean_success"), "kept")


def risk_point(done: DataFrame, released_sizes: DataFrame) -> DataFrame:
    """R_all over all targets, R_released over retained ones, and the uniform attacker's.

    ``released_sizes`` has ``config_id, n_c`` (retained rows).
    """
    means, by = shared(target_means(done)), ["scenario", "config_id"]
    counted = means.groupBy(*by).agg(F.count(F.lit(1)).alias("targets"), F.sum("kept").alias("targets_retained"))
    c = exact_sums(means, by, {"s": F.col("mean_success")}).join(counted, by)
    joined = c.join(F.broadcast(released_sizes), "config_id", "left")
    return joined.select(
        "scenario", "config_id", "targets", "targets_retained", ratio(F.col("s"), F.col("targets")).alias("r_all"), ratio(F.col("s"), F.col("targets_retained")).alias("r_released"),
        F.round(ratio(F.col("targets_retained"), F.col("targets") * F.col("n_c")), 12).alias("uniform_r_all"), F.round(ratio(F.lit(1), F.col("n_c")), 12).alias("uniform_r_released"),
    )


def permuted_truth(released: DataFrame, mine: DataFrame, n: int, spec: QuasiIdentifierSpec, numeric: str) -> DataFrame:
    """Negative control: each target is credited with a row drawn by a random permutation of the retained rows.

    The permutation shifts the targets' places: the i-th target by hash gets the labels of the i-th retained
    row by another hash. Only as many rows as there are targets (``n``) leave a task.
    """
    kept = released.filter("not is_outlier")
    order = Window.partitionBy("config_id").orderBy("h", spec.row_id)
    rows = kept.select("config_id", spec.row_id, *[f"g_{q}" for q in spec.names], keyed_hash("11007", F.col("config_id"), F.col(spec.row_id)).alias("h"))
    ranked = rows.withColumn("target_pos", F.row_number().over(order)).filter(F.col("target_pos") <= n)
    return mine.select("config_id", "target_pos", "is_outlier").join(ranked.drop(spec.row_id, "h"), ["config_id", "target_pos"], "left").select("config_id", "target_pos", *[F.col(f"g_{q}").alias(f"p_{q}") for q in spec.names], (~F.col("is_outlier") & F.col(f"g_{numeric}").isNotNull()).alias("retained"))


def permuted_success(won: DataFrame, permuted: DataFrame, spec: QuasiIdentifierSpec, scenarios: list[Scenario], numeric: str) -> DataFrame:
    """Success where the credited row must agree on the known labels as well as on a winning one."""
    joined = won.join(permuted, ["config_id", "target_pos"], "left")
    agrees = F.lit(True)
    for q in spec.names:
        if q != numeric:
            agrees = agrees & ((F.col(f"k_{q}") == "-") | (F.col(f"k_{q}") == F.col(f"p_{q}")))
    hit = F.coalesce(F.col("retained") & agrees & F.array_contains("winning", F.col(f"p_{numeric}")), F.lit(False))
    return joined.select("scenario", "config_id", "target_pos", "draw", "tie_size", F.coalesce("retained", F.lit(False)).alias("retained"), hit.alias("hit"), F.when(hit, ratio(F.lit(1), F.col("tie_size"))).otherwise(0.0).alias("success"))


def oracle(spark: SparkSession) -> DataFrame:
    """The hand-made attack: z = 33 against 30-34 (two rows) and 35-39, with the triangular error, by the operators of any attack."""
    spec = QuasiIdentifierSpec(("num", "other"), {"num": 1, "other": 1}, "sens", "1", "rid")
    pmf = spark.createDataFrame([("X", d, q) for d, q in {-2: 0.1, -1: 0.2, 0: 0.4, 1: 0.2, 2: 0.1}.items()], "scenario string, err int, q double")
    paths = [("num", str(leaf), 1, f"{low}-{low + 4}") for low in (30, 35) for leaf in range(low, low + 5)]
    compat = age_compat(spark.createDataFrame(paths, "attr string, leaf string, level int, label string"), pmf, "num")
    candidates = spark.createDataFrame([("X", "C", "k", "30-34", 1, 2), ("X", "C", "k", "35-39", 1, 1)], "scenario string, config_id string, k_other string, g_num string, lv_num int, size long")
    seen = spark.createDataFrame([("X", "C", 1, 1, "k", 33)], "scenario string, config_id string, target_pos int, draw int, k_other string, z int")
    scored = scores(seen, candidates, compat, spec, "num")
    won = winners(scored, seen, spec, "num").select("target_pos", "winning", F.col("tie_size").alias("tie"))
    hit = F.array_contains("winning", F.col("g_num"))
    return scored.join(won, "target_pos").select(F.col("g_num").alias("label"), "size", "score", hit.alias("winner"), F.when(hit, F.col("tie")).alias("tie_size"))
