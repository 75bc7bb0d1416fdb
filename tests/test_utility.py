"""The utility side against plain row-by-row versions."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from maskwright.functions.prng import keyed_hash
from maskwright.operators import fits, hierarchy, privacy, ranking, resampling, schema, utility
from maskwright.operators.schema import AnonConfig, ContractError, QuasiIdentifierSpec
from maskwright.plans import catalog

SF = "/root/testdata/sf0.001"


def brute_auroc(p, y):
    pairs = [(a > b) + 0.5 * (a == b) for a, s in zip(p, y, strict=True) if s for b, t in zip(p, y, strict=True) if not t]
    return sum(pairs) / len(pairs)


@pytest.fixture(scope="module")
def scored(spark):
    """Forty holdout rows with scores of two configurations; some rows look alike."""
    rng = np.random.default_rng(4)
    rows = [(c, k, int(k % 3 == 0), 1, float(rng.integers(0, 4)) / 4 if c == "A" else float(k % 5)) for c in "AB" for k in range(40)]
    return rows, spark.createDataFrame(rows, "config_id string, key long, y int, w long, p double")


def test_bootstrap_equals_drawing_the_rows(spark, scored):
    """Multinomial counts of cells are unfolded to rows again, and each replicate's AUROC is taken pair by pair."""
    rows, frame = scored
    cells = utility.score_cells(frame, "config_id")
    assert cells.agg(F.sum("n")).first()[0] == 40 and cells.count() < 40
    got = {(r["config_id"], r["replicate"]): r["auroc"] for r in utility.bootstrap_auroc(cells, ["A", "B"], "config_id", 20).collect()}
    assert len(got) == 40
    vectors = sorted((r["y"], tuple(r["scores"]), r["n"]) for r in cells.collect())
    for replicate in range(1, 21):
        drawn = []
        for side in (0, 1):
            mine = [v for v in vectors if v[0] == side]
            counts = plain_split([v[2] for v in mine], sum(v[2] for v in mine), resampling.seed("11006", replicate, side))
            assert sum(counts) == sum(v[2] for v in mine)  # each class keeps its size
            drawn += [(v, side) for (_, v, _), n in zip(mine, counts, strict=True) for _ in range(n)]
        for c, name in enumerate("AB"):
            assert got[name, replicate] == pytest.approx(brute_auroc([v[c] for v, _ in drawn], [s for _, s in drawn]), abs=1e-9)


def plain_split(weights, draws, seed, low=0):
    """The tree of halves by recursion, with quantiles from sums of exact binomial coefficients."""
    if len(weights) == 1 or not draws:
        return [draws, *[0] * (len(weights) - 1)]
    half = (2 * low + len(weights)) // 2 - low
    x = (seed + (low + half) * 2654435769) % 2**32
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B), (16, 1)):
        x = ((x ^ (x >> shift)) * factor) % 2**32
    u, p, total, k = (x + 0.5) / 2**32, sum(weights[:half]) / sum(weights), 0.0, -1
    while total <= u and k < draws:
        k += 1
        total += math.comb(draws, k) * p**k * (1 - p) ** (draws - k)
    return plain_split(weights[:half], k, seed, low) + plain_split(weights[half:], draws - k, seed, low + half)


def test_counts_are_multinomial():
    weights = np.array([1, 5, 3, 1, 10, 0, 20])
    seeds = np.array([resampling.seed("x", r) for r in range(4000)], np.uint64)
    counts = resampling.split(weights, np.full(4000, 40), seeds)
    assert (counts.sum(axis=1) == 40).all() and not counts[:, 5].any()
    share = weights / 40
    assert np.allclose(counts.mean(axis=0), weights, atol=0.25)
    assert np.allclose(np.cov(counts.T), 40 * (np.diag(share) - np.outer(share, share)), atol=0.7)
    for r in (0, 7, 99):
        assert counts[r].tolist() == plain_split([1, 5, 3, 1, 10, 0, 20], 40, int(seeds[r]))
    large = resampling.split(np.full(4, 10**9), np.full(1000, 4 * 10**9), seeds[:1000])
    assert np.allclose(large.mean(axis=0) / 1e9, 1, atol=1e-5) and np.allclose(large.var(axis=0) / 7.5e8, 1, atol=0.25)
    assert resampling.split(np.zeros(0, int), np.zeros(2, int), seeds[:2]).shape == (2, 0)


def test_bootstrap_of_many_cells_stays_distributed(spark, scored):
    cells = utility.score_cells(scored[1], "config_id")
    got = utility.bootstrap_auroc(cells, ["A", "B"], "config_id", 60, limit=3).groupBy("config_id").agg(F.count("*").alias("n"), F.avg("auroc").alias("mean")).collect()
    near = {r["config_id"]: r["m"] for r in utility.bootstrap_auroc(cells, ["A", "B"], "config_id", 600).groupBy("config_id").agg(F.avg("auroc").alias("m")).collect()}
    assert all(r["n"] == 60 and abs(r["mean"] - near[r["config_id"]]) < 0.06 for r in got)
    none = utility.bootstrap_auroc(utility.score_cells(scored[1].filter("y = 1"), "config_id"), ["A", "B"], "config_id", 2).collect()
    assert len(none) == 4 and all(r["auroc"] is None or np.isnan(r["auroc"]) for r in none)


def test_places_by_buckets_are_those_of_one_window(spark):
    rows = spark.range(2000).select(F.col("id").alias("row_id"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    window = Window.partitionBy("y").orderBy(keyed_hash("11004", F.col("row_id")), "row_id")
    want = {r[0]: r[1] for r in rows.select("row_id", F.row_number().over(window) - 1).collect()}
    for digits in (1, 3):
        assert {r["row_id"]: r["place"] for r in utility.ranked(rows, "11004", digits).collect()} == want
    sizes = {tuple(r)[:2]: r["n"] for r in utility.folds(rows).groupBy("y", "fold").agg(F.count("*").alias("n")).collect()}
    assert len(sizes) == 10 and all(max(n for (y, _), n in sizes.items() if y == s) - min(n for (y, _), n in sizes.items() if y == s) <= 1 for s in (0, 1))


def plain_fit(rows, attrs, c, penalised=True):
    """Regularised logistic regression by gradient descent on single rows."""
    names = sorted({(a, r[a]) for r in rows for a in attrs})
    x = np.array([[float(r[a] == v) for a, v in names] + [1.0] for r in rows])
    y = np.array([r["y"] for r in rows], float)
    beta, free = np.zeros(x.shape[1]), np.r_[np.ones(len(names)), 1.0 if penalised else 0.0]
    for _ in range(20_000):
        p = 1 / (1 + np.exp(-x @ beta))
        beta -= 0.5 / (c * len(rows)) * (free * beta + c * x.T @ (p - y))
    return names, beta


def fit_rows(seed=1, n=150):
    rng = np.random.default_rng(seed)
    rows = [{"m": str(k % 2), "a": str(rng.integers(3)), "b": str(rng.integers(2)), "split": "train" if k % 3 else "holdout"} for k in range(n)]
    for r in rows:
        r["y"] = int(rng.random() < (0.8 if r["a"] == "1" else 0.3))
    rows.append({"m": "0", "a": "new", "b": "0", "split": "holdout", "y": 1})
    return rows


def cells_of(spark, rows):
    frame = spark.createDataFrame([(r["m"], r["a"], r["b"], r["split"], r["y"]) for r in rows], "m string, a string, b string, split string, y int")
    return frame.groupBy("m", "a", "b", "split").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))


@pytest.mark.parametrize("penalised", [True, False])
def test_fits_by_aggregation_equal_a_plain_fit_on_rows(spark, penalised):
    rows = fit_rows()
    cells = cells_of(spark, rows)
    cost = {"0": 0.1, "1": 1.0}
    got = fits.fit(cells.filter("split = 'train'"), ["m"], ["a", "b"], lambda m: cost[m[0]], penalised)
    assert all(got.converged.values()) and set(got.beta) == {("0",), ("1",)}
    scored = {(r["m"], r["a"], r["b"]): r["p"] for r in got.score(cells.filter("split = 'holdout'")).collect()}
    for m, c in cost.items():
        names, beta = plain_fit([r for r in rows if r["split"] == "train" and r["m"] == m], ["a", "b"], c, penalised)
        for r in (r for r in rows if r["split"] == "holdout" and r["m"] == m):
            z = beta[-1] + sum(w for (a, v), w in zip(names, beta, strict=False) if r[a] == v)
            assert scored[m, r["a"], r["b"]] == pytest.approx(1 / (1 + np.exp(-z)), abs=2e-4)
        named = {(r["attr"], r["label"]): r["coefficient"] for r in got.coefficients(cells).filter(F.col("m") == m).collect()}
        assert named[None, None] == pytest.approx(beta[-1], abs=2e-3)
        assert all(named[key] == pytest.approx(w, abs=2e-3) for key, w in zip(names, beta, strict=False))


def test_fits_do_not_depend_on_how_cells_are_dealt(spark):
    train = cells_of(spark, fit_rows(3, 400)).filter("split = 'train'")
    digests = [fits.fit(train.repartition(k, F.rand(k)), ["m"], ["a", "b"]).digest() for k in (1, 3, 8)]
    assert digests[0] == digests[1] == digests[2]


def test_fits_of_odd_tables(spark):
    none = spark.createDataFrame([], "m string, a string, n long, pos long")
    assert fits.fit(none, ["m"], ["a"]).beta == {}
    one_class = spark.createDataFrame([("x", "u", 5, 5), ("x", None, 2, 2)], "m string, a string, n long, pos long")
    got = fits.fit(one_class, ["m"], ["a"])
    assert got.converged[("x",)] and got.beta[("x",)][0] > 0
    with pytest.raises(ContractError, match="FIT_CATEGORIES"):
        fits.categories(spark.range(10).select(F.col("id").cast("string").alias("a")), ["a"], 9)


def brute_metrics(groups, threshold=0.5):
    rows = [(p, 1) for p, pos, _ in groups for _ in range(pos)] + [(p, 0) for p, _, neg in groups for _ in range(neg)]
    p, y = [r[0] for r in rows], [r[1] for r in rows]
    total, precision = sum(y), 0.0
    for score, pos, _ in groups:
        reached = [s for q, s in rows if q >= score]
        precision += pos / total * sum(reached) / len(reached) if pos else 0.0
    return brute_auroc(p, y), precision, sum(s for q, s in rows if q >= threshold)


@pytest.mark.parametrize("ranges", [1, 4, 128])
def test_metrics_from_prefix_sums(spark, ranges):
    rng = np.random.default_rng(5)
    groups = {m: [(k / 60, int(rng.integers(0, 4)), int(rng.integers(0, 4))) for k in range(60) if rng.random() < 0.7 or m == "b"] for m in ("a", "b")}
    frame = spark.createDataFrame([(m, *g) for m, each in groups.items() for g in each] + [("flat", 0.5, 3, 5), ("one", 0.1, 2, 0)], "m string, p double, pos long, neg long")
    got = {r["m"]: r for r in ranking.metrics(frame, ["m"], n=ranges).collect()}
    for m, each in groups.items():
        want = brute_metrics(each)
        assert got[m]["auroc"] == pytest.approx(want[0]) and got[m]["average_precision"] == pytest.approx(want[1], abs=1e-9) and got[m]["tp"] == want[2]
    assert got["flat"]["auroc"] == 0.5 and got["flat"]["average_precision"] == 0.375 and got["one"]["auroc"] is None


def test_a_million_scores_are_ranked_in_many_tasks(spark):
    n = 1_000_000
    groups = spark.range(n).select(F.when(F.col("id") < n, "m").alias("m"), (F.col("id") / n).alias("p"), (F.col("id") % 3 == 0).cast("long").alias("pos"), (F.col("id") % 3 != 0).cast("long").alias("neg"))
    parted = ranking.prefix_sums(groups, ["m"], ["pos", "neg"])
    plan = parted._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(m#" in plan and all("__range" in line for line in plan.split("\n") if "windowspecdefinition" in line)
    first = parted.filter("p = 0.5").first()
    assert first["below_pos"] == -(-500_000 // 3) and first["all_pos"] == -(-n // 3)
    y = np.arange(n) % 3 == 0
    want = (np.flatnonzero(y) - np.arange(y.sum())).sum() / (y.sum() * (n - y.sum()))
    assert ranking.metrics(groups, ["m"]).first()["auroc"] == pytest.approx(want, abs=1e-12)


def test_c_is_selected_by_fits_on_folds(spark):
    """Each of the grid's means is taken again with a plain fit for each fold."""
    rng = np.random.default_rng(2)
    data = [(k, str(rng.integers(4)), str(rng.integers(3))) for k in range(120)]
    rows = [(k, int(rng.random() < 0.2 + 0.2 * int(a)), a, b) for k, a, b in data]
    frame = spark.createDataFrame(rows, "row_id long, y int, a string, b string")
    grid = (0.1, 1.0)
    got = {r["c"]: (r["mean_auroc"], r["folds"]) for r in utility.select_c(frame, ["a", "b"], grid, 3).collect()}
    fold = {r["row_id"]: r["fold"] for r in utility.folds(frame, 3).collect()}
    for c in grid:
        values = []
        for k in range(3):
            names, beta = plain_fit([{"y": y, "a": a, "b": b} for i, y, a, b in rows if fold[i] != k], ["a", "b"], c)
            held = [(y, round(beta[-1] + sum(w for (n, v), w in zip(names, beta, strict=False) if {"a": a, "b": b}[n] == v), 3)) for i, y, a, b in rows if fold[i] == k]
            values.append(brute_auroc([z for _, z in held], [y for y, _ in held]))
        assert got[c][1] == 3 and got[c][0] == pytest.approx(np.mean(values), abs=0.02)
    means = spark.createDataFrame([(0.1, 0.5), (1.0, 0.7), (10.0, 0.7)], "c double, mean_auroc double")
    assert utility.best_c(means).first()["c"] == 1.0


def test_every_fit_of_the_matrix_converges(spark):
    found = catalog.QUERIES["lr_convergence"](spark, SF).collect()
    assert len(found) == 33 and all(r["converged"] and r["evaluations"] < 20 for r in found)


def test_releases_under_l_and_t_suppress_failing_classes(spark):
    spec = QuasiIdentifierSpec(("a",), {"a": 1}, "s", ">T", "rid")
    parts = {"x": (3, 3), "y": (5, 0), "z": (1, 9)}  # negatives, positives
    rows = [(leaf, ">T" if k >= low else "<=T") for leaf, (low, high) in parts.items() for k in range(low + high)]
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "rid long, a string, s string")
    hier = spark.createDataFrame([("a", leaf, k, label) for leaf in parts for k, label in enumerate((leaf, "*"))], "attr string, leaf string, level int, label string")
    configs = schema.configurations(spark, spec, [AnonConfig("K", {"a": 0}, k=6), AnonConfig("L", {"a": 0}, k=2, l=2), AnonConfig("T", {"a": 0}, k=2, t=0.2), AnonConfig("ALL", {"a": 1}, k=2, l=2, t=0.01)])
    sig = privacy.signature(table, spec)
    recoded = privacy.generalized(sig, hier, configs, spec)
    found = privacy.classes(recoded, spec)
    # the whole table has 12 of 21 positive: x is 0.071, y 0.571, z 0.329 away
    assert {(r["config_id"], r["g_a"]) for r in found.filter("fails").collect()} == {("K", "y"), ("L", "y"), ("T", "y"), ("T", "z")}
    gone = privacy.with_outliers(recoded, found, spec).filter("is_outlier").groupBy("config_id").agg(F.sum("w").alias("n")).collect()
    assert {(r["config_id"], r["n"]) for r in gone} == {("K", 5), ("L", 5), ("T", 15)}


def test_paths_from_literal_maps_and_joins_agree(spark, monkeypatch):
    spec = QuasiIdentifierSpec(("a", "b"), {"a": 1, "b": 1}, "s", "1", "rid")
    hier = spark.createDataFrame([(q, leaf, k, label) for q in "ab" for leaf in "xyz" for k, label in enumerate((leaf, "*"))], "attr string, leaf string, level int, label string")
    rows = spark.createDataFrame([(1, "x", "y"), (2, "z", "unknown"), (3, None, "x"), (4, "z", "z")], "rid long, a string, b string")
    want = {1: (["x", "*"], ["y", "*"]), 4: (["z", "*"], ["z", "*"])}
    for leaves, limit in ((64, 100), (0, 100), (0, 2)):
        monkeypatch.setattr(hierarchy, "MAP_LEAVES", leaves)
        monkeypatch.setattr(hierarchy, "BROADCAST_ROWS", limit)
        assert {r["rid"]: (r["path_a"], r["path_b"]) for r in hierarchy.with_paths(rows, hier, spec).collect()} == want
