"""Hand-made goldens and identities of the engine."""

import math
import zipfile

import pytest
from pyspark.sql import functions as F

from maskwright.functions import scalars
from maskwright.operators import bootstrap, export, hierarchy, lattice, privacy, schema, structure, utility, validation
from maskwright.operators.schema import AnonConfig, ContractError, QuasiIdentifierSpec
from maskwright.plans import catalog
from maskwright.plans.study import SPEC, Study
from maskwright.sources import readers, writers

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def study(spark):
    return Study(spark, SF)


TINY = QuasiIdentifierSpec(("a", "b"), {"a": 1, "b": 2}, "s", ">T", "rid")


def tiny(spark):
    """Twenty common rows and a rare one."""
    rows = [(i, "rare" if i == 20 else "common", "rare" if i == 20 else "common", ">T" if i == 20 or i % 2 else "<=T") for i in range(21)]
    table = spark.createDataFrame(rows, "rid long, a string, b string, s string")
    paths = [("a", leaf, k, label) for leaf in ("common", "rare") for k, label in enumerate((leaf, "*"))]
    paths += [("b", leaf, k, label) for leaf in ("common", "rare") for k, label in enumerate((leaf, "b_ALL", "*"))]
    return table, spark.createDataFrame(paths, "attr string, leaf string, level int, label string")


def test_lattice_suppresses_the_rare_row_or_generalises_all(spark):
    rows, hier = tiny(spark)
    sig = lattice.signature(rows, hier, TINY)
    with_budget = lattice.optimum(sig, hier, TINY, k=5, limit=0.05)
    assert with_budget.node == (0, 0) and with_budget.suppressed == 1
    without = lattice.optimum(sig, hier, TINY, k=5, limit=0.0)
    assert without.suppressed == 0 and min(without.node) >= 1 and without.loss == pytest.approx(1.0)
    assert lattice.optimum(sig.limit(0), hier, TINY, 5, 0.0) is None
    checked = {r["node"]: r for r in lattice.check(lattice.classes(sig, TINY.lattice(), TINY), lattice.failing(5)).collect()}
    assert len(checked) == 6 and checked["0.0"]["suppressed"] == 1 and checked["1.2"]["suppressed"] == 0
    close = lattice.check(lattice.classes(sig, [(0, 0)], TINY), lattice.failing(1, l=2, t=0.2, total=21, positive=11)).first()
    assert close["suppressed"] == 1  # the rare class has one sensitive value


DENSE = QuasiIdentifierSpec(tuple("abcdefgh"), dict(zip("abcdefgh", (4, 3, 2, 2, 2, 2, 1, 1), strict=True)), "s", "v0", "rid", values=("v0", "v1", "v2"))


def dense(spark, rows=4000):
    """Eight attributes of few leaves, 6,480 nodes; a leaf's label at level v is its number divided by 2 ** v."""
    leaves = {q: 2 ** (h + (h > 1)) if h < 4 else 12 for q, h in DENSE.heights.items()}
    paths = [(q, str(x), v, "*" if v == DENSE.heights[q] else f"{v}:{x >> v}") for q, n in leaves.items() for x in range(n) for v in range(DENSE.heights[q] + 1)]
    place = F.xxhash64("id")
    cells = [F.pmod(F.shiftright(place, 7 * k), F.lit(min(n, 3 if k < 4 else 2))).cast("string").alias(q) for k, (q, n) in enumerate(leaves.items())]
    table = spark.range(rows).select(F.col("id").alias("rid"), *cells, F.concat(F.lit("v"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)).cast("string")).alias("s"))
    return table, spark.createDataFrame(paths, "attr string, leaf string, level int, label string")


def test_rolling_up_spares_rows_and_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(lattice, "JOB_ROWS", 5000)
    rows, hier = dense(spark)
    assert len(DENSE.lattice()) == 6480
    sig = lattice.signature(rows, hier, DENSE)
    up = lattice.optimum(sig, hier, DENSE, 300, 0.0, l=3, t=0.1)
    down = lattice.optimum(sig, hier, DENSE, 300, 0.0, l=3, t=0.1, roll_up=False)
    assert (up.node, up.loss, up.suppressed) == (down.node, down.loss, down.suppressed)
    assert down.cuboids == 0 and down.rows_read == down.rows_from_leaves
    assert up.cuboids >= 1 and up.rows_read < up.rows_from_leaves / 2


def test_rolled_up_classes_are_those_of_the_leaves(spark):
    rows, hier = dense(spark, 500)
    numbered, codes = lattice.coded(lattice.signature(rows, hier, DENSE), hier, DENSE)
    low, high = (1, 1, 0, 1, 0, 1, 0, 1), (3, 1, 2, 1, 1, 2, 0, 1)
    direct = lattice.coded_classes(numbered, [high], codes, DENSE)
    again = lattice.coded_classes(lattice.rolled(numbered, low, codes, DENSE), [high], codes, DENSE)
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, again.collect()))
    assert lattice.node_number(high, DENSE) == DENSE.lattice().index(high)
    labelled = lattice.classes(lattice.signature(rows, hier, DENSE), [high], DENSE)
    assert sorted(r["n"] for r in direct.collect()) == sorted(r["n"] for r in labelled.collect()) and {r["node"] for r in labelled.collect()} == {"3.1.2.1.1.2.0.1"}


def test_class_keys_of_many_leaves_take_more_columns(spark):
    wide = QuasiIdentifierSpec(tuple(f"q{k}" for k in range(8)), {f"q{k}": 1 for k in range(8)}, "s", "1", "rid")
    hier = spark.range(300).select(F.explode(F.array(*map(F.lit, wide.names))).alias("attr"), F.col("id").cast("string").alias("leaf"), F.explode(F.array(F.lit(0), F.lit(1))).alias("level")).withColumn("label", F.when(F.col("level") == 0, F.col("leaf")).otherwise("*"))
    rows = spark.range(600).select(F.col("id").alias("rid"), *[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(300)).cast("string").alias(q) for k, q in enumerate(wide.names)], F.lit("1").alias("s"))
    numbered, codes = lattice.coded(lattice.signature(rows, hier, wide), hier, wide)
    assert codes.keys == 2
    assert lattice.coded_classes(numbered, [tuple([0] * 8)], codes, wide).count() == 600


def brute_distance(values, whole):
    return sum(abs(values.count(v) / len(values) - whole.count(v) / len(whole)) for v in set(whole)) / 2


@pytest.mark.parametrize("declared", [True, False])
def test_sensitive_columns_of_many_values(spark, declared):
    rng = __import__("random").Random(3)
    rows = [(k, rng.choice("xyz"), rng.choice("aabbbcde")) for k in range(300)]
    values = tuple(sorted({r[2] for r in rows}))
    spec = QuasiIdentifierSpec(("q",), {"q": 1}, "s", "a", "rid", values=values if declared else tuple(f"v{k}" for k in range(100)))
    hier = spark.createDataFrame([("q", leaf, v, label) for leaf in "xyz" for v, label in enumerate((leaf, "*"))], "attr string, leaf string, level int, label string")
    configs = schema.configurations(spark, spec, [AnonConfig("T", {"q": 0}, t=0.05), AnonConfig("L", {"q": 0}, l=5), AnonConfig("ALL", {"q": 1}, k=2, l=5, t=0.01)])
    found = privacy.classes(privacy.generalized(privacy.signature(spark.createDataFrame(rows, "rid long, q string, s string"), spec), hier, configs, spec), spec)
    for r in found.collect():
        mine = [s for _, q, s in rows if r["g_q"] in (q, "*")]
        distance = brute_distance(mine, [s for *_, s in rows])
        assert {x["value"]: x["n"] for x in r["freq"]} == {v: mine.count(v) for v in set(mine)} and r["n_sens"] == len(set(mine))
        assert r["distance"] == pytest.approx(distance, abs=1e-12)
        assert r["fails"] == ((r["config_id"] == "T" and distance > 0.05) or (r["config_id"] == "L" and len(set(mine)) < 5))


def test_anchors_of_the_fixture(study):
    assert study.md.count() == 1500 and study.md.filter("sens = '>T'").count() == 380
    found = {r["config_id"]: r for r in catalog.QUERIES["privacy_summary"](study.spark, SF).collect()}
    assert found["CFG00"]["n_classes"] == 1425 and found["CFG00"]["singles"] == 1353 and found["CFG00"]["max_class"] == 3
    coarse = found["CFG01"]
    assert (coarse["n_classes"], coarse["k_hat"], coarse["max_class"], coarse["l_hat"]) == (25, 14, 94, 2)
    assert coarse["t_hat"] == pytest.approx(0.129019608, abs=1e-9)


def test_identities(study):
    for r in catalog.QUERIES["risk_point"](study.spark, SF).collect():
        if r["r_released"] is not None:
            assert r["r_all"] == pytest.approx(r["targets_retained"] / r["targets"] * r["r_released"], abs=1e-8)
    kept = {r["config_id"]: r["n"] for r in study.classes.groupBy("config_id").agg(F.sum("n").alias("n")).collect()}
    rows = {r["config_id"]: r["n"] for r in study.released.filter("not is_outlier").groupBy("config_id").agg(F.sum("w").alias("n")).collect()}
    assert kept == rows
    moved = {r["config_id"]: r["tvd_max"] for r in structure.tvd_summary(study.tvd).collect()}
    assert moved["CFG01"] == moved["CFG00"] == moved["CFG04"] == 0.0 and moved["CFG02"] > 0


def test_attack_oracle(spark):
    got = {r["label"]: r for r in catalog.QUERIES["attack_oracle"](spark, SF).collect()}
    assert got["30-34"]["score"] == 0.4 and got["35-39"]["score"] == 0.1
    assert got["30-34"]["tie_size"] == 2 and got["35-39"]["tie_size"] is None


def test_constant_predictor_and_ties(spark):
    scores = spark.createDataFrame([("m", i, int(i < 3), 0.25) for i in range(12)], "config_id string, row_id long, y int, p double")
    got = utility.point_metrics(scores, ["config_id"]).first()
    assert got["auroc"] == 0.5 and got["average_precision"] == 0.25 and got["balanced_accuracy"] == 0.5 and got["accuracy"] == 0.75
    ranked = spark.createDataFrame([("m", 1, 1, 0.9), ("m", 2, 0, 0.9), ("m", 3, 1, 0.5), ("m", 4, 0, 0.1)], "config_id string, row_id long, y int, p double")
    assert utility.point_metrics(ranked, ["config_id"]).first()["auroc"] == 0.625
    single = utility.auroc(utility.tie_groups(ranked.filter("y = 1"), ["config_id"]), ["config_id"]).first()
    assert single["auroc"] is None  # no negative


def test_resampling_plan_sums_to_the_units(spark):
    plan = bootstrap.resampling_plan(spark.range(1), 37, 5)
    assert {r["s"] for r in plan.groupBy("replicate").agg(F.sum("mult").alias("s")).collect()} == {37}


def test_pareto_front(spark):
    points = spark.createDataFrame([("a", 0.1, 0.3), ("b", 0.2, 0.2), ("c", 0.3, 0.3), ("d", 0.1, 0.3)], "k string, x double, y double")
    assert {r["k"] for r in structure.pareto_front(points, "k", "x", "y").collect()} == {"a", "b", "d"}


def test_scalars(spark):
    rows = spark.createDataFrame([(12, 18), (0, 5), (7, 0), (2**62, 6)], "a long, b long")
    assert [r[0] for r in rows.select(scalars.gcd(F.col("a"), F.col("b"))).collect()] == [math.gcd(12, 18), 5, 7, math.gcd(2**62, 6)]
    cells = spark.createDataFrame([("ok",), ("",), (" x",), ("?",), ("a\tb",), (None,)], "c string")
    assert [r[0] for r in cells.select(scalars.cell_is_clean(F.col("c"))).collect()] == [True] + [False] * 5
    assert cells.limit(1).select(scalars.interval_label(F.lit(3), F.lit(3)), scalars.block_label(F.lit(20), 5)).first()[:] == ("3", "16-20")


def test_hierarchy_checks(spark):
    paths = spark.createDataFrame([("x", "a", 0, "a"), ("x", "a", 1, "g"), ("x", "a", 2, "*"), ("x", "b", 0, "b"), ("x", "b", 1, "g"), ("x", "b", 2, "!")], "attr string, leaf string, level int, label string")
    assert [(r["label"], r["parents"]) for r in hierarchy.functional_violations(paths).collect()] == [("g", 2)]
    values = spark.createDataFrame([("x", "a"), ("x", "z")], "attr string, value string")
    assert [r["value"] for r in hierarchy.uncovered(values, paths).collect()] == ["z"]
    assert [r["value"] for r in hierarchy.unused(values, paths).collect()] == ["b"]


@pytest.mark.parametrize(
    ("change", "code"),
    [({"vector": {"a": 0}}, "CFG_VECTOR_KEYS"), ({"vector": {"a": 2, "b": 0}}, "CFG_VECTOR_RANGE"), ({"k": 0}, "CFG_K"), ({"l": 1}, "CFG_L"), ({"t": 0.0}, "CFG_T"), ({"limit": 1.0}, "CFG_LIMIT")],
)
def test_broken_configurations_have_stable_codes(change, code):
    good = {"config_id": "C", "vector": {"a": 0, "b": 0}}
    AnonConfig(**good).validate(TINY)
    with pytest.raises(ContractError) as e:
        AnonConfig(**good | change).validate(TINY)
    assert e.value.code == code


@pytest.mark.parametrize(
    ("place", "change", "code"),
    [
        (0, {"config_id": "CFG01"}, "CAT_IDS"), (1, {"config_id": "CFG00"}, "CAT_IDS"), (2, {"config_id": "cfg02"}, "CAT_IDS"), (0, {"k": 2}, "CAT_RAW"), (0, {"l": 2}, "CAT_RAW"), (0, {"t": 0.5}, "CAT_RAW"), (0, {"limit": 0.05}, "CAT_RAW"),
        (0, {"vector": {"a": 1, "b": 0}}, "CAT_RAW_VECTOR"), (1, {"k": 1}, "CAT_K"), (1, {"l": 9}, "CAT_L"), (1, {"vector": {"a": 0, "b": 0}}, "CAT_VECTOR"), (1, {"limit": 0}, "CAT_LIMIT_TYPE"), (1, {"limit": -0.0}, "CAT_LIMIT_SIGN"),
        (2, {"limit": 0.05 + 1e-12}, "CAT_LIMIT_STEP"), (2, {"pair": "CFG09"}, "CAT_PAIR"), (2, {"pair": "CFG02"}, "CAT_PAIR"), (2, {"limit": 0.0}, "CAT_PAIR_LIMIT"), (1, {"limit": 0.5}, "CAT_PAIR_LIMIT"), (2, {"k": 2}, "CAT_PAIR_K"),
    ],
)
def test_a_broken_catalogue_has_stable_codes(place, change, code):
    good = [
        {"config_id": "CFG00", "vector": {"a": 0, "b": 0}},
        {"config_id": "CFG01", "vector": {"a": 1, "b": 1}, "k": 3},
        {"config_id": "CFG02", "vector": {"a": 0, "b": 1}, "k": 5, "l": 2, "limit": 0.05, "pair": "CFG01"},
    ]
    schema.catalogue([AnonConfig(**c) for c in good], TINY)
    good[place] |= change
    with pytest.raises(ContractError) as e:
        schema.catalogue([AnonConfig(**c) for c in good], TINY)
    assert e.value.code == code


def test_the_study_is_a_closed_catalogue():
    from maskwright.sources import fixture

    assert schema.catalogue(fixture.CONFIGS, SPEC) is fixture.CONFIGS
    with pytest.raises(ContractError):
        schema.catalogue([], SPEC)


def test_bundles_are_bound_to_each_other_and_the_source(spark, tmp_path, study):
    small = study.released_rows.filter("config_id in ('CFG01', 'CFG02')")
    configs = study.configs.filter("config_id in ('CFG01', 'CFG02')")
    writers.by_config(small, f"{tmp_path}/good")
    assert readers.bundles(spark, f"{tmp_path}/good", configs, study.md, "rid", "sens").count() == 2 * study.md.count()
    bad = {
        "BUNDLE_SET": (small.filter("config_id = 'CFG01'"), configs), "BUNDLE_ROWS": (small.filter("rid % 5 <> 0 or config_id = 'CFG01'"), configs),
        "BUNDLE_TARGET": (small.withColumn("sens", F.when(F.col("rid") % 7 == 0, "other").otherwise(F.col("sens"))), configs), "BUNDLE_VECTOR": (small, configs.withColumn("lv_num", F.lit(9))),
    }
    for code, (rows, declared) in bad.items():
        writers.by_config(rows, f"{tmp_path}/{code}")
        with pytest.raises(ContractError) as e:
            readers.bundles(spark, f"{tmp_path}/{code}", declared, study.md, "rid", "sens")
        assert e.value.code == code
    twice = validation.binding(small.unionByName(small), configs, study.md, "rid", "sens").first()
    assert twice["repeated"] == study.md.count()


def test_predictions_are_admitted_only_if_they_fit_the_holdout(spark):
    holdout = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "row_id long, y int")
    rows = [("good", 1, 0, 0.0), ("good", 2, 1, 1.0), ("good", 3, 1, 0.5), ("bad", 1, 1, 0.5), ("bad", 2, 1, 1.5), ("bad", 2, 1, None), ("bad", 9, 0, 0.1)]
    found = {r["m"]: tuple(r)[1:] for r in validation.admission(spark.createDataFrame(rows, "m string, row_id long, y int, p double"), holdout, "m", "row_id").collect()}
    assert found == {"good": (0, 0, 0, 0, 0), "bad": (1, 1, 1, 1, 2)}


def test_stages_go_on_where_they_stopped_and_are_verified(spark, tmp_path):
    calls = []

    def step(n):
        return lambda before: calls.append(n) or (spark.range(5) if before is None else before.selectExpr(f"id + {n} as id"))

    steps = [("first", step(0)), ("second", step(1))]
    for _ in range(2):
        assert writers.stages(steps, f"{tmp_path}/s", spark).agg(F.sum("id")).first()[0] == 15
    assert calls == [0, 1]
    assert writers.stages(steps, f"{tmp_path}/s", spark, verify=True).count() == 5 and calls == [0, 1, 0, 1]
    with pytest.raises(ContractError) as e:
        writers.stages([steps[0], ("second", step(2))], f"{tmp_path}/s", spark, verify=True)
    assert e.value.code == "CHECKPOINT_DIFFERS"


def test_stages_are_made_again_below_what_changed(spark, tmp_path):
    calls = []

    def step(name):
        return lambda before, add=0: calls.append(name) or before.selectExpr(f"id + {add} as id")

    def run(inputs, adds=(1, 2, 3), version="1"):
        calls.clear()
        steps = [(name, step(name), {"add": add}) for name, add in zip("abc", adds, strict=True)]
        return writers.stages(steps, f"{tmp_path}/s", spark, version=version, inputs=inputs).agg(F.sum("id")).first()[0], "".join(calls)

    four = spark.range(4)
    assert run(four) == (30, "abc") and run(four.repartition(3)) == (30, "")
    assert run(four, (1, 5, 3)) == (42, "bc") and run(four, (1, 2, 4)) == (34, "c")
    assert run(spark.range(5)) == (40, "abc") and run(four, version="2") == (30, "abc") and run(four) == (30, "")


@pytest.mark.parametrize("block", ["64b", "1000b", "128m"])
def test_lines_are_numbered_over_splits_and_files(spark, tmp_path, block):
    for k, n in enumerate((500, 0, 1, 137)):
        (tmp_path / f"part-{k}").write_text("".join(f"{k}:{i}{'x' * (i * 7 % 90)}\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        got = sorted((r["line_no"], r["line"].rstrip("x")) for r in readers.lines(spark, str(tmp_path)).collect())
        assert readers.lines(spark, f"{tmp_path}/part-1").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == list(enumerate([f"{k}:{i}" for k, n in enumerate((500, 0, 1, 137)) for i in range(n)], 1))


def test_validation_report_is_enforced(spark):
    found = validation.report([("GOOD", spark.range(0).agg(F.count("*"))), ("BAD", spark.range(2).agg(F.count("*")))])
    with pytest.raises(ContractError) as e:
        validation.enforce(found)
    assert e.value.code == "BAD"
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string"), spark.createDataFrame([(1, "z"), (1, "z"), (3, None)], "k long, v string")
    assert validation.alignment(a, b, "k", "v").first()[:] == (1, 1, 1, 1)
    assert validation.multiset_difference(a.select("k"), b.select("k")).first()[:] == (1, 2)


def test_readers(spark, tmp_path):
    census = ", ".join("39 State-gov 1 Bachelors 13 Never-married Adm ? White Male 0 0 40 US".split()) + ", <=50K.\n"
    (tmp_path / "t").write_text("|1x3 Cross validator\n" + census + "\n")
    got = readers.census(spark, f"{tmp_path}/t", "adult.test", test=True).first()
    assert got["rid"] == "adult.test:2" and got["salary_class"] == "<=50K" and got["relationship"] == "?"
    for name, text in (("t1", census), ("t2", census + "\n" + census + "\n"), ("t3", census + "\n\n")):
        (tmp_path / name).write_text("|1x3 Cross validator\n" + text)
        with pytest.raises(ContractError) as e:
            readers.census(spark, f"{tmp_path}/{name}", "adult.test", test=True)
        assert e.value.code == "TRAILING_BLANK"
    (tmp_path / "h").write_text("a;g;*\nb;g;*\n")
    assert readers.hierarchy(spark, f"{tmp_path}/h", "x", 3).count() == 6
    (tmp_path / "p").write_text("2\n0\n1\n")
    assert [r["value"] for r in readers.permutation(spark, f"{tmp_path}/p").orderBy("place").collect()] == [2, 0, 1]
    (tmp_path / "q").write_text("2\n2\n1\n")
    with pytest.raises(ContractError):
        readers.permutation(spark, f"{tmp_path}/q")
    (tmp_path / "s").write_text("x;y\n1;2\n3;4\n")
    assert readers.strict_table(spark, f"{tmp_path}/s", ["x", "y"]).count() == 2
    with pytest.raises(ContractError):
        readers.strict_table(spark, f"{tmp_path}/s", ["x", "z"])
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("m", "hello")
    assert readers.zip_members(spark, f"{tmp_path}/z.zip", ["m"]).first()["content"] == b"hello"
    assert readers.strict_json(b'{"a":1,"b":[2]}\n') == {"a": 1, "b": [2]}
    for bad in (b'{"a":1,"a":1}\n', b'{"a": 1}\n', b'{"a":NaN}\n'):
        with pytest.raises(ContractError):
            readers.strict_json(bad)
    catalog_ = readers.Catalog({"x": got})
    catalog_.read("x")
    with pytest.raises(ContractError):
        catalog_.read("x")


def test_sinks(spark, tmp_path):
    frame = spark.createDataFrame([("C1", None, 0.5), ("C2", 3, 1.0)], "config_id string, n long, v double")
    writers.family(frame, f"{tmp_path}/f", 2)
    assert "NA" in {r["n"] for r in spark.read.option("header", True).csv(f"{tmp_path}/f").collect()}
    with pytest.raises(ContractError):
        writers.family(frame.withColumn("rid", F.lit(1)), f"{tmp_path}/g")
    with pytest.raises(ContractError):
        export.public(frame.select(F.struct(F.lit(1).alias("rid")).alias("nested")))
    out = writers.PublicWriter(f"{tmp_path}/w", {"a"})
    out("a", frame)
    with pytest.raises(ContractError):
        out("a", frame)
    out.finish()
    calls = []
    for _ in range(2):
        writers.checkpointed(lambda: calls.append(1) or frame, f"{tmp_path}/c", spark).count()
    assert len(calls) == 1
    writers.canonical_table(frame, f"{tmp_path}/t", ["config_id", "v"], "config_id")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/t").collect()] == ["config_id;v", "C1;0.5", "C2;1.0"]


def test_stream_monitor(spark, tmp_path):
    from maskwright.streaming import monitor

    events = spark.read.parquet(f"{SF}/events.parquet").select("ts", "event_type")
    events.write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e")
    job = monitor.class_counts(stream, "ts", ["event_type"]).writeStream.outputMode("complete").format("memory").queryName("monitor").start()
    job.processAllAvailable()
    job.stop()
    want = monitor.class_counts(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"])
    assert spark.table("monitor").exceptAll(want).count() == 0


@pytest.mark.parametrize("name", ["equivalence_classes", "privacy_gate", "success_coverage", "utility_point", "lattice_optimum"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "orders", "lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = con.sql(catalog.SQL[name])
    columns = sorted(result.columns)
    want = sorted(repr([f"{v:.9g}" if isinstance(v, float) else v for _, v in sorted(zip(result.columns, row, strict=True))]) for row in result.fetchall())
    got = sorted(repr([f"{r[c]:.9g}" if isinstance(r[c], float) else r[c] for c in columns]) for r in catalog.QUERIES[name](spark, SF).collect())
    assert got == want


def test_roles():
    assert schema.QuasiIdentifierSpec(("a",), {"a": 2}, "s", "1", "r").lattice() == [(0,), (1,), (2,)]
    assert len(SPEC.lattice()) == 540 and privacy.labels(SPEC)[0] == "g_num"
    with pytest.raises(ContractError):
        QuasiIdentifierSpec(("a",), {"a": 1}, "a", "1", "r")


def test_the_encoder_is_fitted_on_all_retained_training_rows(spark):
    from types import SimpleNamespace

    rows = [(1, "train", "1", False), (2, "train", "2", False), (3, "train", "3", True), (4, "holdout", "1", False), (5, "holdout", "2", False), (6, "holdout", "3", False), (7, "holdout", "4", False)]
    released = spark.createDataFrame([("X", *r[:2], r[3], *[r[2]] * len(catalog.QI)) for r in rows], ", ".join(["config_id string, rid long, split string, is_outlier boolean", *[f"g_{q} string" for q in catalog.QI]]))
    found = catalog._unknown(SimpleNamespace(released_rows=released)).collect()
    assert len(found) == len(catalog.QI)
    assert {(r["fitted"], r["unknown_categories"], r["unknown_rows"], r["unknown_rate"]) for r in found} == {(2, 2, 2, 0.5)}
