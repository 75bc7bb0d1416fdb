"""The frames of the study over the star-schema tables, each built when asked for."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bootstrap, disclosure, fits, hierarchy, privacy, schema, structure, utility
from ..operators.lattice import cell_losses
from ..sources import fixture, readers
from ..sources.writers import shared, shared_folder

SPEC, NUM = fixture.SPEC, "num"
CLUSTER_KEYS = ["num", "segment", "status", "nation"]
SCORE_KEYS = ["g_num", "g_nation", "g_status"]


class Study:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = fixture.table(self.spark, self.sf_dir, name)
        return self._tables[name]

    @cached_property
    def md(self) -> DataFrame:
        return fixture.microdata(*map(self.table, ("orders", "customer", "nation")))

    @cached_property
    def hier(self) -> DataFrame:
        """Declared domains: a local relation of some hundred rows."""
        return fixture.hierarchies(self.spark, *map(self.table, ("nation", "region")))

    @cached_property
    def configs(self) -> DataFrame:
        return schema.configurations(self.spark, SPEC, fixture.CONFIGS)

    @cached_property
    def sig(self) -> DataFrame:
        """Distinct value combinations with their numbers; every measure of classes starts here."""
        return shared(privacy.signature(self.md, SPEC, "split"))

    @cached_property
    def generalized(self) -> DataFrame:
        return privacy.generalized(self.sig, self.hier, self.configs, SPEC)

    @cached_property
    def all_classes(self) -> DataFrame:
        return shared(privacy.classes(self.generalized, SPEC))

    @cached_property
    def classes(self) -> DataFrame:
        """Equivalence classes of what is published."""
        return privacy.retained(self.all_classes)

    @cached_property
    def many_rows(self) -> DataFrame:
        """Value combinations with the priority as sensitive column, recoded for each of its configurations."""
        configs = schema.configurations(self.spark, fixture.MANY, schema.catalogue(fixture.MANY_CONFIGS, fixture.MANY))
        return privacy.generalized(shared(privacy.signature(self.md, fixture.MANY)), self.hier, configs, fixture.MANY)

    @cached_property
    def many_classes(self) -> DataFrame:
        return shared(privacy.classes(self.many_rows, fixture.MANY))

    @cached_property
    def released(self) -> DataFrame:
        """Value combinations, recoded, with their number ``w`` and whether they are suppressed."""
        return privacy.with_outliers(self.generalized, self.all_classes, SPEC)

    @cached_property
    def released_rows(self) -> DataFrame:
        """The same for each row of the table, for what needs row ids."""
        rows = privacy.generalized(self.md.withColumn("w", F.lit(1)), self.hier, self.configs, SPEC)
        return privacy.with_outliers(rows, self.all_classes, SPEC)

    @cached_property
    def released_targets(self) -> DataFrame:
        rows = privacy.generalized(self.targets.withColumn("w", F.lit(1)), self.hier, self.configs, SPEC)
        return privacy.with_outliers(rows, self.all_classes, SPEC)

    @cached_property
    def cells(self) -> DataFrame:
        return hierarchy.local(cell_losses(self.hier))

    @cached_property
    def sizes(self) -> DataFrame:
        return self.classes.groupBy("config_id").agg(F.sum("n").alias("n_c"))

    @cached_property
    def targets(self) -> DataFrame:
        """A sample of fixed size."""
        return hierarchy.local(disclosure.target_sample(self.md, SPEC.row_id, fixture.TARGETS))

    @cached_property
    def pmf(self) -> DataFrame:
        return hierarchy.local(disclosure.scenario_pmf(self.spark, fixture.SCENARIOS))

    @cached_property
    def noise(self) -> DataFrame:
        return disclosure.age_noise(self.targets, fixture.SCENARIOS, fixture.DRAWS)

    @cached_property
    def compat(self) -> DataFrame:
        return hierarchy.local(disclosure.age_compat(self.hier, self.pmf, NUM))

    @cached_property
    def groups(self) -> DataFrame:
        return disclosure.groups(self.classes, SPEC, fixture.SCENARIOS, NUM)

    @cached_property
    def seen(self) -> DataFrame:
        return disclosure.observations(self.released_targets, self.noise, SPEC, fixture.SCENARIOS, NUM)

    @cached_property
    def scores(self) -> DataFrame:
        return disclosure.scores(self.seen, self.groups, self.compat, SPEC, NUM)

    @cached_property
    def won(self) -> DataFrame:
        return disclosure.winners(self.scores, self.seen, SPEC, NUM)

    @cached_property
    def done(self) -> DataFrame:
        return disclosure.success(self.won, disclosure.truth_of(self.released_targets, NUM), NUM)

    @cached_property
    def control(self) -> DataFrame:
        permuted = disclosure.permuted_truth(self.released_rows, self.released_targets, fixture.TARGETS, SPEC, NUM)
        return disclosure.permuted_success(self.won, permuted, SPEC, fixture.SCENARIOS, NUM)

    @cached_property
    def clusters(self) -> DataFrame:
        return bootstrap.clusters(self.targets, CLUSTER_KEYS)

    @cached_property
    def plan(self) -> DataFrame:
        return bootstrap.resampling_plan(self.targets, self.clusters.count(), fixture.REPLICATES)

    @cached_property
    def per_cluster(self) -> DataFrame:
        return bootstrap.cluster_success(disclosure.target_means(self.done), self.targets, self.clusters, CLUSTER_KEYS)

    @cached_property
    def boot(self) -> DataFrame:
        cells = [(s.scenario, c.config_id) for s in fixture.SCENARIOS for c in fixture.CONFIGS]
        return bootstrap.bootstrap_risk(self.per_cluster, self.plan, cells)

    @cached_property
    def pairs(self) -> DataFrame:
        return self.spark.createDataFrame(sorted(fixture.PAIRS.items()), "config_id string, other string")

    def labelled(self, rows: DataFrame) -> DataFrame:
        named = {"row_id": F.col(SPEC.row_id)} if SPEC.row_id in rows.columns else {}
        return rows.withColumns({**named, "y": (F.col(SPEC.sensitive) == SPEC.positive).cast("int")})

    @cached_property
    def released_models(self) -> DataFrame:
        rows = self.labelled(self.released)
        return utility.rate_scores(rows.filter("split = 'train' and not is_outlier"), rows.filter("split = 'holdout'"), SCORE_KEYS, ["config_id"])

    @cached_property
    def counterfactual_models(self) -> DataFrame:
        rows = self.labelled(self.released)
        return utility.rate_scores(rows.filter("split = 'train'"), rows.filter("split = 'holdout'"), SCORE_KEYS, ["config_id"])

    @cached_property
    def score_cells(self) -> DataFrame:
        """Holdout rows by the scores that the releases' models give them."""
        rows = self.labelled(self.released).withColumn("key", F.xxhash64(*SPEC.names))
        scored = utility.rate_scores(rows.filter("split = 'train' and not is_outlier"), rows.filter("split = 'holdout'"), SCORE_KEYS, ["config_id"])
        return utility.score_cells(scored, "config_id")

    @cached_property
    def best_c(self) -> float:
        """The C that the folds of the raw training rows select."""
        return utility.best_c(self.c_means).first()["c"]

    @cached_property
    def c_means(self) -> DataFrame:
        rows = self.labelled(self.md.filter("split = 'train'"))
        return shared(utility.select_c(rows.select("row_id", "y", *[F.col(q).cast("string") for q in SPEC.names]), list(SPEC.names)))

    @cached_property
    def matrix_cells(self) -> DataFrame:
        """Recoded value combinations of every configuration's release and counterfactual model; the raw one has one model."""
        configs = schema.configurations(self.spark, SPEC, schema.catalogue(fixture.MATRIX, SPEC))
        recoded = privacy.generalized(self.sig, self.hier, configs, SPEC)
        rows = self.labelled(privacy.with_outliers(recoded, shared(privacy.classes(recoded, SPEC)), SPEC))
        both = F.array(F.lit("counterfactual"), F.lit("release"))
        kinds = F.when(F.col("config_id") == "CFG00", F.array(F.lit("release"))).when((F.col("split") == "holdout") | ~F.col("is_outlier"), both).otherwise(F.array(F.lit("counterfactual")))
        positive = F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0)).alias("pos")
        return shared(rows.withColumn("kind", F.explode(kinds)).groupBy("config_id", "kind", "split", *[F.col(f"g_{q}").alias(q) for q in SPEC.names]).agg(F.sum("w").alias("n"), positive))

    def fitted(self, cells: DataFrame | None = None) -> fits.Fits:
        """All models of the matrix, with the selected C."""
        train = (self.matrix_cells if cells is None else cells).filter("split = 'train'")
        return fits.fit(train, ["config_id", "kind"], list(SPEC.names), self.best_c)

    @cached_property
    def models(self) -> fits.Fits:
        return self.fitted()

    @cached_property
    def model_scores(self) -> DataFrame:
        """``config_id, kind, <attributes>, n, pos, p``: the holdout's value combinations with their scores."""
        return shared(self.models.score(self.matrix_cells.filter("split = 'holdout'")))

    @cached_property
    def boot_auroc(self) -> DataFrame:
        names = [c.config_id for c in sorted(fixture.CONFIGS, key=lambda c: c.config_id)]
        return utility.bootstrap_auroc(self.score_cells, names, "config_id", fixture.REPLICATES)

    @cached_property
    def tvd(self) -> DataFrame:
        return structure.tvd(self.released, SPEC)

    @cached_property
    def raw_lines(self) -> DataFrame:
        """Raw text rows with ``?`` for missing values, as a census file would hold them."""
        t = self.table("lineitem")
        flag = F.when(F.col("l_returnflag") == "N", "?").otherwise(F.col("l_returnflag"))
        cells = [F.col("l_orderkey"), F.col("l_linenumber"), flag, F.col("l_linestatus"), F.col("l_quantity").cast("int"), F.concat("l_linestatus", F.lit("."))]
        return t.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_no"), F.concat_ws(", ", *[c.cast("string") for c in cells]).alias("line"))

    @cached_property
    def file_lines(self) -> DataFrame:
        """The lines written to text files in their order, and read back by the reader, which numbers them."""
        path = f"{shared_folder(self.spark)}/lines-{uuid.uuid4()}"
        self.raw_lines.orderBy("line_no", "line").select("line").write.text(path)
        return readers.lines(self.spark, path)

    @cached_property
    def scanned(self) -> DataFrame:
        return self._cells(self.file_lines)

    @cached_property
    def parsed(self) -> DataFrame:
        return self._cells(self.raw_lines)

    @staticmethod
    def _cells(lines: DataFrame) -> DataFrame:
        cells = F.transform(F.split("line", ","), lambda c: F.trim(c))
        names = ("orderkey", "linenumber", "flag", "status", "quantity", "label")
        rows = lines.select("line_no", cells.alias("c"))
        return rows.select(F.concat_ws(":", F.lit("lineitem"), F.col("line_no").cast("string")).alias("rid"), "line_no", *[F.col("c")[k].alias(n) for k, n in enumerate(names)])

    def values(self) -> DataFrame:
        """``attr, value`` of every quasi-identifier of the data."""
        pairs = F.array(*[F.struct(F.lit(q).alias("attr"), F.col(q).cast("string").alias("value")) for q in SPEC.names])
        return self.md.select(F.explode(pairs).alias("p")).select("p.attr", "p.value").distinct()

    def sized_hier(self) -> DataFrame:
        return hierarchy.sized(self.hier)
