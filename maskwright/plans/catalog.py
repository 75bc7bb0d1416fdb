"""Registry of the engine's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.prng import keyed_hash
from ..functions.scalars import ratio
from ..operators import bootstrap, disclosure, export, hierarchy, lattice, privacy, ranking, structure, utility, validation
from ..sources import fixture
from ..sources.writers import shared
from ..streaming import monitor
from .oracle import BOOT, KEYS, MG, MQ, PRE, QI, VALUES, G, big, block, div, label_case
from .study import CLUSTER_KEYS, NUM, SPEC, Study

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Vector of the single-release queries, in the quasi-identifiers' order.
VECTOR = dict(zip(QI, (3, 1, 1, 2, 2, 1), strict=True))
K, LIMIT, T = 5, 0.05, 0.2
#: Queries whose results are published.
FAMILIES = (
    "privacy_summary", "equivalence_classes", "ec_histogram", "ec_size_quantiles", "structural_summary", "tvd_summary", "tvd_marginal", "marginal_profiles", "suppression_profile", "class_counts_pivot", "info_loss",
    "risk_points_and_controls", "risk_matrix", "success_coverage", "tie_summary", "tie_histogram", "attack_counts", "risk_intervals", "endpoint_sign", "utility_point", "delta_auroc_interval", "prior_baseline", "ohe_model_summary", "pareto_front",
)


def query(sql: str | None = None):
    def register(f: Callable[[Study], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Study(spark, sf_dir))
        if sql is not None:
            SQL[f.__name__] = (PRE.replace("WITH", "WITH RECURSIVE", 1) if sql.startswith(BOOT) else PRE) + sql
        return f

    return register


def queries():
    return QUERIES


def oracle_sql():
    return SQL


def entry(spark: SparkSession) -> DataFrame:
    return QUERIES["privacy_summary"](spark, "/root/testdata/sf0.001")


# ---- scans and cleaning -------------------------------------------------------------------------


_FILED = "(SELECT * EXCLUDE (line_no), row_number() OVER (ORDER BY line_no, concat_ws(', ', orderkey, linenumber, flag, status, quantity, label)) AS line_no FROM raw)"


@query(f"SELECT line_no, orderkey, linenumber, flag, status, quantity, label FROM {_FILED}")
def src_scan(s):
    return s.scanned.drop("rid")


@query(f"SELECT 'lineitem:' || line_no AS rid, line_no FROM {_FILED}")
def src_rid_assign(s):
    return s.scanned.select("rid", "line_no")


@query("SELECT line_no, length(flag) > 0 AND flag = trim(flag) AND flag <> '?' AS flag_clean, length(label) > 0 AND label = trim(label) AND label <> '?' AS label_clean FROM raw")
def src_strict_cells(s):
    return s.parsed.select("line_no", scalars.cell_is_clean(F.col("flag")).alias("flag_clean"), scalars.cell_is_clean(F.col("label")).alias("label_clean"))


_PUBLISHED = "(SELECT rid FROM (SELECT rid, md5('11002|' || rid) AS perm_hash FROM md))"


@query(f"SELECT (SELECT count(*) FROM (SELECT DISTINCT rid FROM md EXCEPT SELECT rid FROM {_PUBLISHED})) AS only_a, (SELECT count(*) FROM (SELECT rid FROM {_PUBLISHED} EXCEPT SELECT rid FROM md)) AS only_b, (SELECT count(*) FROM (SELECT rid FROM md GROUP BY rid HAVING count(*) > 1)) AS repeated")
def src_bijection_check(s):
    return validation.bijection(s.md, disclosure.publish_order(s.md, "rid"), "rid")


@query("SELECT line_no, orderkey, status FROM raw WHERE flag <> '?'")
def complete_case(s):
    return validation.complete_cases(s.parsed, ["orderkey", "linenumber", "flag", "status", "quantity", "label"]).select("line_no", "orderkey", "status")


@query("SELECT status, flag, quantity, 'lineitem:' || line_no AS rid FROM raw WHERE flag <> '?'")
def project_reorder(s):
    return validation.complete_cases(s.parsed, ["flag"]).select("status", "flag", "quantity", "rid")


@query("SELECT line_no, regexp_replace(label, '\\.$', '') AS label FROM raw")
def label_strip(s):
    return s.parsed.select("line_no", validation.strip_period(F.col("label")).alias("label"))


@query("SELECT rid, CASE WHEN sens = '>T' THEN 1 ELSE 0 END AS y FROM md")
def label_encode(s):
    return s.labelled(s.md).select("rid", "y")


@query("SELECT field, count(*) AS rows, count(*) FILTER (WHERE v = '?') AS missing FROM (SELECT 'flag' AS field, flag AS v FROM raw UNION ALL SELECT 'status', status FROM raw UNION ALL SELECT 'quantity', quantity FROM raw) GROUP BY 1")
def missing_profile(s):
    return validation.missing_profile(s.parsed, ["flag", "status", "quantity"])


@query("SELECT field, count(*) FILTER (WHERE v = '?') AS violations FROM (SELECT 'flag' AS field, flag AS v FROM raw UNION ALL SELECT 'label', label FROM raw) GROUP BY 1")
def cell_rule_violations(s):
    return validation.cell_violations(s.parsed, ["flag", "label"])


@query(
    "SELECT part, count(*) FILTER (WHERE n <= before) AS not_increasing, CAST(0 AS BIGINT) AS malformed FROM (SELECT line_no AS n, CAST(orderkey AS BIGINT) % 4 AS part, lag(line_no) OVER (PARTITION BY CAST(orderkey AS BIGINT) % 4 ORDER BY quantity, line_no) AS before FROM raw) GROUP BY 1"
)
def rid_order_check(s):
    rows = s.parsed.select("rid", (F.col("orderkey").cast("long") % 4).alias("part"), F.struct("quantity", "line_no").alias("place"))
    return validation.rid_order(rows, "rid", "place", "part")


@query(f"SELECT count(*) AS rows, {', '.join(f'count(DISTINCT {q}) AS d_{q}' for q in QI)}, count(*) FILTER (WHERE sens = '>T') AS positive, count(*) FILTER (WHERE sens <> '>T') AS negative FROM md")
def table_metrics(s):
    positive = F.col("sens") == ">T"
    return s.md.agg(F.count(F.lit(1)).alias("rows"), *[F.countDistinct(q).alias(f"d_{q}") for q in QI], F.sum(positive.cast("long")).alias("positive"), F.sum((~positive).cast("long")).alias("negative"))


@query("""SELECT 'QI_COVERAGE' AS code, (SELECT count(*) FROM vals WHERE (attr, value) NOT IN (SELECT (attr, leaf) FROM hier)) AS violations
UNION ALL SELECT 'RID_UNIQUE', (SELECT count(*) - count(DISTINCT rid) FROM md)
UNION ALL SELECT 'CELL_CLEAN', (SELECT count(*) FROM raw WHERE flag = '?')
UNION ALL SELECT 'RELEASE_SIZE', (SELECT count(*) FROM (SELECT config_id FROM rel GROUP BY 1 HAVING count(*) <> (SELECT count(*) FROM md)))
UNION ALL SELECT 'BUDGET', (SELECT count(*) FROM (SELECT config_id FROM rel GROUP BY config_id, lim HAVING count(*) FILTER (WHERE is_outlier) > floor(count(*) * round(lim * 1000000) / 1000000)))""")
def validation_report(s):
    n = F.count(F.lit(1))
    total = s.md.agg(n.alias("t"))
    sizes = s.all_classes.groupBy("config_id", "lim").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("fails"), F.col("n")).otherwise(0)).alias("out"))
    return validation.report([
        ("QI_COVERAGE", hierarchy.uncovered(s.values(), s.hier).agg(n)),
        ("RID_UNIQUE", s.md.groupBy("rid").agg((n - 1).alias("x")).agg(F.coalesce(F.sum("x"), F.lit(0)))),
        ("CELL_CLEAN", s.parsed.filter(~scalars.cell_is_clean(F.col("flag"))).agg(n)),
        ("RELEASE_SIZE", sizes.join(F.broadcast(total)).filter("n <> t").agg(n)),
        ("BUDGET", sizes.filter(F.col("out") > F.floor(F.col("n") * F.round(F.col("lim") * 1000000).cast("long") / 1000000)).agg(n)),
    ])


@query("SELECT count(*) FILTER (WHERE b.rid IS NULL) AS only_a, count(*) FILTER (WHERE a.rid IS NULL) AS only_b, CAST(0 AS BIGINT) AS repeated, count(*) FILTER (WHERE a.rid IS NOT NULL AND b.rid IS NOT NULL AND a.sens <> b.sens) AS differing FROM (SELECT rid, sens FROM md) a FULL JOIN (SELECT rid, CASE WHEN rid % 7 = 0 THEN '<=T' ELSE sens END AS sens FROM md WHERE rid % 11 <> 0) b ON a.rid = b.rid")
def alignment_mismatches(s):
    other = s.md.filter("rid % 11 <> 0").select("rid", F.when(F.col("rid") % 7 == 0, "<=T").otherwise(F.col("sens")).alias("sens"))
    return validation.alignment(s.md.select("rid", "sens"), other, "rid", "sens")


@query(f"""SELECT config_id, true AS declared, true AS present, count(*) - count(md.rid) AS unbound, count(*) - count(DISTINCT rel.rid) AS repeated, greatest((SELECT count(DISTINCT rid) FROM md) - count(DISTINCT rel.rid), 0) AS lacking,
  count(*) FILTER (WHERE md.rid IS NOT NULL AND rel.sens IS DISTINCT FROM md.sens) AS target_mismatches, count(*) FILTER (WHERE {' OR '.join(f'rel.lv_{q} <> cfg.lv_{q}' for q in QI)}) AS vector_mismatches
  FROM rel LEFT JOIN md USING (rid) JOIN cfg USING (config_id) GROUP BY 1""")
def bundle_binding(s):
    """Every release against the source and its declared configuration."""
    return validation.binding(s.released_rows, s.configs, s.md, "rid", "sens")


_CODES = {
    "LINES_NUMBERED": "SELECT count(*) - count(DISTINCT line_no) FROM raw",
    "FIELD_COUNT": "SELECT count(*) FROM raw WHERE orderkey IS NULL OR linenumber IS NULL OR flag IS NULL OR status IS NULL OR quantity IS NULL OR label IS NULL",
    "MISSING_FLAGS": "SELECT count(*) FROM raw WHERE flag = '?'",
    "LABEL_PERIOD": "SELECT count(*) FROM raw WHERE NOT ends_with(label, '.')",
    "ROW_ID_UNIQUE": "SELECT count(*) - count(DISTINCT rid) FROM md",
    "SPLIT_DISJOINT": "SELECT count(*) FROM (SELECT rid FROM md WHERE split = 'train' INTERSECT SELECT rid FROM md WHERE split = 'holdout')",
    "HIERARCHY_COVERAGE": "SELECT count(*) FROM vals WHERE (attr, value) NOT IN (SELECT (attr, leaf) FROM hier)",
    "HIERARCHY_FUNCTION": "SELECT count(*) FROM (SELECT 1 FROM hier a JOIN hier b ON a.attr = b.attr AND a.leaf = b.leaf AND b.level = a.level + 1 GROUP BY a.attr, a.level, a.label HAVING count(DISTINCT b.label) > 1)",
    "HIERARCHY_ROOT": "SELECT count(*) FROM (SELECT attr FROM hier WHERE level = (SELECT max(h.level) FROM hier h WHERE h.attr = hier.attr) GROUP BY attr HAVING count(DISTINCT label) <> 1)",
    "LATTICE_SIZE": f"SELECT abs(count(*) - {len(SPEC.lattice())}) FROM {{levels}}",
}


@query(" UNION ALL ".join(f"SELECT '{code}' AS code, CAST(({sql.format(levels=' CROSS JOIN '.join(f'(SELECT DISTINCT level AS v_{q} FROM hier WHERE attr = {chr(39)}{q}{chr(39)})' for q in QI))}) AS BIGINT) AS violations" for code, sql in _CODES.items()))
def source_preflight(s):
    """One report on the sources: lines and fields, row ids, splits, hierarchies and the lattice they span."""
    n = F.count(F.lit(1))
    fields = ["orderkey", "linenumber", "flag", "status", "quantity", "label"]
    top = s.hier.groupBy("attr").agg(F.max("level").alias("level"))
    roots = s.hier.join(F.broadcast(top), ["attr", "level"]).groupBy("attr").agg(F.countDistinct("label").alias("roots")).filter("roots <> 1")
    size = s.hier.groupBy("attr").agg(F.countDistinct("level").alias("levels")).agg(F.abs(F.product("levels") - len(SPEC.lattice())).cast("long"))
    train, holdout = (s.md.filter(F.col("split") == part).select("rid") for part in ("train", "holdout"))
    return validation.report([
        ("LINES_NUMBERED", s.parsed.groupBy("line_no").agg((n - 1).alias("x")).agg(F.coalesce(F.sum("x"), F.lit(0)))),
        ("FIELD_COUNT", s.parsed.filter(F.exists(F.array(*fields), lambda c: c.isNull())).agg(n)),
        ("MISSING_FLAGS", s.parsed.filter("flag = '?'").agg(n)),
        ("LABEL_PERIOD", s.parsed.filter(~F.col("label").endswith(".")).agg(n)),
        ("ROW_ID_UNIQUE", s.md.groupBy("rid").agg((n - 1).alias("x")).agg(F.coalesce(F.sum("x"), F.lit(0)))),
        ("SPLIT_DISJOINT", train.intersect(holdout).agg(n)),
        ("HIERARCHY_COVERAGE", hierarchy.uncovered(s.values(), s.hier).agg(n)),
        ("HIERARCHY_FUNCTION", hierarchy.functional_violations(s.hier).agg(n)),
        ("HIERARCHY_ROOT", roots.agg(n)),
        ("LATTICE_SIZE", size),
    ])


# ---- hierarchies ---------------------------------------------------------------------------------


@query("SELECT attr, leaf, CAST(level AS INT) AS level, label FROM hier")
def hier_unpivot(s):
    paths = hierarchy.label_arrays(s.hier, QI[0]).select(F.lit(QI[0]).alias("attr"), "leaf", "labels")
    for q in QI[1:]:
        paths = paths.unionByName(hierarchy.label_arrays(s.hier, q).select(F.lit(q).alias("attr"), "leaf", "labels"))
    return paths.select("attr", "leaf", F.posexplode("labels").alias("level", "label"))


@query("SELECT attr, level, count(*) AS labels, max(parents) AS most_parents, count(*) FILTER (WHERE parents > 1) AS violations FROM (SELECT a.attr, CAST(a.level AS INT) AS level, a.label, count(DISTINCT b.label) AS parents FROM hier a JOIN hier b ON a.attr = b.attr AND a.leaf = b.leaf AND b.level = a.level + 1 GROUP BY 1, 2, 3) GROUP BY 1, 2")
def hier_functional_check(s):
    up = s.hier.select("attr", "leaf", (F.col("level") - 1).alias("level"), F.col("label").alias("parent"))
    per = s.hier.join(up, ["attr", "leaf", "level"]).groupBy("attr", "level", "label").agg(F.countDistinct("parent").alias("parents"))
    return per.groupBy("attr", "level").agg(F.count(F.lit(1)).alias("labels"), F.max("parents").alias("most_parents"), F.sum((F.col("parents") > 1).cast("long")).alias("violations"))


@query("SELECT attr, CAST(level AS INT) AS level, count(DISTINCT label) AS nodes FROM hier GROUP BY 1, 2")
def hier_nodes_per_level(s):
    return hierarchy.nodes_per_level(s.hier)


@query("SELECT attr, value FROM vals v WHERE NOT EXISTS (SELECT 1 FROM hier h WHERE h.attr = v.attr AND h.leaf = v.value AND NOT (h.attr = 'num' AND CAST(h.leaf AS VARCHAR) IN ('7', '8')))")
def hier_coverage_anti(s):
    short = s.hier.filter("not (attr = 'num' and leaf in ('7', '8'))")
    return hierarchy.uncovered(s.values(), short)


@query("SELECT attr, leaf AS value FROM hier WHERE level = 0 EXCEPT SELECT attr, value FROM vals")
def hier_unused_except(s):
    return hierarchy.unused(s.values(), s.hier)


@query("SELECT leaf, CAST(level AS INT) AS level, CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || '-' || hi END AS label FROM (SELECT leaf, level, min(CAST(leaf AS INT)) OVER w AS lo, max(CAST(leaf AS INT)) OVER w AS hi FROM hier WHERE attr = 'num' WINDOW w AS (PARTITION BY level, label))")
def hier_interval_relabel(s):
    return hierarchy.interval_relabel(s.hier, NUM)


_BLOCKS = "SELECT level, string_agg(leaf, ',' ORDER BY leaf) AS block FROM ({}) GROUP BY level, label"
_RAW_BLOCKS = _BLOCKS.format("SELECT leaf, level, label FROM hier WHERE attr = 'num'")
_NEW_BLOCKS = _BLOCKS.format("SELECT leaf, level, min(CAST(leaf AS INT)) OVER w || '-' || max(CAST(leaf AS INT)) OVER w AS label FROM hier WHERE attr = 'num' WINDOW w AS (PARTITION BY level, label)")


@query(f"SELECT CAST(level AS INT) AS level, count(*) AS blocks, coalesce(any_value(d), 0) AS differing FROM ({_RAW_BLOCKS}) LEFT JOIN (SELECT level, count(*) AS d FROM (({_RAW_BLOCKS} EXCEPT ALL {_NEW_BLOCKS}) UNION ALL ({_NEW_BLOCKS} EXCEPT ALL {_RAW_BLOCKS})) GROUP BY 1) USING (level) GROUP BY 1")
def hier_partition_equiv(s):
    raw = s.hier.filter(F.col("attr") == NUM).select("leaf", "level", "label")
    derived = hierarchy.interval_relabel(s.hier, NUM)
    differing = hierarchy.partition_difference(raw, derived).groupBy("level").agg(F.count(F.lit(1)).alias("d"))
    blocks = hierarchy.partition_blocks(raw).groupBy("level").agg(F.count(F.lit(1)).alias("blocks"))
    return blocks.join(differing, "level", "left").select("level", "blocks", F.coalesce("d", F.lit(0)).alias("differing"))


@query("SELECT attr, CAST(level AS INT) AS level, label, leaves FROM leafset")
def hier_leafsets(s):
    return hierarchy.leafsets(s.hier)


@query(f"SELECT rid, sens, {', '.join(f'{label_case(q, str(VECTOR[q]))} AS {q}' for q in QI)} FROM md")
def generalize_rows(s):
    return hierarchy.generalize(s.md, s.hier, VECTOR, SPEC).select("rid", "sens", *QI)


_LEVELS = " CROSS JOIN ".join(f"(SELECT unnest(range(0, {SPEC.heights[q] + 1})) AS l_{q})" for q in QI)
_NODE = " || '.' || ".join(f"l_{q}" for q in QI)


@query(f"SELECT {_NODE} AS node, CAST({' + '.join(f'l_{q}' for q in QI)} AS INT) AS height FROM {_LEVELS}")
def lattice_nodes(s):
    frame = s.spark.range(1)
    for q in QI:
        frame = frame.withColumn(f"l_{q}", F.explode(F.sequence(F.lit(0), F.lit(SPEC.heights[q]))))
    return frame.select(F.concat_ws(".", *[F.col(f"l_{q}").cast("string") for q in QI]).alias("node"), sum((F.col(f"l_{q}") for q in QI[1:]), F.col(f"l_{QI[0]}")).alias("height"))


_SIG = f"sig AS (SELECT {', '.join(QI)}, region, count(*) AS n, count(*) FILTER (WHERE sens = '>T') AS n_pos FROM md GROUP BY ALL)"
_CLASSES = f"""lc AS (SELECT node, {G}, {big('sum(n)')} AS n, {big('sum(n_pos)')} AS n_pos FROM (
  SELECT {_NODE} AS node, n, n_pos, {', '.join(f'{label_case(q, f"l_{q}")} AS g_{q}' for q in QI)} FROM sig CROSS JOIN {_LEVELS}) GROUP BY node, {G})"""


@query(f", {_SIG}, {_CLASSES} SELECT node, count(*) AS n_classes, min(n) AS min_class, {big(f'coalesce(sum(n) FILTER (WHERE n < {K}), 0)')} AS suppressed, coalesce(sum(n) FILTER (WHERE n < {K}), 0) = 0 AS admissible_0, coalesce(sum(n) FILTER (WHERE n < {K}), 0) <= floor(sum(n) * 0.05) AS admissible_5 FROM lc GROUP BY node")
def lattice_check(s):
    found = lattice.classes(lattice.signature(s.md, s.hier, SPEC), SPEC.lattice(), SPEC)
    total = s.md.agg(F.count(F.lit(1)).alias("total"))
    got = lattice.check(found, lattice.failing(K)).join(F.broadcast(total))
    return got.select("node", "n_classes", "min_class", "suppressed", (F.col("suppressed") == 0).alias("admissible_0"), (F.col("suppressed") <= F.floor(F.col("total") * 0.05)).alias("admissible_5"))


def _optimum_sql(bad: str, limit: float) -> str:
    return f""", {_SIG}, {_CLASSES}, ll AS (
  SELECT lc.*, {bad} AS bad, {', '.join(f'CAST(c_{q}.num AS DOUBLE) / c_{q}.den AS loss_{q}' for q in QI)} FROM lc CROSS JOIN whole {' '.join(f"JOIN cell c_{q} ON c_{q}.attr = '{q}' AND c_{q}.level = CAST(split_part(node, '.', {i + 1}) AS INT) AND c_{q}.label = g_{q}" for i, q in enumerate(QI))}
), nl AS (SELECT node, {big('coalesce(sum(n) FILTER (WHERE bad), 0)')} AS suppressed, sum(n) AS total, ({' + '.join(f"sum(CASE WHEN bad THEN n ELSE n * loss_{q} END)" for q in QI)}) / {len(QI)} / sum(n) AS loss FROM ll GROUP BY node)
SELECT node, suppressed, round(loss, 9) AS loss FROM nl WHERE suppressed <= floor(total * round({limit} * 1000000) / 1000000) ORDER BY round(loss, 12), {' + '.join(f"CAST(split_part(node, '.', {i + 1}) AS INT)" for i in range(len(QI)))}, node LIMIT 1"""


def _optimum(s, **models):
    best = lattice.optimum(lattice.signature(s.md, s.hier, SPEC), s.hier, SPEC, K, **models)
    rows = [] if best is None else [(lattice.node_name(best.node), best.suppressed, round(best.loss, 9))]
    return s.spark.createDataFrame(rows, "node string, suppressed long, loss double")


@query(_optimum_sql(f"n < {K}", LIMIT))
def lattice_optimum(s):
    return _optimum(s, limit=LIMIT)


@query(_optimum_sql(f"(n < {K} OR n_pos IN (0, n))", LIMIT))
def lattice_optimum_l(s):
    """The search under k-anonymity and distinct l-diversity (2)."""
    return _optimum(s, limit=LIMIT, l=2)


@query(_optimum_sql(f"(n < {K} OR CAST(abs(n_pos * whole_n - whole_pos * n) AS DOUBLE) > ({T} + 1e-9) * CAST(n AS DOUBLE) * whole_n)", LIMIT))
def lattice_optimum_t(s):
    """The search under k-anonymity and equal-distance t-closeness."""
    return _optimum(s, limit=LIMIT, t=T)


_VALUE_COUNTS = ", ".join(f"count(*) FILTER (WHERE priority = '{v}') AS c_{i}" for i, v in enumerate(fixture.PRIORITIES))
_VALUE_LEVELS = " CROSS JOIN ".join(f"(SELECT unnest(range(0, {fixture.MANY.heights[q] + 1})) AS l_{q})" for q in MQ)
_VALUE_NODE = " || '.' || ".join(f"l_{q}" for q in MQ)
_MANY_L, _MANY_T = 4, 0.3


@query(f""", vsig AS MATERIALIZED (SELECT {', '.join(MQ)}, region, count(*) AS n, {_VALUE_COUNTS} FROM md GROUP BY ALL
), vlc AS (SELECT node, {MG}, {big('sum(n)')} AS n, {', '.join(f'{big(f"sum(c_{i})")} AS c_{i}' for i in range(5))} FROM (SELECT {_VALUE_NODE} AS node, n, {', '.join(f'c_{i}' for i in range(5))}, {', '.join(f'{label_case(q, f"l_{q}")} AS g_{q}' for q in MQ)} FROM vsig CROSS JOIN {_VALUE_LEVELS}) GROUP BY node, {MG}
), vtot AS (SELECT {big('sum(n)')} AS total, {', '.join(f'{big(f"sum(c_{i})")} AS w_{i}' for i in range(5))} FROM vsig
), vll AS (
  SELECT vlc.*, n < {K} OR {' + '.join(f'(c_{i} > 0)::INT' for i in range(5))} < {_MANY_L} OR ({' + '.join(f'abs(c_{i}::HUGEINT * total - w_{i}::HUGEINT * n)::DOUBLE' for i in range(5))}) > 2 * ({_MANY_T} + 1e-9) * n::DOUBLE * total AS bad, {', '.join(f'CAST(c_{q}.num AS DOUBLE) / c_{q}.den AS loss_{q}' for q in MQ)}
  FROM vlc CROSS JOIN vtot {' '.join(f"JOIN cell c_{q} ON c_{q}.attr = '{q}' AND c_{q}.level = CAST(split_part(node, '.', {i + 1}) AS INT) AND c_{q}.label = g_{q}" for i, q in enumerate(MQ))}
), vnl AS (SELECT node, {big('coalesce(sum(n) FILTER (WHERE bad), 0)')} AS suppressed, sum(n) AS total, ({' + '.join(f"sum(CASE WHEN bad THEN n ELSE n * loss_{q} END)" for q in MQ)}) / {len(MQ)} / sum(n) AS loss FROM vll GROUP BY node)
SELECT node, suppressed, round(loss, 9) AS loss FROM vnl WHERE suppressed <= floor(total * round({LIMIT} * 1000000) / 1000000) ORDER BY round(loss, 12), {' + '.join(f"CAST(split_part(node, '.', {i + 1}) AS INT)" for i in range(len(MQ)))}, node LIMIT 1""")
def lattice_optimum_values(s):
    """The search under k, l and t with a sensitive column of five values."""
    best = lattice.optimum(lattice.signature(s.md, s.hier, fixture.MANY), s.hier, fixture.MANY, K, LIMIT, l=_MANY_L, t=_MANY_T)
    rows = [] if best is None else [(lattice.node_name(best.node), best.suppressed, round(best.loss, 9))]
    return s.spark.createDataFrame(rows, "node string, suppressed long, loss double")


@query()
def lattice_rollup(s):
    """The search over the 6,480 nodes of eight quasi-identifiers, with what rolling classes up has spared."""
    rows = fixture.wide_microdata(s.md, s.table("orders"))
    hier = fixture.hierarchies(s.spark, s.table("nation"), s.table("region"), wide=True)
    best = lattice.optimum(lattice.signature(rows, hier, fixture.WIDE), hier, fixture.WIDE, K, LIMIT)
    found = [] if best is None else [(lattice.node_name(best.node), best.suppressed, round(best.loss, 9), best.evaluated, best.rows_read, best.rows_from_leaves, best.cuboids)]
    return s.spark.createDataFrame(found, "node string, suppressed long, loss double, evaluated long, rows_read long, rows_from_leaves long, cuboids long")


@query(f"SELECT config_id, round(avg(loss), 9) AS loss FROM (SELECT config_id, attr, {div('sum(CASE WHEN is_outlier THEN den ELSE cell.num END)', 'sum(den)')} AS loss FROM (SELECT config_id, is_outlier, unnest([{', '.join(repr(q) for q in QI)}]) AS attr, unnest([{', '.join(f'lv_{q}' for q in QI)}]) AS level, unnest([{', '.join(f'g_{q}' for q in QI)}]) AS label FROM rel) JOIN cell USING (attr, level, label) GROUP BY 1, 2) GROUP BY 1")
def info_loss(s):
    return structure.info_loss(s.all_classes, s.cells, SPEC)


@query(f"SELECT config_id, round(({' + '.join(f'lv_{q} / {SPEC.heights[q]}.0::DOUBLE' for q in QI)}) / {len(QI)}.0::DOUBLE, 9) AS intensity FROM cfg")
def generalization_intensity(s):
    return structure.intensity(s.configs, SPEC)


@query("SELECT config_id, CASE WHEN is_outlier THEN 'suppressed' WHEN lv_num >= 1 THEN 'generalised' ELSE 'exposed' END AS fate, count(*) AS rows FROM rel WHERE num IN (SELECT num FROM md GROUP BY 1 HAVING count(*) <= 120) GROUP BY 1, 2")
def rare_value_fate(s):
    return structure.rare_value_fate(s.sig, s.released, NUM, 120)


# ---- privacy ---------------------------------------------------------------------------------------


@query(f"SELECT config_id, {G}, n, n_pos, n_sens FROM rc")
def equivalence_classes(s):
    return s.classes.drop("k", "lim", "l", "t", "fails", *[f"lv_{q}" for q in QI])


@query(f"SELECT config_id, convention, count(*) AS classes, {big('sum(n)')} AS rows, count(*) FILTER (WHERE n = 1) AS singles FROM (SELECT config_id, CASE WHEN grouping(sens) = 1 THEN 'qi' ELSE 'full' END AS convention, count(*) AS n FROM rel WHERE NOT is_outlier GROUP BY GROUPING SETS ((config_id, {G}), (config_id, {G}, sens))) GROUP BY 1, 2")
def ec_grouping_sets(s):
    columns = ["config_id", *privacy.labels(SPEC)]
    both = s.released.filter("not is_outlier").groupingSets([columns, [*columns, "sens"]], *columns, "sens").agg(F.sum("w").alias("n"), F.grouping("sens").alias("without"))
    named = both.select("config_id", F.when(F.col("without") == 1, "qi").otherwise("full").alias("convention"), "n")
    return named.groupBy("config_id", "convention").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("rows"), F.sum((F.col("n") == 1).cast("long")).alias("singles"))


@query("SELECT config_id, min(n) AS k_hat, min(n) >= any_value(k) AS passes FROM rc JOIN cfg USING (config_id) GROUP BY 1")
def k_anonymity(s):
    return s.classes.groupBy("config_id", "k").agg(F.min("n").alias("k_hat")).select("config_id", "k_hat", (F.col("k_hat") >= F.col("k")).alias("passes"))


@query("SELECT config_id, min(n_sens) AS l_hat FROM rc GROUP BY 1")
def l_diversity(s):
    return s.classes.groupBy("config_id").agg(F.min("n_sens").alias("l_hat"))


_T = div("abs(n_pos * total - positive * n)", "n * total")


@query(f"SELECT config_id, max({_T}) AS t_hat FROM rc JOIN tot USING (config_id) GROUP BY 1")
def t_closeness(s):
    return privacy.t_hat(s.classes, privacy.totals(s.all_classes))


@query(f"SELECT config_id, max({_T}) AS t_hat FROM rc JOIN (SELECT config_id, {big('sum(n)')} AS total, {big('sum(n_pos)')} AS positive FROM rc GROUP BY 1) USING (config_id) GROUP BY 1")
def t_closeness_retained(s):
    return privacy.t_hat(s.classes, privacy.totals(s.classes))


@query(f"SELECT config_id, {div('count(*) FILTER (WHERE n = 1)', 'sum(n)')} AS u_qi, any_value(u_full) AS u_full FROM rc JOIN (SELECT config_id, {div('count(*) FILTER (WHERE n = 1)', 'sum(n)')} AS u_full FROM (SELECT config_id, count(*) AS n FROM rel WHERE NOT is_outlier GROUP BY config_id, {G}, sens) GROUP BY 1) USING (config_id) GROUP BY 1")
def uniqueness(s):
    # of a binary sensitive column: the class's positive and negative part
    parts = F.array(F.col("n_pos"), F.col("n") - F.col("n_pos"))
    full = s.classes.select("config_id", F.explode(parts).alias("n")).filter("n > 0")

    def share(frame, name):
        return frame.groupBy("config_id").agg(ratio(F.sum((F.col("n") == 1).cast("long")), F.sum("n")).alias(name))

    return share(s.classes, "u_qi").join(share(full, "u_full"), "config_id")


@query("SELECT config_id, n, count(*) AS frequency FROM rc GROUP BY 1, 2")
def ec_histogram(s):
    return privacy.histogram(s.classes)


@query("SELECT config_id, CAST(quantile_cont(n, 0.5) AS DOUBLE) AS median, CAST(quantile_cont(n, 0.95) AS DOUBLE) AS p95 FROM rc GROUP BY 1")
def ec_size_quantiles(s):
    return privacy.size_quantiles(s.classes)


@query("SELECT config_id, max(n) FILTER (WHERE r = need) AS p95 FROM (SELECT config_id, n, row_number() OVER (PARTITION BY config_id ORDER BY n) AS r, (count(*) OVER (PARTITION BY config_id) * 95 + 99) // 100 AS need FROM rc) GROUP BY 1")
def ec_p95_nearest_rank(s):
    return privacy.nearest_rank(s.classes, 95)


@query(f"""SELECT config_id, rows_in, suppressed, budget, suppressed <= budget AS within_budget, k_hat, k_hat >= k AS k_ok, l_hat, l_hat >= 2 AS l_ok, t_hat, t_hat <= {T} + 1e-9 AS t_ok FROM (
SELECT config_id, k, count(*) AS rows_in, count(*) FILTER (WHERE is_outlier) AS suppressed, CAST(floor(count(*) * round(lim * 1000000) / 1000000) AS BIGINT) AS budget FROM rel GROUP BY config_id, k, lim)
JOIN (SELECT config_id, min(n) AS k_hat, min(n_sens) AS l_hat, max({_T}) AS t_hat FROM rc JOIN tot USING (config_id) GROUP BY 1) USING (config_id)""")
def privacy_gate(s):
    return privacy.gate(s.all_classes, 2, T)


@query(f"""SELECT config_id, count(*) AS n_classes, {big('sum(n)')} AS rows, min(n) AS k_hat, max(n) AS max_class, min(n_sens) AS l_hat, count(*) FILTER (WHERE n = 1) AS singles, max({_T}) AS t_hat, {div('count(*) FILTER (WHERE n = 1)', 'sum(n)')} AS u_qi FROM rc JOIN tot USING (config_id) GROUP BY 1""")
def privacy_summary(s):
    base = privacy.summary(s.classes).withColumn("u_qi", ratio(F.col("singles"), F.col("rows")))
    return base.join(privacy.t_hat(s.classes, privacy.totals(s.all_classes)), "config_id")


@query(f"SELECT config_id, rid, {G}, sens FROM rel WHERE NOT is_outlier")
def retained_rows(s):
    return s.released_rows.filter("not is_outlier").select("config_id", "rid", *privacy.labels(SPEC), "sens")


@query("SELECT config_id, count(*) AS rows, count(*) FILTER (WHERE rel.sens IS DISTINCT FROM md.sens) AS target_mismatches FROM rel JOIN md USING (rid) GROUP BY 1")
def release_binding(s):
    joined = s.released_rows.select("config_id", "rid", F.col("sens").alias("released_sens")).join(s.md.select("rid", "sens"), "rid")
    return joined.groupBy("config_id").agg(F.count(F.lit(1)).alias("rows"), F.sum((~F.col("sens").eqNullSafe(F.col("released_sens"))).cast("long")).alias("target_mismatches"))


_LOOKED_UP = "SELECT " + ", ".join(f"h_{q}.label AS {q}" for q in QI) + ", sens FROM md " + " ".join(f"JOIN hier h_{q} ON h_{q}.attr = '{q}' AND h_{q}.level = {VECTOR[q]} AND h_{q}.leaf = CAST(md.{q} AS VARCHAR)" for q in QI)
_RELEASED = f"SELECT {', '.join(f'g_{q} AS {q}' for q in QI)}, sens FROM rel WHERE config_id = 'CFG01'"


@query(f"SELECT (SELECT count(*) FROM ({_RELEASED} EXCEPT ALL {_LOOKED_UP})) AS only_a, (SELECT count(*) FROM ({_LOOKED_UP} EXCEPT ALL {_RELEASED})) AS only_b")
def release_multiset_equal(s):
    """The same release by broadcast lookups and by label paths, as multisets of rows."""
    columns = [F.col(f"g_{q}").alias(q) for q in QI]
    a = s.released_rows.filter("config_id = 'CFG01'").select(*columns, "sens")
    return validation.multiset_difference(a, hierarchy.generalize(s.md, s.hier, VECTOR, SPEC).select(*QI, "sens"))


@query(VALUES + f"SELECT config_id, {MG}, priority AS value, m AS n FROM mcount")
def sensitive_frequencies(s):
    """The frequency vector of every class of a sensitive column of five values."""
    return s.many_classes.select("config_id", *privacy.labels(fixture.MANY), F.explode("freq").alias("x")).select("config_id", *privacy.labels(fixture.MANY), "x.value", "x.n")


@query(VALUES + "SELECT config_id, min(n_sens) AS l_hat FROM mclass WHERE NOT fails GROUP BY 1")
def l_diversity_values(s):
    return privacy.retained(s.many_classes).groupBy("config_id").agg(F.min("n_sens").alias("l_hat"))


@query(VALUES + "SELECT config_id, round(max(distance), 12) AS t_hat FROM mclass WHERE NOT fails GROUP BY 1")
def t_closeness_values(s):
    return privacy.retained(s.many_classes).groupBy("config_id").agg(F.round(F.max("distance"), 12).alias("t_hat"))


@query(VALUES + f"""SELECT config_id, {big('sum(n)')} AS rows_in, {big('coalesce(sum(n) FILTER (WHERE fails), 0)')} AS suppressed, coalesce(sum(n) FILTER (WHERE fails), 0) <= floor(sum(n) * round(any_value(lim) * 1000000) / 1000000) AS within_budget,
  min(n) FILTER (WHERE NOT fails) AS k_hat, min(n_sens) FILTER (WHERE NOT fails) AS l_hat, round(max(distance) FILTER (WHERE NOT fails), 12) AS t_hat,
  coalesce(min(n) FILTER (WHERE NOT fails), 0) >= any_value(k) AS k_ok, coalesce(min(n_sens) FILTER (WHERE NOT fails), 0) >= coalesce(any_value(l), 1) AS l_ok,
  coalesce(max(distance) FILTER (WHERE NOT fails), 1) <= coalesce(any_value(t), 1) + 1e-9 AS t_ok FROM mclass GROUP BY 1""")
def privacy_gate_values(s):
    return privacy.gate_of_values(s.many_classes)


@query(VALUES + f"SELECT config_id, priority, count(*) AS source, count(*) FILTER (WHERE NOT fails) AS retained, count(*) FILTER (WHERE fails) AS suppressed FROM mgen JOIN mclass USING (config_id, {MG}) GROUP BY 1, 2")
def class_counts_values(s):
    return structure.class_counts(privacy.with_outliers(s.many_rows, s.many_classes, fixture.MANY), fixture.MANY)


# ---- structure --------------------------------------------------------------------------------------


@query(f"""SELECT config_id, n, n_ret, {div('n - n_ret', 'n')} AS suppression_rate, {div('pos', 'n')} AS p0, {div('pos_ret', 'n_ret')} AS pr, {div('pos - pos_ret', 'n - n_ret')} AS ps, {div('pos_ret', 'n_ret')} - {div('pos', 'n')} AS pr_minus_p0, CASE WHEN n = n_ret THEN 'NA_NO_SUPPRESSED_ROWS' ELSE 'OK' END AS suppressed_prevalence_status
FROM (SELECT config_id, count(*) AS n, count(*) FILTER (WHERE NOT is_outlier) AS n_ret, count(*) FILTER (WHERE sens = '>T') AS pos, count(*) FILTER (WHERE sens = '>T' AND NOT is_outlier) AS pos_ret FROM rel GROUP BY 1)""")
def suppression_profile(s):
    return structure.suppression_profile(s.released, SPEC)


@query("SELECT config_id, sens, count(*) AS source, count(*) FILTER (WHERE NOT is_outlier) AS retained, count(*) FILTER (WHERE is_outlier) AS suppressed FROM rel GROUP BY 1, 2")
def class_counts_pivot(s):
    return structure.class_counts(s.released, SPEC)


@query(f"SELECT config_id, attr, raw AS value, count(*) AS source, count(*) FILTER (WHERE NOT is_outlier) AS retained, count(*) FILTER (WHERE is_outlier) AS suppressed, {div('count(*) FILTER (WHERE NOT is_outlier)', 'any_value(n_c)')} - {div('count(*)', 'any_value(n)')} AS share_difference FROM long JOIN sizes USING (config_id) GROUP BY 1, 2, 3")
def marginal_profiles(s):
    return structure.marginal_profiles(s.released, SPEC)


def _tvd(keys: str) -> str:
    return f"SELECT config_id, attr, sum(abs(CAST(a AS HUGEINT) * n_c - CAST(b AS HUGEINT) * n))::DOUBLE / nullif(2.0::DOUBLE * any_value(n)::DOUBLE * any_value(n_c)::DOUBLE, 0) AS tvd FROM (SELECT config_id, attr, {keys}, count(*) AS a, count(*) FILTER (WHERE NOT is_outlier) AS b FROM long GROUP BY config_id, attr, {keys}) JOIN sizes USING (config_id) GROUP BY 1, 2"


@query(_tvd("value"))
def tvd_marginal(s):
    return s.tvd


@query(_tvd("value, sens"))
def tvd_joint(s):
    return structure.tvd(s.released, SPEC, joint=True)


@query(f"SELECT config_id, round(avg(tvd), 9) AS tvd_mean, max(tvd) AS tvd_max FROM ({_tvd('value')}) GROUP BY 1")
def tvd_summary(s):
    return structure.tvd_summary(s.tvd)


@query(f"SELECT config_id, round(({' + '.join(f'lv_{q} / {SPEC.heights[q]}.0::DOUBLE' for q in QI)}) / {len(QI)}.0::DOUBLE, 9) AS intensity, loss, {div('n - n_c', 'n')} AS suppression_rate FROM cfg JOIN sizes USING (config_id) JOIN (" + SQL["info_loss"].removeprefix(PRE) + ") USING (config_id)")
def structural_summary(s):
    rate = s.all_classes.groupBy("config_id").agg(ratio(F.sum(F.when(F.col("fails"), F.col("n")).otherwise(0)), F.sum("n")).alias("suppression_rate"))
    return structure.intensity(s.configs, SPEC).join(structure.info_loss(s.all_classes, s.cells, SPEC), "config_id").join(rate, "config_id")


# ---- attack ------------------------------------------------------------------------------------------


@query("SELECT scenario, err, q FROM pmf")
def scenario_pmf(s):
    return s.pmf


@query("SELECT rid, CAST(target_pos AS INT) AS target_pos FROM tg")
def target_sample(s):
    return s.targets.select("rid", "target_pos")


@query("SELECT rid, md5('11002|' || rid) AS perm_hash FROM md")
def publish_order(s):
    return disclosure.publish_order(s.md, "rid")


@query("SELECT scenario, CAST(target_pos AS INT) AS target_pos, CAST(draw AS INT) AS draw, err FROM nz")
def age_noise(s):
    return s.noise


@query("SELECT scenario, CAST(level AS INT) AS level, label, z, q FROM compat")
def age_compat(s):
    return s.compat


@query(f"SELECT scenario, config_id, {KEYS}, g_num, lv_num, size FROM grp")
def attack_groups(s):
    return s.groups


@query("SELECT scenario, config_id, count(*) AS pairs, " + big("sum(size)") + f" AS rows FROM seen JOIN grp USING (scenario, config_id, {KEYS}) GROUP BY 1, 2")
def attack_candidates(s):
    met = s.seen.join(s.groups, ["scenario", "config_id", *disclosure.key_columns(SPEC, NUM)])
    return met.groupBy("scenario", "config_id").agg(F.count(F.lit(1)).alias("pairs"), F.sum("size").alias("rows"))


@query("SELECT scenario, config_id, CAST(target_pos AS INT) AS target_pos, CAST(draw AS INT) AS draw, g_num, size, score FROM sc")
def attack_scores(s):
    return s.scores.select("scenario", "config_id", "target_pos", "draw", "g_num", "size", "score")


@query("SELECT scenario, config_id, CAST(target_pos AS INT) AS target_pos, CAST(draw AS INT) AS draw, best, tie_size, array_to_string(winning, ',') AS winning FROM won")
def attack_winners(s):
    return s.won.select("scenario", "config_id", "target_pos", "draw", "best", "tie_size", F.array_join("winning", ",").alias("winning"))


@query("SELECT scenario, config_id, CAST(target_pos AS INT) AS target_pos, CAST(draw AS INT) AS draw, success FROM done")
def attack_success(s):
    return s.done.select("scenario", "config_id", "target_pos", "draw", "success")


@query("SELECT scenario, config_id, count(*) AS attempts, count(*) FILTER (WHERE tie_size = 0) AS abstained, count(*) FILTER (WHERE hit) AS true_in_best FROM done GROUP BY 1, 2")
def attack_counts(s):
    return disclosure.counts(s.done)


@query("""SELECT label, size, score, score >= top - 1e-12 AS winner, CASE WHEN score >= top - 1e-12 THEN CAST(sum(CASE WHEN score >= top - 1e-12 THEN size ELSE 0 END) OVER () AS BIGINT) END AS tie_size FROM (
  SELECT *, max(score) OVER () AS top FROM (SELECT label, size, max(q) AS score FROM (SELECT unnest(range(30, 40)) AS leaf) JOIN (VALUES ('30-34', 30, CAST(2 AS BIGINT)), ('35-39', 35, 1)) g(label, low, size) ON leaf BETWEEN low AND low + 4 JOIN pmf ON scenario = 'BASE' AND leaf + err = 33 GROUP BY 1, 2))""")
def attack_oracle(s):
    return disclosure.oracle(s.spark)


@query("SELECT config_id, CAST(target_pos AS INT) AS target_pos FROM truth WHERE retained")
def retained_targets_semi(s):
    places = s.configs.select("config_id").join(F.broadcast(s.targets.select("rid", "target_pos")))
    return places.join(s.released_rows.filter("not is_outlier").select("config_id", "rid"), ["config_id", "rid"], "left_semi").select("config_id", "target_pos")


@query("SELECT scenario, config_id, count(*) AS attempted, min(tie_size) AS tie_min, max(tie_size) AS tie_max, " + big("sum(tie_size)") + " AS tie_sum, CAST(quantile_cont(tie_size, 0.5) AS DOUBLE) AS tie_median, CAST(quantile_cont(tie_size, 0.95) AS DOUBLE) AS tie_p95 FROM done WHERE tie_size > 0 GROUP BY 1, 2")
def tie_summary(s):
    return disclosure.tie_summary(s.done)


@query("SELECT scenario, config_id, tie_size, count(*) AS frequency FROM done WHERE tie_size > 0 GROUP BY 1, 2, 3")
def tie_histogram(s):
    return disclosure.tie_histogram(s.done)


_COVERED = "count(*) FILTER (WHERE tie_size BETWEEN 1 AND m)"


@query(f"SELECT scenario, config_id, m, {_COVERED} AS covered, {div(_COVERED, 'count(*)')} AS coverage, round({div('sum(success) FILTER (WHERE tie_size BETWEEN 1 AND m)', _COVERED)}, 9) AS conditional_success, CASE WHEN {_COVERED} = 0 THEN 'NA_NO_COVERED' ELSE 'OK' END AS conditional_success_status FROM done CROSS JOIN (SELECT unnest([1, 2, 5, 10]) AS m) GROUP BY 1, 2, 3")
def success_coverage(s):
    return disclosure.coverage(s.done)


_RISK = f"scenario, config_id, targets, targets_retained, {div('s', 'targets')} AS r_all, {div('s', 'targets_retained')} AS r_released, round({div('targets_retained', 'targets * n_c')}, 12) AS uniform_r_all, round({div('1', 'n_c')}, 12) AS uniform_r_released"


@query(f"SELECT {_RISK} FROM risk WHERE scenario = 'BASE'")
def risk_point(s):
    return disclosure.risk_point(s.done.filter("scenario = 'BASE'"), s.sizes)


@query(f"SELECT {_RISK} FROM risk")
def risk_matrix(s):
    return disclosure.risk_point(s.done, s.sizes)


@query("SELECT scenario, config_id, count(*) AS attempts, count(*) FILTER (WHERE hit) AS true_in_best, round(sum(success) / count(*), 9) AS permuted_r_all FROM ctl GROUP BY 1, 2")
def permuted_control(s):
    return s.control.groupBy("scenario", "config_id").agg(F.count(F.lit(1)).alias("attempts"), F.sum(F.col("hit").cast("long")).alias("true_in_best"), F.round(F.sum("success") / F.count(F.lit(1)), 9).alias("permuted_r_all"))


@query(f"SELECT scenario, config_id, {div('s', 'targets')} AS r_all, permuted_r_all, round({div('targets_retained', 'targets * n_c')}, 12) AS uniform_r_all FROM risk JOIN (SELECT scenario, config_id, round(sum(success) / count(*), 9) AS permuted_r_all FROM ctl GROUP BY 1, 2) USING (scenario, config_id)")
def risk_points_and_controls(s):
    control = s.control.groupBy("scenario", "config_id").agg(F.round(F.sum("success") / F.count(F.lit(1)), 9).alias("permuted_r_all"))
    return disclosure.risk_point(s.done, s.sizes).join(control, ["scenario", "config_id"]).select("scenario", "config_id", "r_all", "permuted_r_all", "uniform_r_all")


@query(f"SELECT (SELECT count(*) FROM (SELECT rid FROM md EXCEPT ALL SELECT rid FROM {_PUBLISHED})) AS only_a, (SELECT count(*) FROM (SELECT rid FROM {_PUBLISHED} EXCEPT ALL SELECT rid FROM md)) AS only_b")
def bijection_check(s):
    return validation.multiset_difference(s.md.select("rid"), disclosure.publish_order(s.md, "rid").select("rid"))


@query("SELECT CAST(rid AS BIGINT) AS rid FROM md WHERE split = 'train' AND rid NOT IN (SELECT rid FROM md WHERE split = 'holdout' OR rid % 5 = 0)")
def disjoint_anti(s):
    other = s.md.filter("split = 'holdout' or rid % 5 = 0").select("rid")
    return s.md.filter("split = 'train'").select("rid").join(other, "rid", "left_anti")


@query("SELECT count(*) AS shared FROM (SELECT rid FROM md WHERE split = 'train' INTERSECT SELECT rid FROM md WHERE split = 'holdout' OR rid % 5 = 0)")
def disjoint_intersect(s):
    other = s.md.filter("split = 'holdout' or rid % 5 = 0").select("rid")
    return s.md.filter("split = 'train'").select("rid").intersect(other).agg(F.count(F.lit(1)).alias("shared"))


# ---- bootstrap -----------------------------------------------------------------------------------------


@query("SELECT num, segment, status, nation, n, CAST(cluster_id AS BIGINT) AS cluster_id FROM cl")
def cluster_first_appearance(s):
    return s.clusters


@query("SELECT scenario, config_id, cluster_id, n, round(s, 9) AS s FROM pc")
def risk_clusters(s):
    return s.per_cluster.select("scenario", "config_id", "cluster_id", "n", F.round("s", 9).alias("s"))


@query("SELECT replicate, unit, mult FROM plan")
def bootstrap_plan(s):
    return s.plan


@query("SELECT scenario, config_id, replicate, r_all FROM boot")
def bootstrap_risk(s):
    return s.boot


@query("SELECT scenario, replicate, config_id, round(r_all - raw, 9) AS difference FROM (SELECT *, max(r_all) FILTER (WHERE config_id = 'CFG00') OVER (PARTITION BY scenario, replicate) AS raw FROM boot) WHERE config_id <> 'CFG00' AND raw IS NOT NULL")
def delta_vs_raw(s):
    return bootstrap.against(s.boot, "CFG00", "r_all", ["scenario", "replicate"])


_OF = "max(r_all) FILTER (WHERE config_id = '{}')"
_PAIRED = ", ".join(f"{{'config_id': '{a}', 'other': '{b}', 'difference': round({_OF.format(a)} - {_OF.format(b)}, 9)}}" for a, b in sorted(fixture.PAIRS.items()))


@query(f"SELECT scenario, replicate, d.config_id, d.other, d.difference FROM (SELECT scenario, replicate, unnest([{_PAIRED}]) AS d FROM boot GROUP BY 1, 2) WHERE d.difference IS NOT NULL")
def suppression_pairs(s):
    return bootstrap.paired(s.boot, s.pairs, "r_all", ["scenario", "replicate"])


def _interval(v: str) -> str:
    return f"round(quantile_cont({v}, 0.025), 9) AS low, round(quantile_cont({v}, 0.975), 9) AS high"


_RAW_DIFFERENCE = SQL["delta_vs_raw"].removeprefix(PRE)
_PAIR_DIFFERENCE = SQL["suppression_pairs"].removeprefix(PRE)
_INTERVALS = f"SELECT 'R_ALL' AS kind, scenario, config_id, {_interval('r_all')} FROM boot GROUP BY 2, 3 UNION ALL SELECT 'VS_RAW', scenario, config_id, {_interval('difference')} FROM ({_RAW_DIFFERENCE}) GROUP BY 2, 3 UNION ALL SELECT 'PAIR', scenario, config_id, {_interval('difference')} FROM ({_PAIR_DIFFERENCE}) GROUP BY 2, 3"


@query(_INTERVALS)
def risk_intervals(s):
    boot, by, keys = s.boot, ["scenario", "config_id"], ["scenario", "replicate"]
    parts = [
        ("R_ALL", bootstrap.intervals(boot, "r_all", by)),
        ("VS_RAW", bootstrap.intervals(bootstrap.against(boot, "CFG00", "r_all", keys), "difference", by)),
        ("PAIR", bootstrap.intervals(bootstrap.paired(boot, s.pairs, "r_all", keys), "difference", by)),
    ]
    frames = [f.select(F.lit(kind).alias("kind"), *by, "low", "high") for kind, f in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query(f"SELECT kind, scenario, config_id, CASE WHEN low > 0 THEN 'positive' WHEN high < 0 THEN 'negative' ELSE 'includes_zero' END AS sign FROM ({_INTERVALS})")
def endpoint_sign(s):
    return risk_intervals(s).select("kind", "scenario", "config_id", scalars.endpoint_sign(F.col("low"), F.col("high")).alias("sign"))


# ---- utility -----------------------------------------------------------------------------------------------


@query("SELECT config_id, 'release' AS kind, count(*) AS rows FROM lab WHERE split = 'train' AND NOT is_outlier GROUP BY 1 UNION ALL SELECT config_id, 'counterfactual', count(*) FROM lab WHERE split = 'train' GROUP BY 1 UNION ALL SELECT config_id, 'holdout', count(*) FROM lab WHERE split = 'holdout' GROUP BY 1")
def counterfactual_vs_release(s):
    kinds = F.when(F.col("split") == "holdout", F.array(F.lit("holdout"))).when(F.col("is_outlier"), F.array(F.lit("counterfactual"))).otherwise(F.array(F.lit("counterfactual"), F.lit("release")))
    return s.released.select("config_id", "w", F.explode(kinds).alias("kind")).groupBy("config_id", "kind").agg(F.sum("w").alias("rows"))


_FOLDS = "SELECT rid AS row_id, y, CAST((row_number() OVER (PARTITION BY y ORDER BY md5('11004|' || rid), rid) - 1) % 5 AS INT) AS fold FROM lab WHERE config_id = 'CFG00' AND split = 'train'"


@query(_FOLDS)
def cv_folds(s):
    return utility.folds(s.labelled(s.md.filter("split = 'train'")))


@query(f"SELECT fold, y, count(*) AS rows FROM ({_FOLDS}) GROUP BY 1, 2")
def cv_fold_balance(s):
    return cv_folds(s).groupBy("fold", "y").agg(F.count(F.lit(1)).alias("rows"))


@query()
def select_c_folds(s):
    """Mean AUROC over stratified folds of the raw training rows for each C of the grid: 15 fits."""
    return s.c_means


@query()
def select_c_topk(s):
    """The C of the best mean; ties go to the smaller."""
    return utility.best_c(select_c_folds(s)).select("c", "mean_auroc")


@query("SELECT config_id, tp, fp, tn, fn, accuracy, balanced_accuracy FROM confm")
def confusion_counts(s):
    return utility.confusion(s.released_models, ["config_id"])


@query("SELECT config_id, auroc FROM auc")
def auroc(s):
    return utility.auroc(utility.tie_groups(s.released_models, ["config_id"]), ["config_id"])


@query("SELECT config_id, average_precision FROM ap")
def average_precision(s):
    return utility.average_precision(utility.tie_groups(s.released_models, ["config_id"]), ["config_id"])


@query("SELECT config_id, round(auroc, 9) AS auroc, average_precision, accuracy, balanced_accuracy FROM auc JOIN ap USING (config_id) JOIN confm USING (config_id)")
def utility_point(s):
    return utility.point_metrics(s.released_models, ["config_id"])


@query("SELECT a.config_id, round(b.auroc - a.auroc, 9) AS delta FROM auc a JOIN auc b ON b.config_id = 'CFG00' WHERE a.config_id <> 'CFG00'")
def delta_auroc(s):
    points = auroc(s)
    raw = points.filter("config_id = 'CFG00'").select(F.col("auroc").alias("raw"))
    return points.filter("config_id <> 'CFG00'").join(F.broadcast(raw)).select("config_id", F.round(F.col("raw") - F.col("auroc"), 9).alias("delta"))


@query(BOOT + "SELECT config_id, replicate, auroc FROM bauc")
def bootstrap_auroc(s):
    return s.boot_auroc


@query(BOOT + f"SELECT config_id, {_interval('difference')} FROM (SELECT config_id, replicate, round(auroc - max(auroc) FILTER (WHERE config_id = 'CFG00') OVER (PARTITION BY replicate), 9) AS difference FROM bauc) WHERE config_id <> 'CFG00' GROUP BY 1")
def delta_auroc_interval(s):
    return bootstrap.intervals(bootstrap.against(s.boot_auroc, "CFG00", "auroc", ["replicate"]), "difference", ["config_id"])


_H = "FROM lab WHERE config_id = 'CFG00' AND split = 'holdout'"


@query(f"SELECT prior, 0.5::DOUBLE AS auroc, prev AS average_precision, 0.5::DOUBLE AS balanced_accuracy, CASE WHEN prior >= 0.5 THEN prev ELSE {div('hn - hp', 'hn')} END AS accuracy FROM (SELECT {div('sum(y)', 'count(*)')} AS prior FROM lab WHERE config_id = 'CFG00' AND split = 'train') CROSS JOIN (SELECT {div('sum(y)', 'count(*)')} AS prev, sum(y) AS hp, count(*) AS hn {_H})")
def prior_baseline(s):
    rows = s.labelled(s.md)
    return utility.prior_baseline(rows.filter("split = 'train'"), rows.filter("split = 'holdout'"))


_FIT = "split = 'train' AND NOT is_outlier"
#: Value combinations of this many attributes, for categories that a fit can miss on any data.
_PAIR = ("num", "nation")


@query(f"SELECT DISTINCT {_PAIR[0]} || '/' || {_PAIR[1]} AS value FROM md WHERE split = 'holdout' AND {_PAIR[0]} || '/' || {_PAIR[1]} NOT IN (SELECT {_PAIR[0]} || '/' || {_PAIR[1]} FROM md WHERE split = 'train')")
def unknown_categories(s):
    """Categories (of a crossed attribute) that holdout rows have and no training row."""
    value = F.concat_ws("/", *[F.col(q).cast("string") for q in _PAIR]).alias("value")
    train = s.md.filter("split = 'train'").select(value).distinct()
    return s.md.filter("split = 'holdout'").select(value).distinct().join(train, "value", "left_anti")


_OHE = " UNION ALL ".join(
    f"SELECT config_id, '{q}' AS attr, (SELECT count(DISTINCT f.g_{q}) FROM rel f WHERE f.config_id = h.config_id AND {_FIT}) AS fitted, count(DISTINCT g_{q}) FILTER (WHERE NOT known) AS unknown_categories, count(*) FILTER (WHERE NOT known) AS unknown_rows, {div('count(*) FILTER (WHERE NOT known)', 'count(*)')} AS unknown_rate FROM (SELECT r.config_id, r.g_{q}, f.g_{q} IS NOT NULL AS known FROM rel r LEFT JOIN (SELECT DISTINCT config_id, g_{q} FROM rel WHERE {_FIT}) f ON r.config_id = f.config_id AND r.g_{q} = f.g_{q} WHERE split = 'holdout') h GROUP BY config_id"
    for q in QI
)


def _unknown(s):
    rows = s.released_rows.select("config_id", "split", "is_outlier", *[F.col(f"g_{q}").alias(q) for q in QI])
    return utility.unknown_by_attribute(rows.filter("split = 'train' and not is_outlier"), rows.filter("split = 'holdout'"), list(QI), ["config_id"])


@query(_OHE)
def ohe_unknown_by_qi(s):
    return _unknown(s)


_PLACE = "CASE attr " + " ".join(f"WHEN '{q}' THEN {i}" for i, q in enumerate(QI)) + " END"


@query(f"SELECT config_id, {big('sum(fitted)')} AS fitted, {big('sum(unknown_rows)')} AS unknown_rows, coalesce(string_agg(attr || ': ' || unknown_categories, '; ' ORDER BY {_PLACE}) FILTER (WHERE unknown_categories > 0), '0') AS unknown FROM ({_OHE}) GROUP BY 1")
def ohe_model_summary(s):
    return utility.encoder_summary(_unknown(s), list(QI), ["config_id"])


@query()
def ohe_encode(s):
    """Encoded width and active blocks of holdout rows; unknown categories are all-zero blocks."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    from pyspark.ml.functions import vector_to_array

    attrs = ["segment", "priority", "status", "nation"]
    index = StringIndexer(inputCols=attrs, outputCols=[f"i_{a}" for a in attrs], handleInvalid="keep", stringOrderType="alphabetAsc")
    hot = OneHotEncoder(inputCols=[f"i_{a}" for a in attrs], outputCols=[f"v_{a}" for a in attrs], dropLast=True)
    model = Pipeline(stages=[index, hot]).fit(s.md.filter("split = 'train'"))
    active = [F.aggregate(vector_to_array(f"v_{a}"), F.lit(0.0), lambda x, y: x + y).alias(f"active_{a}") for a in attrs]
    return model.transform(s.md.filter("split = 'holdout'")).select("rid", *active)


@query()
def lr_release(s):
    """Holdout metrics of logistic regression on the released training rows of one configuration."""
    rows = s.labelled(s.released_rows.filter("config_id = 'CFG02'")).select("row_id", "y", "split", "is_outlier", *[F.col(f"g_{q}").alias(q) for q in QI])
    _, scored = utility.logistic(rows.filter("split = 'train' and not is_outlier"), rows.filter("split = 'holdout'"), list(QI))
    return utility.point_metrics(scored.select(F.lit("CFG02").alias("config_id"), "row_id", "y", "p"), ["config_id"])


def _model_points(s):
    groups = s.model_scores.groupBy("config_id", "kind", "p").agg(F.sum("pos").alias("pos"), F.sum(F.col("n") - F.col("pos")).alias("neg"))
    return ranking.metrics(groups, ["config_id", "kind"]).select("config_id", "kind", F.round("auroc", 9).alias("auroc"), "average_precision", "accuracy", "balanced_accuracy")


@query()
def lr_matrix(s):
    """Holdout metrics of all 33 logistic models (releases, counterfactuals and the raw one), with the selected C."""
    return _model_points(s)


@query()
def lr_coefficients(s):
    """The coefficients of every model, the intercept without attribute and label."""
    return s.models.coefficients(s.matrix_cells)


@query()
def lr_convergence(s):
    """Whether every fit of the matrix converged, after how many evaluations, and its penalised loss."""
    found = s.models
    rows = [(*m, found.converged[m], found.evaluations[m], round(found.loss[m], 6)) for m in sorted(found.beta)]
    fitted = s.spark.createDataFrame(rows, "config_id string, kind string, converged boolean, evaluations long, loss double")
    return fitted.join(s.model_scores.groupBy("config_id", "kind").agg(F.sum("n").alias("holdout_rows")), ["config_id", "kind"])


@query()
def lr_determinism(s):
    """Whether fits of the same cells, dealt anew and in another order, have the same coefficients bit for bit."""
    again = s.fitted(s.matrix_cells.repartition(7, F.xxhash64(F.lit(1), *QI)))
    one, two = s.models.digest(), again.digest()
    return s.spark.createDataFrame([(*m, one[m], one[m] == two[m]) for m in sorted(one)], "config_id string, kind string, digest string, same boolean")


@query()
def lr_deltas(s):
    """What a release's model loses against the raw one in AUROC, and what of it comes from suppression alone."""
    points = shared(_model_points(s)).select("config_id", "kind", "auroc")
    raw = points.filter("config_id = 'CFG00'").select(F.col("auroc").alias("raw"))
    other = points.filter("kind = 'counterfactual'").select("config_id", F.col("auroc").alias("counterfactual"))
    return points.filter("kind = 'release' and config_id <> 'CFG00'").join(F.broadcast(raw)).join(F.broadcast(other), "config_id").select("config_id", F.round(F.col("raw") - F.col("auroc"), 9).alias("delta"), F.round(F.col("counterfactual") - F.col("auroc"), 9).alias("delta_suppression"))


_MODELS = "SELECT config_id, kind FROM (SELECT unnest([" + ", ".join(f"'{c.config_id}'" for c in fixture.MATRIX) + "]) AS config_id) CROSS JOIN (SELECT unnest(['release', 'counterfactual']) AS kind) WHERE NOT (config_id = 'CFG00' AND kind = 'counterfactual')"


@query(f"SELECT config_id, kind, holdout_rows, positives FROM ({_MODELS}) CROSS JOIN (SELECT count(*) AS holdout_rows, {big('sum(y)')} AS positives FROM lab WHERE config_id = 'CFG00' AND split = 'holdout')")
def model_shapes(s):
    """Which models there are, and that each scores every holdout row once."""
    return s.model_scores.groupBy("config_id", "kind").agg(F.sum("n").alias("holdout_rows"), F.sum("pos").alias("positives"))


@query("SELECT config_id, count(*) FILTER (WHERE mr.row_id IS NULL) AS lacking, CAST(0 AS BIGINT) AS unknown, (SELECT count(*) FROM (SELECT 1 FROM mr m WHERE m.config_id = c.config_id GROUP BY row_id HAVING count(*) > 1)) AS repeated, count(*) FILTER (WHERE mr.y <> c.y) AS relabelled, count(*) FILTER (WHERE mr.row_id IS NOT NULL AND (mr.p IS NULL OR mr.p NOT BETWEEN 0 AND 1)) AS out_of_range FROM (SELECT config_id, row_id, h.y FROM cfg CROSS JOIN (SELECT row_id, y FROM lab WHERE config_id = 'CFG00' AND split = 'holdout') h) c LEFT JOIN mr USING (config_id, row_id) GROUP BY 1")
def prediction_admission(s):
    """Whether the predictions of every release cover the holdout rows, once each, with their labels."""
    rows = s.labelled(s.released_rows).withColumn("w", F.lit(1))
    scored = utility.rate_scores(rows.filter("split = 'train' and not is_outlier"), rows.filter("split = 'holdout'"), ["g_num", "g_nation", "g_status"], ["config_id"])
    return validation.admission(scored, s.labelled(s.md.filter("split = 'holdout'")), "config_id", "row_id")


# ---- export -----------------------------------------------------------------------------------------------------


@query(f"SELECT kind, scenario, config_id, low AS interval_low, high AS interval_high FROM ({_INTERVALS})")
def export_flatten_intervals(s):
    nested = risk_intervals(s).select("kind", "scenario", "config_id", F.struct("low", "high").alias("interval"))
    return export.flatten(nested, "interval", "interval_")


@query("SELECT config_id, CAST(n AS VARCHAR) AS n, CAST(n_ret AS VARCHAR) AS n_ret, coalesce(CAST(nullif(n - n_ret, 0) AS VARCHAR), 'NA') AS suppressed, CASE WHEN n = n_ret THEN 'NA_NO_SUPPRESSED_ROWS' ELSE 'OK' END AS status FROM (SELECT config_id, n, n_c AS n_ret FROM sizes)")
def export_na_render(s):
    p = structure.suppression_profile(s.released, SPEC)
    return export.rendered(p.select("config_id", "n", "n_ret", F.nullif(F.col("n") - F.col("n_ret"), F.lit(0)).alias("suppressed"), F.col("suppressed_prevalence_status").alias("status")))


@query(f"""SELECT config_id, r_all, delta FROM (SELECT r.config_id, {div('s', 'targets')} AS r_all, round(b.auroc - a.auroc, 9) AS delta FROM risk r JOIN auc a USING (config_id) JOIN auc b ON b.config_id = 'CFG00' WHERE scenario = 'BASE' AND r.config_id <> 'CFG00') x
WHERE NOT EXISTS (SELECT 1 FROM (SELECT r.config_id, {div('s', 'targets')} AS r_all, round(b.auroc - a.auroc, 9) AS delta FROM risk r JOIN auc a USING (config_id) JOIN auc b ON b.config_id = 'CFG00' WHERE scenario = 'BASE' AND r.config_id <> 'CFG00') o WHERE o.r_all <= x.r_all AND o.delta <= x.delta AND (o.r_all < x.r_all OR o.delta < x.delta))""")
def pareto_front(s):
    points = risk_point(s).select("config_id", "r_all").join(delta_auroc(s), "config_id")
    return structure.pareto_front(points, "config_id", "r_all", "delta")


@query(f"SELECT config_id, num // g AS num, den // g AS den, {div('num', 'den')} AS value FROM (SELECT config_id, num, den, gcd(num, den) AS g FROM (SELECT config_id, {big('sum(n_pos)')} AS num, {big('sum(n)')} AS den FROM rc GROUP BY 1))")
def rational_reduce(s):
    c = s.classes.groupBy("config_id").agg(F.sum("n_pos").alias("a"), F.sum("n").alias("b"))
    g = c.withColumn("g", scalars.gcd(F.col("a"), F.col("b")))
    return g.select("config_id", F.expr("a div g").alias("num"), F.expr("b div g").alias("den"), ratio(F.col("a"), F.col("b")).alias("value"))


@query(f"SELECT rid, {block('num', 5)} AS label FROM md")
def interval_label(s):
    return s.md.select("rid", scalars.block_label(F.col("num"), 5).alias("label"))


@query()
def public_schema_guard(s):
    """How many private columns each published family would leak (none)."""
    frames = {name: QUERIES[name](s.spark, s.sf_dir) for name in FAMILIES}
    return s.spark.createDataFrame(export.guard_report(frames), "family string, private_columns int")


@query()
def src_file_identity(s):
    from ..sources.readers import identity

    found = identity(s.spark, f"{s.sf_dir}/region.parquet")
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "bytes", "sha256")


@query(f"SELECT rid, sha256(concat_ws(chr(9), {', '.join(f'CAST({q} AS VARCHAR)' for q in QI)})) AS digest FROM md")
def sha_canonical(s):
    return s.md.select("rid", export.canonical_hash(*[F.col(q) for q in QI]).alias("digest"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) < 50")
def stream_small_classes(s):
    """Classes of a day and event type that are smaller than 50; the batch form of the stream monitor."""
    return monitor.small_classes(monitor.class_counts(s.table("events"), "ts", ["event_type"]), 50)
