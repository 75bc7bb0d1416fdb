"""Common table expressions of the DuckDB side: the same study, written in SQL."""

from __future__ import annotations

from ..sources.fixture import CONFIGS, DRAWS, MANY, MANY_CONFIGS, PAIRS, PRIORITIES, REPLICATES, SCENARIOS, SEGMENTS, SPEC, STATUSES, TARGETS, YEARS

QI = SPEC.names
G = ", ".join(f"g_{q}" for q in QI)
KEYS = ", ".join(f"k_{q}" for q in QI if q != "num")


def uniform(text: str) -> str:
    return f"(CAST(CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT) AS DOUBLE) / 4294967296.0)"


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def block(v: str, w: int) -> str:
    low = f"(({v} - 1) - ({v} - 1) % {w} + 1)"
    return f"(CAST({low} AS VARCHAR) || '-' || CAST({low} + {w - 1} AS VARCHAR))"


def exact(x: str) -> str:
    """A sum of doubles between 2 ** -22 and 1 (or 0), rounded once: whole numbers of 2 ** -75, of which the first 53 bits stay, half to even."""
    n = f"sum(CAST({x} * 37778931862957161709568.0 AS HUGEINT))"
    unit = f"CAST(pow(2, greatest(0, length(bin({n}::UHUGEINT)) - 53)) AS HUGEINT)"
    up = f"CASE WHEN 2 * ({n} % {unit}) > {unit} OR (2 * ({n} % {unit}) = {unit} AND ({n} // {unit}) % 2 = 1) THEN 1 ELSE 0 END"
    return f"(({n} // {unit} + {up})::DOUBLE * {unit}::DOUBLE / 37778931862957161709568.0::DOUBLE)"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _noise() -> str:
    parts = []
    for s in SCENARIOS:
        errors, run, cases = sorted(s.errors), 0.0, ""
        total = sum(s.errors.values())
        cuts = []
        left = total
        for d, after in zip(reversed(errors[:-1]), reversed(errors[1:]), strict=True):
            left -= s.errors[after]
            cuts.append((round(left, 12), d))
        for c, d in reversed(cuts):
            cases += f" WHEN u < CAST({c!r} AS DOUBLE) THEN {d}"
        case = f"CASE{cases} ELSE {errors[-1]} END" if cases else f"{errors[-1]}"
        u = uniform(f"'{s.stream}|' || target_pos || '|' || draw")
        parts.append(f"SELECT '{s.scenario}' AS scenario, target_pos, draw, {case} AS err FROM (SELECT target_pos, draw, {u} AS u FROM tg CROSS JOIN (SELECT unnest(range(1, {DRAWS + 1})) AS draw))")
    return " UNION ALL ".join(parts)


def _keys() -> str:
    return ", ".join("CASE scenario " + " ".join(f"WHEN '{s.scenario}' THEN " + (f"g_{q}" if q in s.known else "'-'") for s in SCENARIOS) + f" END AS k_{q}" for q in QI if q != "num")


def label_case(q: str, level: str) -> str:
    arms = {
        "num": f"WHEN 0 THEN CAST(num AS VARCHAR) WHEN 1 THEN {block('num', 5)} WHEN 2 THEN {block('num', 10)} WHEN 3 THEN {block('num', 20)}",
        "nation": "WHEN 0 THEN nation WHEN 1 THEN region",
        "segment": "WHEN 0 THEN segment",
        "priority": "WHEN 0 THEN priority WHEN 1 THEN CASE WHEN substr(priority, 1, 1) IN ('1', '2') THEN 'HIGH' ELSE 'LOW' END",
        "yr": "WHEN 0 THEN CAST(yr AS VARCHAR) WHEN 1 THEN CASE WHEN yr <= 1998 THEN 'early' ELSE 'late' END",
        "status": "WHEN 0 THEN status",
    }
    return f"CASE {level} {arms[q]} ELSE '*' END"


CFG_ROWS = ", ".join(f"('{c.config_id}', {c.k}, CAST({c.limit!r} AS DOUBLE), CAST({'NULL' if c.l is None else c.l} AS INT), CAST({'NULL' if c.t is None else c.t} AS DOUBLE), {', '.join(str(c.vector[q]) for q in QI)})" for c in CONFIGS)
PMF_ROWS = ", ".join(f"('{s.scenario}', {d}, CAST({q!r} AS DOUBLE))" for s in SCENARIOS for d, q in sorted(s.errors.items()))
SCENARIO_ROWS = ", ".join(f"('{s.scenario}')" for s in SCENARIOS)
PAIR_ROWS = ", ".join(f"('{a}', '{b}')" for a, b in sorted(PAIRS.items()))

PRE = f"""WITH md AS (
  SELECT o_orderkey AS rid, CAST(floor((c_acctbal + 1000.0) / 110.0) AS INT) + 1 AS num, n_name AS nation, r_name AS region,
         c_mktsegment AS segment, o_orderpriority AS priority, CAST(year(o_orderdate) AS INT) AS yr, o_orderstatus AS status,
         CASE WHEN o_totalprice > 375000.0 THEN '>T' ELSE '<=T' END AS sens,
         CASE WHEN o_orderkey % 3 = 0 THEN 'holdout' ELSE 'train' END AS split
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), hier AS (
  SELECT 'num' AS attr, CAST(num AS VARCHAR) AS leaf, level, {label_case('num', 'level')} AS label FROM (SELECT unnest(range(1, 101)) AS num) CROSS JOIN (SELECT unnest(range(0, 5)) AS level)
  UNION ALL SELECT 'nation', n_name, level, CASE level WHEN 0 THEN n_name WHEN 1 THEN r_name ELSE '*' END FROM nation JOIN region ON n_regionkey = r_regionkey CROSS JOIN (SELECT unnest(range(0, 3)) AS level)
  UNION ALL SELECT 'segment', segment, level, {label_case('segment', 'level')} FROM (SELECT unnest({_list(SEGMENTS)}) AS segment) CROSS JOIN (SELECT unnest(range(0, 2)) AS level)
  UNION ALL SELECT 'priority', priority, level, {label_case('priority', 'level')} FROM (SELECT unnest({_list(PRIORITIES)}) AS priority) CROSS JOIN (SELECT unnest(range(0, 3)) AS level)
  UNION ALL SELECT 'yr', CAST(yr AS VARCHAR), level, {label_case('yr', 'level')} FROM (SELECT unnest({list(YEARS)}) AS yr) CROSS JOIN (SELECT unnest(range(0, 3)) AS level)
  UNION ALL SELECT 'status', status, level, {label_case('status', 'level')} FROM (SELECT unnest({_list(STATUSES)}) AS status) CROSS JOIN (SELECT unnest(range(0, 2)) AS level)
), cfg(config_id, k, lim, l, t, {', '.join(f'lv_{q}' for q in QI)}) AS (VALUES {CFG_ROWS}
), gen AS (
  SELECT config_id, k, lim, l, t, md.*, {', '.join(f'lv_{q}' for q in QI)}, {', '.join(f'{label_case(q, f"lv_{q}")} AS g_{q}' for q in QI)} FROM md CROSS JOIN cfg
), sz AS (SELECT config_id, {G}, count(*) AS class_n, count(*) FILTER (WHERE sens = '>T') AS class_pos FROM gen GROUP BY config_id, {G}
), whole AS (SELECT count(*) AS whole_n, count(*) FILTER (WHERE sens = '>T') AS whole_pos FROM md
), rel AS (
  SELECT gen.*, class_n, class_n < k OR coalesce(CASE WHEN class_pos IN (0, class_n) THEN 1 ELSE 2 END < l, false)
    OR coalesce(CAST(abs(class_pos * whole_n - whole_pos * class_n) AS DOUBLE) > (t + 1e-9) * CAST(class_n AS DOUBLE) * whole_n, false) AS is_outlier
  FROM gen JOIN sz USING (config_id, {G}) CROSS JOIN whole
), rc AS (
  SELECT config_id, {G}, count(*) AS n, {big("count(*) FILTER (WHERE sens = '>T')")} AS n_pos, count(DISTINCT sens) AS n_sens FROM rel WHERE NOT is_outlier GROUP BY config_id, {G}
), tot AS (SELECT config_id, count(*) AS total, count(*) FILTER (WHERE sens = '>T') AS positive FROM rel GROUP BY config_id
), leafset AS (SELECT attr, level, label, count(*) AS leaves FROM hier GROUP BY 1, 2, 3
), cell AS (
  SELECT attr, level, label, leaves - 1 AS num, domain - 1 AS den FROM leafset JOIN (SELECT attr, {big('sum(leaves)')} AS domain FROM leafset WHERE level = 0 GROUP BY attr) USING (attr)
), long AS (
  {' UNION ALL '.join(f"SELECT config_id, is_outlier, sens, '{q}' AS attr, CAST({q} AS VARCHAR) AS raw, g_{q} AS value FROM rel" for q in QI)}
), sizes AS (SELECT config_id, count(*) AS n, count(*) FILTER (WHERE NOT is_outlier) AS n_c FROM rel GROUP BY config_id
), tg AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY md5('11001|' || rid), rid) AS target_pos FROM md) WHERE target_pos <= {TARGETS}
), nz AS MATERIALIZED ({_noise()}
), pmf(scenario, err, q) AS (VALUES {PMF_ROWS}
), scn(scenario) AS (VALUES {SCENARIO_ROWS}
), compat AS (
  SELECT scenario, level, label, CAST(leaf AS INT) + err AS z, max(q) AS q FROM hier CROSS JOIN pmf WHERE attr = 'num' GROUP BY 1, 2, 3, 4
), grp AS MATERIALIZED (
  SELECT scenario, config_id, {KEYS}, g_num, lv_num, {big('sum(n)')} AS size FROM (SELECT scenario, rc.*, lv_num, {_keys()} FROM rc JOIN cfg USING (config_id) CROSS JOIN scn) GROUP BY ALL
), mine AS MATERIALIZED (SELECT rel.*, target_pos FROM rel JOIN (SELECT rid, target_pos FROM tg) USING (rid)
), seen AS MATERIALIZED (
  SELECT scenario, config_id, target_pos, draw, {KEYS}, num + err AS z FROM (SELECT scenario, mine.*, {_keys()} FROM mine CROSS JOIN scn) JOIN nz USING (scenario, target_pos)
), sc AS MATERIALIZED (
  SELECT seen.*, grp.g_num, grp.lv_num, size, q AS score FROM seen JOIN grp USING (scenario, config_id, {KEYS}) JOIN compat ON compat.scenario = seen.scenario AND level = lv_num AND label = g_num AND compat.z = seen.z
), best AS (SELECT scenario, config_id, target_pos, draw, max(score) AS best FROM sc GROUP BY 1, 2, 3, 4
), top AS (
  SELECT scenario, config_id, target_pos, draw, max(best) AS best, {big('sum(size)')} AS tie_size, list_sort(list(g_num)) AS winning
  FROM sc JOIN best USING (scenario, config_id, target_pos, draw) WHERE score >= best - 1e-12 GROUP BY 1, 2, 3, 4
), won AS MATERIALIZED (
  SELECT seen.*, coalesce(best, 0.0) AS best, coalesce(tie_size, 0) AS tie_size, coalesce(winning, CAST([] AS VARCHAR[])) AS winning FROM seen LEFT JOIN top USING (scenario, config_id, target_pos, draw)
), truth AS (SELECT config_id, target_pos, g_num AS true_label, NOT is_outlier AS retained FROM mine
), done AS (
  SELECT *, CASE WHEN hit THEN 1.0 / CAST(tie_size AS DOUBLE) ELSE 0.0 END AS success FROM (
    SELECT scenario, config_id, target_pos, draw, tie_size, retained, retained AND list_contains(winning, true_label) AS hit FROM won JOIN truth USING (config_id, target_pos))
), pt AS (
  SELECT t.config_id, t.target_pos, {', '.join(f'p.g_{q} AS p_{q}' for q in QI)}, t.retained AND p.g_num IS NOT NULL AS retained FROM truth t
  LEFT JOIN (SELECT config_id, {G}, row_number() OVER (PARTITION BY config_id ORDER BY md5('11007|' || config_id || '|' || rid), rid) AS target_pos FROM rel WHERE NOT is_outlier) p USING (config_id, target_pos)
), ctl AS (
  SELECT *, CASE WHEN hit THEN 1.0 / CAST(tie_size AS DOUBLE) ELSE 0.0 END AS success FROM (
    SELECT scenario, config_id, target_pos, draw, tie_size, retained,
      coalesce(retained AND {' AND '.join(f"(k_{q} = '-' OR k_{q} = p_{q})" for q in QI if q != 'num')} AND list_contains(winning, p_num), false) AS hit FROM won JOIN pt USING (config_id, target_pos))
), means AS (SELECT scenario, config_id, target_pos, {div(exact('success'), 'count(*)')} AS mean_success, max(CAST(retained AS INT)) AS kept FROM done GROUP BY 1, 2, 3
), risk AS MATERIALIZED (
  SELECT scenario, config_id, count(*) AS targets, {big('sum(kept)')} AS targets_retained, {exact('mean_success')} AS s, any_value(n_c) AS n_c FROM means JOIN sizes USING (config_id) GROUP BY 1, 2
), cl AS MATERIALIZED (
  SELECT num, segment, status, nation, count(*) AS n, dense_rank() OVER (ORDER BY min(target_pos)) AS cluster_id FROM tg GROUP BY 1, 2, 3, 4
), plan AS MATERIALIZED (
  SELECT replicate, unit, count(*) AS mult FROM (
    SELECT replicate, CAST(floor({uniform("'11005|' || replicate || '|' || draw")} * (SELECT count(*) FROM cl)) AS BIGINT) + 1 AS unit
    FROM (SELECT unnest(range(1, {REPLICATES + 1})) AS replicate) CROSS JOIN (SELECT unnest(range(1, (SELECT count(*) FROM cl) + 1)) AS draw)) GROUP BY 1, 2
), pc AS MATERIALIZED (
  SELECT scenario, config_id, cluster_id, count(*) AS n, sum(mean_success) AS s FROM means JOIN tg USING (target_pos) JOIN cl USING (num, segment, status, nation) GROUP BY 1, 2, 3
), boot AS MATERIALIZED (
  SELECT scenario, config_id, replicate, round({div('sum(mult * s)', 'sum(mult * n)')}, 9) AS r_all FROM (SELECT pc.*, replicate, mult FROM pc JOIN plan ON cluster_id = unit) GROUP BY 1, 2, 3
), pairs(config_id, other) AS (VALUES {PAIR_ROWS}
), lab AS (SELECT *, rid AS row_id, CASE WHEN sens = '>T' THEN 1 ELSE 0 END AS y FROM rel
), mr AS (
  SELECT h.config_id, row_id, y, coalesce({div('c.h', 'c.n')}, prior) AS p FROM (SELECT * FROM lab WHERE split = 'holdout') h
  LEFT JOIN (SELECT config_id, g_num, g_nation, g_status, sum(y) AS h, count(*) AS n FROM lab WHERE split = 'train' AND NOT is_outlier GROUP BY 1, 2, 3, 4) c USING (config_id, g_num, g_nation, g_status)
  JOIN (SELECT config_id, {div('sum(y)', 'count(*)')} AS prior FROM lab WHERE split = 'train' AND NOT is_outlier GROUP BY 1) USING (config_id)
), mc AS (
  SELECT h.config_id, row_id, y, coalesce({div('c.h', 'c.n')}, prior) AS p FROM (SELECT * FROM lab WHERE split = 'holdout') h
  LEFT JOIN (SELECT config_id, g_num, g_nation, g_status, sum(y) AS h, count(*) AS n FROM lab WHERE split = 'train' GROUP BY 1, 2, 3, 4) c USING (config_id, g_num, g_nation, g_status)
  JOIN (SELECT config_id, {div('sum(y)', 'count(*)')} AS prior FROM lab WHERE split = 'train' GROUP BY 1) USING (config_id)
), tie AS (SELECT config_id, p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM mr GROUP BY 1, 2
), auc AS (
  SELECT config_id, {div('sum(pos * (2 * below + neg))', '2 * sum(pos) * sum(neg)')} AS auroc FROM (
    SELECT *, coalesce(sum(neg) OVER (PARTITION BY config_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM tie) GROUP BY 1
), ap AS (
  SELECT config_id, round({div(f"sum(pos * {div('tp', 'al')})", 'sum(pos)')}, 9) AS average_precision FROM (
    SELECT *, sum(pos) OVER w AS tp, sum(pos + neg) OVER w AS al FROM tie WINDOW w AS (PARTITION BY config_id ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY 1
), conf AS (
  SELECT config_id, count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp, count(*) FILTER (WHERE p < 0.5 AND y = 0) AS tn, count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn FROM mr GROUP BY 1
), confm AS (
  SELECT *, {div('tp + tn', 'tp + fp + tn + fn')} AS accuracy, round(({div('tp', 'tp + fn')} + {div('tn', 'tn + fp')}) / 2.0, 9) AS balanced_accuracy FROM conf
), raw AS (
  SELECT l_orderkey * 8 + l_linenumber AS line_no, CAST(l_orderkey AS VARCHAR) AS orderkey, CAST(l_linenumber AS VARCHAR) AS linenumber, CASE WHEN l_returnflag = 'N' THEN '?' ELSE l_returnflag END AS flag,
         l_linestatus AS status, CAST(CAST(trunc(l_quantity) AS INT) AS VARCHAR) AS quantity, l_linestatus || '.' AS label FROM lineitem
), vals AS ({' UNION '.join(f"SELECT '{q}' AS attr, CAST({q} AS VARCHAR) AS value FROM md" for q in QI)}
)
"""


def _binomial(d: str, p: str, u: str) -> str:
    """The least k whose binomial distribution function exceeds u, summed up over eight standard deviations around the mean."""
    reach = f"8 * sqrt({d} * {p} * (1 - {p}))"
    low, high = f"greatest(0, floor({d} * {p} - {reach}) - 1)::BIGINT", f"least({d}, ceil({d} * {p} + {reach}) + 20)::BIGINT"
    mass = f"exp(lgamma({d} + 1) - lgamma(k + 1) - lgamma({d} - k + 1) + k * ln({p}) + ({d} - k) * ln(1 - {p}))"
    masses = f"list_prepend({{'c': 0.0::DOUBLE, 'n': 0::BIGINT}}, list_transform(range({low}, {high} + 1), lambda k: {{'c': {mass}, 'n': 0::BIGINT}}))"
    return f"least({d}, {low} + list_reduce({masses}, lambda a, b: {{'c': a.c + b.c, 'n': a.n + CASE WHEN a.c + b.c <= {u} THEN 1 ELSE 0 END}}).n)"


def _mixed() -> str:
    """A number between 0 and 1 from 32 mixed bits of a seed and the place of the cut."""
    x = "((seed + mid * 2654435769) & 4294967295)"
    for shift, factor in ((16, 2146121005), (15, 2221713035)):
        x = f"((xor({x}, {x} >> {shift})::UBIGINT * {factor}::UBIGINT) & 4294967295::UBIGINT)"
    return f"((xor({x}, {x} >> 16)::DOUBLE + 0.5) / 4294967296.0)"


#: Stratified multinomial counts of the holdout's distinct score vectors, and AUROC of each replicate: ``bauc``.
BOOT = f""", vec AS (
  SELECT y, list(p ORDER BY config_id) AS v FROM mr GROUP BY row_id, y
), vcell AS MATERIALIZED (SELECT y, v, n, row_number() OVER (PARTITION BY y ORDER BY v) - 1 AS i FROM (SELECT y, v, count(*) AS n FROM vec GROUP BY 1, 2)
), upto AS MATERIALIZED (
  SELECT y, i, coalesce(sum(n) OVER (PARTITION BY y ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS w FROM vcell
  UNION ALL SELECT y, count(*), sum(n)::BIGINT FROM vcell GROUP BY y
), stretch AS (
  SELECT y, 0::BIGINT AS lo, max(i) AS hi FROM upto GROUP BY y
  UNION ALL SELECT y, CASE side WHEN 0 THEN lo ELSE (lo + hi) // 2 END, CASE side WHEN 0 THEN (lo + hi) // 2 ELSE hi END FROM stretch CROSS JOIN (VALUES (0), (1)) s(side) WHERE hi - lo > 1
), knot AS MATERIALIZED (
  SELECT s.y, s.lo, s.hi, (s.lo + s.hi) // 2 AS mid, (m.w - a.w) / (b.w - a.w)::DOUBLE AS p FROM stretch s JOIN upto a ON a.y = s.y AND a.i = s.lo JOIN upto m ON m.y = s.y AND m.i = (s.lo + s.hi) // 2 JOIN upto b ON b.y = s.y AND b.i = s.hi WHERE s.hi - s.lo > 1
), seeded AS MATERIALIZED (
  SELECT replicate, y, CAST('0x' || substr(md5('11006|' || replicate || '|' || y), 1, 8) AS BIGINT) AS seed, max(w) AS d, max(i) AS m FROM upto CROSS JOIN (SELECT unnest(range(1, {REPLICATES + 1})) AS replicate) GROUP BY 1, 2
), fallen AS (
  SELECT replicate, y, seed, 0::BIGINT AS lo, m AS hi, d FROM seeded
  UNION ALL SELECT replicate, y, seed, CASE side WHEN 0 THEN lo ELSE mid END, CASE side WHEN 0 THEN mid ELSE hi END, CASE side WHEN 0 THEN k ELSE d - k END
  FROM (SELECT *, {_binomial('d', 'p', 'u')} AS k FROM (SELECT replicate, f.y, seed, f.lo, f.hi, mid, d, p, {_mixed()} AS u FROM fallen f JOIN knot USING (y, lo, hi))) CROSS JOIN (VALUES (0), (1)) s(side)
  WHERE CASE side WHEN 0 THEN k ELSE d - k END > 0
), drawn AS MATERIALIZED (SELECT replicate, y, lo AS i, d FROM fallen WHERE hi - lo = 1
), scored AS MATERIALIZED (
  SELECT config_id, y, i, dense_rank() OVER (PARTITION BY config_id ORDER BY p) AS g FROM (SELECT unnest([{', '.join(f"'{c}'" for c in sorted(c.config_id for c in CONFIGS))}]) AS config_id, unnest(v) AS p, y, i FROM vcell)
), btie AS (SELECT config_id, replicate, g, coalesce(sum(d) FILTER (WHERE y = 1), 0)::BIGINT AS pos, coalesce(sum(d) FILTER (WHERE y = 0), 0)::BIGINT AS neg FROM drawn JOIN scored USING (y, i) GROUP BY 1, 2, 3
), bauc AS MATERIALIZED (
  SELECT config_id, replicate, round({div('sum(pos * (2 * below + neg))', '2 * sum(pos) * sum(neg)')}, 9) AS auroc FROM (
    SELECT *, coalesce(sum(neg) OVER (PARTITION BY config_id, replicate ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS below FROM btie) GROUP BY 1, 2
)
"""

MQ = MANY.names
MG = ", ".join(f"g_{q}" for q in MQ)
MANY_ROWS = ", ".join(f"('{c.config_id}', {c.k}, CAST({c.limit!r} AS DOUBLE), CAST({'NULL' if c.l is None else c.l} AS INT), CAST({'NULL' if c.t is None else c.t} AS DOUBLE), {', '.join(str(c.vector[q]) for q in MQ)})" for c in MANY_CONFIGS)
#: Releases with the priority as sensitive column: counts by class and value (``mcount``), classes with their distance (``mclass``).
VALUES = f""", mcfg(config_id, k, lim, l, t, {', '.join(f'lv_{q}' for q in MQ)}) AS (VALUES {MANY_ROWS}
), mgen AS (SELECT config_id, k, lim, l, t, priority, {', '.join(f'{label_case(q, f"lv_{q}")} AS g_{q}' for q in MQ)} FROM md CROSS JOIN mcfg
), mval AS MATERIALIZED (SELECT priority, count(*) AS whole, (SELECT count(*) FROM md) AS total FROM md GROUP BY 1
), mcount AS MATERIALIZED (SELECT config_id, {MG}, priority, count(*) AS m FROM mgen GROUP BY ALL
), msize AS (SELECT config_id, k, lim, l, t, {MG}, count(*) AS n, count(DISTINCT priority) AS n_sens FROM mgen GROUP BY ALL
), mclass AS MATERIALIZED (
  SELECT *, n < k OR coalesce(n_sens < l, false) OR coalesce(distance > t + 1e-9, false) AS fails FROM (
    SELECT config_id, k, lim, l, t, {MG}, n, n_sens, sum(abs(coalesce(m, 0)::HUGEINT * total - whole::HUGEINT * n))::DOUBLE / (2 * n::HUGEINT * any_value(total))::DOUBLE AS distance
    FROM msize CROSS JOIN mval LEFT JOIN mcount USING (config_id, {MG}, priority) GROUP BY config_id, k, lim, l, t, {MG}, n, n_sens)
)
"""
