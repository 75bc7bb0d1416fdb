"""Search of the generalisation lattice on a signature table.

Raw rows are read once and collapsed to distinct leaf combinations with counts; every
node is evaluated from these. Loss is additive over quasi-identifiers and a suppressed
row costs as much as a fully generalised one, so a node's loss from the marginals alone
is a lower bound. Nodes are evaluated in batches by that bound until no open node can
beat the best one found, which needs no assumption of monotonicity.

A node's classes are rolled up from those of a less general node where that is cheaper than from the leaves: before a batch the search
materialises the nodes (cuboids) that spare the batch more rows than they cost, each from the smallest one below it.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.writers import shared
from .hierarchy import at_level, leafsets, with_paths
from .schema import QuasiIdentifierSpec, require

Node = tuple[int, ...]


def node_name(node: Node) -> str:
    return ".".join(map(str, node))


#: Declared sensitive domains of at most so many values can be searched under l and t.
VALUES = 64
#: A job costs about as much as reading so many class rows; at most so many cuboids are made before a batch.
JOB_ROWS, CUBOIDS = 100_000, 8


def _steps(spec: QuasiIdentifierSpec) -> list[int]:
    return [math.prod(spec.heights[q] + 1 for q in spec.names[k + 1 :]) for k in range(len(spec.names))]


def node_number(node: Node, spec: QuasiIdentifierSpec) -> int:
    """The place of a node in the lattice's lexicographic order."""
    return sum(v * step for v, step in zip(node, _steps(spec), strict=True))


def measures(spec: QuasiIdentifierSpec) -> list[str]:
    """What is added up for a class: its rows, and of them the sensitive-positive ones or those of each declared value."""
    return ["n", *(["n_pos"] if spec.values is None else [f"c_{i}" for i in range(len(spec.values))])]


def signature(rows: DataFrame, hier: DataFrame, spec: QuasiIdentifierSpec) -> DataFrame:
    """Distinct leaf combinations with their :func:`measures` and the label paths."""
    require(spec.values is None or len(spec.values) <= VALUES, "LATTICE_VALUES", f"at most {VALUES} sensitive values")
    wanted = {"n_pos": spec.positive} if spec.values is None else {f"c_{i}": v for i, v in enumerate(spec.values)}
    sums = [F.sum((F.col(spec.sensitive) == v).cast("long")).alias(name) for name, v in wanted.items()]
    return with_paths(rows.groupBy(*spec.names).agg(F.count(F.lit(1)).alias("n"), *sums), hier, spec)


def _levels(spec: QuasiIdentifierSpec) -> dict[str, Column]:
    """Each attribute's level at the node whose number is column ``node``."""
    return {q: F.expr(f"(node div {step}) % {spec.heights[q] + 1}").cast("int") for q, step in zip(spec.names, _steps(spec), strict=True)}


def _numbers(nodes: list[Node], spec: QuasiIdentifierSpec) -> Column:
    """The nodes as one literal that the planner folds, however many there are."""
    return F.split(F.lit("|".join(str(node_number(n, spec)) for n in nodes)), r"\|").cast("array<int>")


def classes(sig: DataFrame, nodes: list[Node], spec: QuasiIdentifierSpec) -> DataFrame:
    """Equivalence classes of each node: ``node, <labels>`` and their measures."""
    at = _levels(spec)
    spread = sig.select(*measures(spec), *[f"path_{q}" for q in spec.names], F.explode(_numbers(nodes, spec)).alias("node"))
    labels = spread.select("node", *measures(spec), *[at_level(q, at[q]).alias(f"g_{q}") for q in spec.names])
    found = labels.groupBy("node", *[f"g_{q}" for q in spec.names]).agg(*[F.sum(m).alias(m) for m in measures(spec)])
    return found.withColumn("node", F.concat_ws(".", *[at[q].cast("string") for q in spec.names]))


#: Rows of a hierarchy that are coded; unit fractions of a loss whose denominators have a larger common multiple are rounded to it.
HIERARCHY_ROWS, UNITS = 1_000_000, 1 << 31


@dataclass(frozen=True)
class Codes:
    """How labels are numbered: each attribute's share of a class key, the number of key columns, and the loss units of one cell."""

    key_of: dict[str, int]
    keys: int
    unit: int


def coded(sig: DataFrame, hier: DataFrame, spec: QuasiIdentifierSpec) -> tuple[DataFrame, Codes]:
    """The signature with whole numbers in the place of labels: ``k_<qi>`` (by level, what the label adds to the class key) and ``u_<qi>`` (by level,
    the loss of the cell in units). A class key is a sum of the former, in one long for as many attributes as fit."""
    rows = hier.select("attr", "leaf", "level", "label").filter(F.col("attr").isin(*spec.names)).limit(HIERARCHY_ROWS + 1).collect()
    require(len(rows) <= HIERARCHY_ROWS, "LATTICE_HIERARCHY", f"hierarchies have at most {HIERARCHY_ROWS} rows")
    paths: dict[str, dict[str, list[str]]] = {q: {} for q in spec.names}
    for r in sorted(rows, key=lambda r: r["level"]):
        paths[r["attr"]].setdefault(r["leaf"], []).append(r["label"])
    dens = {q: max(len(paths[q]) - 1, 1) for q in spec.names}
    unit = math.lcm(*dens.values())
    unit = unit if unit <= UNITS else UNITS
    radix, column, key_of = 1, 0, {}
    for q in spec.names:
        size = max(len(paths[q]), 1)
        if radix * size >= 1 << 62:
            radix, column = 1, column + 1
        key_of[q] = column
        by_level: list[dict[str, int]] = [{} for _ in range(spec.heights[q] + 1)]
        leaves = [{} for _ in by_level]
        for path in paths[q].values():
            for v, label in enumerate(path):
                by_level[v].setdefault(label, len(by_level[v]))
                leaves[v][label] = leaves[v].get(label, 0) + 1
        table = pa.table({
            f"__{q}": pa.array(list(paths[q]), pa.string()),
            f"k_{q}": pa.array([[radix * by_level[v][x] for v, x in enumerate(p)] for p in paths[q].values()], pa.list_(pa.int64())),
            f"u_{q}": pa.array([[round((leaves[v][x] - 1) * unit / dens[q]) for v, x in enumerate(p)] for p in paths[q].values()], pa.list_(pa.int64())),
        })
        # declared domains, of a checked length
        sig = sig.join(sig.sparkSession.createDataFrame(table), F.col(q).cast("string") == F.col(f"__{q}")).drop(f"__{q}", f"path_{q}")
        radix *= size
    kept = [f"{x}_{q}" for q in spec.names for x in "ku"]
    return sig.select(*measures(spec), *kept), Codes(key_of, column + 1, unit)


def _placed(frame: DataFrame, level, codes: Codes, spec: QuasiIdentifierSpec) -> tuple[list[Column], Column]:
    """The class key's columns of a row, and its loss, at the levels that ``level`` gives for each attribute."""
    keys = []
    for k in range(codes.keys):
        parts = [F.get(f"k_{q}", level(q)) for q in spec.names if codes.key_of[q] == k]
        keys.append(functools.reduce(lambda a, b: a + b, parts).alias(f"key{k}"))
    return keys, functools.reduce(lambda a, b: a + b, [F.get(f"u_{q}", level(q)) for q in spec.names])


def rolled(sig: DataFrame, node: Node, codes: Codes, spec: QuasiIdentifierSpec) -> DataFrame:
    """The classes of ``node`` as a coded signature of its own: every class keeps the numbers of one of its leaf combinations, which
    agree with those of all the others from the node's levels on."""
    at = dict(zip(spec.names, node, strict=True))
    keys, _ = _placed(sig, lambda q: F.lit(at[q]), codes, spec)
    arrays = [f"{x}_{q}" for q in spec.names for x in "ku"]
    return sig.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures(spec)], *[F.any_value(a).alias(a) for a in arrays]).select(*measures(spec), *arrays)


def coded_classes(sig: DataFrame, nodes: list[Node], codes: Codes, spec: QuasiIdentifierSpec) -> DataFrame:
    """``node, <key>`` of the classes of each node with their measures and ``units`` (loss of all their rows)."""
    at = _levels(spec)
    spread = sig.withColumn("node", F.explode(_numbers(nodes, spec)))
    keys, units = _placed(spread, lambda q: at[q], codes, spec)
    placed = spread.select("node", *keys, *measures(spec), (F.col("n") * units).alias("units"))
    return placed.groupBy("node", *[f"key{k}" for k in range(codes.keys)]).agg(*[F.sum(m).alias(m) for m in [*measures(spec), "units"]])


class Cuboids:
    """The signature and the cuboids rolled up from it, with what each has cost and spared."""

    def __init__(self, sig: DataFrame, rows: int, labels: dict[tuple[str, int], int], codes: Codes, spec: QuasiIdentifierSpec):
        self.spec, self.codes, self.frames = spec, codes, {tuple([0] * len(spec.names)): (sig, rows)}
        self.read, self.from_leaves, self.rows = 0, 0, rows
        self.every = np.array(spec.lattice())
        # distinct classes to expect of rows that fall evenly on the node's cells
        cells = np.prod([np.array([float(labels[q, v]) for v in self.every[:, k]]) for k, q in enumerate(spec.names)], axis=0)
        self.expected = np.minimum(cells * -np.expm1(-rows / cells), rows)

    def _sources(self, nodes: np.ndarray) -> tuple[list[Node], np.ndarray]:
        """For each node the smallest frame that lies below it, and its rows."""
        kept = sorted(self.frames, key=lambda n: (self.frames[n][1], n), reverse=True)
        cost, which = np.full(len(nodes), np.inf), np.zeros(len(nodes), int)
        for k, anchor in enumerate(kept):
            below = (nodes >= np.array(anchor)).all(axis=1)
            cost[below], which[below] = self.frames[anchor][1], k
        return [kept[k] for k in which], cost

    def prepare(self, batch: list[Node]) -> None:
        """Materialise what spares the batch more than it costs."""
        nodes = np.array(batch)
        covers = np.ones((len(self.every), len(nodes)), bool)
        for k in range(nodes.shape[1]):
            covers &= self.every[:, k : k + 1] <= nodes[:, k]
        for _ in range(CUBOIDS):
            cost = self._sources(nodes)[1]
            own = self._sources(self.every)[1]
            gain = (np.maximum(cost - self.expected[:, None], 0) * covers).sum(axis=1) - own - JOB_ROWS
            best = int(gain.argmax())
            anchor = tuple(map(int, self.every[best]))
            if gain[best] <= 0:
                return
            source = self._sources(self.every[best : best + 1])[0][0]
            frame = shared(rolled(self.frames[source][0], anchor, self.codes, self.spec))
            self.read += self.frames[source][1]
            self.expected[best] = held = frame.count()
            self.frames[anchor] = (frame, held)

    def classes(self, batch: list[Node]) -> DataFrame:
        """The classes of all nodes of a batch, each from its smallest frame."""
        sources, cost = self._sources(np.array(batch))
        self.read += int(cost.sum())
        self.from_leaves += self.rows * len(batch)
        by: dict[Node, list[Node]] = {}
        for node, source in zip(batch, sources, strict=True):
            by.setdefault(source, []).append(node)
        frames = [coded_classes(self.frames[source][0], nodes, self.codes, self.spec) for source, nodes in by.items()]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out


def failing(k: int, l: int | None = None, t: float | None = None, total: int = 0, positive: int = 0, whole: list[int] | None = None):  # noqa: E741
    """Whether a class breaks k-anonymity, distinct l-diversity or equal-distance t-closeness; ``whole`` are the numbers of each
    declared sensitive value in the table (without them the column is binary)."""
    bad = F.col("n") < k
    if whole is None:
        if l is not None:
            bad = bad | (F.when((F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n")), 2).otherwise(1) < l)
        if t is not None:
            bad = bad | (F.abs(F.col("n_pos") * F.lit(total) - F.lit(positive) * F.col("n")).cast("double") > (F.lit(t) + 1e-9) * F.col("n").cast("double") * total)
        return bad
    if l is not None:
        bad = bad | (sum(((F.col(f"c_{i}") > 0).cast("int") for i in range(len(whole))), F.lit(0)) < l)
    if t is not None:
        gaps = sum((F.abs(F.col(f"c_{i}").cast("decimal(19,0)") * F.lit(total) - F.col("n").cast("decimal(19,0)") * F.lit(x)).cast("double") for i, x in enumerate(whole)), F.lit(0.0))
        bad = bad | (gaps > 2 * (F.lit(t) + 1e-9) * F.col("n").cast("double") * total)
    return bad


def check(found: DataFrame, bad) -> DataFrame:
    """``node, n_classes, min_class, suppressed`` of each node."""
    return found.groupBy("node").agg(F.count(F.lit(1)).alias("n_classes"), F.min("n").alias("min_class"), F.sum(F.when(bad, F.col("n")).otherwise(0)).alias("suppressed"))


def cell_losses(hier: DataFrame) -> DataFrame:
    """``attr, level, label, num, den``: loss of a cell as (leaves - 1) / (domain - 1)."""
    sets = leafsets(hier)
    domain = sets.filter("level = 0").groupBy("attr").agg(F.sum("leaves").alias("domain"))
    return sets.join(domain, "attr").select("attr", "level", "label", (F.col("leaves") - 1).alias("num"), (F.col("domain") - 1).alias("den"))


@dataclass(frozen=True)
class Optimum:
    node: Node
    loss: float
    suppressed: int
    evaluated: int
    rows_read: int = 0
    rows_from_leaves: int = 0
    cuboids: int = 0


def marginals(numbered: DataFrame, spec: QuasiIdentifierSpec) -> tuple[dict[tuple[str, int], int], dict[tuple[str, int], int]]:
    """Summed loss units, and about how many labels occur, for each attribute and level: one row, bounded by the hierarchies' shape."""
    places = [(q, v) for q in spec.names for v in range(spec.heights[q] + 1)]
    sums = [F.sum((F.col("n") * F.get(f"u_{q}", F.lit(v))).cast("decimal(38,0)")) for q, v in places]
    seen = [F.approx_count_distinct(F.get(f"k_{q}", F.lit(v))) for q, v in places]
    row = numbered.agg(*[x.alias(f"x{k}") for k, x in enumerate([*sums, *seen])]).first()
    return {p: int(row[k]) for k, p in enumerate(places)}, {p: max(int(row[len(places) + k]), 1) for k, p in enumerate(places)}


def optimum(sig: DataFrame, hier: DataFrame, spec: QuasiIdentifierSpec, k: int, limit: float, l: int | None = None, t: float | None = None, batch: int = 48, roll_up: bool = True) -> Optimum | None:  # noqa: E741
    """The admissible node of least loss; ties go to the least sum of levels, then the first vector.

    A node is admissible if the rows of failing classes are at most floor(rows * limit). Suppressed rows
    cost 1 in every quasi-identifier. The result tells how many nodes were evaluated, how many class rows were read for that, and how
    many it would have been from the leaves each time.
    """
    numbered, codes = coded(sig, hier, spec)
    numbered = shared(numbered)
    totals = numbered.agg(F.count(F.lit(1)), *[F.sum(m) for m in measures(spec)]).first()
    rows, total = int(totals[0]), int(totals[1] or 0)
    if not total:
        return None
    whole = None if spec.values is None else [int(x) for x in totals[2:]]
    bad = failing(k, l, t, total, int(totals[2] or 0) if whole is None else 0, whole)
    budget = int(total * round(limit * 1_000_000) // 1_000_000)
    most = codes.unit * len(spec.names)
    sums, labels = marginals(numbered, spec)
    bound = {n: sum(sums[q, v] for q, v in zip(spec.names, n, strict=True)) / (most * total) for n in spec.lattice()}
    order = sorted(bound, key=lambda n: (bound[n], sum(n), n))
    by_number = {node_number(n, spec): n for n in order}
    cuboids = Cuboids(numbered, rows, labels, codes, spec)
    best, evaluated = None, 0
    while evaluated < len(order):
        todo = order[evaluated : evaluated + batch]
        if best is not None:
            todo = [n for n in todo if bound[n] <= best[0] + 1e-12]
            if not todo:
                break
        evaluated += len(todo)
        batch *= 2  # the later a node, the less likely it is to be looked at at all
        if roll_up:
            cuboids.prepare(todo)
        found = cuboids.classes(todo).withColumn("bad", bad)
        units = F.when(F.col("bad"), F.col("n") * most).otherwise(F.col("units")).cast("decimal(38,0)")
        scored = found.groupBy("node").agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("suppressed"), F.sum(units).alias("units")).filter(F.col("suppressed") <= budget)
        for r in scored.collect():  # a row for each node of the batch at most
            node = by_number[r["node"]]
            loss = int(r["units"]) / (most * total)
            key = (round(loss, 12), sum(node), node)
            if best is None or key < best[1]:
                best = (loss, key, node, int(r["suppressed"]))
    return None if best is None else Optimum(best[2], best[0], best[3], evaluated, cuboids.read, cuboids.from_leaves, len(cuboids.frames) - 1)
