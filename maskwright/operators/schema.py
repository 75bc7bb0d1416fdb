"""Roles of columns, privacy configurations and attack scenarios."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


class ContractError(ValueError):
    """A broken rule with a stable code."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def require(condition: bool, code: str, message: str) -> None:
    if not condition:
        raise ContractError(code, message)


@dataclass(frozen=True)
class QuasiIdentifierSpec:
    """Quasi-identifiers in their order, the heights of their hierarchies, sensitive column, row id.

    ``values`` is the sensitive column's declared domain; without it the column is binary (``positive`` or not).
    """

    names: tuple[str, ...]
    heights: dict[str, int]
    sensitive: str
    positive: str
    row_id: str
    values: tuple[str, ...] | None = None

    def __post_init__(self):
        require(self.values is None or len(set(self.values)) == len(self.values) > 1, "QI_VALUES", "a declared sensitive domain has distinct values")
        require(len(set(self.names)) == len(self.names) > 0, "QI_UNIQUE", "quasi-identifiers must be distinct")
        require(set(self.heights) == set(self.names), "QI_HEIGHTS", "every quasi-identifier needs a height")
        require(self.sensitive not in self.names and self.row_id not in self.names, "QI_ROLES", "a column has one role")
        require(all(type(h) is int and h >= 1 for h in self.heights.values()), "QI_HEIGHT_RANGE", "heights are whole and positive")

    def lattice(self) -> list[tuple[int, ...]]:
        """All full-domain vectors, in lexicographic order."""
        nodes: list[tuple[int, ...]] = [()]
        for name in self.names:
            nodes = [(*n, level) for n in nodes for level in range(self.heights[name] + 1)]
        return nodes


@dataclass(frozen=True)
class AnonConfig:
    """One release: its privacy models, suppression limit and generalisation vector."""

    config_id: str
    vector: dict[str, int]
    k: int = 1
    l: int | None = None  # noqa: E741
    t: float | None = None
    limit: float = 0.0
    pair: str | None = field(default=None)

    def validate(self, spec: QuasiIdentifierSpec) -> AnonConfig:
        require(set(self.vector) == set(spec.names), "CFG_VECTOR_KEYS", "the vector names every quasi-identifier")
        require(all(0 <= self.vector[q] <= spec.heights[q] for q in spec.names), "CFG_VECTOR_RANGE", "levels lie within the hierarchy")
        require(type(self.k) is int and self.k >= 1, "CFG_K", "k is a positive whole number")
        require(self.l is None or (type(self.l) is int and self.l >= 2), "CFG_L", "l is at least 2")
        require(self.t is None or 0 < self.t <= 1, "CFG_T", "t lies in (0, 1]")
        require(0 <= self.limit < 1, "CFG_LIMIT", "the suppression limit lies in [0, 1)")
        return self


def catalogue(configs: list[AnonConfig], spec: QuasiIdentifierSpec) -> list[AnonConfig]:
    """The configurations, if they form a closed catalogue: numbered ids in order, one raw release that comes first, models that
    suppress only if they ask for something, suppression limits in whole millionths, and pairs of a release that may suppress with
    one that may not, under the same k or a lesser one."""
    require(bool(configs), "CAT_EMPTY", "there are configurations")
    ids = [c.config_id for c in configs]
    require(ids == [f"CFG{k:02d}" for k in range(len(ids))], "CAT_IDS", "ids are CFG00, CFG01, ... in order")
    by_id = {c.config_id: c.validate(spec) for c in configs}
    raw = configs[0]
    require(raw.k == 1 and raw.l is None and raw.t is None and not raw.limit, "CAT_RAW", "the first configuration asks for nothing")
    require(not any(raw.vector.values()), "CAT_RAW_VECTOR", "the first configuration generalises nothing")
    for c in configs[1:]:
        require(c.k >= 2, "CAT_K", f"{c.config_id} asks for k of 2 or more")
        require(c.l is None or c.l <= c.k, "CAT_L", f"{c.config_id}: a class of k rows has no more than k sensitive values")
        require(any(c.vector.values()), "CAT_VECTOR", f"{c.config_id} generalises something")
    for c in configs:
        require(type(c.limit) is float, "CAT_LIMIT_TYPE", f"{c.config_id}: the limit is a float")
        require(math.copysign(1.0, c.limit) > 0, "CAT_LIMIT_SIGN", f"{c.config_id}: the limit is no negative zero")
        require(round(c.limit * 1_000_000) / 1_000_000 == c.limit, "CAT_LIMIT_STEP", f"{c.config_id}: the limit is a whole number of millionths")
        if c.pair is not None:
            require(c.pair in by_id and c.pair != c.config_id, "CAT_PAIR", f"{c.config_id}: the pair is another configuration")
            other = by_id[c.pair]
            require(c.limit > 0 and other.limit == 0, "CAT_PAIR_LIMIT", f"{c.config_id}: a pair is one that may suppress with one that may not")
            require(other.k <= c.k, "CAT_PAIR_K", f"{c.config_id}: the pair asks for no more")
    return configs


def configurations(spark: SparkSession, spec: QuasiIdentifierSpec, configs: list[AnonConfig]) -> DataFrame:
    """The configurations as a table: id, k, limit, l and t (null where not asked for), one level column for each quasi-identifier."""
    require(len({c.config_id for c in configs}) == len(configs), "CFG_UNIQUE", "configuration ids are distinct")
    rows = [(c.config_id, c.k, c.limit, c.l, c.t, *[c.validate(spec).vector[q] for q in spec.names]) for c in configs]
    kinds = [("config_id", pa.string()), ("k", pa.int32()), ("lim", pa.float64()), ("l", pa.int32()), ("t", pa.float64()), *[(f"lv_{q}", pa.int32()) for q in spec.names]]
    columns = zip(*rows, strict=True)
    return spark.createDataFrame(pa.table({name: pa.array(c, kind) for (name, kind), c in zip(kinds, columns, strict=True)}))


@dataclass(frozen=True)
class Scenario:
    """What an attacker knows, and the probabilities of errors of the numeric attribute."""

    scenario: str
    known: tuple[str, ...]
    errors: dict[int, float]
    stream: str
