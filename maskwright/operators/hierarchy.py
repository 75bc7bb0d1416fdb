"""Generalisation hierarchies as long tables ``attr, leaf, level, label``, and what is computed from them."""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .schema import QuasiIdentifierSpec, require

#: Hierarchies are dimension tables over declared domains; larger ones are joined without a hint.
BROADCAST_ROWS = 100_000


def local(frame: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A dimension of at most ``limit`` rows as a local relation, whose size the planner knows; a larger
    one stays as it is."""
    rows = frame.limit(limit + 1).toArrow()
    return frame.sparkSession.createDataFrame(rows) if rows.num_rows <= limit else frame


def sized(frame: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the dimension has at most ``limit`` rows."""
    return F.broadcast(frame) if frame.limit(limit + 1).count() <= limit else frame


def unpivot(paths: DataFrame, attr: str, columns: list[str]) -> DataFrame:
    """Path rows (leaf first, root last) to the long table."""
    return paths.select(F.lit(attr).alias("attr"), F.col(columns[0]).cast("string").alias("leaf"), F.posexplode(F.array(*[F.col(c).cast("string") for c in columns])).alias("level", "label"))


def functional_violations(hier: DataFrame) -> DataFrame:
    """Labels with more than one parent at the next level: ``attr, level, label, parents``."""
    up = hier.select("attr", "leaf", (F.col("level") - 1).alias("level"), F.col("label").alias("parent"))
    return hier.join(up, ["attr", "leaf", "level"]).groupBy("attr", "level", "label").agg(F.countDistinct("parent").alias("parents")).filter("parents > 1")


def nodes_per_level(hier: DataFrame) -> DataFrame:
    return hier.groupBy("attr", "level").agg(F.countDistinct("label").alias("nodes"))


def uncovered(values: DataFrame, hier: DataFrame) -> DataFrame:
    """``attr, value`` of the data that no leaf covers."""
    leaves = hier.filter("level = 0").select("attr", F.col("leaf").alias("value"))
    return values.select("attr", "value").distinct().join(leaves, ["attr", "value"], "left_anti")


def unused(values: DataFrame, hier: DataFrame) -> DataFrame:
    """Leaves that do not occur in the data."""
    return hier.filter("level = 0").select("attr", F.col("leaf").alias("value")).exceptAll(values.select("attr", "value").distinct())


def interval_relabel(hier: DataFrame, attr: str) -> DataFrame:
    """Blocks of a numeric attribute named by their least and greatest leaf; the partition stays the same."""
    block = Window.partitionBy("level", "label")
    low, high = F.min(F.col("leaf").cast("int")).over(block), F.max(F.col("leaf").cast("int")).over(block)
    return hier.filter(F.col("attr") == attr).select("leaf", "level", F.when(low == high, low.cast("string")).otherwise(F.concat_ws("-", low.cast("string"), high.cast("string"))).alias("label"))


def partition_blocks(hier: DataFrame) -> DataFrame:
    """``level, block``: the sorted leaves of each label, without its name."""
    return hier.groupBy("level", "label").agg(F.array_join(F.array_sort(F.collect_list("leaf")), ",").alias("block")).select("level", "block")


def partition_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Blocks that only one of two hierarchies of an attribute has; none if they part the leaves alike."""
    x, y = partition_blocks(a), partition_blocks(b)
    return x.exceptAll(y).withColumn("side", F.lit("a")).unionByName(y.exceptAll(x).withColumn("side", F.lit("b")))


def leafsets(hier: DataFrame) -> DataFrame:
    """``attr, level, label, leaves``: how many leaves each node covers."""
    return hier.groupBy("attr", "level", "label").agg(F.count(F.lit(1)).alias("leaves"))


def label_arrays(hier: DataFrame, attr: str) -> DataFrame:
    """``leaf, labels``: the path of each leaf as an array over the levels."""
    path = F.transform(F.array_sort(F.collect_list(F.struct("level", "label"))), lambda s: s["label"])
    return hier.filter(F.col("attr") == attr).groupBy("leaf").agg(path.alias("labels"))


#: An attribute with at most so many leaves is looked up in a literal map; others are joined.
MAP_LEAVES = 64


def _paths(hier: DataFrame) -> dict[str, dict[str, list[str]]] | None:
    """Attribute -> leaf -> labels by level, of a hierarchy of at most BROADCAST_ROWS rows."""
    rows = hier.select("attr", "leaf", "level", "label").limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS:
        return None
    out: dict[str, dict[str, list[str]]] = {}
    for attr, leaf, _, label in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(attr, {}).setdefault(leaf, []).append(label)
    return out


def with_paths(rows: DataFrame, hier: DataFrame, spec: QuasiIdentifierSpec) -> DataFrame:
    """``rows`` with a column ``path_<qi>`` for each quasi-identifier; rows with an unknown value fall away."""
    found = _paths(hier)
    mapped = {q: found.get(q, {}) for q in spec.names if found is not None and len(found.get(q, {})) <= MAP_LEAVES}
    literal = {}
    for q, leaves in mapped.items():
        items = [x for leaf, labels in leaves.items() for x in (F.lit(leaf), F.array(*map(F.lit, labels)))]
        literal[f"path_{q}"] = (F.create_map(*items) if items else F.create_map().cast("map<string,array<string>>"))[F.col(q).cast("string")]
    if literal:
        rows = rows.withColumns(literal).filter(functools.reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in literal]))
    for q in spec.names:
        if q in mapped:
            continue
        if found is not None:
            paths = rows.sparkSession.createDataFrame(pa.table({f"__{q}": pa.array(list(found[q]), pa.string()), f"path_{q}": pa.array(list(found[q].values()), pa.list_(pa.string()))}))
        else:
            path = F.transform(F.array_sort(F.collect_list(F.struct("level", "label"))), lambda s: s["label"])
            paths = hier.filter(F.col("attr") == q).groupBy(F.col("leaf").alias(f"__{q}")).agg(path.alias(f"path_{q}"))
        rows = rows.join(paths, F.col(q).cast("string") == F.col(f"__{q}")).drop(f"__{q}")
    return rows


def at_level(qi: str, level: Column) -> Column:
    return F.element_at(F.col(f"path_{qi}"), level + 1)


def generalize(rows: DataFrame, hier: DataFrame, vector: dict[str, int], spec: QuasiIdentifierSpec) -> DataFrame:
    """Full-domain recoding: each quasi-identifier at its level of the vector; other columns stay."""
    require(set(vector) == set(spec.names), "CFG_VECTOR_KEYS", "the vector names every quasi-identifier")
    for q in spec.names:
        at = hier.filter((F.col("attr") == q) & (F.col("level") == vector[q])).select(F.col("leaf").alias("__leaf"), F.col("label").alias("__label"))
        rows = rows.join(at, F.col(q).cast("string") == F.col("__leaf")).withColumn(q, F.col("__label")).drop("__leaf", "__label")
    return rows
