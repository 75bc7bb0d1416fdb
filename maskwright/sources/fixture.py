"""The microdata stand-in over the star-schema tables: one row per order."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.schema import AnonConfig, QuasiIdentifierSpec, Scenario

SPEC = QuasiIdentifierSpec(
    names=("num", "nation", "segment", "priority", "yr", "status"),
    heights={"num": 4, "nation": 2, "segment": 1, "priority": 2, "yr": 2, "status": 1},
    sensitive="sens", positive=">T", row_id="rid",
)

#: Eight quasi-identifiers: 5 * 4 * 3 * 3 * 3 * 3 * 2 * 2 = 6,480 nodes.
WIDE = QuasiIdentifierSpec(
    names=("num", "month", "nation", "priority", "yr", "band", "segment", "status"),
    heights={"num": 4, "month": 3, "nation": 2, "priority": 2, "yr": 2, "band": 2, "segment": 1, "status": 1},
    sensitive="sens", positive=">T", row_id="rid",
)

#: Declared domains; leaves come from here, not from the data.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
YEARS = tuple(range(1995, 2002))
STATUSES = ("F", "O", "P")

#: The order's priority as a sensitive column of five values, which is no quasi-identifier then.
MANY = QuasiIdentifierSpec(
    names=("num", "nation", "segment", "yr", "status"),
    heights={"num": 4, "nation": 2, "segment": 1, "yr": 2, "status": 1},
    sensitive="priority", positive=PRIORITIES[0], row_id="rid", values=PRIORITIES,
)


def _vector(*levels: int) -> dict[str, int]:
    return dict(zip(SPEC.names, levels, strict=True))


#: config, levels of (num, nation, segment, priority, yr, status), privacy models, suppression limit, its pair without suppression.
MATRIX = [
    AnonConfig("CFG00", dict(zip(SPEC.names, (0, 0, 0, 0, 0, 0), strict=True))),
    AnonConfig("CFG01", dict(zip(SPEC.names, (3, 1, 1, 2, 2, 1), strict=True)), k=2),
    AnonConfig("CFG02", dict(zip(SPEC.names, (2, 1, 1, 1, 1, 1), strict=True)), k=5, limit=0.05, pair="CFG01"),
    AnonConfig("CFG03", dict(zip(SPEC.names, (1, 1, 0, 2, 1, 1), strict=True)), k=10, limit=0.5, pair="CFG04"),
    AnonConfig("CFG04", dict(zip(SPEC.names, (4, 2, 1, 2, 2, 1), strict=True)), k=5, limit=0.0),
    AnonConfig("CFG05", dict(zip(SPEC.names, (2, 1, 1, 1, 1, 1), strict=True)), k=5, l=2, limit=0.5, pair="CFG01"),
    AnonConfig("CFG06", dict(zip(SPEC.names, (2, 2, 1, 1, 2, 1), strict=True)), k=5, t=0.1, limit=0.5, pair="CFG04"),
    AnonConfig("CFG07", _vector(3, 2, 0, 2, 2, 1), k=5),
    AnonConfig("CFG08", _vector(2, 1, 0, 2, 2, 1), k=5, limit=0.05, pair="CFG07"),
    AnonConfig("CFG09", _vector(3, 1, 0, 2, 1, 1), k=10),
    AnonConfig("CFG10", _vector(2, 1, 1, 2, 1, 1), k=10, limit=0.05, pair="CFG09"),
    AnonConfig("CFG11", _vector(4, 1, 0, 1, 1, 0), k=5, limit=0.05, pair="CFG07"),
    AnonConfig("CFG12", _vector(3, 2, 1, 0, 2, 0), k=5, l=2, limit=0.05, pair="CFG07"),
    AnonConfig("CFG13", _vector(2, 2, 1, 2, 1, 0), k=5, l=2, limit=0.5, pair="CFG07"),
    AnonConfig("CFG14", _vector(4, 0, 1, 2, 2, 1), k=5, t=0.2, limit=0.05, pair="CFG07"),
    AnonConfig("CFG15", _vector(3, 2, 1, 2, 0, 1), k=5, t=0.1, limit=0.5, pair="CFG07"),
    AnonConfig("CFG16", _vector(2, 2, 0, 2, 2, 1), k=5, l=2, t=0.2, limit=0.5, pair="CFG07"),
]
#: The configurations of every query but the logistic models', which take all of the matrix.
CONFIGS = MATRIX[:7]
#: Configuration with suppression -> its counterpart without.
PAIRS = {c.config_id: c.pair for c in CONFIGS if c.pair}

_TRIANGLE = {-2: 0.1, -1: 0.2, 0: 0.4, 1: 0.2, 2: 0.1}
_BASE = ("num", "segment", "status", "nation")
SCENARIOS = [
    Scenario("BASE", _BASE, _TRIANGLE, "11003"),
    Scenario("S1", ("num", "status"), _TRIANGLE, "11003"),
    Scenario("S2", SPEC.names, _TRIANGLE, "11003"),
    Scenario("S3", _BASE, {0: 1.0}, "11003"),
    Scenario("S4", _BASE, {d: 1.0 / 11.0 for d in range(-5, 6)}, "11003.4"),
]
TARGETS, DRAWS, REPLICATES = 200, 5, 2000


#: config, levels of (num, nation, segment, yr, status), privacy models against the five values, suppression limit.
MANY_CONFIGS = [
    AnonConfig("CFG00", dict(zip(MANY.names, (0, 0, 0, 0, 0), strict=True))),
    AnonConfig("CFG01", dict(zip(MANY.names, (3, 1, 1, 2, 1), strict=True)), k=5, l=5),
    AnonConfig("CFG02", dict(zip(MANY.names, (2, 1, 1, 1, 1), strict=True)), k=5, l=4, limit=0.2),
    AnonConfig("CFG03", dict(zip(MANY.names, (3, 2, 1, 1, 1), strict=True)), k=5, t=0.15, limit=0.5),
    AnonConfig("CFG04", dict(zip(MANY.names, (1, 2, 1, 2, 0), strict=True)), k=10, l=3, t=0.25, limit=0.5),
    AnonConfig("CFG05", dict(zip(MANY.names, (4, 2, 1, 2, 1), strict=True)), k=5, l=5, t=0.1),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def microdata(orders: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    # 25 nations at every scale
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.col("o_orderkey").alias("rid"),
        (F.floor((F.col("c_acctbal") + 1000.0) / 110.0).cast("int") + 1).alias("num"),
        F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority"),
        F.year("o_orderdate").alias("yr"), F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_totalprice") > 375000.0, ">T").otherwise("<=T").alias("sens"),
        F.when(F.col("o_orderkey") % 3 == 0, "holdout").otherwise("train").alias("split"),
    )


def wide_microdata(md: DataFrame, orders: DataFrame) -> DataFrame:
    """The microdata with the order's month (1 to 12) and price band (0 to 19) as two more quasi-identifiers."""
    more = orders.select(F.col("o_orderkey").alias("rid"), F.month("o_orderdate").alias("month"), F.least(F.floor(F.col("o_totalprice") / 25000.0), F.lit(19)).cast("int").alias("band"))
    return md.join(more, "rid")


def hierarchies(spark: SparkSession, nation: DataFrame, region: DataFrame, wide: bool = False) -> DataFrame:
    """``attr, leaf, level, label`` for all quasi-identifiers, a local relation; leaves are strings."""
    # 25 nations at every scale; all other leaves are declared
    names = {r["r_regionkey"]: r["r_name"] for r in region.select("r_regionkey", "r_name").collect()}
    regions = {r["n_name"]: names[r["n_regionkey"]] for r in nation.select("n_name", "n_regionkey").collect() if r["n_regionkey"] in names}

    def block(v: int, width: int) -> str:
        low = (v - 1) - (v - 1) % width + 1
        return f"{low}-{low + width - 1}"

    paths = {
        "num": [(str(v), *[block(v, w) for w in (5, 10, 20)]) for v in range(1, 101)],
        "nation": list(regions.items()),
        "segment": [(v,) for v in SEGMENTS],
        "priority": [(v, "HIGH" if v[0] in "12" else "LOW") for v in PRIORITIES],
        "yr": [(str(v), "early" if v <= 1998 else "late") for v in YEARS],
        "status": [(v,) for v in STATUSES],
    }
    if wide:
        paths["month"] = [(str(v), f"q{(v + 2) // 3}", f"h{(v + 5) // 6}") for v in range(1, 13)]
        paths["band"] = [(str(v), f"b{v // 5}") for v in range(20)]
    long = [(attr, path[0], level, label) for attr, each in paths.items() for path in each for level, label in enumerate((*path, "*"))]
    kinds = (pa.string(), pa.string(), pa.int32(), pa.string())
    return spark.createDataFrame(pa.table({name: pa.array(c, kind) for name, c, kind in zip(("attr", "leaf", "level", "label"), zip(*long, strict=True), kinds, strict=True)}))
