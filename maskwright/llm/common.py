"""Small helpers that the text operators share."""

from __future__ import annotations

import functools
import itertools
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it was counted and is no longer than this.
BROADCAST_ROWS = 200_000


#: Rows and bytes of an Arrow batch of whole texts. A worker holds a batch, its strings and the result at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def lean(frame: DataFrame) -> None:
    """Let the session hand whole texts to Python in small batches, if it does not yet; it stays so afterwards, as
    plans are run later."""
    conf = frame.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        plain = re.fullmatch(r"(\d+)b?", conf.get(key))  # a size with another unit is set anew
        if plain is None or not 0 < int(plain[1]) <= most:
            conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; set one of this machine only in local mode (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


def cut(frame: DataFrame) -> DataFrame:
    """Materialise ``frame`` in the shared checkpoint folder, which survives lost executors."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint()


def broadcast_if_small(frame: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the (materialised, slim) frame has at most ``limit`` rows, else the frame,
    so that beyond the bound the join is an ordinary shuffled one."""
    return F.broadcast(frame) if frame.limit(limit + 1).count() <= limit else frame


def written(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` as Parquet in the shared folder, read again."""
    spark = frame.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def keep_best(marked: DataFrame, found: DataFrame, keys: dict[str, str]) -> DataFrame:
    """The rows of ``marked`` that the decisions ``found`` keep, exactly one for each decision.

    ``keys`` maps columns of ``marked`` to those of ``found``, which has one row per distinct key with
    ``best`` (it stays) and ``copies`` (how many rows have this key). Nulls equal each other.
    """

    def matches(rows: DataFrame):
        return functools.reduce(lambda a, b: a & b, [marked[m].eqNullSafe(rows[f]) for m, f in keys.items()])

    dropped = broadcast_if_small(found.filter(~F.col("best")).select(*keys.values()))
    kept = marked.join(dropped, matches(dropped), "left_anti")
    twice = found.filter("best and copies > 1").select(*keys.values())
    if twice.isEmpty():
        return kept
    twice = broadcast_if_small(twice)
    again = marked.join(twice, matches(twice), "left_semi").dropDuplicates([*keys])
    return kept.join(twice, matches(twice), "left_anti").unionByName(again)


def order_numbers(frame: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``frame`` with column ``name``: 1, 2, 3 ... in the given order, numbered in all tasks at once.

    Rows are dealt by ranges of the order, written, and counted by range; a range's rows are numbered on top of the ranges before.
    """
    placed = cut(frame.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).orderBy("__range").collect()  # one row for each range
    before = [0, *itertools.accumulate(row["n"] for row in sizes)]
    offset = F.element_at(F.create_map(*[F.lit(x) for row, n in zip(sizes, before, strict=False) for x in (row["__range"], n)]), F.col("__range")) if sizes else F.lit(0)
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return placed.withColumn(name, (inside + offset).cast("long")).drop("__range")
