"""Sinks: canonical tables, families with NA, checkpoints by configuration, the public side."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.export import public, rendered
from ..operators.schema import require


def shared_folder(spark) -> str:
    """The checkpoint folder that the cluster shares. A folder of this machine is taken only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        require(bool(named) or re.fullmatch(r"local(\[.*\])?", context.master) is not None, "CHECKPOINT_DIR", "set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def shared(frame: DataFrame) -> DataFrame:
    """``frame``, worked out once and kept in the shared checkpoint folder, which survives lost executors.

    ``spark.cleaner.referenceTracking.cleanCheckpoints`` lets Spark delete what is no longer referred to.
    """
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def canonical_table(rows: DataFrame, path: str, columns: list[str], order: str, sep: str = ";") -> None:
    """Header and rows in the order of ``order``, LF-terminated; never over an existing path.

    Range-partitioned, so the files in name order hold the rows in order whatever their number.
    """
    rows.orderBy(order).select(*columns).write.mode("errorifexists").option("sep", sep).option("header", True).option("lineSep", "\n").option("quote", "").csv(path)


def release_table(released: DataFrame, path: str, columns: list[str], row_id: str) -> None:
    """All input rows, suppressed ones included, tab-separated in the physical column order."""
    canonical_table(released, path, columns, row_id, "\t")


def family(frame: DataFrame, path: str, expected_rows: int | None = None) -> None:
    """A published family: public columns only, NA rendered, row count checked, read back and compared."""
    out = rendered(public(frame))
    if expected_rows is not None:
        n = out.count()
        require(n == expected_rows, "EXPORT_ROWS", f"{n} rows, {expected_rows} expected")
    out.write.mode("errorifexists").option("header", True).csv(path)
    back = out.sparkSession.read.schema(out.schema).option("header", True).csv(path)
    require(back.exceptAll(out).isEmpty() and out.exceptAll(back).isEmpty(), "EXPORT_READ_BACK", path)


def by_config(frame: DataFrame, path: str) -> None:
    """One Parquet directory for each configuration; readers prune by it."""
    frame.write.mode("errorifexists").partitionBy("config_id").parquet(path)


def digest(frame: DataFrame) -> tuple[int, int]:
    """Number of rows, and the sum of their hashes: the same for the same rows in any order."""
    row = frame.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in frame.columns]).cast("decimal(38,0)"))).first()
    return int(row[0]), int(row[1] or 0)


def checkpointed(make: Callable[[], DataFrame], path: str, spark, verify: bool = False) -> DataFrame:
    """The table at ``path`` if an earlier run completed it, else made and written now (the commit is atomic).

    With ``verify``, a table that is there is made again and must hold the same rows.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        make().write.mode("overwrite").parquet(path)
    elif verify:
        require(digest(make()) == digest(spark.read.parquet(path)), "CHECKPOINT_DIFFERS", path)
    return spark.read.parquet(path)


def stage_keys(steps: list[tuple], version: str = "", inputs: DataFrame | None = None) -> list[str]:
    """A key for each of ``steps`` (``name, step`` or ``name, step, parameters``): of the code's version, the digest of ``inputs``, and the names
    and parameters of the steps up to it. What is declared decides: a step whose code changes needs a new version."""
    key = json.dumps([version, list(digest(inputs)) if inputs is not None else None])
    keys = []
    for name, _, *parameters in steps:
        key = hashlib.sha256(json.dumps([key, name, *parameters], sort_keys=True).encode()).hexdigest()
        keys.append(key)
    return keys


def stages(steps: list[tuple], root: str, spark, verify: bool = False, version: str = "", inputs: DataFrame | None = None) -> DataFrame:
    """Steps in their order, each checkpointed under its key and fed with the one before it (the first with ``inputs``), and with its parameters by name.

    A run that was interrupted goes on where it stopped. A changed version, input or parameter makes the steps concerned and those below
    them again, and no other; what was made under other keys stays where it is.
    """
    names = [name for name, *_ in steps]
    require(len(set(names)) == len(names) > 0, "STAGE_NAMES", "stages have distinct names")
    now = inputs
    for place, ((name, step, *parameters), key) in enumerate(zip(steps, stage_keys(steps, version, inputs), strict=True)):
        chosen = parameters[0] if parameters else {}
        now = checkpointed(lambda step=step, before=now, chosen=chosen: step(before, **chosen), f"{root}/{place:02d}-{name}-{key[:32]}", spark, verify)
    return now


def receipts(frame: DataFrame) -> DataFrame:
    """One canonical JSON line for each row, keys sorted."""
    return frame.select(F.to_json(F.struct(*sorted(frame.columns)), {"ignoreNullFields": "false"}).alias("receipt"))


class PublicWriter:
    """Writes only what :func:`public` lets through, each name once and only declared names."""

    def __init__(self, root: str, declared: set[str]):
        self.root, self.declared, self.done = root, set(declared), set()

    def __call__(self, name: str, frame: DataFrame, *, private: bool = False) -> None:
        require(name in self.declared, "SINK_NAME", name)
        require(name not in self.done, "SINK_ONCE", name)
        side = "private" if private else "public"
        (frame if private else public(frame)).write.mode("errorifexists").parquet(f"{self.root}/{side}/{name}")
        self.done.add(name)

    def finish(self) -> None:
        left = sorted(self.declared - self.done)
        require(not left, "SINK_LEFT", ", ".join(left))
