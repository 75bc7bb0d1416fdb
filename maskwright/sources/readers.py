"""Strict readers: fixed schemas, no inference, every row with its place where order has a meaning."""

from __future__ import annotations

import io
import json
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import cell_is_clean
from ..operators.hierarchy import sized
from ..operators.schema import require
from .writers import shared

#: The raw census fields and the nine of the microdata, in their physical order.
CENSUS_FIELDS = ("age", "workclass", "fnlwgt", "education", "education_num", "marital_status", "occupation", "relationship", "race", "sex", "capital_gain", "capital_loss", "hours_per_week", "native_country", "salary_class")
MICRODATA_FIELDS = ("sex", "age", "race", "marital_status", "education", "native_country", "workclass", "occupation", "salary_class")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no`` (from 1), ``line``: the files of ``path`` in the order of their names, one after the other.

    Files are split by byte range. A first pass counts the lines of each range; the second numbers them from the lines that stand before their range.
    A range is read by one task, whose row numbers follow the file. Only the table of ranges is ordered as a whole (one row for each
    ``spark.sql.files.maxPartitionBytes`` of text), and no line is shuffled while it is small.
    """
    text = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    counted = text.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    ahead = F.sum("n").over(Window.orderBy("file", "start")) - F.col("n")
    ranges = sized(shared(counted.select("file", "start", (ahead - F.col("first") + 1).alias("shift"))))
    return text.join(ranges, ["file", "start"]).select((F.col("at") + F.col("shift")).alias("line_no"), "line")


def census(spark: SparkSession, path: str, member: str, test: bool = False) -> DataFrame:
    """``rid, line_no`` and the fifteen raw fields as trimmed strings.

    ``test`` files begin with a line of metadata, which goes, and their labels end in a full stop, of
    which one goes. The row id is ``member:line``. The file ends in exactly one blank line, which is no row; a blank line
    anywhere else, and a line of any other number of fields, is an error.
    """
    every = lines(spark, path).withColumn("blank", F.length(F.trim("line")) == 0)
    ends = every.agg(F.sum(F.col("blank").cast("long")).alias("blanks"), F.max(F.when(F.col("blank"), F.col("line_no"))).alias("at"), F.max("line_no").alias("last")).first()
    require(ends["blanks"] == 1 and ends["at"] == ends["last"], "TRAILING_BLANK", "one blank line ends the file")
    rows = every.filter(~F.col("blank")).drop("blank")
    if test:
        rows = rows.filter(~((F.col("line_no") == 1) & F.col("line").startswith("|")))
    cells = F.transform(F.split("line", ","), lambda c: F.trim(c))
    rows = rows.withColumn("cells", F.when(F.size(cells) == len(CENSUS_FIELDS), cells).otherwise(F.raise_error(F.concat(F.lit("FIELD_COUNT: line "), F.col("line_no").cast("string")))))
    out = rows.select(F.concat_ws(":", F.lit(member), F.col("line_no").cast("string")).alias("rid"), "line_no", *[F.col("cells")[k].alias(name) for k, name in enumerate(CENSUS_FIELDS)])
    return out.withColumn("salary_class", F.regexp_replace("salary_class", r"\.$", "")) if test else out


def strict_table(spark: SparkSession, path: str, columns: list[str], sep: str = ";") -> DataFrame:
    """A separated table whose header is exactly ``columns``; ragged rows and unclean cells are errors."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    head = spark.read.text(path).first()
    require(head is not None and head[0] == sep.join(columns), "HEADER", f"expected {sep.join(columns)}")
    rows = spark.read.schema(schema).option("header", True).option("sep", sep).option("mode", "FAILFAST").option("enforceSchema", False).option("quote", "").csv(path)
    return rows.select(*[F.when(cell_is_clean(F.col(f"`{c}`")), F.col(f"`{c}`")).otherwise(F.raise_error(F.lit(f"CELL: {c}"))).alias(c) for c in columns])


def hierarchy(spark: SparkSession, path: str, attr: str, depth: int, sep: str = ";") -> DataFrame:
    """A hierarchy file (leaf first, root last, no header) as ``attr, leaf, level, label``."""
    rows = spark.read.text(path).filter(F.length("value") > 0).select(F.split("value", sep, -1).alias("cells"))
    rows = rows.withColumn("cells", F.when(F.size("cells") == depth, F.col("cells")).otherwise(F.raise_error(F.lit("HIERARCHY_DEPTH"))))
    return rows.select(F.lit(attr).alias("attr"), F.col("cells")[0].alias("leaf"), F.posexplode("cells").alias("level", "label"))


def permutation(spark: SparkSession, path: str) -> DataFrame:
    """``place, value`` of a file of whole numbers, which must be a bijection on its places (from 0)."""
    rows = lines(spark, path).select((F.col("line_no") - 1).alias("place"), F.col("line").cast("long").alias("value"))
    c = rows.agg(F.count(F.lit(1)), F.countDistinct("value"), F.min("value"), F.max("value")).first()
    require(c[0] == c[1] and (c[0] == 0 or (c[2] == 0 and c[3] == c[0] - 1)), "BIJECTION", "not a permutation of its places")
    return rows


def strict_json(raw: bytes, maximum: int = 1 << 24) -> object:
    """A receipt: bounded, canonical (sorted keys, no blanks, one line feed), no repeated keys, no NaN."""
    require(len(raw) <= maximum, "JSON_SIZE", "too large")

    def unique(pairs):
        keys = [k for k, _ in pairs]
        require(len(set(keys)) == len(keys), "JSON_KEY", "repeated key")
        return dict(pairs)

    def refuse(value):
        require(False, "JSON_NUMBER", value)

    value = json.loads(raw, object_pairs_hook=unique, parse_constant=refuse)
    canonical = (json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False) + "\n").encode()
    require(raw == canonical, "JSON_CANONICAL", "not in canonical form")
    return value


def zip_members(spark: SparkSession, path: str, members: list[str]) -> DataFrame:
    """``path, member, size, crc, content`` of the named members of each archive; each must be there once."""

    def read(frames):
        for frame in frames:
            out = []
            for p, raw in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(raw)) as archive:
                    names = archive.namelist()
                    for m in members:
                        require(names.count(m) == 1, "ZIP_MEMBER", m)
                        info = archive.getinfo(m)
                        out.append((p, m, info.file_size, info.CRC, archive.read(m)))  # reading checks the CRC
            yield pd.DataFrame(out, columns=["path", "member", "size", "crc", "content"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(read, "path string, member string, size long, crc long, content binary")


def identity(spark: SparkSession, path: str) -> DataFrame:
    """``path, bytes, sha256`` of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


class Catalog:
    """Roles bound to tables; a role that is not bound is an error, and each is read once."""

    def __init__(self, bound: dict[str, DataFrame]):
        self._bound = dict(bound)
        self._read: set[str] = set()

    def read(self, role: str) -> DataFrame:
        require(role in self._bound, "CATALOG_ROLE", role)
        require(role not in self._read, "CATALOG_ONCE", role)
        self._read.add(role)
        return self._bound[role]

    def finish(self) -> None:
        left = sorted(set(self._bound) - self._read)
        require(not left, "CATALOG_LEFT", ", ".join(left))


def bundles(spark: SparkSession, path: str, configs: DataFrame, source: DataFrame, row_id: str, target: str) -> DataFrame:
    """All releases under ``path`` (one directory for each configuration), once they are bound to each other and to the source."""
    from ..operators.validation import binding

    loaded = spark.read.parquet(path)
    # one row for each configuration
    for r in binding(loaded, configs, source, row_id, target).collect():
        require(r["declared"] and r["present"], "BUNDLE_SET", f"{r['config_id']} is not both declared and there")
        require(not r["unbound"] and not r["repeated"] and not r["lacking"], "BUNDLE_ROWS", r["config_id"])
        require(not r["target_mismatches"], "BUNDLE_TARGET", r["config_id"])
        require(not r["vector_mismatches"], "BUNDLE_VECTOR", r["config_id"])
    return loaded
