"""Exact dedup with DataFrame functions only.

Rows are grouped by a 128-bit hash of the normalised text. Groups of more than one
row are then held against their own bytes: a group whose smallest and largest
normalised text are the same string holds one text only; any other group is a
collision and is regrouped by the text itself. Only slim rows (id, hash, length)
are dealt by group, hot groups are pre-aggregated before the shuffle, and in the join
that brings a group's verdict back to its members the large groups are salted.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, keep_best

#: A group's verdict is joined once for every so many of its members, in so many parts at most.
SALT_ROWS, SALTS = 64, 4096
#: The characters that normalisation deletes: space and U+0009 to U+000D.
BLANKS = (" ", "\t", "\n", "\x0b", "\f", "\r")


def normalised(text: Column) -> Column:
    """The text without blanks; null counts as empty."""
    return functools.reduce(lambda c, blank: F.replace(c, F.lit(blank), F.lit("")), BLANKS, F.coalesce(text, F.lit("")))


def content_hash(norm: Column) -> Column:
    return F.unhex(F.md5(norm))


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_fn: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per distinct (id, text): ``id, h, sub, sha, ncp, copies, group_size, keep_id, best``.

    ``copies`` is how often the same row is repeated, ``best`` marks the row that stays.
    """
    raw = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    norm = normalised(F.col("t"))
    keyed = cut(raw.select("id", hash_fn(norm).alias("h"), F.sha2(norm, 256).alias("sha"), F.length("t").cast("long").alias("ncp")))

    repeated = cut(keyed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"))
    inside = raw.select(hash_fn(norm).alias("h"), norm.alias("norm")).join(broadcast_if_small(repeated), "h", "left_semi")
    collided = cut(inside.groupBy("h").agg(F.min("norm").alias("a"), F.max("norm").alias("b")).filter("a <> b").select("h"))
    if collided.isEmpty():
        keyed = keyed.withColumn("sub", F.lit(""))
    else:
        clash = broadcast_if_small(collided)
        apart = raw.select("id", hash_fn(norm).alias("h"), F.sha2(norm, 256).alias("sha"), F.length("t").cast("long").alias("ncp"), norm.alias("sub")).join(clash, "h", "left_semi")
        keyed = keyed.join(clash, "h", "left_anti").withColumn("sub", F.lit("")).unionByName(apart)

    each = keyed.groupBy("id", "h", "sub", "sha", "ncp").agg(F.count(F.lit(1)).alias("copies"))
    groups = each.groupBy("h", "sub").agg(
        F.count(F.lit(1)).alias("members"),
        F.sum("copies").alias("group_size"),
        F.min(F.struct((-F.col("ncp")).alias("longest"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id"))).alias("first"),
    )
    groups = cut(groups.withColumn("parts", F.least(F.expr(f"members div {SALT_ROWS}"), F.lit(SALTS - 1))).drop("members"))
    hot = broadcast_if_small(groups.filter("parts > 0").select("h", "sub", "parts"))
    salted = each.join(hot, ["h", "sub"], "left").withColumn("salt", F.when(F.col("parts") > 0, F.pmod(F.xxhash64("id", "ncp"), F.col("parts") + 1)).otherwise(F.lit(0).cast("long"))).drop("parts")
    return salted.join(groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), "parts"))), ["h", "sub", "salt"]).select(
        "id", "h", "sub", "sha", "ncp", "copies", "group_size", F.col("first.id").alias("keep_id"),
        (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("ncp") == -F.col("first.longest"))).alias("best"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_fn: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per input row: ``<id_col>, keep_id, group_size, kept, text_sha256``.

    * Null text counts as empty, so null and blank-only texts form one group.
    * Of equal texts the row with most code points stays, then the smallest id; a null id
      comes after every other id.
    * Of repeated rows (same id and text) exactly one stays.
    * An empty table gives an empty result. Other columns of ``docs`` are not looked at.
    """
    found = decisions(docs, id_col, text_col, hash_fn)
    rows = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        (F.col("best") & (F.col("copy") == 1)).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` drops; all columns are kept as they are."""
    found = decisions(docs, id_col, text_col)
    key, length = content_hash(normalised(F.col(f"`{text_col}`"))), F.length(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    marked = docs.withColumns({"__h": key, "__n": length})

    # colliding texts of one id and length, and repeated rows, are told apart by the number of copies
    once = found.groupBy("id", "h", "ncp").agg(F.max("best").alias("best"), F.sum("copies").alias("copies"))
    return keep_best(marked, cut(once), {id_col: "id", "__h": "h", "__n": "ncp"}).drop("__h", "__n")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), w AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
"""
