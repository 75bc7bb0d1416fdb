"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most three bits differ in at most one bit in
one of their halves. Every fingerprint therefore emits, for each half, all variants
within half the radius (one flipped bit) that have one bit more, and the half itself;
these are dealt by variant, met with the fingerprints that own the variant, deduplicated
and verified on all 64 bits. Only distinct fingerprints take part, so exact copies cost
nothing here.

Variants that very many fingerprints own are met in the middle a second time, on the
other half: there every owner emits its ball of radius one and the shell of radius two,
every flipped variant its ball of radius one. Whatever meets an owner's inner ball is
within three bits of it, so one star per meeting point links them all; the number of
rows stays in proportion to the members, not to their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, keep_best, lean, written

#: Words of a shingle; fingerprints link at so many differing bits or fewer.
SHINGLE_WORDS, RADIUS = 3, 3
SEED = 42
#: Half-variants with more owners than this go through the second meeting.
HOT_OWNERS = 64
#: Hashes whose bits are counted at once.
_BLOCK = 1 << 15


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a whole text, unsigned; zero if it has no word."""
    from xxhash import xxh64_intdigest as digest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE_WORDS:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        line = b" ".join(words)
        ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
        starts = [0, *[e + 1 for e in ends[: -SHINGLE_WORDS]]]
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, ends[SHINGLE_WORDS - 1 :], strict=True)]
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _BLOCK):
        block = np.array(hashes[k : k + _BLOCK], "<u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = np.array([fingerprint(x.as_py()) for x in batch.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], names=["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp``: one row per input row, the fingerprint as a signed 64-bit integer."""
    lean(docs)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(_fingerprints, T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("fp", T.LongType())]))


def _half(fp: Column, half: int) -> Column:
    return F.shiftrightunsigned(fp, 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))


def _flips(bits: int, most: int, least: int = 0) -> list[int]:
    """All patterns of ``least`` to ``most`` set bits among ``bits``."""
    masks = [0] if least == 0 else []
    if least <= 1 <= most:
        masks += [1 << i for i in range(bits)]
    if most >= 2:
        masks += [1 << i | 1 << j for i in range(bits) for j in range(i)]
    return masks


def _ball(value: Column, masks: list[int]) -> Column:
    return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: value.bitwiseXOR(m))


def links(fps: DataFrame, hot_owners: int = HOT_OWNERS) -> DataFrame:
    """Edges ``u, v`` between distinct fingerprints at distance 1 to 3 that connect all that are linked.

    Every edge is a true link. All links of fingerprints that share no hot half-variant are there; within
    a hot one the edges form stars that connect the same fingerprints.
    """
    owned = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(h).alias("h"), _half(F.col("fp"), h).alias("key")) for h in (0, 1)])).alias("x")).select("fp", "x.h", "x.key")
    hot = cut(owned.groupBy("h", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_owners).select("h", "key"))
    up = [F.lit(1 << i).cast("long") for i in range(32)]
    raised = F.filter(F.transform(F.array(*up), lambda m: F.col("key").bitwiseOR(m)), lambda v: v != F.col("key"))
    variants = owned.select("fp", "h", F.explode(F.concat(F.array("key"), raised)).alias("key"))

    owners = owned.join(hot, ["h", "key"], "left_anti").withColumnRenamed("fp", "o")
    near = variants.join(owners, ["h", "key"]).filter((F.col("fp") != F.col("o")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("o"))) <= RADIUS))
    edges = near.select(F.greatest("fp", "o").alias("u"), F.least("fp", "o").alias("v"))
    if not hot.isEmpty():
        # second meeting, on the other half
        met = variants.join(hot, ["h", "key"], "left_semi").select(
            "fp", "h", "key", F.when(F.col("h") == 0, _half(F.col("fp"), 1)).otherwise(_half(F.col("fp"), 0)).alias("other"),
            (F.col("key") == F.when(F.col("h") == 0, _half(F.col("fp"), 0)).otherwise(_half(F.col("fp"), 1))).alias("owner"),
        )
        inner = met.select("fp", "h", "key", "owner", F.explode(_ball(F.col("other"), _flips(32, 1))).alias("at"))
        shell = met.filter("owner").select("fp", "h", "key", F.lit(False).alias("owner"), F.explode(_ball(F.col("other"), _flips(32, 2, 2))).alias("at"))
        points = inner.unionByName(shell)
        hubs = points.filter("owner").groupBy("h", "key", "at").agg(F.min("fp").alias("hub"))
        stars = points.join(hubs, ["h", "key", "at"]).filter("fp <> hub").select(F.greatest("fp", "hub").alias("u"), F.least("fp", "hub").alias("v"))
        edges = edges.unionByName(stars)
    return edges.distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: each node of the edges ``u > v`` with the smallest node that it is connected to.

    Alternates large and small stars until nothing changes; each round is cut in the shared folder.
    """

    def state(e: DataFrame):
        row = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(row)

    def hub(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("low"))

    now = cut(edges)
    before = state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(hub(both), "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "low").alias("v")).filter("u <> v").distinct()
        near = large.select("u", "v")
        joined = near.join(hub(near), "u")
        small = joined.select(F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e"))
        now = cut(small.select("e.u", "e.v").filter("u <> v").distinct())
        after = state(now)
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after


def _components(prints: DataFrame, hot_owners: int) -> DataFrame:
    """``fp, component_id, root`` for each distinct fingerprint of the materialised ``id, fp``."""
    firsts = cut(prints.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(links(firsts.select("fp"), hot_owners))
    every = roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
    smallest = every.join(firsts, every["node"] == firsts["fp"]).groupBy("root").agg(F.min("first").alias("smallest"))
    named = every.join(smallest, "root").select("node", "root", "smallest")
    # written, so that both sides of the join to come are dealt anew and a hot fingerprint's rows can be split
    return cut(firsts.join(named, firsts["fp"] == named["node"], "left").select("fp", F.coalesce("smallest", "first").alias("component_id"), F.coalesce("root", "fp").alias("root")))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_owners: int = HOT_OWNERS) -> DataFrame:
    """One row per input row: ``<id_col>, fp, fingerprint, component_id, root``.

    * ``fingerprint`` is the 64-bit SimHash over 3-word shingles as 16 hex digits; texts without a word
      (null, empty, blank) have fingerprint zero and are linked like any other.
    * ``component_id`` is the smallest id reachable over links of 3 or fewer differing bits; null ids
      never count as smallest, and a component of null ids only has a null one. Where ids are null or
      repeated, several components can have one ``component_id``.
    * ``root`` is the smallest fingerprint of the component, which no other component has; never null.
    * Repeated rows give repeated result rows; an empty table gives an empty result. Other columns are not looked at.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    labels = _components(prints, hot_owners)
    return prints.join(labels, "fp").select(F.col("id").alias(id_col), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_owners: int = HOT_OWNERS) -> DataFrame:
    """``docs`` with one row of each component of near copies: that of the smallest id (null ids come last), and
    of rows of one id that of the smallest fingerprint. All columns are kept as they are. Texts are read once
    and written with their fingerprints."""
    lean(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            made = np.array([fingerprint(x.as_py()) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.int64())], names=[*batch.schema.names, "__fp"])

    marked = written(docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__fp", T.LongType())])), "fingerprints")
    prints = marked.select(F.col(f"`{id_col}`").alias("id"), F.col("__fp").alias("fp"))
    each = cut(prints.groupBy("id", "fp").agg(F.count(F.lit(1)).alias("copies")))
    each = each.join(_components(prints, hot_owners).select("fp", "root"), "fp")
    best = each.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "fp")).alias("one")).select(F.col("one.id").alias("best_id"), F.col("one.fp").alias("best_fp"))
    # dealt by row key, of which each component has one: a large component is no hot key
    found = each.join(best, F.col("id").eqNullSafe(F.col("best_id")) & (F.col("fp") == F.col("best_fp")), "left")
    decided = cut(found.select("id", "fp", "copies", F.col("best_fp").isNotNull().alias("best")))
    return keep_best(marked, decided, {id_col: "id", "__fp": "fp"}).drop("__fp")
