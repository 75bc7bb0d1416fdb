"""Exact top-k inner products by columnar branch-and-bound.

Vectors are quantised and laid out vertically: a candidate block holds one contiguous
run per dimension. A group of queries meets a block dimension block by dimension block:
partial scores are accumulated, and a candidate goes on only while its partial score
plus the most that the remaining dimensions can add (the product of the remaining
masses) reaches the query's k-th best score so far. Survivors are compacted, so later
dimension blocks touch fewer and fewer candidates. Nothing that could enter the result,
ties included, is ever dropped.

Queries are gathered in groups and candidates in shards; each pair of a group and a shard
is one cell. Candidates go over the network once for each group of up to GROUP queries, in
the narrowest whole-number type that holds them. Before that, each group meets a bounded
number of candidates, whose k-th best score is the bar to start from: cells return only
what reaches it, and a block whose largest mass cannot reach a group's lowest bar is not sent.

Scores are exact whatever the components: sums below 2**53 are added up in float64; larger
ones are bounded in float64 with their rounding error, and survivors are added up in
whole numbers of any length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, cut

#: Vectors of a candidate block, queries of a query block, query blocks of a group, dimensions of a dimension block.
BLOCK, QUERY_BLOCK, GROUP_BLOCKS, DIMENSIONS = 4096, 1024, 64, 16
#: Candidates of a shard (on average) at most, and candidates that set the first bars.
SHARD, SEEDS = 1 << 17, 2048
#: Sums below are exact in float64; masses below can be multiplied in it.
_EXACT, _HUGE = 2.0**53, 1e145
_LONG = 2**63 - 1
#: How a block's components are kept: whole numbers of 16 or 32 bits, whole numbers in float64, or, if
#: scaling leaves the range of float64, as they were.
_KINDS = ("<i2", "<i4", "<f8", "<f8")


class Block:
    """A packed block: ``ids``, the components (dimensions x vectors), and whether they still have to be scaled."""

    def __init__(self, kind: int, dim: int, ids: bytes, data: bytes, scale: float):
        self.ids = np.frombuffer(ids, "<i8")
        self.raw = np.frombuffer(data, _KINDS[kind]).reshape(dim, len(self.ids))
        self.unscaled, self.scale = kind == 3, scale
        self.top = math.inf if self.unscaled else float(np.abs(self.raw.astype(np.float64)).max(initial=0.0))
        self._values: np.ndarray | None = None

    @property
    def values(self) -> np.ndarray:
        if self._values is None:
            self._values = self.raw.astype(np.float64)
        return self._values

    def whole(self, column: int) -> list[int]:
        """The components of one vector as whole numbers."""
        if self.unscaled:
            return [math.floor(Fraction(self.scale) * Fraction(float(x))) for x in self.raw[:, column]]
        return [int(x) for x in self.raw[:, column]]


class _Best:
    """The k best (score, id) of one query: higher scores first, ties to the smaller id; nothing below the floor."""

    def __init__(self, k: int, floor: float = -math.inf):
        self.k, self.floor = k, floor
        self.scores = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)

    @property
    def bar(self) -> float:
        """No more than the k-th best score, as far as it is known."""
        if len(self.scores) < self.k:
            return self.floor
        return max(self.floor, _below(self.scores[-1]))

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        if scores.dtype == object:
            order = sorted(range(len(ids)), key=lambda n: (-scores[n], ids[n]))[: self.k]
        else:
            order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def _below(score) -> float:
    """A float64 no larger than a whole number; the same where it has one."""
    score = int(score)
    if abs(score) < _EXACT:
        return float(score)
    try:
        return math.nextafter(float(score), -math.inf)
    except OverflowError:
        return -math.inf if score < 0 else math.nextafter(math.inf, 0)


def search_block(queries: Block, best: list[_Best], block: Block, dimensions: int = DIMENSIONS) -> None:
    """Offer the vectors of ``block`` to the best of each query."""
    d, n = block.raw.shape
    if not n:
        return
    most = queries.top * block.top * d
    if not (queries.top < _HUGE and block.top < _HUGE and most < _HUGE * _HUGE):
        columns = [block.whole(j) for j in range(n)]
        for q, found in enumerate(best):
            vector = queries.whole(q)
            others = np.flatnonzero(block.ids != queries.ids[q])
            found.offer(np.array([sum(a * b for a, b in zip(vector, columns[j], strict=True)) for j in others] or [], object), block.ids[others])
        return
    exact = most < _EXACT
    rows, columns = np.ascontiguousarray(queries.values.T), block.values
    cuts = [*range(0, d, dimensions), d]
    # mass that remains behind each cut, of candidates and of queries
    rest = np.sqrt(np.stack([np.square(columns[c:]).sum(axis=0) for c in cuts])) if d else np.zeros((1, n))
    rest_q = np.sqrt(np.stack([np.square(rows[:, c:]).sum(axis=1) for c in cuts], axis=1)) if d else np.zeros((len(rows), 1))
    first = rows[:, : cuts[1]] @ columns[: cuts[1]] if d else np.zeros((len(rows), n))
    rounding = 0.0 if exact else 4 * (d + 8) * np.finfo(np.float64).eps
    for q, vector in enumerate(rows):
        found = best[q]
        bar = found.bar
        alive = np.flatnonzero(block.ids != queries.ids[q])
        score = first[q, alive]
        for j in range(1, max(len(cuts) - 1, 1)):
            if bar > -math.inf:
                # the bound is rounded up, so no candidate that ties with the bar is lost
                keep = score + rest[j, alive] * rest_q[q, j] * (1 + 1e-12) + rounding * rest_q[q, 0] * rest[0, alive] + 1e-6 >= bar
                if not keep.all():
                    alive, score = alive[keep], score[keep]
            if not len(alive) or d == 0:
                break
            part = columns[cuts[j] : cuts[j + 1]]
            score = score + vector[cuts[j] : cuts[j + 1]] @ (part if len(alive) == n else part[:, alive])
        error = rounding * rest_q[q, 0] * rest[0, alive]
        keep = score + error >= bar
        alive, score, error = alive[keep], score[keep], error[keep]
        if len(alive) > found.k:  # the k-th best and its ties are enough
            enough = np.partition(score - error, len(score) - found.k)[len(score) - found.k]
            keep = score + error >= enough
            alive, score = alive[keep], score[keep]
        if not len(alive):
            continue
        if not exact:
            mine = queries.whole(q)
            score = np.array([sum(a * b for a, b in zip(mine, block.whole(j), strict=True)) for j in alive], object)
            keep = np.array([s >= found.floor for s in score], bool)
            alive, score = alive[keep], score[keep]
            if not len(alive):
                continue
        found.offer(score if not exact else score.astype(np.int64), block.ids[alive])


_PACKED = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("dim", T.IntegerType()), T.StructField("norm", T.DoubleType()), T.StructField("ids", T.BinaryType()), T.StructField("data", T.BinaryType())])


def _packer(size: int, scale: float, parts: int, run_of: int):
    """Valid vectors, quantised, in column-major blocks of ``size``, those of other lengths and kinds apart.
    ``part`` is the task's number plus one for each ``run_of`` blocks it made, in turn below ``parts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        task, done = TaskContext.get().partitionId(), 0

        def made(kind: int, dim: int, ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
            nonlocal done
            part = (task + done // run_of) % parts
            done += 1
            values = np.ascontiguousarray(rows.T)
            norm = math.inf if kind == 3 else float(np.sqrt(np.square(rows).sum(axis=1)).max(initial=0.0))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([dim], pa.int32()), pa.array([norm]), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([values.astype(_KINDS[kind]).tobytes()], pa.binary())],
                names=_PACKED.names,
            )

        for batch in batches:
            ids = batch.column(0)
            vectors = batch.column(1)
            vectors = vectors.cast(pa.list_(pa.float64()))
            lengths = np.diff(vectors.offsets.to_numpy())
            flat, null = vectors.flatten(), np.asarray(vectors.is_null())
            values = flat.to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(np.where(null, 0, lengths))])
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            good = ~null & (bad[offsets[1:]] == bad[offsets[:-1]]) & ~np.asarray(ids.is_null())
            for dim in np.unique(lengths[good]).tolist():
                rows = np.flatnonzero(good & (lengths == dim))
                raw = values[offsets[rows][:, None] + np.arange(dim)]
                with np.errstate(over="ignore", invalid="ignore"):
                    scaled = np.floor(scale * raw)
                    most = np.abs(scaled).max(axis=1, initial=0.0)
                kinds = np.select([~np.isfinite(most), most < 2.0**15, most < 2.0**31], [3, 0, 1], 2)
                for kind in np.unique(kinds).tolist():
                    mine = kinds == kind
                    key = kind, dim
                    held.setdefault(key, []).append((ids.take(pa.array(rows[mine])).to_numpy(), (raw if kind == 3 else scaled)[mine]))
                    while sum(len(x[0]) for x in held[key]) >= size:
                        all_ids, all_rows = np.concatenate([x[0] for x in held[key]]), np.concatenate([x[1] for x in held[key]])
                        yield made(kind, dim, all_ids[:size], all_rows[:size])
                        held[key] = [(all_ids[size:], all_rows[size:])]
        for (kind, dim), parts_held in held.items():
            ids, rows = np.concatenate([x[0] for x in parts_held]), np.concatenate([x[1] for x in parts_held])
            if len(ids):
                yield made(kind, dim, ids, rows)

    return run


def _blocks(table: pa.Table, scale: float) -> Iterator[tuple[int, Block]]:
    for kind, dim, ids, data in zip(*(table.column(c) for c in ("kind", "dim", "ids", "data")), strict=True):
        yield dim.as_py(), Block(kind.as_py(), dim.as_py(), ids.as_py(), data.as_py(), scale)


def _digits(score: int) -> str | None:
    """A text that sorts as a whole number beyond 64 bits does among those of its sign."""
    if -_LONG - 1 <= score <= _LONG:
        return None
    text = str(abs(score))
    if score > 0:
        return f"{len(text):06d}{text}"
    return f"{999_999 - len(text):06d}" + text.translate(str.maketrans("0123456789", "9876543210"))


def _met(queries: pa.Table, blocks: pa.Table, k: int, scale: float, dimensions: int) -> Iterator[tuple[int, list[_Best], Block]]:
    """Each query block's number with its best, all candidate blocks of its length having been offered."""
    for n, (dim, asked) in enumerate(_blocks(queries, scale)):
        floors = queries.column("bars")[n].as_py() if "bars" in queries.column_names else None
        floors = np.frombuffer(floors, "<f8") if floors is not None else np.full(len(asked.ids), -math.inf)
        best = [_Best(k, float(f)) for f in floors]
        for bdim, block in _blocks(blocks, scale):
            if bdim == dim:
                search_block(asked, best, block, dimensions)
        yield n, best, asked


def _bars(k: int, scale: float, dimensions: int):
    """The query blocks of a group with the k-th best score of the seeds (minus infinity if there are fewer)."""

    def run(queries: pa.Table, seeds: pa.Table) -> pa.Table:
        bars = [np.array([f.bar for f in best], "<f8") for _, best, _ in _met(queries, seeds, k, scale, dimensions)]
        queries = queries.append_column("bars", pa.array([b.tobytes() for b in bars], pa.binary()))
        return queries.append_column("low", pa.array([float(b.min(initial=math.inf)) for b in bars], pa.float64()))

    return run


def _cell(k: int, scale: float, dimensions: int):
    def run(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for n, best, asked in _met(queries, blocks, k, scale, dimensions):
            number = queries.column("block")[n].as_py()
            for q, found in enumerate(best):
                for i, s in zip(found.ids.tolist(), found.scores.tolist(), strict=True):
                    s = int(s)
                    out.append((int(asked.ids[q]), number, q, i, max(min(s, _LONG), -_LONG - 1), (s > _LONG) - (s < -_LONG - 1), _digits(s)))
        columns = list(zip(*out, strict=True)) or [()] * 7
        kinds = [pa.int64()] * 5 + [pa.int32(), pa.string()]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "block", "q", "vec_id", "score", "side", "digits"), columns, kinds, strict=True)})

    return run


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0,
    block: int = BLOCK, query_block: int = QUERY_BLOCK, dimensions: int = DIMENSIONS, shards: int | None = None, seeds: int = SEEDS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` vectors of highest inner product for each query.

    Components x count as floor(scale * x). Ranks start at 1; ties go to the smaller id.

    * Vectors that are null or hold null or non-finite components, and null ids, take no part; any finite ones do.
    * A query meets vectors of its own length only, and never rows of its own id.
    * Repeated candidate rows are candidates each; a repeated query row is answered once for each row.
    * Fewer than ``k`` candidates give fewer rows; an empty table gives none. Other columns are not looked at.
    * Ranks are exact for any scores; a score beyond 64 bits is given as the nearest 64-bit number.
    """

    def slim(frame: DataFrame) -> DataFrame:
        return frame.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))

    total = vectors.count()
    groups = max(1, math.ceil(queries.count() / (query_block * GROUP_BLOCKS)))
    shards = shards or max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / SHARD))
    # one task packs one group; a group's blocks of other lengths and kinds are at most a few more
    asked = slim(queries).repartition(groups).mapInArrow(_packer(query_block, scale, groups, 1 << 30), _PACKED).withColumnRenamed("part", "group").withColumn("block", F.monotonically_increasing_id())
    asked = cut(asked)
    spread = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    # which rows set the first bars changes the work, not the result
    few = slim(vectors).filter(F.pmod(F.xxhash64("id"), F.lit(max(1, total // max(1, seeds)))) == 0)
    sown = few.repartition(1).mapInArrow(_packer(block, scale, 1, 1), _PACKED).withColumn("group", spread)
    barred = T.StructType([*asked.schema.fields, T.StructField("bars", T.BinaryType()), T.StructField("low", T.DoubleType())])
    asked = cut(asked.groupBy("group").cogroup(sown.groupBy("group")).applyInArrow(_bars(k, scale, dimensions), barred))

    blocks = slim(vectors).mapInArrow(_packer(block, scale, shards, 1), _PACKED).withColumnRenamed("part", "shard").withColumn("group", spread)
    # a group's lowest bar and largest mass: one row for each group and length; beyond the bound every block is sent
    reach = asked.groupBy("group", "dim").agg(F.min("low").alias("low"), F.max("norm").alias("mass"))
    near = blocks
    if reach.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        near = blocks.join(F.broadcast(reach), ["group", "dim"]).filter(~(F.col("norm") * F.col("mass") * (1 + 1e-9) + 1 < F.col("low"))).drop("low", "mass")
    left = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    schema = "query_id long, block long, q long, vec_id long, score long, side int, digits string"
    cells = left.groupBy("group", "shard").cogroup(near.groupBy("group", "shard")).applyInArrow(_cell(k, scale, dimensions), schema)
    order = Window.partitionBy("query_id", "block", "q").orderBy(F.desc("side"), F.desc("digits"), F.desc("score"), "vec_id")
    ranked = cells.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND vec_id IS NOT NULL
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
