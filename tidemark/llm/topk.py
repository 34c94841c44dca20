"""Exact top-k inner-product search by columnar branch and bound.

Vectors are packed into blocks held dimension by dimension (vertical layout, in the narrowest
integer type that fits) with, for each boundary between groups of dimensions, the norm of what
remains.  A query block meets a candidate block group of dimensions by group: partial sums are
accumulated, and a candidate is compacted away as soon as, for every query of the block, the partial
sum plus the product of the two remaining norms (Cauchy-Schwarz) lies below that query's k-th best
score so far.  Nothing that can still tie is dropped, so the result is exact.

The work is a grid of tiles: query groups of about ``held`` packed bytes by candidate groups.  A
tile's query blocks come first and are held, packed as they came, with their best scores so far; then
its candidate blocks stream by, each unpacked once for all of them, while of a query block only one
group of dimensions at a time is widened.  So a task holds one query group and one candidate block,
whatever the number of either, and a query's threshold lasts for the whole tile.  Candidates travel
once for each query group: with 128 bytes a vector, half a million queries are one group.  Each tile
hands on at most k rows per query; a last grouping keeps the k best of those.

Scores are integers and are formed in float32 or float64 only while the bound on their size fits
the mantissa, else in int64 (which wraps beyond 63 bits).

Defined cases: vectors that are null or hold a null, NaN or infinite component, or one whose scaled
floor is no long (2^55 and more in size), take no part, nor do rows without an id; vectors of
different lengths are compared up to zeros; ties go to the smaller id; rows that repeat an id are
separate candidates, though never for a query with that id; query rows that repeat id and vector are
one query, and different vectors under one id are a query each, ranked apart; fewer than k candidates
give as many rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import partitions_for, written

SCALE, K, EVERY, ROWS, QUERIES, HELD, GROUP = 256, 5, 50, 4096, 64, 1 << 26, 16
_PACKED = "number long, part long, dims int, n int, width int, ids binary, names binary, cells binary"
_FOUND = "query_id long, query long, vec_id long, score long"


def _narrow(cells: np.ndarray) -> np.ndarray:
    """The cells in the narrowest little-endian integers that hold them."""
    low, high = int(cells.min(initial=0)), int(cells.max(initial=0))
    return cells.astype(next(t for t in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _pack(rows: int):
    """Blocks of at most ``rows`` vectors of one part in vertical layout (dims x n); ``name`` tells equal ids apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, open_ = TaskContext.get().partitionId() << 32, {}

        def made(part: int) -> pa.RecordBatch:
            nonlocal number
            ids, names, have = open_.pop(part)
            cells = np.zeros((max(map(len, have)), len(have)), dtype="<i8")
            for j, v in enumerate(have):
                cells[: len(v), j] = v
            cells, number = _narrow(cells), number + 1
            row = [[number], [part], [len(cells)], [len(have)], [cells.itemsize], [np.array(ids, "<i8").tobytes()], [np.array(names, "<i8").tobytes()], [cells.tobytes()]]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], [c.split()[0] for c in _PACKED.split(", ")])

        for batch in batches:
            for vec_id, part, name, v in zip(*(batch.column(c).to_pylist() for c in ("id", "part", "name")), batch.column("v")):
                x = v.values
                if x.null_count:
                    continue
                x = np.floor(SCALE * x.to_numpy(zero_copy_only=False).astype(np.float64))
                if not (np.abs(x) < 2.0**63).all():  # false for NaN, too
                    continue
                ids, names, have = open_.setdefault(part, ([], [], []))
                ids.append(vec_id)
                names.append(name)
                have.append(x.astype(np.int64))
                if len(ids) == rows:
                    yield made(part)
        for part in list(open_):
            yield made(part)

    return run


class _Side:
    """A block, packed as it came, with the norms of what remains at each boundary."""

    def __init__(self, dims: int, n: int, ids: bytes, cells: bytes, width: int = 8, names: bytes | None = None):
        self.ids = np.frombuffer(ids, "<i8")
        self.names = self.ids if names is None else np.frombuffer(names, "<i8")
        self.cells = np.frombuffer(cells, f"<i{width}").reshape(dims, n)
        ends = np.zeros((-(-dims // GROUP) + 1, n))
        for g in range(len(ends) - 2, -1, -1):
            ends[g] = ends[g + 1] + (self.cells[g * GROUP : (g + 1) * GROUP].astype(np.float64) ** 2).sum(axis=0)
        self.rest = np.sqrt(ends) * (1 + 1e-9)
        self.wide: np.ndarray | None = None

    def rest_at(self, g: int) -> np.ndarray:
        return self.rest[g] if g < len(self.rest) else np.zeros(len(self.ids))

    def widened(self, dtype) -> np.ndarray:
        """All cells as ``dtype``, kept for the next block that this one meets."""
        if self.wide is None or self.wide.dtype != dtype:
            self.wide = self.cells.astype(dtype)
        return self.wide


class Best:
    """The k best (score, id) of each query of a block."""

    def __init__(self, q: _Side, k: int):
        self.q, self.k, self.compacted = q, k, 0
        self.scores, self.ids = np.zeros((len(q.ids), k), np.int64), np.zeros((len(q.ids), k), np.int64)
        self.found = np.zeros(len(q.ids), np.int64)  # how many of the k there are

    def floor(self) -> np.ndarray:
        """Each query's k-th best score so far."""
        return np.where(self.found == self.k, self.scores[:, -1].astype(np.float64), -np.inf)

    def meet(self, c: _Side) -> None:
        q = self.q
        dims = min(len(q.cells), len(c.cells))
        size = float(q.rest[0].max(initial=0) * c.rest[0].max(initial=0))
        dtype = np.float32 if size < 1 << 23 else np.float64 if size < 1 << 52 else np.int64
        cs, floor = c.widened(dtype), self.floor()
        live, acc = np.arange(len(c.ids)), np.zeros((len(q.ids), len(c.ids)), dtype=dtype)
        for g, lo in enumerate(range(0, dims, GROUP)):
            hi = min(dims, lo + GROUP)
            part = cs[lo:hi] if len(live) == len(c.ids) else cs[lo:hi, live]
            acc = acc + q.cells[lo:hi].astype(dtype).T @ part
            if hi < dims and dtype is not np.int64:
                reach = acc + np.outer(q.rest_at(g + 1), c.rest_at(g + 1)[live]) + 1
                keep = (reach >= floor[:, None]).any(axis=0)
                if keep.sum() < 0.9 * len(live):
                    self.compacted += int((~keep).sum())
                    live, acc = live[keep], acc[:, keep]
                    if not len(live):
                        return
        ids, scores = c.ids[live], acc.astype(np.int64)
        for i, own in enumerate(q.ids):
            at = np.flatnonzero((ids != own) & (scores[i] >= floor[i]))
            if len(at):
                have = self.found[i]
                s, n = np.concatenate([self.scores[i, :have], scores[i, at]]), np.concatenate([self.ids[i, :have], ids[at]])
                order = np.lexsort((n, ~s))[: self.k]
                self.found[i] = len(order)
                self.scores[i, : len(order)], self.ids[i, : len(order)] = s[order], n[order]

    def rows(self) -> pa.RecordBatch:
        there = np.arange(self.k) < self.found[:, None]
        found = (np.repeat(self.q.ids, self.found), np.repeat(self.q.names, self.found), self.ids[there], self.scores[there])
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], [c.split()[0] for c in _FOUND.split(", ")])


def _search(k: int):
    """Over rows sorted by tile, query blocks first: the best of each tile's queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["tile"] != tile:
                    yield from (best.rows() for best in held)
                    tile, held = row["tile"], []
                side = _Side(row["dims"], row["n"], row["ids"], row["cells"], row["width"], row["names"])
                if row["asks"]:
                    held.append(Best(side, k))
                else:
                    for best in held:
                        best.meet(side)
        yield from (best.rows() for best in held)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", held: int = HELD) -> DataFrame:
    """(query_id, rank, vec_id, score, query): the k best of ``vectors`` for each of ``queries``; ``query`` tells vectors of one id apart."""

    def rows(df: DataFrame) -> DataFrame:
        return df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))

    slots = partitions_for(vectors.sparkSession)
    each = rows(queries).distinct().select("id", "v", F.xxhash64("id", "v").alias("name"), F.lit(0).cast("long").alias("part"))
    blocks = written(each.mapInArrow(_pack(QUERIES), _PACKED), "query-blocks")
    groups = max(1, -(-(blocks.agg(F.sum(F.length("cells"))).first()[0] or 0) // held))  # one number: how many query groups of bounded size there are
    spread = max(1, -(-slots // groups))  # candidate groups, so that there is a tile for every slot
    blocks = blocks.withColumn("part", F.pmod(F.xxhash64("number"), F.lit(groups)).cast("long"))
    others = rows(vectors).select("id", "v", F.lit(0).cast("long").alias("name"), F.lit(0).cast("long").alias("part")).mapInArrow(_pack(ROWS), _PACKED)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asking = blocks.withColumns({"asks": F.lit(True), "other": upto(spread)}).withColumn("tile", F.col("part") * spread + F.col("other")).drop("other")
    streamed = others.withColumns({"asks": F.lit(False), "part": upto(groups)}).withColumn("tile", F.col("part") * spread + F.pmod(F.xxhash64("number"), F.lit(spread)))
    met = asking.unionByName(streamed).drop("part", "number").repartition(max(slots, min(groups * spread, 64 * slots)), "tile").sortWithinPartitions("tile", F.desc("asks"))
    order = W.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return met.mapInArrow(_search(k), _FOUND).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0)).drop("query")


OP1_SQL = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
p AS (
  SELECT a.vec_id AS query_id, a.q, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) a JOIN v b ON a.vec_id <> b.vec_id
),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, q ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
