"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is two grouped minima and two equi-joins, so a hub with any number of
neighbours is aggregated map-side and its join is split by the adaptive skew join.
The number of rounds is logarithmic in the number of nodes for the usual graphs.
Edges stay distributed; only a count and a checksum come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over edges (u, v): every neighbour is hung onto the least one."""
    pairs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    if large:  # neighbours greater than u
        out = pairs.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # edges run from the greater to the smaller node
        out = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``edges``; component is its smallest node id.

    Nulls and loops are ignored; repeated edges are harmless; an empty table gives an empty
    result.  ``max_rounds`` only guards against a bug: it raises instead of stopping early.
    """
    a_, b_ = F.col(a).cast("long"), F.col(b).cast("long")
    edges = edges.select(F.greatest(a_, b_).alias("u"), F.least(a_, b_).alias("v"), a_.alias("_a"), b_.alias("_b"))
    edges = cut(edges.where("_a IS NOT NULL AND _b IS NOT NULL AND u <> v").select("u", "v").distinct())
    before = _digest(edges)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        edges = cut(_star(_star(edges, large=True), large=False))
        now = _digest(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
