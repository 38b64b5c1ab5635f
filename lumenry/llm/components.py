"""Connected components by alternating star contraction, for edge tables of any size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenry.llm.common import meet, settle


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Hangs every larger neighbour of a node on the smallest of its neighbours and itself."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return meet(both.where(F.col("v") > F.col("u")), least, "u", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Hangs a node and its smaller neighbours on the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = meet(down, least, "u", n).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


#: Edges that one task may take; more are contracted over all.
FEW_EDGES = 1 << 18


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of bounded edges by union of the larger root with the smaller."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up.setdefault(y, y)
        return x

    for b in batches:
        for u, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
            a, b_ = root(u), root(v)
            up[max(a, b_)] = min(a, b_)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "root"])


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """(node, root) for every node of the edges (u, v): root is the smallest node that can be reached.

    Minima are aggregated before the shuffle and joined back, heavy nodes apart, so that a node of any degree is never one group in
    memory or one task. Rounds end when the edges no longer change; each is a written table. No more than `few` edges are joined in one task instead, which
    gives the same. Self-links, repeated edges and an
    empty table are fine; edges with a null end are left out.
    """
    now = settle(edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))).distinct())
    n, mark = now.count(), None
    if n <= few:
        return now.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).coalesce(1).mapInArrow(_in_one_task, "node long, root long")
    while n:
        now = settle(_small_star(settle(_large_star(now, n).distinct()), n).where(F.col("u") != F.col("v")).distinct())
        new = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if new == mark:
            break
        n, mark = new[0], new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
