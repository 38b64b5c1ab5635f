"""Centroid clustering on distinct quantised vectors.

Components become integers floor(scale * x), so equal and nearly equal vectors fall together: they are grouped with their number, Lloyd's rounds
run over the distinct vectors with sums weighted by these numbers, and the assignment of each distinct vector is joined back to the ids. Sums, distances and the floors of
means are exact integers, so neither the deal of rows over tasks nor repeated runs change a result. A task sends one row for each centroid, whatever it read; a vector
that a third of all rows share is one row in every round, and its assignment is sent to its rows instead of moving them.

Rows whose vector is null, has another length than `dim`, or has a null, NaN or infinite component are left out. Components beyond +-2^62 after scaling count as
+-2^62; distances and inertias beyond 2^63 - 1 are given as that, while nearest centroids are still found by the exact numbers. The first centroids are the kept rows with the least
sha256 of `<seed>:<id>`; rows without an id come last among them, equal ids in the order of their vectors; with fewer kept rows than `k` there are fewer centroids.
Repeated rows count as often as they occur and each gets its row. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenry.llm.common import meet, release, settle, with_workers

CLUSTERS, ROUNDS, DIM, SCALE, SEED = 16, 3, 64, 64, 1
#: Components and distances beyond these count as these.
LARGEST, FARTHEST = 1 << 62, (1 << 63) - 1
#: Up to these magnitudes a product of matrices of doubles, or 64-bit differences, are exact for DIM components.
EXACT_DOUBLE, EXACT_LONG = 1 << 22, 1 << 27
_WIDTHS = (np.int8, np.int16, np.int32, np.int64)


def quantised(column: pa.Array, dim: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(places, integers) of the vectors of a list column that are kept."""
    long_enough = np.flatnonzero(np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)))
    values = column.take(pa.array(long_enough)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    finite = np.isfinite(values).all(axis=1)
    with np.errstate(over="ignore"):
        whole = np.floor(values[finite] * scale)
    return long_enough[finite], np.clip(whole, -float(LARGEST), float(LARGEST)).astype(np.int64)


def pack(x: np.ndarray) -> list[bytes]:
    """Each row in the narrowest integers that hold it, so equal rows have equal bytes."""
    out: list[bytes] = [b""] * len(x)
    low, high = x.min(axis=1, initial=0), x.max(axis=1, initial=0)
    todo = np.ones(len(x), bool)
    for kind in _WIDTHS:
        fits = todo & (low >= np.iinfo(kind).min) & (high <= np.iinfo(kind).max)
        for k, row in zip(np.flatnonzero(fits).tolist(), x[fits].astype(kind), strict=True):
            out[k] = row.tobytes()
        todo &= ~fits
    return out


def unpack(column: pa.Array, dim: int) -> np.ndarray:
    rows = column.to_pylist()
    out = np.zeros((len(rows), dim), np.int64)
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    for kind in _WIDTHS:
        at = np.flatnonzero(size == dim * np.dtype(kind).itemsize)
        if len(at):
            out[at] = np.frombuffer(b"".join(rows[k] for k in at.tolist()), kind).reshape(-1, dim)
    return out


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, list[int]]:
    """(number, exact squared distance) of the nearest centroid of each row; ties go to the smaller number."""
    most = max((abs(v) for c in centroids for v in c), default=0)
    most = max(most, int(np.abs(x).max(initial=0)))
    if most <= EXACT_DOUBLE and x.shape[1] <= DIM:
        own, c = x.astype(np.float64), np.array(centroids, np.float64)
        apart = (own * own).sum(axis=1)[:, None] - 2 * (own @ c.T) + (c * c).sum(axis=1)
    elif most <= EXACT_LONG and x.shape[1] <= DIM:
        apart = np.stack([((x - np.array(c, np.int64)) ** 2).sum(axis=1) for c in centroids], axis=1)
    else:
        own = x.astype(object)
        apart = np.stack([((own - np.array(c, object)) ** 2).sum(axis=1) for c in centroids], axis=1)
    place = np.array([min(range(len(centroids)), key=row.__getitem__) for row in apart], np.int64) if apart.dtype == object else apart.argmin(axis=1)
    return place, [int(d) for d in apart[np.arange(len(x)), place]]


def _packed(vectors: DataFrame, key: str, vector: str, dim: int, scale: float) -> DataFrame:
    """(key, q) of the vectors that are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = quantised(b.column(1), dim, scale)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(pack(x), pa.binary())], [key, "q"])

    return vectors.select(key, vector).mapInArrow(run, T.StructType([T.StructField(key, vectors.schema[key].dataType), T.StructField("q", T.BinaryType())]))


def _sums(distinct: DataFrame, centroids: list[list[int]], dim: int) -> dict[int, tuple[int, list[int]]]:
    """By centroid: how many vectors are nearest to it, and the sums of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = [0] * len(centroids), np.zeros((len(centroids), dim), object)
        for b in batches:
            x, n = unpack(b.column(0), dim), b.column(1).to_numpy()
            place, _ = nearest(x, centroids)
            if int(n.sum()) * int(np.abs(x).max(initial=0)) >= LARGEST:
                x, n = x.astype(object), n.astype(object)
            for c in np.unique(place).tolist():
                own = place == c
                count[c] += int(n[own].sum())
                total[c] += (x[own] * n[own, None]).sum(axis=0).astype(object)
        met = [c for c in range(len(centroids)) if count[c]]
        exact = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array([Decimal(count[c]) for c in met], exact), pa.array([[Decimal(int(v)) for v in total[c]] for c in met], pa.list_(exact))], ["cluster", "n", "s"])

    parts = distinct.select("q", "n").mapInArrow(run, "cluster int, n decimal(38,0), s array<decimal(38,0)>")
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[k]).alias(f"s{k}") for k in range(dim)]).collect()  # a row for each centroid
    return {r["cluster"]: (int(r["n"]), [int(r[f"s{k}"]) for k in range(dim)]) for r in rows}


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, key: str = "vec_id", vector: str = "embedding", dim: int = DIM, scale: float = SCALE, seed: int = SEED) -> DataFrame:
    """Per kept row: the key, cluster int, distance long (squared), copies long (rows of the same quantised vector), cluster_inertia and inertia long, centroid_sha256 string."""
    with_workers(vectors.sparkSession)
    rows = settle(_packed(vectors, key, vector, dim, scale))
    distinct = settle(rows.groupBy("q").agg(F.count("*").alias("n")), narrow=True)
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    first = rows.select(mark.alias("mark"), key, "q").orderBy(F.asc_nulls_last("mark"), "q").limit(k).collect()
    centroids = [unpack(pa.array([bytes(r["q"])], pa.binary()), dim)[0].tolist() for r in first]
    if not centroids:
        made = "cast(null as int) as cluster, 0L as distance, 0L as copies, 0L as cluster_inertia, 0L as inertia, '' as centroid_sha256"
        return rows.where("false").selectExpr(f"`{key}`", *made.split(", "))
    for _ in range(rounds):
        for c, (n, sums) in _sums(distinct, centroids, dim).items():
            centroids[c] = [s // n for s in sums]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, apart = nearest(unpack(b.column(0), dim), centroids)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(place, pa.int32()), pa.array([min(d, FARTHEST) for d in apart], pa.int64())], ["q", "n", "cluster", "distance"])

    assigned = settle(distinct.select("q", "n").mapInArrow(assign, "q binary, n long, cluster int, distance long"))
    as_long = lambda total: F.least(total, F.lit(Decimal(FARTHEST)).cast("decimal(38,0)")).cast("long")
    of = assigned.groupBy("cluster").agg(F.sum(F.col("n").cast("decimal(19,0)") * F.col("distance").cast("decimal(19,0)")).cast("decimal(38,0)").alias("own"))
    of = of.withColumn("all", F.sum("own").over(Window.partitionBy()).cast("decimal(38,0)"))
    digests = [(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids)]
    of = of.join(F.broadcast(vectors.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")), "cluster")
    of = of.select("cluster", as_long(F.col("own")).alias("cluster_inertia"), as_long(F.col("all")).alias("inertia"), "centroid_sha256")
    facts = assigned.join(F.broadcast(of), "cluster").withColumn("copies", F.col("n"))  # of: a row for each centroid
    out = meet(rows, facts, "q", rows.count()).select(key, "cluster", "distance", "copies", "cluster_inertia", "inertia", "centroid_sha256")
    release(distinct)
    return out
