"""Clusters against brute force in whole numbers, and the exactness of the small parts."""

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lumenry.llm import centroids
from lumenry.llm import queries as q
from tests.llm.conftest import embeddings


def brute(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    mark = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest())
    width = lambda v: next(w for w in (1, 2, 4, 8) if all(-(1 << 8 * w - 1) <= x < 1 << 8 * w - 1 for x in v))
    packed = lambda v: b"".join(x.to_bytes(width(v), "little", signed=True) for x in v)
    now = [v for _, v in sorted(kept, key=lambda r: (mark(r[0]), packed(r[1])))[:k]]
    apart = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    of = lambda v: min(range(len(now)), key=lambda c: apart(v, now[c]))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(of(v), []).append(v)
        now = [[sum(x) // len(groups[c]) for x in zip(*groups[c], strict=True)] if c in groups else now[c] for c in range(len(now))]
    placed = [(i, of(v), apart(v, now[of(v)])) for i, v in kept]
    own = Counter()
    for _, c, d in placed:
        own[c] += d
    cap = lambda x: min(x, (1 << 63) - 1)
    return Counter((i, c, cap(d), cap(own[c]), cap(sum(own.values())), hashlib.sha256(",".join(map(str, now[c])).encode()).hexdigest()) for i, c, d in placed)


def found(df):
    return Counter(tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


def test_op13(spark, edge_dir):
    assert found(q.op13_centroid_clustering(spark, edge_dir)) == brute([(i, v) for i, v, _ in embeddings()])


def test_op13_counts_copies(spark, edge_dir):
    rows = q.op13_centroid_clustering(spark, edge_dir).collect()
    assert max(r.copies for r in rows) >= 40 and sum(1 / r.copies for r in rows) == pytest.approx(len({tuple(map(lambda x: math.floor(64 * x), v)) for i, v, _ in embeddings() if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)}))


def test_components_beyond_doubles_and_longs_are_exact(spark):
    """Differences that neither doubles nor 64-bit squares can tell still decide, and few vectors make few centroids."""
    rows = [(k, [float((1 << 40) + (k * 7 + j) % 5) / 64 for j in range(64)]) for k in range(9)] + [(20, [1e30] * 64), (21, [-1e30] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    clipped = [(i, [max(min(x, (1 << 62) / 64), -(1 << 62) / 64) for x in v]) for i, v in rows]
    assert found(centroids.cluster(df)) == brute(clipped)
    assert found(centroids.cluster(df, k=2)) == brute(clipped, k=2)


def test_the_deal_of_rows_does_not_show(spark, edge_dir):
    df = spark.read.parquet(f"{edge_dir}/embeddings.parquet")
    assert found(centroids.cluster(df.repartition(1))) == found(centroids.cluster(df.repartition(7, "embedding")))


def test_packing_returns(spark):
    x = np.array([[0, -128, 127], [0, 0, 128], [-40000, 1, 2], [1 << 40, -5, 0], [1, 2, 3]], np.int64)
    packed = centroids.pack(x)
    assert list(map(len, packed)) == [3, 6, 12, 24, 3]
    assert (centroids.unpack(pa.array(packed, pa.binary()), 3) == x).all()
