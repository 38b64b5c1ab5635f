"""Text vectors learned from a corpus: a truncated singular value decomposition of hashed, weighted word counts.

A text is a sparse row of BUCKETS weights, (1 + ln n) times the bucket's rarity, at unit length. The right singular vectors of all rows come from a few passes of subspace iteration: each task multiplies its rows
with the present basis and sends one row for each bucket, the sums of these make the next basis, and only that matrix, whose size no corpus changes, is on the driver. The vector of a text is its row in
that basis, at unit length, so texts alike in words have a high dot product whatever corpus they come from. Texts without words have a zero vector.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Classes of words; dimensions of a vector, and those beyond them that the iteration uses; passes over the texts.
BUCKETS, DIM, OVER, PASSES = 4096, 64, 16, 6
#: Texts that are multiplied at a time.
AT_ONCE = 512

_KEPT = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def row(text: str | None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, 1 + ln n) of a text's words, A-Z lower-cased."""
    found = Counter(zlib.crc32(w) % buckets for w in (text or "").encode("utf-8", "replace").translate(_KEPT).split())
    return np.fromiter(found.keys(), np.int64, len(found)), 1 + np.log(np.fromiter(found.values(), np.float64, len(found)))


def matrix(texts: list[str | None], rarity: np.ndarray) -> np.ndarray:
    """Rows of texts, dense."""
    out = np.zeros((len(texts), len(rarity)))
    for k, t in enumerate(texts):
        at, w = row(t, len(rarity))
        out[k, at] = w * rarity[at]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class Encoder:
    """A basis (buckets x dim) and the rarity of each bucket."""

    def __init__(self, rarity: np.ndarray, basis: np.ndarray):
        self.rarity, self.basis = rarity, basis

    def encode(self, texts: list[str]) -> list[list[float]]:
        out = []
        for at in range(0, len(texts), AT_ONCE):
            v = matrix(texts[at : at + AT_ONCE], self.rarity) @ self.basis
            out += (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).tolist()
        return out

    def factory(self) -> Callable[[], Callable[[list[str]], list[list[float]]]]:
        """As providers.embedded takes an encoder."""
        return lambda: self.encode

    def saved(self, spark: SparkSession, path: str) -> None:
        rows = [(k, float(r), v.tolist()) for k, (r, v) in enumerate(zip(self.rarity, self.basis, strict=True))]
        spark.createDataFrame(rows, "bucket int, rarity double, v array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def opened(spark: SparkSession, path: str) -> Encoder:
    rows = spark.read.parquet(path).orderBy("bucket").collect()  # a row for each bucket
    return Encoder(np.array([r.rarity for r in rows]), np.array([r.v for r in rows]))


def _rarity(texts: DataFrame, text: str, buckets: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, n = np.zeros(buckets, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                at = row(t, buckets)[0]
                have[at] += 1
                n += bool(len(at))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, buckets, dtype=np.int32)), pa.array(np.r_[n, have])], ["bucket", "n"])

    sums = {r.bucket: r.n for r in texts.select(text).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    return np.array([math.log((sums.get(-1, 0) + 1) / (sums.get(k, 0) + 1)) + 1 for k in range(buckets)])


def _product(texts: DataFrame, text: str, rarity: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The rows' products summed: transposed rows times (rows times basis)."""
    buckets, width = basis.shape
    sent = texts.sparkSession.sparkContext.broadcast((rarity, basis))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity, basis = sent.value
        total = np.zeros((buckets, width))
        for b in batches:
            texts = b.column(0).to_pylist()
            for at in range(0, len(texts), AT_ONCE):
                x = matrix(texts[at : at + AT_ONCE], rarity)
                total += x.T @ (x @ basis)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets, dtype=np.int32)), pa.FixedSizeListArray.from_arrays(pa.array(total.reshape(-1)), width).cast(pa.list_(pa.float64()))], ["bucket", "z"])

    parts = texts.select(text).mapInArrow(run, "bucket int, z array<double>")
    sums = parts.groupBy("bucket").agg(F.array(*[F.sum(F.col("z")[k]) for k in range(width)]).alias("z"))
    out = np.zeros((buckets, width))
    for r in sums.toLocalIterator():  # a row for each bucket
        out[r["bucket"]] = r["z"]
    sent.unpersist()
    return out


def learn(texts: DataFrame, text: str = "text", dim: int = DIM, buckets: int = BUCKETS, over: int = OVER, passes: int = PASSES, seed: int = 1) -> Encoder:
    """The encoder of all texts, after one pass for rarity and `passes` for the basis."""
    rarity = _rarity(texts, text, buckets)
    width = min(dim + over, buckets)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(buckets, width)))[0]
    for k in range(passes):
        z = _product(texts, text, rarity, basis)
        if k + 1 < passes:
            basis = np.linalg.qr(z)[0]
    small = basis.T @ z
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[:dim]
    found = basis @ vectors[:, order]
    sign = np.sign(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])])
    return Encoder(rarity, found * np.where(sign == 0, 1, sign))
