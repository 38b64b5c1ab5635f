"""Sharding by histogram sort: shards of near equal bytes over one order of all rows.

Rows are ordered by (hash of the text, doc_id), written as one fixed-width key, so equal texts lie side by side and
share a shard unless a splitter must fall among them. Splitters are found without sorting: bytes below a few candidate
boundaries of every splitter are counted exactly over all partitions, the interval that holds the target is kept, shrunk
to the keys that lie in it, and probed again until the bytes below a probe meet the target within tolerance or one
row's key remains. Only then rows move, once, to ranges of
keys; slots follow the order of keys within a shard.

A null text has size 1 and its own hash value; a null doc_id sorts first. Rows with equal text and doc_id share
a key and so a shard, however many; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenry.llm.common import numbered, settle, text_of

#: Key digits: 16 for the text's hash, 16 for the doc_id, both as unsigned hexadecimal.
DIGITS = 32
TOP = 16**DIGITS


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, key) of every row, settled; size is UTF-8 bytes plus 1."""
    t = text_of(text)
    unsigned = lambda c: F.lpad(F.hex(c), 16, "0")
    least = -(1 << 63)
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).bitwiseXOR(F.lit(least))
    return settle(docs.select("doc_id", (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.concat(unsigned(F.xxhash64(t)), unsigned(order)).alias("key")))


def splitters(rows: DataFrame, shards: int, tolerance: float = 0.002, probes: int = 24) -> list[str]:
    """Keys that split rows into shards: shard k holds the keys from splitter k - 1 to before splitter k.

    Each round is one aggregation by interval; at most shards * (probes + 1) counts come to the driver. Every round parts an interval of two keys
    or more into smaller ones, or shrinks it to the keys in it, so rounds end.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    goals = [total * k / shards for k in range(1, shards)]
    slack = tolerance * total / shards
    # Of each splitter: lowest and highest (first not allowed) candidate, bytes below the lowest; the result once found.
    open_: dict[int, tuple[int, int, int]] = {k: (0, TOP, 0) for k in range(len(goals))}
    done: dict[int, int] = {}
    while open_ and total:
        cuts = sorted({lo + (hi - lo) * j // (probes + 1) for lo, hi, _ in open_.values() for j in range(probes + 2)})
        texts = [f"{c:0{DIGITS}X}" for c in cuts if c < TOP]
        place = F.size(F.filter(F.array(*map(F.lit, texts)), lambda c: c <= F.col("key")))
        got = {r["at"]: r for r in rows.groupBy(place.alias("at")).agg(F.sum("size").alias("size"), F.min("key").alias("low"), F.max("key").alias("high")).collect()}
        below, run = [], got[0]["size"] if 0 in got else 0
        for at in range(1, len(texts) + 1):
            below.append(run)
            run += got[at]["size"] if at in got else 0
        below += [total] * (len(cuts) - len(texts))
        for k in list(open_):
            lo, hi, _ = open_[k]
            mine = [j for j, c in enumerate(cuts) if lo <= c <= hi]
            nearest = min(mine, key=lambda j: (abs(below[j] - goals[k]), j))
            inner = max(j for j in mine if below[j] <= goals[k])
            held = got.get(inner + 1)
            if abs(below[nearest] - goals[k]) <= slack or held is None:
                done[k] = cuts[nearest]
            else:
                low, high = int(held["low"], 16), int(held["high"], 16)
                if low == high:  # one key: it goes to the nearer side
                    done[k] = low if goals[k] - below[inner] <= below[inner] + held["size"] - goals[k] else low + 1
                else:
                    open_[k] = (low, high + 1, below[inner])
            if k in done:
                del open_[k]
    out = sorted(done.get(k, TOP) for k in range(len(goals)))
    return [f"{min(c, TOP - 1):0{DIGITS}X}" if c < TOP else "G" for c in out]


def shard(docs: DataFrame, shards: int = 8, tolerance: float = 0.002, text: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, shard (0 to shards - 1), slot (gapless from 0 within its shard, in the order of keys).

    Rows of one key are told apart by their place in the settled table, so that a range may end among them.
    """
    rows = keyed(docs, text)
    found = splitters(rows, shards, tolerance)
    at = F.size(F.filter(F.array(*map(F.lit, found)), lambda c: c <= F.col("key"))) if found else F.lit(0)
    placed = numbered(rows.withColumns({"shard": at.cast("int"), "row": F.monotonically_increasing_id()}), "at", F.col("key"), F.col("row"))
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("at") - F.col("first")).alias("slot"))
