"""SimHash near-duplicates: fingerprints, a Gray-order hierarchical index, and components.

Fingerprints that differ in at most two bits agree in two of four 16-bit parts, so distinct fingerprints are dealt
six times, by each pair of parts. In a group that shares a pair the fingerprints are sorted by Gray rank, which
brings alike ones together; runs of them form nodes that hold the bits all members share, less what the nodes above
hold. A search goes down from the root for many fingerprints at once, adds up differences, and drops a whole node once they
exceed the limit. Groups above `split_above` are dealt again by pairs of bytes of the rest of their bits, which leaves
at most 2^16 distinct fingerprints in a group whatever the data. Groups give spanning links, not all their pairs.

Null and empty texts and texts without words have fingerprint zero, linked like any other; texts shorter than a
shingle are hashed whole. Rows with one doc_id but different texts are all linked to that doc_id's class through
their fingerprints; a null doc_id keeps its row, and its class is the least non-null doc_id, or null. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenry.llm.common import meet, settle, with_workers
from lumenry.llm.components import components

U = np.uint64
WIDTH, SEED = 3, 42


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The 64-bit SimHash of a text; see the module for short texts."""
    return majority(shingles(text, width))


def shingles(text: str | None, width: int) -> np.ndarray:
    """The hashes of a text's shingles in order, repeats included."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return np.zeros(0, "<u8")
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - width + 1)
    return np.fromiter((digest(b" ".join(words[i : i + width]), SEED) for i in range(n)), "<u8", n)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, fp long) for every row."""
    with_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py(), width) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", text).mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())]))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code word in the Gray sequence."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> U(shift)
    return x


class GrayIndex:
    """A forest over fingerprints in groups: one tree a group, leaves in Gray order, FAN children to a node.

    kin (a class of each fingerprint): pairs within a class aren't looked for, and nodes that hold one class only are dropped
    whole for its members.
    """

    FAN = 8

    def __init__(self, group: np.ndarray, fps: np.ndarray, kin: np.ndarray | None = None):
        keys = (gray_rank(fps), group) if kin is None else (gray_rank(fps), kin, group)
        order = np.lexsort(keys)
        self.order, self.fps, self.group = order, fps[order], group[order]
        self.kin = None if kin is None else kin[order]
        # A level: first child and number of children of each node; of each child the bits that all its members share and its
        # node lacks, their values, and its members' class (-1: several).
        self.levels: list[tuple] = []
        owner, shared, value, kin = self.group, np.full(len(fps), ~U(0)), self.fps, self.kin
        while True:
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            inside = np.arange(len(owner)) - np.repeat(starts, np.diff(np.r_[starts, len(owner)]))
            first = np.flatnonzero(inside % self.FAN == 0)
            count = np.diff(np.r_[first, len(owner)])
            both_one = np.bitwise_and.reduceat(value & shared, first)
            both_zero = np.bitwise_and.reduceat(~value & shared, first)
            up_shared = both_one | both_zero
            self.levels.append((first, count, shared & ~np.repeat(up_shared, count), value, kin))  # children keep what the node lacks
            owner, shared, value = owner[first], up_shared, both_one
            if kin is not None:
                kin = np.where(np.minimum.reduceat(kin, first) == np.maximum.reduceat(kin, first), kin[first], -1)
            if len(starts) == len(owner):
                self.roots = (shared, value)
                break
        sizes = np.diff(np.r_[np.flatnonzero(np.r_[True, self.group[1:] != self.group[:-1]]), len(self.group)])
        self.root_of, self.group_size = np.repeat(np.arange(len(starts)), sizes), np.repeat(sizes, sizes)

    def near(self, limit: int | np.ndarray, at_once: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places (i < j) in the index whose fingerprints differ in at most `limit` bits (of i, where given by place), within their group.

        Searches go down together for as many fingerprints as can meet `at_once` others, or one.
        """
        limit = np.broadcast_to(np.asarray(limit), len(self.fps))
        block = np.cumsum(self.group_size) // at_once
        cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]) if len(block) else []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            who = np.arange(lo, hi)
            node, apart = self.root_of[who], np.zeros(len(who), np.int64)
            for first, count, own, value, kin in reversed(self.levels):
                reps = count[node]
                who, apart = np.repeat(who, reps), np.repeat(apart, reps)
                child = np.repeat(first[node] - np.r_[0, np.cumsum(reps)[:-1]], reps) + np.arange(len(who))
                apart = apart + np.bitwise_count((self.fps[who] ^ value[child]) & own[child])
                ok = apart <= limit[who]
                if kin is not None:
                    ok &= kin[child] != self.kin[who]
                who, node, apart = who[ok], child[ok], apart[ok]
            later = node > who
            yield who[later], node[later]


def links_within(group: np.ndarray, fps: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (fingerprint, least fingerprint of its part) of the groups' near pairs."""
    index = GrayIndex(group, fps)
    root = np.arange(len(fps))
    for i, j in index.near(limit):
        while True:  # hook the larger root on the smaller, then halve all paths, until the pairs agree
            a, b = root[i], root[j]
            if not (differ := a != b).any():
                break
            i, j = i[differ], j[differ]
            np.minimum.at(root, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
            while (root[root] != root).any():
                root = root[root]
    own = index.fps.view(np.int64)
    moved = root != np.arange(len(root))
    return own[moved], own[root[moved]]


def _parts(source: str, bits: int, width: int, choose: int) -> list:
    """Masks of every choice of `choose` parts of `width` bits among the low `bits`."""
    one = (1 << width) - 1
    return [sum(one << (width * k) for k in c) for c in combinations(range(bits // width), choose)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _free_halves(mask: int) -> list[int]:
    """Masks of each pair of bytes among the four bytes outside `mask`, with `mask`."""
    bytes_left = [0xFF << (8 * k) for k in range(8) if not mask >> (8 * k) & 0xFF]
    return [mask | a | b for a, b in combinations(bytes_left, 2)]


def near_links(fps: DataFrame, limit: int = 2, split_above: int = 4096) -> DataFrame:
    """Links (u, v) that span every class of distinct fingerprints (fp long) at `limit` (at most 2) differing bits."""
    if limit > 2:
        raise ValueError("the deal by parts is exact up to two differing bits")
    with_workers(fps.sparkSession)
    masks = _parts("fp", 64, 16, 2)
    key = lambda m: F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits"))
    dealt = settle(fps.select("fp", F.explode(F.array(*map(key, masks))).alias("k")).select("fp", "k.*"))
    sizes = dealt.groupBy("mask", "bits").agg(F.count("*").alias("n")).where("n > 1")
    dealt = dealt.join(sizes, ["mask", "bits"])
    again = F.lit(None)
    for m in masks:
        again = F.when(F.col("mask") == _signed(m), F.array(*map(key, _free_halves(m)))).otherwise(again)
    small = dealt.where(F.col("n") <= split_above).select("mask", "bits", "fp")
    large = dealt.where(F.col("n") > split_above).select("fp", F.explode(again).alias("k")).select("k.mask", "k.bits", "fp").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Takes sorted rows, and so whole groups one after another, in blocks of bounded size."""
        held: list[pa.RecordBatch] = []

        def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            cols = [np.concatenate([p.column(k).to_numpy(zero_copy_only=False) for p in parts]) for k in range(3)]
            group = np.cumsum(np.r_[False, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])])
            u, v = links_within(group, cols[2].view(np.uint64), limit)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < 1 << 16:
                continue
            mask, bits = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            last = np.flatnonzero((mask != mask[-1]) | (bits != bits[-1]))
            if len(last):  # the last group may go on in the next batch
                cut = int(last[-1]) + 1
                held[-1] = batch.slice(0, cut)
                yield flush(held)
                held = [batch.slice(cut)]
        if held:
            yield flush(held)

    rows = small.union(large).repartition("mask", "bits").sortWithinPartitions("mask", "bits")
    return rows.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, limit: int = 2, text: str = "text", width: int = WIDTH, similarity: float | None = None) -> DataFrame:
    """Per row of docs: doc_id, fp (long), component_id.

    With a similarity (of sets of shingles, 0.8 or more), fingerprints of these sets only tell which pairs are compared: see `similar`.
    """
    if similarity is not None:
        from lumenry.llm.similar import similar_documents

        return similar_documents(docs, text, width, similarity)
    prints = settle(fingerprints(docs, text, width))
    least = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    parts = components(near_links(least.select("fp"), limit)).withColumnRenamed("node", "fp")
    ids = parts.join(least, "fp")
    part_id = ids.groupBy("root").agg(F.min("first_id").alias("part_id"))
    of_print = least.join(ids.select("fp", "root").join(part_id, "root").select("fp", "part_id"), "fp", "left")
    of_print = settle(of_print.select("fp", "n", F.coalesce("part_id", "first_id").alias("component_id")))
    return meet(prints, of_print, "fp", prints.count()).select("doc_id", "fp", "component_id")
