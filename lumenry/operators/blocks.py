"""Sentences against references of any number: a product of groups and blocks of both.

Sentences are dealt into groups and references into blocks, each packed into one row of bounded size. A task holds one group and lets blocks pass, one matrix product after
another; groups and blocks meet by a product of partitions, which reads both sides where they lie and writes neither again, so disk grows with sentences and references, not with
their product (reading does, by sentences x references / group). Both sides are checkpointed once. Groups are slices of the partitions in which sentences lie and blocks pieces of those of the references, without a shuffle,
unless there are far more partitions than groups or blocks are wanted, or too few. Neither side is ever whole in a task or in the driver. References up to `scoring.MOST_REFERENCES` are cheaper as a dictionary (see scoring).

Scores are rounded as everywhere: half to even in decimals. A null vector gives no score. Equal best scores go to the reference of least `ord`. Rows that occur twice count twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_EVEN, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumenry.functions.lineage import cut

#: Sentences of a group and references of a block, about, where that makes no more of them than tasks are wanted.
GROUP, BLOCK = 1 << 14, 1 << 12
#: Numbers in the vectors of a group or a block at most, about; tasks for each core.
CELLS, TASKS = 1 << 21, 4
#: Groups or blocks that may be made of partitions as they lie, for each that is wanted; slices of a partition at most. Beyond these a shuffle deals.
UNEVEN, SLICES = 4, 64
#: Rows of a group and references of a block that are multiplied at a time, and pairs that leave at a time.
AT_ONCE, REFS_AT_ONCE, PAIRS_AT_ONCE = 1 << 10, 1 << 11, 1 << 16
#: Bits of a row's number that count inside its partition.
IN_PARTITION = 33
#: Two decimals: what rounding moves a score by, at most, and a little more.
MOVED = 0.0051


def half_even(scores: np.ndarray, places: int = 2) -> np.ndarray:
    """Scores rounded half to even by their shortest decimals, as the engine rounds."""
    scaled = scores * 10.0**places
    out = np.rint(scaled) / 10.0**places + 0.0
    near = np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6  # here the product by a power of ten may have moved a tie
    if near.any():
        step = Decimal(1).scaleb(-places)
        out[near] = [float(Decimal(repr(float(x))).quantize(step, ROUND_HALF_EVEN)) + 0.0 for x in scores[near]]
    return out


def _may_be(scores: np.ndarray, least) -> np.ndarray:
    """Where rounded scores may reach `least`; what is found is rounded and compared then, so that few scores are."""
    return scores >= least - MOVED - 1e-9 * np.abs(least)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    array = column.combine_chunks()
    return np.asarray(array.flatten(), np.float64).reshape(len(array), -1)


def _packed(name: str, order: list[tuple[str, str]], most: int | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """All rows of a partition as one, or `most` at a time, in an Arrow stream."""

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        rows = (rows.sort_by(order) if order else rows).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_table(rows)
        return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], [name])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            while b.num_rows:
                taken = b if most is None else b.slice(0, most - n)
                held, n, b = [*held, taken], n + taken.num_rows, b.slice(taken.num_rows)
                if n == most:
                    yield packed(held)
                    held, n = [], 0
        if held:
            yield packed(held)

    return pack


def _opened(packed: bytes) -> pa.Table:
    with pa.ipc.open_stream(packed) as rows:
        return rows.read_all()


class Grid:
    """Sentences and references dealt for their product. Sentences are named by `_row`, unique in `sentences`, and checkpointed, as are the blocks, so a task that runs again deals alike."""

    def __init__(self, sentences: DataFrame, refs: DataFrame, vector: str = "vec", key: str = "ref_key", order: str = "ord", group: int = GROUP, block: int = BLOCK):
        self.vector = vector
        self.sentences = cut(sentences.where(F.col(vector).isNotNull()).withColumn("_row", F.monotonically_increasing_id()))
        own = refs.where(F.col(vector).isNotNull()).select(F.col(key).alias("ref_key"), F.col(order).cast("long").alias("ord"), F.col(vector).alias("ref_vec"))
        lie = lambda rows, at, vec: rows.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.max(F.size(vec)).alias("width")).agg(F.sum("n"), F.max("width"), F.max("n"), F.max("at") + 1).first()
        n, width, largest, lying = (x or 0 for x in lie(self.sentences, F.shiftright("_row", IN_PARTITION), vector))
        m, _, _, refs_lying = (x or 0 for x in lie(own, F.spark_partition_id(), "ref_vec"))
        most = max(1, CELLS // max(1, width))
        tasks = TASKS * sentences.sparkSession.sparkContext.defaultParallelism
        parts = lambda rows, least: max(1, min(-(-rows // least), max(-(-rows // most), tasks)))
        self.groups, blocks = parts(n, group), parts(m, block)
        #: Slices of each partition of the sentences, and rows of a slice; no slices where a shuffle deals groups.
        self.slices = max(1, -(-4 * largest * self.groups // (5 * max(1, n))))
        self.rows = max(1, -(-largest // self.slices))
        if self.slices > SLICES or lying * self.slices > UNEVEN * self.groups:
            self.slices = 0
        #: Blocks lie in one partition where there are groups enough for all tasks.
        self.passes = min(blocks, -(-tasks // self.groups))
        by = [("ord", "ascending"), ("ref_key", "ascending")]
        if self.passes <= refs_lying <= UNEVEN * blocks:
            packed = own.mapInArrow(_packed("refs", by, -(-m // blocks)), "refs binary")
        else:
            packed = own.repartitionById(blocks, F.pmod(F.xxhash64("ref_key", "ord"), F.lit(blocks)).cast("int")).mapInArrow(_packed("refs", by), "refs binary")
        self.blocks = cut(packed.withColumn("block", F.monotonically_increasing_id())).coalesce(self.passes)

    def fields(self, columns: list[str] | None) -> list[T.StructField]:
        """Of the sentences' columns those named, or all."""
        return [f for f in self.sentences.schema.fields if f.name != "_row" and (columns is None or f.name in columns)]

    def product(self, found, schema: T.StructType, columns: list[str]) -> DataFrame:
        """What found(group, blocks) gives as tables: the group's columns `columns`, and for each block its references in order of ord and the pieces of the product, (first row, first reference, scores).

        Scores come as they are, not rounded. A group may meet its blocks in `passes` tasks.
        """
        held = [*map(F.col, columns), F.col(self.vector).alias("_vec")]
        pack = lambda rows: rows.mapInArrow(_packed("rows", []), "rows binary")
        if self.slices:
            slice_of = F.expr(f"(_row & {(1 << IN_PARTITION) - 1}) div {self.rows}")
            groups = reduce(DataFrame.unionAll, [pack(self.sentences.where(slice_of == k).select(*held)) for k in range(self.slices)])
        else:
            groups = pack(self.sentences.select(*held, F.pmod(F.xxhash64("_row"), F.lit(self.groups)).cast("int").alias("_g")).repartitionById(self.groups, "_g").drop("_g"))
        arrow = to_arrow_schema(schema)

        def pieces(left: np.ndarray, right: pa.Table) -> Iterator[tuple[int, int, np.ndarray]]:
            refs = _matrix(right.column("ref_vec"))
            refs = (refs / np.maximum(np.linalg.norm(refs, axis=1, keepdims=True), 1e-12)).T
            for at in range(0, refs.shape[1], REFS_AT_ONCE):
                for of in range(0, len(left), AT_ONCE):
                    yield of, at, left[of : of + AT_ONCE] @ refs[:, at : at + REFS_AT_ONCE]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pairs = ((i.as_py(), r, s) for b in batches for i, r, s in zip(b.column("block"), b.column("refs"), b.column("rows"), strict=True))
            now = next(pairs, None)
            if now is None:
                return
            at, refs, held = now[0], now[1], []
            while now is not None and now[0] == at:  # all that lies in the partition of groups comes for the first block, and again for each other
                held.append(_opened(now[2].as_buffer()))
                now = next(pairs, None)
            group = pa.concat_tables(held)
            left, group = _matrix(group.column("_vec")), group.drop_columns(["_vec"])

            def blocks() -> Iterator[tuple[pa.Table, Iterator]]:
                nonlocal at, refs, now
                while refs is not None:
                    right = _opened(refs.as_buffer())
                    yield right, pieces(left, right)
                    while now is not None and now[0] == at:
                        now = next(pairs, None)
                    at, refs = now[:2] if now is not None else (None, None)

            for out in found(group, blocks()):
                yield from pa.Table.from_arrays(out, names=arrow.names).cast(arrow).to_batches()

        return self.blocks.hint("shuffle_replicate_nl").crossJoin(groups).mapInArrow(run, schema)

    def whole(self, merged: DataFrame) -> DataFrame:
        """The sentences with what was merged for them."""
        return self.sentences.join(merged, "_row", "left").drop("_row")


def _ahead(ords: np.ndarray, keys: np.ndarray, other_ords: np.ndarray, other_keys: np.ndarray) -> np.ndarray:
    """Which references come before others: by ord, then by key."""
    out = ords < other_ords
    for k in np.flatnonzero(ords == other_ords):
        out[k] = (keys[k] is None, keys[k] or "") < (other_keys[k] is None, other_keys[k] or "")
    return out


def best(grid: Grid, columns: list[str] | None = None) -> DataFrame:
    """The sentences (the columns named, or all) with ref_key, ord and score of their best reference."""
    no_ord = np.iinfo(np.int64).max

    def found(group, blocks):
        n = group.num_rows
        score, ords, keys = np.full(n, np.nan), np.full(n, no_ord), np.full(n, None, object)
        for refs, pieces in blocks:
            ord_of, key_of = refs.column("ord").fill_null(no_ord).to_numpy(), np.array(refs.column("ref_key").to_pylist(), object)
            for of, at, scores in pieces:
                top = half_even(np.fmax.reduce(scores, axis=1))
                live = np.flatnonzero((top >= score[of : of + len(top)]) | (np.isnan(score[of : of + len(top)]) & ~np.isnan(top)))
                i, j = np.nonzero(_may_be(scores[live], top[live, None]))
                same = half_even(scores[live[i], j]) == top[live[i]]
                i, first = np.unique(i[same], return_index=True)  # the first of equal ones
                row, ref, top = of + live[i], at + j[same][first], top[live[i]]
                better = ~(top <= score[row]) | _ahead(ord_of[ref], key_of[ref], ords[row], keys[row])
                row, ref = row[better], ref[better]
                score[row], ords[row], keys[row] = top[better], ord_of[ref], key_of[ref]
        bare = np.isnan(score)
        yield [*group.columns, pa.array(keys, pa.string()), pa.array(ords, mask=bare | (ords == no_ord)), pa.array(score, mask=bare)]

    own, of_ref = grid.fields(columns), T.StructType.fromDDL("ref_key string, ord long, score double").fields
    if grid.blocks.isEmpty():
        return grid.sentences.select(*[f.name for f in own], *[F.lit(None).cast(f.dataType).alias(f.name) for f in of_ref])
    merged = grid.passes > 1  # else a row has met all references in one task, and leaves as it is
    fields = [*own, *[grid.sentences.schema["_row"]] * merged]
    each = grid.product(found, T.StructType([*fields, *of_ref]), [f.name for f in fields])
    if not merged:
        return each
    order = F.struct(F.isnull("score"), -F.col("score"), F.isnull("ord"), "ord", F.isnull("ref_key"), "ref_key")
    return each.groupBy("_row").agg(F.min_by(F.struct(*[f.name for f in [*own, *of_ref]]), order).alias("x")).select("x.*")


def reached(grid: Grid, thresholds: list[float]) -> DataFrame:
    """The sentences with `counts`: how many references reach each threshold."""

    def found(group, blocks):
        counts = np.zeros((len(thresholds), group.num_rows), np.int64)
        for _, pieces in blocks:
            for of, _, scores in pieces:
                scores = half_even(scores)
                for k, t in enumerate(thresholds):
                    counts[k, of : of + len(scores)] += (scores >= t).sum(axis=1)
        yield [pa.array(group.column("_row").to_numpy()), *map(pa.array, counts)]

    names = [f"n{k}" for k in range(len(thresholds))]
    each = grid.product(found, T.StructType.fromDDL(", ".join(["_row long", *[f"{x} long" for x in names]])), ["_row"])
    merged = each.groupBy("_row").agg(*[F.sum(x).alias(x) for x in names])
    return grid.whole(merged.select("_row", F.array(*names).alias("counts")))


def pairs_at_least(grid: Grid, threshold: float, columns: list[str] | None = None) -> DataFrame:
    """A row for each sentence and reference with a score at the threshold: the sentence's columns (those named, or all), ref_key, ord and score."""
    own = grid.fields(columns)

    def found(group, blocks):
        for refs, pieces in blocks:
            for of, at, scores in pieces:
                i, j = np.nonzero(_may_be(scores, threshold))
                rounded = half_even(scores[i, j])
                ok = rounded >= threshold
                i, j, rounded = of + i[ok], at + j[ok], rounded[ok]
                for k in range(0, len(i), PAIRS_AT_ONCE):
                    row, ref = (pa.array(x[k : k + PAIRS_AT_ONCE]) for x in (i, j))
                    yield [*group.take(row).columns, *refs.select(["ref_key", "ord"]).take(ref).columns, pa.array(rounded[k : k + PAIRS_AT_ONCE])]

    return grid.product(found, T.StructType([*own, *T.StructType.fromDDL("ref_key string, ord long, score double").fields]), [f.name for f in own])


def threshold_counts(grid: Grid, thresholds: list[float]) -> DataFrame:
    """(theta, n_rows, n_selected): sentences with a score at each threshold, over all references."""

    def found(group, blocks):
        top = np.full(group.num_rows, np.nan)
        for _, pieces in blocks:
            for of, _, scores in pieces:
                top[of : of + len(scores)] = np.fmax(top[of : of + len(scores)], np.fmax.reduce(scores, axis=1))
        ok = ~np.isnan(top)
        yield [pa.array(group.column("_row").to_numpy()[ok]), pa.array(half_even(top[ok]))]

    # A sentence reaches a threshold if its greatest score does.
    top = grid.product(found, T.StructType.fromDDL("_row long, score double"), ["_row"]).groupBy("_row").agg(F.max("score").alias("score"))
    got = top.agg(*[F.count_if(F.col("score") >= t).alias(f"n{k}") for k, t in enumerate(thresholds)]).crossJoin(grid.sentences.agg(F.count("*").alias("n_rows")))
    each = F.array(*[F.struct(F.lit(float(t)).alias("theta"), F.col("n_rows"), F.col(f"n{k}").alias("n_selected")) for k, t in enumerate(thresholds)])
    return got.select(F.inline(each))
