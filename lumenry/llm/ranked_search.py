"""Ranked lexical search over an index of two levels.

The index holds blocks of documents. Of each term of a block it has the documents that hold it, and of each such pair two levels: an impact in one byte, which is the exact impact
over STEP rounded up, and the count the exact impact is made from. A search goes over all blocks twice. By the bytes alone every document gets a bound that its score doesn't exceed
and one that it reaches; each task keeps the greatest lower bounds of each item, and the k-th over all tasks is the item's threshold. Then every document whose
upper bound reaches the threshold is scored in whole numbers, and each task sends its k best. A block whose greatest impacts can't reach an item's threshold is passed over for it. Nothing else is
left out: ties of any number are scored, and only k rows of a task and item travel.

Score of a document: the sum over the item's distinct terms of w * ((10^9 * tf) div (1000 * tf + 8 * m)), w = floor(1000 * ln((2N + 2) / (2 df + 1))), m = 10 + (90 * n * N) div L,
where N counts the documents with a term, L their terms, n the document's terms, df the documents with the term and tf its places in the document.

Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. Documents whose text is null or has no term aren't found, and count nowhere. Items
with a null text, without terms or with terms that no document holds give no rows. Rows of one item_id (null as well) are one item with the terms of all; each row of documents is a document of its own,
so repeated rows are found repeatedly. Equal scores are in order of doc_id, null last. Empty tables give an empty result, and other columns aren't looked at.

Items are searched in sets of about MOST_TERMS terms, each sent to all tasks, so a table of items of any size is searched in as many rounds.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenry.llm.common import release, settle, with_workers

#: Exact impacts are below 10^6, so over STEP they fit in a byte.
STEP = 4096
#: A block ends with the document that brings it to so many postings or documents.
BLOCK_POSTINGS, BLOCK_DOCS = 1 << 19, 1 << 14
#: Terms of the items that are searched together.
MOST_TERMS = 1 << 20

_KEPT = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(_KEPT).split()


def impact(tf, m):
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _as_bytes(column: pa.Array) -> pa.Array:
    return column.cast(pa.string()).cast(pa.binary())


def _narrow(x: np.ndarray) -> bytes:
    """Counts as bytes where they fit, else as 32-bit numbers; the length tells which."""
    return x.astype(np.uint8 if x.max(initial=0) < 256 else np.uint32).tobytes()


_BLOCK = "lengths binary, terms binary, term_at binary, starts binary, docs binary, tfs binary, n_docs long, n_terms long"


def _blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Blocks of documents: ids, lengths; terms with their places, the starts of their postings, and of these the document and count; settled."""
    kind = docs.schema[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, terms, counts, owners = [], [], [], [], []

        def block() -> pa.RecordBatch:
            coded = pa.array(terms, pa.binary()).dictionary_encode()
            codes = coded.indices.to_numpy()
            order = np.argsort(codes, kind="stable")  # documents stay in order within a term
            starts = np.r_[0, np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))].astype(np.int32)
            names = coded.dictionary.to_pylist()
            term_at = np.r_[0, np.cumsum([len(x) for x in names])].astype(np.int32)
            docs_of = np.repeat(np.arange(len(ids), dtype=np.uint16), owners)[order]
            blobs = [np.array(lengths, np.int64).tobytes(), b"".join(names), term_at.tobytes(), starts.tobytes(), docs_of.tobytes(), _narrow(np.array(counts, np.uint32)[order])]
            columns = [pa.array([ids], pa.list_(own)), *[pa.array([x], pa.binary()) for x in blobs], pa.array([len(ids)]), pa.array([sum(lengths)])]
            return pa.RecordBatch.from_arrays(columns, ["ids", *[x.split()[0] for x in _BLOCK.split(", ")]])

        own = None
        for b in batches:
            own = b.column(0).type
            for i, t in zip(b.column(0).to_pylist(), _as_bytes(b.column(1)), strict=True):
                found = Counter(terms_of(t.as_py() or b""))
                if not found:
                    continue
                ids.append(i)
                lengths.append(found.total())
                owners.append(len(found))
                terms += found
                counts += found.values()
                if len(terms) >= BLOCK_POSTINGS or len(ids) >= BLOCK_DOCS:
                    yield block()
                    for x in (ids, lengths, terms, counts, owners):
                        x.clear()
        if ids:
            yield block()

    return settle(docs.select(key, text).mapInArrow(run, T.StructType([T.StructField("ids", T.ArrayType(kind.dataType)), *T.StructType.fromDDL(_BLOCK).fields])))


class Block:
    """A row of the index, its columns by name."""

    def __init__(self, row: dict):
        self.ids = row.get("ids")
        self.m = np.frombuffer(row["m"], np.int64) if "m" in row else None
        self.starts = np.frombuffer(row["starts"], np.int32)
        at = pa.py_buffer(row["term_at"])
        self.terms = pa.Array.from_buffers(pa.binary(), len(self.starts) - 1, [None, at, pa.py_buffer(row["terms"])])
        self.docs = np.frombuffer(row["docs"], np.uint16) if "docs" in row else None
        self.impacts = np.frombuffer(row["impacts"], np.uint8) if "impacts" in row else None
        self.tops = np.frombuffer(row["tops"], np.uint8) if "tops" in row else None
        self.tfs = None
        if "tfs" in row:
            self.tfs = np.frombuffer(row["tfs"], np.uint8 if len(row["tfs"]) == self.starts[-1] else np.uint32)

    def places(self, names: pa.Array) -> np.ndarray:
        """The place of each name among the terms, -1 where the block lacks it."""
        return pc.fill_null(pc.index_in(names, value_set=self.terms), -1).to_numpy()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for b in batches:
        for k in range(b.num_rows):
            yield Block({name: b.column(c)[k].as_py() for c, name in enumerate(b.schema.names)})


class Index:
    """The settled blocks with both levels, and the counts of the whole corpus."""

    def __init__(self, blocks: DataFrame, documents: int, terms: int):
        self.blocks, self.documents, self.terms = blocks, documents, terms


def build(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """The index of all documents: one pass over the texts for the counts, one over the blocks for the impacts, which need the corpus' mean length."""
    with_workers(docs.sparkSession)
    counted = _blocks(docs, key, text)
    documents, terms = (int(x or 0) for x in counted.agg(F.sum("n_docs"), F.sum("n_terms")).first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for k in range(b.num_rows):
                lengths = np.frombuffer(b.column("lengths")[k].as_py(), np.int64)
                m = np.array([10 + 90 * n * documents // terms for n in lengths.tolist()], np.int64)
                own = Block({x: b.column(x)[k].as_py() for x in ("terms", "term_at", "starts", "docs", "tfs")})
                level = ((impact(own.tfs.astype(np.int64), m[own.docs]) + STEP - 1) // STEP).astype(np.uint8)
                made.append((m.tobytes(), level.tobytes(), np.maximum.reduceat(level, own.starts[:-1]).tobytes()))
            more = [pa.array(x, pa.binary()) for x in zip(*made, strict=True)] if made else [pa.array([], pa.binary())] * 3
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in kept), *more], [*kept, "m", "impacts", "tops"])

    kept = ["ids", "terms", "term_at", "starts", "docs", "tfs"]
    schema = T.StructType([*(counted.schema[x] for x in kept), *[T.StructField(x, T.BinaryType()) for x in ("m", "impacts", "tops")]])
    blocks = settle(counted.mapInArrow(run, schema))
    release(counted)
    return Index(blocks, documents, terms)


class Items:
    """A set of items as tasks use it: names of all terms, and of each item the places of its terms."""

    def __init__(self, pairs: list[tuple[int, bytes]]):
        names = sorted({t for _, t in pairs})
        place = {t: k for k, t in enumerate(names)}
        self.names = pa.array(names, pa.binary())
        self.numbers = sorted({i for i, _ in pairs})
        own: dict[int, list[int]] = {i: [] for i in self.numbers}
        for i, t in pairs:
            own[i].append(place[t])
        self.terms = [np.array(sorted(own[i]), np.int64) for i in self.numbers]
        self.weights = np.zeros(len(names), np.int64)
        self.thresholds = np.zeros(len(self.numbers), np.int64)


def _joined(starts: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(postings of these terms one after another, how many each has)."""
    first, size = starts[places], starts[places + 1] - starts[places]
    total = int(size.sum())
    return np.arange(total) + np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size), size


def _bounds(block: Block, places: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(upper, lower) bounds of all documents of a block; the sums are whole doubles, far below 2^53."""
    at, size = _joined(block.starts, places)
    docs, w, n = block.docs[at], np.repeat(weights, size), len(block.m)
    upper = STEP * np.bincount(docs, w * block.impacts[at].astype(np.int64), n).astype(np.int64)
    return upper, upper - (STEP - 1) * np.bincount(docs, w, n).astype(np.int64)


def _exact(block: Block, places: np.ndarray, weights: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Scores of some documents of a block."""
    at, size = _joined(block.starts, places)
    wanted = np.full(len(block.m), -1, np.int64)
    wanted[docs] = np.arange(len(docs))
    ok = wanted[block.docs[at]] >= 0
    at, w = at[ok], np.repeat(weights, size)[ok]
    out = np.zeros(len(docs), np.int64)
    np.add.at(out, wanted[block.docs[at]], w * impact(block.tfs[at].astype(np.int64), block.m[block.docs[at]]))
    return out


def _met(block: Block, items: Items) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(item, places in the block, weights) of the items that share a term of some weight with the block."""
    found = block.places(items.names)
    usable = (found >= 0) & (items.weights > 0)
    for k, own in enumerate(items.terms):
        own = own[usable[own]]
        if len(own):
            yield k, found[own], items.weights[own]


def search_some(index: Index, pairs: list[tuple[int, bytes]], k: int) -> DataFrame:
    """(item int, rank, doc_id, score) of one set of items, given as (number, term)."""
    context = index.blocks.sparkSession.sparkContext
    items = Items(pairs)
    sent = context.broadcast(items)

    def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sent.value.names
        total = np.zeros(len(names), np.int64)
        for block in _rows(batches):
            at = block.places(names)
            have = np.flatnonzero(at >= 0)
            total[have] += np.diff(block.starts)[at[have]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["term", "df"])

    counts = index.blocks.select("terms", "term_at", "starts").mapInArrow(holding, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    for r in counts.toLocalIterator():  # of this set's terms only
        items.weights[r["term"]] = weight(index.documents, r["df"])
    sent.unpersist()
    weighted = context.broadcast(items)

    def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, best = weighted.value, {}
        for block in _rows(batches):
            for i, places, weights in _met(block, items):
                low = _bounds(block, places, weights)[1]
                low = np.r_[best.get(i, np.zeros(0, np.int64)), low[low > 0]]
                best[i] = np.partition(low, len(low) - k)[len(low) - k :] if len(low) > k else low
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(list(best), np.int32), [len(x) for x in best.values()])), pa.array(np.concatenate([np.zeros(0, np.int64), *best.values()]))], ["item", "low"])

    first = ["m", "terms", "term_at", "starts", "docs", "impacts", "tops"]
    lows = index.blocks.select(*first).mapInArrow(lower, "item int, low long")
    lows = lows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("low")))).where(F.col("rank") <= k)
    for r in lows.where(F.col("rank") == k).select("item", "low").toLocalIterator():  # a number for each item
        items.thresholds[r["item"]] = r["low"]
    weighted.unpersist()
    bound = context.broadcast(items)
    kind = index.blocks.schema["ids"].dataType.elementType

    def rescore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, best, own = bound.value, {}, None
        for b in batches:
            own = b.column(b.schema.get_field_index("ids")).type.value_type
            for block in _rows(iter([b])):
                for i, places, weights in _met(block, items):
                    least = max(int(items.thresholds[i]), 1)
                    if STEP * int((weights * block.tops[places].astype(np.int64)).sum()) < least:
                        continue
                    docs = np.flatnonzero(_bounds(block, places, weights)[0] >= least)
                    scores = _exact(block, places, weights, docs)
                    some = np.flatnonzero(scores > 0)
                    rows = [(-int(scores[j]), block.ids[docs[j]] is None, block.ids[docs[j]] or 0) for j in some.tolist()]
                    best[i] = heapq.nsmallest(k, [*best.get(i, ()), *rows])
        out = [(items.numbers[i], None if null else d, -s) for i, rows in best.items() for s, null, d in rows]
        numbers, docs, scores = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(docs, own or pa.int64()), pa.array(scores, pa.int64())], ["item", "doc_id", "score"])

    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("doc_id", kind), T.StructField("score", T.LongType())])
    rows = index.blocks.select("ids", *first, "tfs").mapInArrow(rescore, schema)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term binary): the distinct terms of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(set(terms_of(t.as_py() or b""))) for t in _as_bytes(b.column(1))]
            at = np.repeat(np.arange(b.num_rows), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array([t for x in found for t in x], pa.binary())], [key, "term"])

    schema = T.StructType([T.StructField(key, items.schema[key].dataType), T.StructField("term", T.BinaryType())])
    return items.select(key, text).mapInArrow(run, schema).distinct()


def search(index: Index, items: DataFrame, k: int = 10, key: str = "item_id", text: str = "text", most_terms: int = MOST_TERMS) -> DataFrame:
    """(key, rank int, doc_id, score long): the k best documents of each item with a score above 0."""
    with_workers(items.sparkSession)
    pairs = settle(item_terms(items, key, text))
    total = pairs.count()
    sets = max(1, -(-total // most_terms))
    out = None
    for n in range(sets):
        own = pairs.where(F.pmod(F.xxhash64(key), F.lit(sets)) == n).collect()  # at most about most_terms terms
        names = {x: k for k, x in enumerate({r[key] for r in own})}
        if not names or not index.documents:
            continue
        found = search_some(index, [(names[r[key]], bytes(r["term"])) for r in own], k)
        numbers = items.sparkSession.createDataFrame([(i, x) for x, i in names.items()], T.StructType([T.StructField("item", T.IntegerType()), T.StructField(key, items.schema[key].dataType)]))
        found = found.join(F.broadcast(numbers), "item").select(key, F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = found if out is None else out.unionByName(settle(found))
    if out is None:
        kind = index.blocks.schema["ids"].dataType.elementType
        empty = [T.StructField(key, items.schema[key].dataType), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", kind), T.StructField("score", T.LongType())]
        return items.sparkSession.createDataFrame([], T.StructType(empty))
    return out
