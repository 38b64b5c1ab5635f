"""Documents whose sets of shingles are alike (Jaccard similarity of 0.8 or more), by SimHash, and their classes.

At that similarity fingerprints of 64 bits differ in about ten bits, more than a deal by parts of their bits can search, so they are dealt by shingles: shingles have a
fixed order, those of crowded cells of a sketch last, then by hash; sets alike enough share one of their first n - ceil(0.8 n) + 1, and rows of only these
are dealt. Within a group that shares a shingle, fingerprints of the sets tell which pairs are compared: those of LIMIT bits or
fewer (two sets of the least similarity exceed that three times in a million; sets of fewer than FEW shingles have no limit). First
each set meets the smallest one of its group, or the next one that is too large for that one. Groups that are then in one class are done; in others a
Gray-order index, in which nodes of one class are dropped whole for its members, finds the near pairs of two classes. Of these, those count that are near by
EXTRA longer fingerprints too (exceeded twice in a million). Twice each set meets only its nearest one, so that most classes grow together.
At last the sets that have a near one of another class are dealt once more, with their texts, by the component of such pairs they are in; their index
finds the pairs there, which are compared where they stand, so only links leave. Pairs are always compared exactly by their sets. The sketch only orders, and tells crowded groups, which are dealt in parts of
about PART rows, as large components are by their sets and shingles, every two parts meeting.

Words are those of simhash. Texts shorter than a shingle are one shingle; null texts and texts without words are alike. Equal sets count as one; a null
doc_id keeps its row.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenry.llm import simhash
from lumenry.llm.common import meet, settle, text_of, with_workers
from lumenry.llm.components import components

WIDTH, SIMILARITY, SEED = 5, 0.8, 42
#: Bits in which fingerprints of alike sets may differ; from how many shingles on that holds.
LIMIT, FEW = 24, 40
#: Further fingerprints, by other hashes of the shingles, and the bits in which all together may differ.
EXTRA, LIMIT_ALL = 4, 80
#: Cells of the sketch (a power of two), and the count from which a task reports one.
CELLS, CROWDED = 1 << 20, 8
#: Rows of a group that are dealt together.
PART = 1 << 14
#: Sets and shingles of a component that are dealt together.
PART_SETS, PART_SHINGLES = 1 << 10, 1 << 20
#: Rows and bytes of a block of groups, after which it ends with its group.
BLOCK_ROWS, BLOCK_BYTES = 1 << 15, 1 << 23
#: Sets that a task remembers to leave out their copies; copies beyond meet in their group.
REMEMBERED = 1 << 16
#: Texts that are sent to their pairs, at most; each has over one in SENT of all pairs.
SENT = 200


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(simhash.shingles(text, width))


def name_of(own: np.ndarray) -> int:
    """A set's name, a signed 64-bit number."""
    x = xxhash.xxh64_intdigest(own.tobytes(), SEED)
    return x - (1 << 64) if x >> 63 else x


def longer(own: np.ndarray) -> bytes:
    """EXTRA further fingerprints of a set."""
    out = []
    for k in range(1, EXTRA + 1):
        x = own + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(simhash.majority(x ^ (x >> np.uint64(27))))
    return np.array(out, "<u8").tobytes()


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 1 << 10) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


class Measure:
    """The least similarity as a fraction, and what it implies."""

    def __init__(self, similarity: float):
        if not 0.8 <= similarity <= 1:
            raise ValueError("fingerprints tell pairs of a similarity from 0.8 to 1")
        of = Fraction(similarity).limit_denominator(1000)
        self.num, self.den = of.numerator, of.denominator

    def first_ones(self, n: int) -> int:
        """How many of a set's shingles must hold one of any set that is alike enough."""
        return n - -(-self.num * n // self.den) + 1

    def largest(self, n):
        """The size of the largest set that one of n can be alike to."""
        return n * self.den // self.num

    def possible(self, n1, place1, n2, place2):
        """Whether sets may be alike whose first common shingle has these places."""
        most = np.minimum(np.minimum(place1, place2) + 1 + np.minimum(n1 - place1 - 1, n2 - place2 - 1), np.minimum(n1, n2))
        return (self.num + self.den) * most >= self.num * (n1 + n2)

    def alike(self, a: np.ndarray, b: np.ndarray) -> bool:
        if not len(a) or not len(b):
            return len(a) == len(b)
        if self.den * min(len(a), len(b)) < self.num * max(len(a), len(b)):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return self.den * both >= self.num * (len(a) + len(b) - both)


def _named(docs: DataFrame, text: str, width: int) -> DataFrame:
    """(doc_id, name, fp, more, cell, times): the set of every row, and rows of a null name with crowded cells of the sketch; settled."""
    names = ["doc_id", "name", "fp", "more", "cell", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen, kind = np.zeros(CELLS, np.int32), {}, None
        for b in _pieces(batches):
            kind, found, prints, further = b.column(0).type, [], [], []
            for x in b.column(1):
                own = shingles(x.as_py(), width)
                name = name_of(own)
                fp = seen.get(name)
                if fp is None:
                    fp = simhash.majority(own), longer(own)
                    np.add.at(sketch, own & np.uint64(CELLS - 1), 1)
                    if len(seen) < REMEMBERED:
                        seen[name] = fp
                found.append(name)
                prints.append(fp[0])
                further.append(fp[1])
            n = len(found)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(further, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], names)
        cells = np.flatnonzero(sketch >= max(CROWDED, 4 * sketch.mean())).astype(np.int32)
        if len(cells):
            n = len(cells)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, kind), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(cells), pa.array(sketch[cells].astype(np.int64))], names)

    long = T.LongType()
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, t) for n, t in (("name", long), ("fp", long), ("more", T.BinaryType()), ("cell", T.IntegerType()), ("times", long))]])
    return settle(docs.select("doc_id", text).mapInArrow(run, schema))


_ROW = "shingle long, part int, name long, fp long, n int, place int, parts int"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]


def _dealt(docs: DataFrame, text: str, width: int, crowd: np.ndarray, measure: Measure) -> DataFrame:
    """The first shingles of every set; `part` is the set's part in a group of `parts`."""
    sent = docs.sparkSession.sparkContext.broadcast(crowd)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowd, seen = sent.value, set()
        for b in _pieces(batches):
            rows = []
            for x in b.column(0):
                own = shingles(x.as_py(), width)
                if not len(own) or (name := name_of(own)) in seen:
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(name)
                p = measure.first_ones(len(own))
                times = crowd[own & np.uint64(CELLS - 1)]
                first = np.lexsort((own, times))[:p]
                parts = (times[first] // PART + 1).astype(np.int32)
                fp = np.full(p, simhash.majority(own), np.uint64).view(np.int64)
                rows.append((own[first].view(np.int64), (np.int64(name) % parts).astype(np.int32), np.full(p, name), fp, np.full(p, len(own), np.int32), np.arange(p, dtype=np.int32), parts))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], _NAMES)

    return docs.select(text).mapInArrow(run, _ROW)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of sorted rows, in blocks that hold whole groups of the first `keys` columns."""
    held: list[pa.RecordBatch] = []
    rows = size = 0

    def columns() -> list[np.ndarray]:
        return [np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in range(held[0].num_columns)]

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows, size = rows + b.num_rows, size + b.nbytes
        if rows < BLOCK_ROWS and size < BLOCK_BYTES:
            continue
        key = [b.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        last = np.flatnonzero(np.any([k != k[-1] for k in key], axis=0))
        if len(last):  # the last group may go on in the next batch
            held[-1] = b.slice(0, int(last[-1]) + 1)
            yield columns()
            held = [b.slice(int(last[-1]) + 1)]
            rows, size = held[0].num_rows, held[0].nbytes
    if held:
        yield columns()


def _new(*columns: np.ndarray) -> np.ndarray:
    """Where any of the sorted columns changes."""
    return np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)]


def _few(n: np.ndarray) -> np.ndarray:
    """The limit of bits for sets of n shingles."""
    return np.where(n < FEW, 64, LIMIT)


def _groups(measure: Measure):
    """Rows of groups of two or more sets, and of groups in parts, each set once: with the set it meets first, and whether they are near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _whole_groups(batches, 2):
            once = _new(block[0], block[1], block[2])
            shingle, part, name, fp, n, place, parts = (x[once] for x in block)
            starts = np.flatnonzero(_new(shingle, part))
            sizes = np.diff(np.r_[starts, len(shingle)])
            lead = np.arange(len(name))
            for a, m in zip(starts[sizes > 1], sizes[sizes > 1], strict=True):
                at, own = a, n[a : a + m]
                while at < a + m:
                    end = a + int(np.searchsorted(own, measure.largest(int(n[at])), "right"))
                    lead[at:end] = at
                    at = end
            near = (lead != np.arange(len(name))) & measure.possible(n, place, n[lead], place[lead]) & (np.bitwise_count((fp ^ fp[lead]).view(np.uint64)) <= _few(n))
            ok = np.repeat(sizes > 1, sizes) | (parts > 1)
            yield pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (shingle, part, name, fp, n, place, parts, name[lead], near)], [*_NAMES, "lead", "near"])

    return run


def _candidates(measure: Measure, columns: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, other row, differing bits) of sets of one group that are in two classes, near by fingerprints, and may be alike by size and place."""
    shingle, one, other, name, fp, n, place, root, more = columns[:9]
    starts = np.flatnonzero(_new(shingle, one, other))
    sizes = np.diff(np.r_[starts, len(shingle)])
    rows = np.flatnonzero(np.repeat(np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts), sizes))
    if not len(rows):
        return
    group = np.repeat(np.arange(len(starts)), sizes)[rows]
    index = simhash.GrayIndex(group, fp[rows].view(np.uint64), np.unique(root[rows], return_inverse=True)[1])
    rows = rows[index.order]
    n, place = n[rows].astype(np.int64), place[rows]
    further = np.frombuffer(b"".join(more[rows]), np.uint64).reshape(-1, EXTRA)
    for i, j in index.near(_few(n)):
        ok = (np.maximum(n[i], n[j]) <= measure.largest(np.minimum(n[i], n[j]))) & measure.possible(n[i], place[i], n[j], place[j])
        i, j = i[ok], j[ok]
        apart = np.bitwise_count(index.fps[i] ^ index.fps[j]).astype(np.int32) + np.bitwise_count(further[i] ^ further[j]).sum(axis=1, dtype=np.int32)
        ok = (apart <= LIMIT_ALL) | (n[i] < FEW)
        yield rows[i[ok]], rows[j[ok]], apart[ok]


def _nearest(measure: Measure):
    """For each set of a group only its nearest one of another class, with their difference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _whole_groups(batches, 3):
            block = [x[once] for once in [_new(*block[:4])] for x in block]
            name = block[3]
            for i, j, apart in _candidates(measure, block):
                i, j, apart = np.r_[i, j], np.r_[j, i], np.r_[apart, apart]
                order = np.lexsort((name[j], apart, i))
                if len(order):
                    order = order[_new(i[order])]
                    yield pa.RecordBatch.from_arrays([pa.array(name[i[order]]), pa.array(name[j[order]]), pa.array(apart[order])], ["u", "v", "apart"])

    return run


class _Classes:
    """Classes of values that are joined one pair after another; each is named by its least value."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def of(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = up = self.up.get(y, y)
            x = up
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether they weren't joined yet."""
        x, y = self.of(x), self.of(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _spanning(measure: Measure):
    """Pairs (u, v) of candidates of a group, as many as join its sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _whole_groups(batches, 3):
            block = [x[once] for once in [_new(*block[:4])] for x in block]
            name, joined, found = block[3], _Classes(), []
            for i, j, _ in _candidates(measure, block):
                found += [x for x in zip(name[i].tolist(), name[j].tolist(), strict=True) if joined.join(*x)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["u", "v"])

    return run


def _linked(measure: Measure, width: int):
    """Links (u, v) of sets of a component that are alike, as many as join their classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _whole_groups(batches, 3):
            name, root, own = block[3].tolist(), block[7].tolist(), block[9]
            sets: dict[int, np.ndarray] = {}
            joined, found = _Classes(), []

            def opened(k: int) -> np.ndarray:
                if k not in sets:
                    sets[k] = shingles(zstandard.decompress(own[k]).decode(), width)
                return sets[k]

            for i, j, _ in _candidates(measure, block):
                for a, b in zip(i.tolist(), j.tolist(), strict=True):
                    if joined.of(root[a]) != joined.of(root[b]) and measure.alike(opened(a), opened(b)):
                        joined.join(root[a], root[b])
                        found.append((name[a], name[b]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["u", "v"])

    return run


_KEY = ["shingle", "one", "other"]


def _regrouped(groups: DataFrame, facts: DataFrame, links: DataFrame) -> DataFrame:
    """Rows of groups with the class of each set by now and its further fingerprints; of a group in parts that isn't in one class, every two parts."""
    root = settle(components(links)).groupBy("node").agg(F.first("root").alias("root"))
    facts = facts.join(root, facts["name"] == root["node"], "left").select("name", "more", F.coalesce("root", "name").alias("root"))
    rest = groups.join(facts, "name")
    several = rest.where("parts > 1").groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("shingle")
    own = ["name", "fp", "n", "place", "root", "more"]
    many = rest.where("parts > 1").join(several, "shingle", "left_semi").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    many = many.select("shingle", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("other"), *own)
    rest = rest.where("parts = 1").select("shingle", F.lit(0).alias("one"), F.lit(0).alias("other"), *own).unionByName(many)
    return rest.repartition(*_KEY).sortWithinPartitions(*_KEY, "name")


def _texts(names: DataFrame, docs: DataFrame, named: DataFrame, text: str, width: int) -> DataFrame:
    """(name, own, fp, n_shingles, ...) of the settled names: a compressed text of each set, its fingerprint and size; settled."""
    own = docs.select("doc_id", text_of(text).alias("t"))
    ids = named.where("doc_id is not null").join(names.select("name"), "name", "left_semi").groupBy("name").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    some = own.join(ids, "doc_id", "left_semi").unionByName(own.where("doc_id is null"))

    def name_them(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor().compress
        for b in batches:
            texts = b.column(0).to_pylist()
            rows = [(name_of(x), squeeze(t.encode("utf-8", "replace")), simhash.majority(x), len(x)) for t in texts for x in [shingles(t, width)]]
            names, own, fps, n = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(own, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(n, pa.int32())], ["name", "own", "fp", "n_shingles"])

    return settle(some.select("t").mapInArrow(name_them, "name long, own binary, fp long, n_shingles int").join(names, "name").dropDuplicates(["name"]))


def _verified(pairs: DataFrame, docs: DataFrame, named: DataFrame, text: str, width: int, measure: Measure) -> DataFrame:
    """Those of the settled distinct pairs (u, v) that are alike, settled."""
    ends = settle(pairs.select(F.explode(F.array("u", "v")).alias("name")).groupBy("name").agg(F.count("*").alias("n")))
    texts, total = _texts(ends, docs, named, text, width), pairs.count()
    of = lambda end: texts.select(F.col("name").alias(end), F.col("own").alias(f"own_{end}"), "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [[shingles(zstandard.decompress(x.as_py()).decode(), width) for x in b.column(k)] for k in (2, 3)]
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["u", "v"]).filter(pa.array([measure.alike(x, y) for x, y in zip(*sets, strict=True)], pa.bool_()))

    both = meet(meet(pairs, of("u"), "u", total, SENT), of("v"), "v", total, SENT)
    return settle(both.select("u", "v", "own_u", "own_v").mapInArrow(run, "u long, v long"))


def similar_documents(docs: DataFrame, text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """Per row of docs: doc_id, fp (long) of its set, component_id: the least doc_id of its class."""
    measure = Measure(similarity)
    with_workers(docs.sparkSession)
    named = _named(docs, text, width)
    crowd = np.zeros(CELLS, np.int64)
    for r in named.where("cell is not null").groupBy("cell").agg(F.sum("times").alias("n")).toLocalIterator():
        crowd[r["cell"]] = r["n"]
    named = named.where("name is not null").select("doc_id", "name", "fp", "more")
    groups = _dealt(docs, text, width, crowd, measure).repartition("shingle", "part").sortWithinPartitions("shingle", "part", "n", "name")
    groups = settle(groups.mapInArrow(_groups(measure), f"{_ROW}, lead long, near boolean"))
    pair = lambda a, b: (F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    first = groups.where("near").select(*pair("name", "lead"))
    # The first sets of a group's parts meet the smallest of them.
    leads = groups.where("parts > 1 and name = lead").select("shingle", "name", "fp", "n")
    least = leads.groupBy("shingle").agg(F.min(F.struct("n", "name", "fp")).alias("to")).where("to is not null")
    leads = leads.join(least, "shingle").where((F.col("name") != F.col("to.name")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("to.fp"))) <= LIMIT))
    first = settle(first.unionByName(leads.select(*pair("name", F.col("to.name")))).distinct())
    links = _verified(first, docs, named, text, width, measure)
    facts = settle(named.groupBy("name").agg(F.first("more").alias("more")))
    tried = first
    for _ in range(2):
        near = _regrouped(groups, facts, links).mapInArrow(_nearest(measure), "u long, v long, apart int")
        near = near.groupBy("u").agg(F.min(F.struct("apart", "v"))["v"].alias("v")).select(*pair("u", "v")).distinct()
        near = settle(near.join(tried, ["u", "v"], "left_anti"))
        links, tried = links.unionByName(_verified(near, docs, named, text, width, measure)), tried.unionByName(near)
    met = settle(_regrouped(groups, facts, links).mapInArrow(_spanning(measure), "u long, v long"))
    part_of = settle(components(met).withColumnRenamed("root", "component"))
    texts = _texts(part_of.withColumnRenamed("node", "name"), docs, named, text, width)
    root = components(links).withColumnRenamed("node", "name")
    sizes = texts.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / PART_SETS, F.sum("n_shingles") / PART_SHINGLES)).cast("int").alias("parts"))
    sets = texts.join(sizes, "component").join(facts, "name").join(root, "name", "left").withColumn("part", F.pmod("name", "parts").cast("int"))
    sets = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        F.col("component").alias("shingle"), F.least("part", "other").alias("one"), F.greatest("part", "other").alias("other"),
        "name", "fp", F.col("n_shingles").alias("n"), F.lit(0).alias("place"), F.coalesce("root", "name").alias("root"), "more", "own",
    )
    sets = sets.repartition(*_KEY).sortWithinPartitions(*_KEY, "name").mapInArrow(_linked(measure, width), "u long, v long")
    links = links.unionByName(settle(sets.distinct()))
    least = settle(named.groupBy("name").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    ids = components(links).withColumnRenamed("node", "name").join(least, "name")
    part_id = ids.groupBy("root").agg(F.min("first_id").alias("part_id"))
    of_name = least.join(ids.select("name", "root").join(part_id, "root").select("name", "part_id"), "name", "left")
    of_name = settle(of_name.select("name", "n", F.coalesce("part_id", "first_id").alias("component_id")))
    return meet(named, of_name, "name", named.count()).select("doc_id", "fp", "component_id")
