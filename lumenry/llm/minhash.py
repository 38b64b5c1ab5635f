"""MinHash near-duplicates with sequential Bayesian verification.

Equal sets of shingles count as one set, with HASHES minima of 16 bits as its signature. ROWS minima make a band; sets that share a band are candidates (two sets of similarity 0.8
share none of the bands five times in 10^8, more alike ones less often). The signatures of two candidates are compared BATCH minima at a time: with m of n equal, the similarity
has posterior Beta(m + 1, n - m + 1) from a uniform prior, and a pair goes as soon as the posterior chance that it is alike falls below MISS. Pairs that are left are confirmed on their full sets.

No group emits its pairs. First each set of a band meets the band's least set, then its greatest one of another class, which joins the classes of most copies in a number of pairs that grows with rows. Bands that still
hold several classes are dealt once more: survivors within them, as few as connect them, make components of possible links; sets of a component stand together with their texts, and a pair is
opened only while its classes are apart. A crowded band or component is dealt in parts: sets of the class of its least set stay in one part each, the
others also visit every other part, in a stream, so a task holds the residents of one part only.

Words are runs of anything but ASCII white space, A-Z lower-cased. A text with fewer words than a shingle has its whole sequence as its only one. Null and empty texts and texts without words have an
empty set (n_shingles 0) and are linked with nothing: their component_id is their own doc_id. Each row counts by its own text, so rows of one doc_id with unlike texts can have two classes. A null doc_id keeps its
row; a class is named by its least non-null doc_id, null if it has none, and `kept` tells whether both are the same, nulls alike. An empty table gives an empty result, and other columns aren't looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenry.llm.common import meet, release, settle, text_of, with_workers
from lumenry.llm.components import components
from lumenry.llm.similar import Measure, _Classes, _pieces, shingles

WIDTH, SIMILARITY = 4, 0.8
BANDS, ROWS = 32, 4
HASHES, BATCH = BANDS * ROWS, 32
#: Chance, by the posterior, that a pair that goes unconfirmed is alike after all.
MISS = 1e-8
#: Names that a task remembers, so that copies it meets again bring no signature.
REMEMBERED = 1 << 16
#: Sets of a crowded band that stay in one part; sets and shingles of a component's part.
PART, PART_SETS, PART_SHINGLES = 1 << 12, 1 << 10, 1 << 20
#: Signatures and texts that are sent to their pairs, at most, and the bytes of the longest such text.
SENT_SIGNATURES, SENT_TEXTS, SENT_BYTES = 20_000, 200, 1 << 18

_constant = lambda kind: np.array([xxhash.xxh32_intdigest(f"{kind}{k}") for k in range(HASHES)], np.uint32)
_TIMES, _FLIP = _constant("times") | np.uint32(1), _constant("flip")


def signature(own: np.ndarray) -> bytes:
    """The minima of a set of hashes under HASHES orders, 16 bits of each."""
    x, least = (own >> np.uint64(32)).astype(np.uint32), np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(least, ((x[at : at + 512, None] ^ _FLIP) * _TIMES).min(axis=0), out=least)
    return ((least ^ (least >> np.uint32(16))) & np.uint32(0xFFFF)).astype("<u2").tobytes()


def least_matches(similarity: float, miss: float = MISS) -> list[int]:
    """By number of batches compared: the fewest equal minima at which a pair stays.

    The posterior chance that the similarity reaches t after m of n is that of at most m successes in n + 1 tries of chance t.
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        chance, m = (1 - similarity) ** (n + 1), 0
        while chance < miss:
            m += 1
            chance += math.comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
        out.append(m)
    return out


def signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, HASHES)


def survivors(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs a[i], b[j] of signatures those that no batch drops, with their equal minima."""
    same = np.zeros(len(i), np.int32)
    for k, fewest in enumerate(least):
        own = slice(k * BATCH, (k + 1) * BATCH)
        same = same + (a[i, own] == b[j, own]).sum(axis=1, dtype=np.int32)
        ok = same >= fewest
        i, j, same = i[ok], j[ok], same[ok]
    return i, j, same


def _named(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key, name, n, sig): the set of every row; sig is null where the task has given it already; settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in _pieces(batches):
            names, sizes, sigs = [], [], []
            for x in b.column(1):
                own = shingles(x.as_py(), width)
                name = xxhash.xxh3_128_digest(own.tobytes())
                names.append(name)
                sizes.append(len(own))
                sigs.append(None if name in seen or not len(own) else signature(own))
                if len(seen) < REMEMBERED:
                    seen.add(name)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())], [key, "name", "n", "sig"])

    schema = [T.StructField(key, docs.schema[key].dataType), T.StructField("name", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("sig", T.BinaryType())]
    return settle(docs.select(key, text).mapInArrow(run, T.StructType(schema)))


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id) of each band of each set."""
    apart = np.array([xxhash.xxh64_intdigest(f"band{k}") for k in range(BANDS)], np.uint64)
    for b in batches:
        if b.num_rows:
            keys = (signatures(b.column(1)).copy().view("<u8").reshape(-1, BANDS) ^ apart) * np.uint64(0x9E3779B97F4A7C15)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), BANDS))], ["key", "id"])


def _ends(pairs: DataFrame) -> DataFrame:
    """(id, n) of the ends of settled pairs, n counting the pairs of each; settled."""
    return settle(pairs.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("n")))


def _both(pairs: DataFrame, facts: DataFrame, columns: list[str], most: int, light: Callable[[str], Column] | None = None) -> DataFrame:
    """Pairs with the columns of both ends, heavy ends sent."""
    total = pairs.count()
    for end in ("u", "v"):
        pairs = meet(pairs, facts.select(F.col("id").alias(end), "n", *[F.col(c).alias(f"{c}_{end}") for c in columns]), end, total, most, light and light(end))
    return pairs


def _texts(wanted: DataFrame, docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """The settled rows of wanted (id, name, first_id, ...) with a compressed text of each set in `own`; settled."""
    own = docs.select(F.col(key).alias("_id"), text_of(text).alias("t"))
    ids = wanted.where("first_id is not null").select(F.col("first_id").alias("_id")).distinct()
    some = own.join(ids, "_id", "left_semi")
    if not wanted.where("first_id is null").isEmpty():
        some = some.unionByName(own.where("_id is null"))

    def name_them(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor().compress
        for b in _pieces(batches, 256):
            texts = b.column(0).to_pylist()
            names = [xxhash.xxh3_128_digest(shingles(t, width).tobytes()) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([squeeze(t.encode("utf-8", "replace")) for t in texts], pa.binary())], ["name", "own"])

    return settle(some.select("t").mapInArrow(name_them, "name binary, own binary").join(wanted, "name").dropDuplicates(["id"]))


def _opened(own: bytes, width: int) -> np.ndarray:
    return shingles(zstandard.decompress(own).decode(), width)


def _confirmed(pairs: DataFrame, sets: DataFrame, docs: DataFrame, key: str, text: str, width: int, measure: Measure, least: list[int]) -> DataFrame:
    """Those of the settled distinct pairs (u, v) that are alike: by signatures first, and what is left by full sets; settled."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches, 1 << 12):
            a, c = (signatures(b.column(f"sig_{end}")) for end in ("u", "v"))
            at = np.arange(b.num_rows)
            n = [b.column(f"size_{end}").to_numpy() for end in ("u", "v")]
            at = at[np.maximum(*n) <= measure.largest(np.minimum(*n))]
            yield b.select(["u", "v"]).take(pa.array(survivors(a, c, at, at, least)[0]))

    facts = settle(_ends(pairs).join(sets.select("id", F.col("n").alias("size"), "sig"), "id"))
    near = settle(_both(pairs, facts, ["size", "sig"], SENT_SIGNATURES).mapInArrow(compare, "u long, v long"))
    release(facts)
    ends = settle(_ends(near).join(sets.select("id", "name", "first_id"), "id"))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for b in _pieces(batches, 256):
            ok = []
            for u, v, x, y in zip(*(b.column(c).to_pylist() for c in ("u", "v", "own_u", "own_v")), strict=True):
                if u not in known:  # leads come again and again
                    known = {u: _opened(x, width)}
                ok.append(measure.alike(known[u], _opened(y, width)))
            yield b.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    texts = _texts(ends, docs, key, text, width)
    light = lambda end: F.length(f"own_{end}") <= SENT_BYTES
    out = settle(_both(near, texts, ["own"], SENT_TEXTS, light).mapInArrow(confirm, "u long, v long"))
    release(near, ends, texts)
    return out


class _Part:
    """The residents of a part, and the pairs of two classes that survive, as rows come."""

    def __init__(self, measure: Measure, least: list[int]):
        self.measure, self.least = measure, least
        self.columns: list[np.ndarray] | None = None

    def _pairs(self, a: list[np.ndarray], b: list[np.ndarray], same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Columns are size, root and signature."""
        step = max(1, (1 << 20) // max(1, len(b[0])))
        for at in range(0, len(a[0]), step):
            n, root = a[0][at : at + step, None], a[1][at : at + step, None]
            ok = (root != b[1]) & (np.maximum(n, b[0]) <= self.measure.largest(np.minimum(n, b[0])))
            if same:
                ok &= np.arange(at, at + len(n))[:, None] < np.arange(len(b[0]))
            i, j = np.nonzero(ok)
            for k in range(0, len(i), 1 << 16):
                x, y, equal = survivors(a[2], b[2], i[k : k + (1 << 16)] + at, j[k : k + (1 << 16)], self.least)
                order = np.argsort(-equal, kind="stable")
                yield x[order], y[order], equal[order]

    def add(self, new: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Survivors among residents, of which some come now: places of both, by the order residents came in."""
        old, self.columns = self.columns, new if self.columns is None else [np.concatenate(x) for x in zip(self.columns, new, strict=True)]
        before = 0 if old is None else len(old[0])
        if old is not None:
            for i, j, _ in self._pairs(old, new, False):
                yield i, j + before
        for i, j, _ in self._pairs(new, new, True):
            yield i + before, j + before

    def visit(self, new: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Survivors of residents (first) and visitors."""
        if self.columns is not None:
            for i, j, _ in self._pairs(self.columns, new, False):
                yield i, j


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, bool, pa.RecordBatch]]:
    """(whether a group begins, whether rows visit, rows) of rows sorted by group, part and visits."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        group, part, visits = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        cuts = np.flatnonzero((group[1:] != group[:-1]) | (part[1:] != part[:-1]) | (visits[1:] != visits[:-1])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
            now = group[lo], part[lo]
            yield now != last, bool(visits[lo]), b.slice(lo, hi - lo)
            last = now


def _facts(b: pa.RecordBatch) -> list[np.ndarray]:
    return [b.column("size").to_numpy(), b.column("root").to_numpy(), signatures(b.column("sig"))]


def _spanning(measure: Measure, least: list[int]):
    """Pairs (u, v) of survivors of two classes, as many as connect the sets of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, joined = _Part(measure, least), np.zeros(0, np.int64), _Classes()
        for begins, visits, b in _segments(batches):
            if begins:
                part, ids, joined = _Part(measure, least), np.zeros(0, np.int64), _Classes()
            own = b.column("id").to_numpy()
            if not visits:
                ids = np.r_[ids, own]
            found = []
            for i, j in part.visit(_facts(b)) if visits else part.add(_facts(b)):
                found += [x for x in zip(ids[i].tolist(), (own if visits else ids)[j].tolist(), strict=True) if joined.join(*x)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["u", "v"])

    return run


def _linked(measure: Measure, least: list[int], width: int):
    """Links (u, v) of a component's sets that are alike, as many as join their classes; the sets of residents are kept open, those of visitors while they pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None
        for begins, visits, b in _segments(batches):
            if begins:
                part, joined, ids, roots, texts, sets = _Part(measure, least), _Classes(), [], [], [], {}
            own, passing = [b.column(c).to_pylist() for c in ("id", "root", "own")], {}
            if not visits:
                for x, y in zip((ids, roots, texts), own, strict=True):
                    x += y
            other, kept = (own, passing) if visits else ((ids, roots, texts), sets)
            found = []
            for i, j in part.visit(_facts(b)) if visits else part.add(_facts(b)):
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    if joined.of(roots[x]) != joined.of(other[1][y]):
                        if x not in sets:
                            sets[x] = _opened(texts[x], width)
                        if y not in kept:
                            kept[y] = _opened(other[2][y], width)
                        if measure.alike(sets[x], kept[y]):
                            joined.join(roots[x], other[1][y])
                            found.append((ids[x], other[0][y]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["u", "v"])

    return run


def _dealt(rows: DataFrame, parts: Column, major: Column, *columns: str) -> DataFrame:
    """Rows (grp, id, root, ...) by part: each stays in one, and those of another class than `major` visit the others."""
    parted = rows.withColumns({"_parts": parts.cast("int"), "_major": major}).withColumn("part", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int"))
    stay = parted.select("grp", "part", F.lit(False).alias("visits"), *columns)
    travel = parted.where("_parts > 1 AND root <> _major").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).where("to <> part")
    both = stay.unionByName(travel.select("grp", F.col("to").alias("part"), F.lit(True).alias("visits"), *columns))
    return both.repartition("grp", "part").sortWithinPartitions("grp", "part", "visits", "id")


def _classed(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows (id, ...) with the class of each set by the links so far; a set without links is its own."""
    root = components(links).withColumnRenamed("node", "id")
    return rows.join(root, "id", "left").withColumn("root", F.coalesce("root", "id"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """Per row of docs: the key, n_shingles long, component_id, kept boolean."""
    measure, least = Measure(similarity), least_matches(similarity)
    with_workers(docs.sparkSession)
    named = _named(docs, key, text, width)
    of_name = named.where("n > 0").groupBy("name").agg(F.min(key).alias("first_id"), F.count("*").alias("times"), F.max("n").alias("n"), F.max("sig").alias("sig"))
    sets = settle(of_name.withColumn("id", F.monotonically_increasing_id()))
    dealt = settle(sets.select("id", "sig").mapInArrow(_banded, "key long, id long"))
    heads = settle(dealt.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1"))
    # `rows`: how many sets share the band; meet() takes its n away.
    rows = settle(meet(dealt, heads.withColumn("rows", F.col("n")), "key", dealt.count()))
    release(dealt, heads)
    pairs = settle(rows.where("id <> lead").select(F.col("lead").alias("u"), F.col("id").alias("v")).distinct())
    links = _confirmed(pairs, sets, docs, key, text, width, measure, least)

    def unresolved(links: DataFrame) -> DataFrame:
        """Rows of bands of three or more sets in two or more classes; of a band of two its only pair is tried."""
        own = settle(_classed(rows.where("rows > 2"), links))
        several = own.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max_by("root", "id").alias("last_root"), F.min_by("root", "id").alias("major"), F.count("*").alias("n")).where("lo <> hi").drop("lo", "hi")
        out = settle(meet(own, settle(several), "key", own.count()))
        release(own)
        return out

    left = unresolved(links)
    again = left.where("root <> last_root").select(F.least("id", "last").alias("u"), F.greatest("id", "last").alias("v")).distinct()
    again = settle(again.join(pairs, ["u", "v"], "left_anti"))
    release(left)
    links = settle(links.unionByName(_confirmed(again, sets, docs, key, text, width, measure, least)))
    left = unresolved(links)
    facts = sets.select("id", F.col("n").alias("size"), "sig")
    bands = left.select(F.col("key").alias("grp"), "id", "root", "rows", "major").join(facts, "id")
    bands = _dealt(bands, F.floor(F.col("rows") / PART) + 1, F.col("major"), "id", "root", "size", "sig")
    met = settle(bands.mapInArrow(_spanning(measure, least), "u long, v long").distinct())
    part_of = settle(_classed(components(met).select(F.col("node").alias("id"), F.col("root").alias("grp")), links).join(sets.select("id", F.col("n").alias("size"), "sig", "name", "first_id"), "id"))
    sizes = part_of.groupBy("grp").agg(F.greatest(F.count("*") / PART_SETS, F.sum("size") / PART_SHINGLES).alias("much"), F.min_by("root", "id").alias("major"))
    texts = _texts(part_of, docs, key, text, width).join(sizes, "grp")
    more = _dealt(texts, F.floor("much") + 1, F.col("major"), "id", "root", "size", "sig", "own").mapInArrow(_linked(measure, least, width), "u long, v long")
    links = settle(links.unionByName(settle(more.distinct())))
    classed = settle(_classed(sets.select("id", "name", "first_id", "times"), links))
    part_id = classed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    whole = settle(classed.join(part_id, "root").select("name", F.col("times").alias("n"), "component_id"))
    full = named.where("n > 0").select(key, "name", F.col("n").alias("n_shingles"))
    out = meet(full, whole, "name", full.count()).select(key, "n_shingles", "component_id")
    bare = named.where("n = 0").select(key, F.col("n").alias("n_shingles"), F.col(key).alias("component_id"))
    release(sets, rows, pairs, left, met, part_of)
    return out.unionByName(bare).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
