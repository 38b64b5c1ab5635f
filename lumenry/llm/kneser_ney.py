"""Quality classifier: an interpolated modified Kneser-Ney bigram model of trusted text, and language-wise thresholds.

Words are tokens between ASCII white space; all words of trusted text are known, each by a 32-bit hash. Under the bigrams stand the numbers of distinct words
before a word, and under these a byte model of the same kind that spells words, so any text has a probability. Counts are joined by shards, which
are ranges of hashed pairs and of words. A task turns a block of documents into its distinct pairs and words, sorted, and asks each shard for
its part of them; the shard's task holds the counts of its range and answers in their order; answers meet with the block's words,
which travel as places in its own word list. What is held at once is a block, an answer, and one shard's counts; what comes to the driver are
totals, 65,536 byte pairs and the ids of no more than MANY_WORDS words. A block is named by its
input partition and number there, so a task that runs again gives the same; documents must come from files or a written table, whose
rows keep their order. Neither shards nor blocks show in the results.

Pairs are compared by all 64 bits of their words' ids, so neither the size of the input nor its plan shows in a result. Where the trusted words are no more than MANY_WORDS, their ids
go to all tasks with their counts, ranked by frequency: nothing is asked about words, nor about pairs with others, as the answers would be 0, and pairs travel as two ranks, which are small numbers. That spares traffic and changes nothing.

Trusted documents are those labelled good (quality 1, toxic 0). One in HELD_OUT of them, by hash of doc_id, only sets
thresholds: each language's quantile of their perplexities, from exact counts by thousandths of its logarithm; a
language without any gets the quantile over all. Without trusted documents everything is kept.

Null texts count as empty and are scored by their end alone; a null lang is a language of its own; repeated rows score
alike; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lumenry.llm.common import ids_sent, settle, text_of, with_workers

U = np.uint64
BEGIN, END = 0, 1
#: Bits of a pair's key: both words' ids, mixed so that shards are even.
PAIR_BITS = 64
#: Tokens and documents of a block, at most but for its last document.
BLOCK_TOKENS, BLOCK_DOCS = 1 << 22, 1 << 17
#: Log probabilities of bytes are whole parts of one.
FINE = 250
#: Trusted words that are sent to all tasks with their ranks and counts (13 bytes each, and 16 for each count above 254).
MANY_WORDS = 1 << 22
HELD_OUT, QUANTILE, COARSE = 5, 0.995, 256


# --- packing -------------------------------------------------------------------------------------


def _pack(*columns: np.ndarray, rising: bool = True, level: int | None = None) -> bytes:
    """Columns of whole numbers, the first as differences if it rises, compressed by byte planes, each ordered by the plane above it: bytes of small numbers stand together."""
    parts = [len(columns[0]).to_bytes(8, "little")]
    for k, c in enumerate(columns):
        c = np.diff(c.astype("<u8"), prepend=U(0)) if rising and k == 0 else c.astype("<u8")
        planes = max(1, (int(c.max()).bit_length() + 7) // 8) if len(c) else 1
        own = c.view(np.uint8).reshape(-1, 8)[:, :planes].T
        parts += [bytes([planes]), own[-1].tobytes(), *(own[p][np.argsort(own[p + 1], kind="stable")].tobytes() for p in range(planes - 2, -1, -1))]
    return zstandard.compress(b"".join(parts), level or (3 if rising else 9))


def _unpack(payload: bytes, rising: bool = True) -> list[np.ndarray]:
    raw = zstandard.decompress(payload)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    while at < len(raw):
        planes = raw[at]
        c = np.zeros((n, 8), np.uint8)
        for k, p in enumerate(range(planes - 1, -1, -1)):
            own = np.frombuffer(raw, np.uint8, n, at + 1 + k * n)
            c[slice(None) if k == 0 else np.argsort(c[:, p + 1], kind="stable"), p] = own
        c = c.view("<u8").reshape(-1)
        out.append(np.cumsum(c, dtype=U) if rising and not out else c)
        at += 1 + n * planes
    return out


def _runs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The second of sorted pairs as the difference from the one before, where both have the same first."""
    same = np.r_[False, first[1:] == first[:-1]][: len(first)]
    return np.where(same, second - np.r_[U(0), second[:-1]][: len(second)], second)


def _out_of_runs(first: np.ndarray, runs: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(np.r_[True, first[1:] != first[:-1]][: len(first)])
    summed = np.cumsum(runs, dtype=U)
    return summed - np.repeat(np.r_[U(0), summed[at[1:] - 1]][: len(at)], np.diff(np.r_[at, len(first)]))


def _narrow(column: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A column in bytes, and the places and values of what is 255 or more."""
    at = np.flatnonzero(column >= U(255))
    return np.minimum(column, U(255)).astype(np.uint8), at, column[at]


def _bounds(bits: int, shards: int) -> np.ndarray:
    """The least value of each shard; shards are equal ranges of values of so many bits."""
    return np.array([-(-(s << bits) // shards) for s in range(shards)], U)


def _cuts(values: np.ndarray, bits: int, shards: int) -> list[int]:
    """Where the sorted values part into shards."""
    return [*np.searchsorted(values, _bounds(bits, shards), "left").tolist(), len(values)]


def pair_key(pairs: np.ndarray, bits: int) -> np.ndarray:
    """The leading bits of a mix of pairs of words (first << 32 | second), which is bijective over all 64."""
    x = pairs.astype(U)
    for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> U(31))) * U(m)
    return (x ^ (x >> U(29))) >> U(64 - bits)


def _looked_up(keys: np.ndarray, columns: list[np.ndarray], asked: np.ndarray) -> list[np.ndarray]:
    """The columns at the asked keys, 0 where a key isn't there."""
    if not len(keys):
        return [np.zeros(len(asked), U) for _ in columns]
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    there = keys[at] == asked
    return [np.where(there, c[at], U(0)) for c in columns]


# --- estimation ----------------------------------------------------------------------------------


def discounts(n: list[int]) -> np.ndarray:
    """D(0), D1, D2, D3+ from the numbers of types seen once to four times; halves where a class is empty."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not n1 or not n2:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    return np.array([0.0, np.clip(1 - 2 * y * n2 / n1, 0.01, 0.99), np.clip(2 - 3 * y * n3 / n2, 0.01, 1.99), np.clip(3 - 4 * y * n4 / n3, 0.01, 2.99) if n3 else 1.0])


def _classes(counts: np.ndarray, upto: int = 4) -> list[int]:
    return [int((counts == k).sum()) for k in range(1, upto + 1)]


def spelling(counts: np.ndarray) -> np.ndarray:
    """Log probabilities (256 x 256) of a byte after another, from the counts of byte pairs in words; byte 32 ends a word."""
    c = counts.reshape(256, 256).astype(np.float64)
    d, total = discounts(_classes(c)), c.sum(axis=1)
    backoff = np.where(total > 0, (d[1] * (c == 1).sum(axis=1) + d[2] * (c == 2).sum(axis=1) + d[3] * (c > 2).sum(axis=1)) / np.maximum(total, 1), 1.0)
    before = (c > 0).sum(axis=0)
    lower = np.full(256, 1 / 256)
    if before.sum():
        e = discounts(_classes(before))[np.minimum(before, 3)]
        lower = np.maximum(before - e, 0) / before.sum() + e.sum() / before.sum() / 256
    return np.log(np.maximum(c - d[np.minimum(c, 3).astype(int)], 0) / np.maximum(total, 1)[:, None] + backoff[:, None] * lower)


@dataclass
class Model:
    """What holds for all words: discounts of pairs and of words, the number of types of pairs, and the log probabilities of bytes."""

    pairs: np.ndarray
    words: np.ndarray
    types: int
    rest: float
    letters: np.ndarray
    #: The ids of trusted words in order, and the rank of each by how often it comes; None where they are too many.
    ids: np.ndarray | None = None
    rank: np.ndarray | None = None
    #: With ids, the columns of count_words in their order, narrow.
    stats: list[tuple] | None = None

    def known(self, ids: np.ndarray) -> np.ndarray:
        """Whether words may occur in trusted text."""
        if self.ids is None:
            return np.ones(len(ids), bool)
        return self.ids[np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)] == ids if len(self.ids) else np.zeros(len(ids), bool)

    def halves(self, pairs: np.ndarray) -> list[np.ndarray]:
        """Both words of pairs, by rank where there are ranks: frequent words have small numbers, which travel in few bits."""
        own = [pairs >> U(32), pairs & U(0xFFFFFFFF)]
        return [self.names(x.astype(np.uint32)).astype(U) for x in own]

    @cached_property
    def by_rank(self) -> np.ndarray:
        out = np.empty(len(self.ids), np.uint32)
        out[self.rank] = self.ids
        return out

    def of_words(self, ids: np.ndarray) -> np.ndarray:
        """The columns of count_words at known ids."""
        at, out = np.searchsorted(self.ids, ids), np.zeros((len(self.stats), len(ids)), U)
        for row, (low, places, values) in zip(out, self.stats, strict=True):
            row[:] = low[at]
            more = row == 255
            row[more] = values[np.searchsorted(places, at[more])]
        return out

    def names(self, ids: np.ndarray) -> np.ndarray:
        """Known ids as they travel: by rank where there are ranks."""
        return ids if self.ids is None else self.rank[np.searchsorted(self.ids, ids)]

    def named(self, names: np.ndarray) -> np.ndarray:
        return names if self.ids is None else self.by_rank[names.astype(np.int64)]

    def spelled(self, words: list[bytes]) -> np.ndarray:
        """The log probability of each word by its bytes."""
        raw = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
        ends = np.cumsum([len(w) + 1 for w in words])
        return np.add.reduceat(self.letters[raw[:-1], raw[1:]], np.r_[0, ends[:-1]]) if words else np.zeros(0)

    def lower(self, before: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """The probability of words by the numbers of words before them."""
        if not self.types:
            return np.exp(spelled)
        b = before.astype(np.float64)
        return np.maximum(b - self.words[np.minimum(before, U(3)).astype(int)], 0) / self.types + self.rest * np.exp(spelled)

    def backoff(self, total: np.ndarray, once: np.ndarray, twice: np.ndarray, more: np.ndarray) -> np.ndarray:
        _, d1, d2, d3 = self.pairs
        return np.where(total > 0, (d1 * once + d2 * twice + d3 * more) / np.maximum(total, U(1)), 1.0)

    def log_probability(self, count: np.ndarray, total: np.ndarray, backoff: np.ndarray, lower: np.ndarray) -> np.ndarray:
        seen = np.maximum(count - self.pairs[np.minimum(count, U(3)).astype(int)], 0) / np.maximum(total, U(1))
        return np.log(seen + backoff * lower)


# --- documents to blocks -------------------------------------------------------------------------


class Block:
    """Documents until so many tokens. Their words are places in the block's list of words, in the order in which they first come; 0 and 1 begin and end a document."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.places: dict[bytes, int] = defaultdict(count(END + 1).__next__)
        self.docs: list[np.ndarray] = []
        self.tokens = 0

    def add(self, row: tuple, text: str) -> None:
        words = text.encode("utf-8", "replace").split()
        self.docs.append(np.fromiter(map(self.places.__getitem__, words), np.uint32, len(words)))
        self.rows.append((*row, len(words)))
        self.tokens += len(words) + 1

    def clear(self) -> None:
        """Lets go of documents and words, where ids and sequence are all that is needed."""
        self.docs.clear()
        self.places.clear()

    def words(self) -> list[bytes]:
        return list(self.places)

    def ranked(self) -> tuple[np.ndarray, np.ndarray]:
        """The sequence with new places, and the old one of each: words by how often they come, then those that come once, as they come. In the sequence 1 stands for each of these."""
        sequence = self.sequence()
        times = np.bincount(sequence, minlength=len(self.places) + 2)
        once = times == 1
        once[: END + 1] = False
        several = END + 1 + np.flatnonzero(~once[END + 1 :])
        several = several[np.argsort(-times[several], kind="stable")]
        old = np.r_[BEGIN, END, several, np.flatnonzero(once)]
        new = np.empty(len(old), np.uint32)
        new[old] = np.arange(len(old), dtype=np.uint32)
        return np.where(once[sequence], np.uint32(END), new[sequence]), old

    def ids(self) -> np.ndarray:
        """The id of each place."""
        hashed = np.fromiter(map(xxhash.xxh32_intdigest, self.places), np.uint32, len(self.places))
        return np.r_[np.array([BEGIN, END], np.uint32), np.maximum(hashed, np.uint32(END + 1))]

    def sequence(self) -> np.ndarray:
        """Places of all documents: each begins with 0, and its end is told by the next 0."""
        return np.concatenate([x for d in self.docs for x in (np.zeros(1, np.uint32), d)]) if self.docs else np.zeros(0, np.uint32)


def restored(short: np.ndarray, places: int) -> np.ndarray:
    """The sequence that Block.ranked() shortened."""
    out = short.astype(np.int64)
    once = np.flatnonzero(out == END)
    out[once] = places - len(once) + np.arange(len(once))
    return out


def pairs_of(sequence: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The pairs of each position of a block's sequence: a word and the next one, or a document's last and its end."""
    second = np.r_[sequence[1:], np.uint32(BEGIN)]
    second = np.where(second == BEGIN, np.uint32(END), second)
    out = ids[sequence].astype(U)
    out <<= U(32)
    out |= ids[second]
    return out


def _blocks(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[Block]:
    """Blocks of the rows (..., text)."""
    block = Block()
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            block.add(row[:-1], row[-1])
            if block.tokens >= tokens or len(block.rows) >= BLOCK_DOCS:
                yield block
                block = Block()
    if block.rows:
        yield block


def _merged(held: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Distinct keys, sorted, and the sums of the columns beside them."""
    keys, places = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
    out = [keys]
    for k in range(1, len(held[0])):
        c = np.zeros(len(keys), U)
        np.add.at(c, places, np.concatenate([h[k] for h in held]))
        out.append(c)
    return out


class _Sums:
    """Sums by key of payloads that come one after another; holds about twice the distinct keys."""

    def __init__(self) -> None:
        self.held: list[list[np.ndarray]] = []
        self.weight = 0

    def add(self, columns: list[np.ndarray]) -> None:
        self.held.append(columns)
        self.weight += len(columns[0])
        if len(self.held) > 1 and self.weight > 2 * len(self.held[0][0]) + (1 << 20):
            self.held = [self.whole()]
            self.weight = len(self.held[0][0])

    def whole(self) -> list[np.ndarray]:
        return _merged(self.held)


# --- training ------------------------------------------------------------------------------------

PAIRS, WORDS, LETTERS, ASKED, HEADER, ANSWER = range(6)
_PACKED = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("what", T.IntegerType()), T.StructField("payload", T.BinaryType()), T.StructField("types", T.ArrayType(T.LongType()))])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], _PACKED.names)


def _parted(what: int, columns: list[np.ndarray], by: np.ndarray, bits: int, shards: int) -> list[tuple]:
    """Payloads of the columns for each shard of the sorted values `by` that has any."""
    cuts = _cuts(by, bits, shards)
    return [(s, what, _pack(*(c[a:z] for c in columns)), None) for s, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if z > a]


def dealt(df: DataFrame, shards: int, by: str = "shard", *order: str) -> DataFrame:
    """Each shard in the partition of its number."""
    return df.repartitionById(shards, F.col(by)).sortWithinPartitions(by, *order)


def _merging(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(shard, what, sums) of each run of rows."""
    now, sums = None, _Sums()
    for b in batches:
        for shard, what, payload in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            if (shard, what) != now:
                if now is not None:
                    yield *now, sums.whole()
                now, sums = (shard, what), _Sums()
            sums.add(_unpack(payload))
    if now is not None:
        yield *now, sums.whole()


def count_pairs(trusted: DataFrame, shards: int, bits: int, tokens: int) -> DataFrame:
    """What trusted (text) holds, packed by shard of the pair's hash: PAIRS (pair, times), WORDS in parts (word; tokens after it, types after it seen once, twice and more, types before it), LETTERS (byte pair, times); settled."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = np.zeros(1 << 16, np.int64)
        for block in _blocks(batches, tokens):
            sequence, words = block.sequence(), block.words()
            times = np.bincount(sequence, minlength=len(block.places) + 2)[2:]
            raw = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.int64)
            if words:
                letters += np.bincount(raw[:-1] * 256 + raw[1:], np.repeat(times, [len(w) + 1 for w in words]), 1 << 16).astype(np.int64)
            pairs, times = np.unique(pairs_of(sequence, block.ids()), return_counts=True)
            shard = np.searchsorted(_bounds(bits, shards), pair_key(pairs, bits), "right") - 1
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            yield _rows([(s, PAIRS, _pack(pairs[mine], times[mine]), None) for s in range(shards) if len(mine := order[cuts[s] : cuts[s + 1]])])
        at = np.flatnonzero(letters)
        if len(at):
            yield _rows(_parted(LETTERS, [at, letters[at]], at.astype(U), 16, shards))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, what, (keys, c) in _merging(batches):
            if what == LETTERS:
                yield _rows([(shard, what, _pack(keys, c), None)])
                continue
            first, second, ones = keys >> U(32), keys & U(0xFFFFFFFF), np.ones(len(keys), U)
            none = np.zeros(len(keys), U)
            after = [first, c, *((m).astype(U) for m in (c == 1, c == 2, c > 2)), none]
            words = _merged([after, [second, none, none, none, none, ones]])
            yield _rows([(shard, PAIRS, _pack(keys, c), _classes(c)), *_parted(WORDS, words, words[0], 32, shards)])

    return settle(dealt(trusted.select("text").mapInArrow(emit, _PACKED), shards, "shard", "what").mapInArrow(merge, _PACKED))


def count_words(counted: DataFrame, shards: int) -> DataFrame:
    """WORDS of count_pairs in one payload a shard, with the numbers of words by types before them (1 to 4) and all these types; settled."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, what, words in _merging(batches):
            yield _rows([(shard, what, _pack(*words), [*_classes(words[5]), int(words[5].sum()), int((words[5] > 2).sum()), len(words[0])])])

    return settle(dealt(counted.where(F.col("what") == WORDS), shards).mapInArrow(merge, _PACKED))


def fit(counted: DataFrame, words: DataFrame) -> Model:
    """The totals of all shards; a row for each shard has byte pairs, 65,536 at most in all."""
    sums = lambda df, n: [df.agg(*[F.sum(F.get("types", F.lit(k))) for k in range(n)]).first()[k] or 0 for k in range(n)]
    of_pairs = sums(counted.where(F.col("what") == PAIRS), 4)
    *of_words, types, more, n_words = sums(words, 7)
    letters = np.zeros(1 << 16, np.int64)
    for r in counted.where(F.col("what") == LETTERS).select("payload").toLocalIterator():
        at, c = _unpack(r["payload"])
        letters[at.astype(np.int64)] += c.astype(np.int64)
    e = discounts(of_words)
    rest = float(e[1] * of_words[0] + e[2] * of_words[1] + e[3] * more) / types if types else 1.0
    return Model(discounts(of_pairs), e, types, rest, spelling(letters), *(_ranked(words) if n_words <= MANY_WORDS else ()))


def _ranked(words: DataFrame) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """The ids of no more than MANY_WORDS words in order, their ranks by the tokens after them, and their columns, narrow; a row for each shard comes to the driver."""
    found = [(c[0].astype(np.uint32), c[1], [_narrow(x) for x in c[1:]]) for r in words.select("payload").toLocalIterator() for c in [_unpack(r["payload"])]]
    found.sort(key=lambda x: int(x[0][0]))  # shards are ranges of ids
    ids = np.concatenate([x[0] for x in found]) if found else np.zeros(0, np.uint32)
    times = np.concatenate([x[1] for x in found]) if found else np.zeros(0, U)
    starts = np.cumsum([0, *(len(x[0]) for x in found)])
    stats = [tuple(np.concatenate(x) for x in zip(*((low, at + start, values) for (low, at, values), start in zip((f[2][k] for f in found), starts[:-1], strict=True)), strict=True)) for k in range(5 if found else 0)]
    rank = np.empty(len(ids), np.uint32)
    rank[np.lexsort((ids, -times.astype(np.int64)))] = np.arange(len(ids), dtype=np.uint32)
    return ids, rank, stats or [_narrow(np.zeros(0, U))] * 5


# --- scoring -------------------------------------------------------------------------------------


def score(docs: DataFrame, counted: DataFrame, words: DataFrame, model: Model, shards: int, bits: int, tokens: int) -> DataFrame:
    """(doc_id, lang, n_words, perplexity) of every row, settled; perplexity is by word, its end included."""
    kind = docs.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    integer, long, binary = T.IntegerType(), T.LongType(), T.BinaryType()
    fields = [T.StructField(n, t) for n, t in (("shard", integer), ("what", integer), ("block", long), ("home", integer), ("payload", binary), ("words", binary))]
    schema = T.StructType([*fields, T.StructField("ids", T.ArrayType(kind)), T.StructField("langs", T.ArrayType(T.StringType())), T.StructField("sizes", T.ArrayType(long))])
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(id_type), pa.list_(pa.string()), pa.list_(pa.int64())]
    sent, words_asked = docs.sparkSession.sparkContext.broadcast(model), model.ids is None

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] if k < len(r) else None for r in rows], t) for k, t in enumerate(types)], schema.names)

    def asked(sequence: np.ndarray, ids: np.ndarray, known: np.ndarray, places: bool = True) -> tuple[np.ndarray, tuple, tuple]:
        """Positions whose pair is asked about; of these pairs their halves and shards, and of each position the place of its pair, if `places`; (values, places) of the known words. All in the order in which shards answer."""
        model = sent.value
        names = np.zeros(len(ids), np.uint32)
        names[known] = model.names(ids[known])
        second = np.r_[sequence[1:], np.uint32(BEGIN)]
        at = np.flatnonzero(known[sequence] & known[np.where(second == BEGIN, np.uint32(END), second)])
        pairs, place = np.unique(pairs_of(sequence, names)[at], return_inverse=True) if places else (np.unique(pairs_of(sequence, names)[at]), slice(0))
        halves = [pairs >> U(32), pairs & U(0xFFFFFFFF)]
        key = pair_key(model.named(halves[0]).astype(U) << U(32) | model.named(halves[1]).astype(U), bits)
        shard = np.searchsorted(_bounds(bits, shards), key, "right") - 1
        order = np.argsort(shard.astype(np.uint16 if shards <= 1 << 16 else np.uint32), kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return at, ([h[order] for h in halves], shard[order], back[place]), np.unique(ids[known], return_inverse=True)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, Block]]:
        of = TaskContext.get().partitionId()  # documents are the first part of the unions below
        for k, block in enumerate(_blocks(batches, tokens)):
            yield (of << 24) + k, (of * 7919 + k) % shards, block

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for name, home, block in named(batches):
            spelled = np.r_[0.0, model.letters[32, 32], model.spelled(block.words())]  # the end is the word without letters
            sequence, old = block.ranked()
            ids = block.ids()[old]
            known = model.known(ids)
            first = _pack(2 * np.round(-FINE * spelled[old]).astype(np.int64) + known, rising=False)
            words = len(first).to_bytes(8, "little") + first + _pack(model.names(ids[known]), rising=False)
            yield batch([(home, HEADER, name, home, _pack(sequence, rising=False), words, *(list(c) for c in zip(*block.rows, strict=True)))])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, home, block in named(batches):
            ids, sequence = block.ids(), block.sequence()
            block.clear()
            _, (halves, shard, _), (own, _) = asked(sequence, ids, sent.value.known(ids), places=False)
            own = own if words_asked else own[:0]  # else the model has what there is to know about them
            p, w = np.searchsorted(shard, np.arange(shards + 1)), _cuts(own.astype(U), 32, shards)
            pairs = lambda s: packed_pairs(*(h[p[s] : p[s + 1]] for h in halves))
            yield batch([(s, ASKED, name, home, pairs(s), _pack(own[w[s] : w[s + 1]]) if words_asked else None) for s in range(shards) if p[s + 1] > p[s] or w[s + 1] > w[s]])

    def by_halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counted pairs in the order in which they are asked about."""
        for b in batches:
            for shard, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                pairs, times = _unpack(payload)
                halves = sent.value.halves(pairs)
                order = np.argsort(halves[0] << U(32) | halves[1])
                yield batch([(shard, PAIRS, -1, None, packed_pairs(*(c[order] for c in (*halves, times))))])

    def packed_pairs(first: np.ndarray, second: np.ndarray, *more: np.ndarray) -> bytes:
        return _pack(first, _runs(first, second), *more, level=9)

    def opened_pairs(payload: bytes) -> list[np.ndarray]:
        first, runs, *more = _unpack(payload)
        return [first << U(32) | _out_of_runs(first, runs), *more]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = [np.zeros(0, U)] * 6
        pairs, own = nothing[:2], nothing  # pairs of ranks where there are ranks, as they are asked about
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[1] == PAIRS:
                    pairs = opened_pairs(row[4])
                elif row[1] == WORDS:
                    own = _unpack(row[4])
                else:
                    shard, _, name, home, p, w = row[:6]
                    of_words = _pack(*_looked_up(own[0], own[1:], _unpack(w)[0]), rising=False) if words_asked else None
                    yield batch([(shard, ANSWER, name, home, _pack(*_looked_up(pairs[0], pairs[1:], *opened_pairs(p)), rising=False), of_words)])

    out = T.StructType([T.StructField("doc_id", kind), T.StructField("lang", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("perplexity", T.DoubleType())])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, answers, model = None, [], sent.value

        def done() -> pa.RecordBatch:
            cut = 8 + int.from_bytes(head[5][:8], "little")
            spelled = _unpack(head[5][8:cut], rising=False)[0]
            known, spelled = spelled % U(2) > 0, (spelled // U(2)).astype(np.float64) / -FINE
            sequence = restored(_unpack(head[4], rising=False)[0], len(known))
            ids = np.zeros(len(known), np.uint32)
            ids[known] = model.named(_unpack(head[5][cut:], rising=False)[0])
            at, (_, _, of_pair), (_, of_word) = asked(sequence, ids, known)
            count, stats = np.zeros(len(sequence), U), np.zeros((5, len(ids)), U)
            if answers:
                count[at] = np.concatenate([_unpack(p, rising=False)[0] for p, _ in answers])[of_pair]
            if not words_asked:
                stats[:, known] = model.of_words(ids[known])
            elif answers:
                stats[:, known] = [np.concatenate(c)[of_word] for c in zip(*(_unpack(w, rising=False) for _, w in answers), strict=True)]
            total, once, twice, more, before = stats
            lower, backoff = model.lower(before, spelled), model.backoff(total, once, twice, more)
            second = np.r_[sequence[1:], BEGIN]
            second[second == BEGIN] = END
            logs = model.log_probability(count, total[sequence], backoff[sequence], lower[second])
            sums = np.add.reduceat(logs, np.flatnonzero(sequence == BEGIN))
            perplexity = np.round(np.exp(-sums / (np.array(head[8]) + 1)), 4)
            return pa.RecordBatch.from_arrays([pa.array(head[6], id_type), pa.array(head[7], pa.string()), pa.array(head[8], pa.int64()), pa.array(perplexity)], out.names)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[1] == HEADER:
                    if head is not None:
                        yield done()
                    head, answers = row, []
                else:
                    answers.append((row[4], row[5]))
        if head is not None:
            yield done()

    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    tables = counted.where(F.col("what") == PAIRS).select("shard", "payload").mapInArrow(by_halves, schema)
    if words_asked:
        tables = tables.unionByName(words.select("shard", "what", F.lit(-1).cast("long").alias("block"), none[3], "payload", *none[5:]))
    # Documents are read twice, once for what is asked and once for what the answers meet: only the answers move twice.
    own = docs.select("doc_id", "lang", "text")
    answers = dealt(own.mapInArrow(ask, schema).unionByName(tables), shards, "shard", "what", "block").mapInArrow(answer, schema)
    return settle(dealt(own.mapInArrow(heads, schema).unionByName(answers), shards, "home", "block", "what", "shard").mapInArrow(add_up, out))


def thresholds(scored: DataFrame, held: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(lang, most): the logarithmic bin of each language's quantile over held-out trusted documents; lang `*all*` for all of them."""
    bins = scored.join(held, "doc_id", "left_semi").select("lang", _bin().alias("bin"))
    both = bins.select(F.struct(F.lit(False).alias("every"), "lang").alias("of"), "bin").unionByName(bins.select(F.struct(F.lit(True).alias("every"), F.lit(None).cast("string").alias("lang")).alias("of"), "bin"))
    counts = settle(both.groupBy("of", "bin").agg(F.count("*").alias("n")).withColumn("coarse", F.floor(F.col("bin") / COARSE)))
    # First the run of COARSE bins that holds the quantile, then the bin in it: no task looks at all bins of a language.
    running = lambda by: F.sum("n").over(Window.partitionBy("of").orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    runs = counts.groupBy("of", "coarse").agg(F.sum("n").alias("n"))
    runs = runs.withColumns({"upto": running("coarse"), "whole": F.sum("n").over(Window.partitionBy("of"))}).where(F.col("upto") >= F.lit(quantile) * F.col("whole"))
    held_in = runs.groupBy("of").agg(F.min(F.struct("coarse", (F.col("upto") - F.col("n")).alias("below"), "whole")).alias("r")).select("of", "r.*")
    inside = counts.join(held_in, ["of", "coarse"]).withColumn("upto", F.col("below") + running("bin")).where(F.col("upto") >= F.lit(quantile) * F.col("whole"))
    return inside.groupBy("of").agg(F.min("bin").alias("most")).select("of.every", "of.lang", "most")


def _bin():
    return F.floor(F.log(F.greatest(F.col("perplexity"), F.lit(1e-9))) * 1000)


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, shards: int | None = None, tokens: int | None = None) -> DataFrame:
    """Per row of docs: doc_id, lang, n_words, perplexity, threshold (of its language; null if nothing is trusted), kept."""
    spark = docs.sparkSession
    with_workers(spark)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tokens = tokens or BLOCK_TOKENS
    own = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), text_of().alias("text"))
    ids = settle(labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct())
    is_held = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
    training = ids_sent(ids.where(~is_held))
    counted = count_pairs(own.join(training, "doc_id", "left_semi"), shards, PAIR_BITS, tokens)
    words = count_words(counted, shards)
    scored = score(own, counted, words, fit(counted, words), shards, PAIR_BITS, tokens)
    limits = settle(thresholds(scored, ids.where(is_held), quantile))
    every = limits.where("every").select("most").first()
    all_most = F.lit(every["most"] if every else None).cast("long")
    limits = limits.where("not every").select(F.col("lang").alias("l"), F.col("most").cast("long").alias("most"))
    out = scored.join(limits, F.col("lang").eqNullSafe(F.col("l")), "left").withColumn("most", F.coalesce("most", all_most))
    return out.select("doc_id", "lang", "n_words", "perplexity", F.round(F.exp((F.col("most") + 1) / 1000), 4).alias("threshold"), F.coalesce(_bin() <= F.col("most"), F.lit(True)).alias("kept"))
