"""Byte-level BPE: exact merges by backtracking over longest matches.

Bytes are read as Latin-1 characters, so that a pyahocorasick trie over the vocabulary can find the longest token
at a place. An encoding is exact if every adjacent pair of tokens is: a pair fits if merging never prefers another
cut across its boundary. The encoder takes longest matches, steps back to shorter ones where a pair doesn't fit,
and never visits a place again that has led nowhere, so time is linear in a piece. Pair checks are memoised, and
whole pieces are remembered per worker up to a bound.

Null texts count as empty and give no ids; texts of any length are encoded whole; repeated rows give equal rows; an
empty table gives an empty result. `encode_table` keeps all input columns and replaces those it makes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lumenry.llm.common import with_workers

#: Pieces remembered per worker, and the longest piece that is.
REMEMBERED, REMEMBERED_BYTES = 400_000, 64


class Codec:
    """Encodes and decodes by the ranks of one vocabulary file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.longest = max(map(len, ranks))
        self.bytes_of: list[bytes] = [b""] * self.size
        for b, i in ranks.items():
            self.bytes_of[i] = b
        self.pieces = regex.compile(pattern).findall
        self.seen: dict[str, bytes] = {}
        self._split()
        self._match()

    def _split(self) -> None:
        """halves[t]: the two tokens whose merge makes t last; (t, t) if t is one byte; None if merging never makes t."""
        self.halves: list[tuple[int, int] | None] = [None] * self.size
        self.made: dict[tuple[int, int], int] = {}
        for b, t in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(b) == 1:
                self.halves[t] = (t, t)
            elif len(parts := self._merged(b, t)) == 2:
                self.halves[t] = (parts[0], parts[1])
                self.made[parts[0], parts[1]] = t

    def _merged(self, b: bytes, below: int) -> list[int]:
        """Plain merging of b by ranks under `below`; for the table only."""
        ranks, parts = self.ranks, [b[i : i + 1] for i in range(len(b))]
        while len(parts) > 1:
            r, k = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if r >= below:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [ranks[x] for x in parts]

    def _match(self) -> None:
        """The trie of reachable tokens, and for each token the next shorter one that begins it (-1: none)."""
        self.trie = ahocorasick.Automaton()
        for b, t in self.ranks.items():
            if self.halves[t] is not None:
                self.trie.add_word(b.decode("latin-1"), t)
        self.shorter = [-1] * self.size
        for b, t in self.ranks.items():
            if self.halves[t] is not None and len(b) > 1:
                head = self.trie.longest_prefix(s := b[:-1].decode("latin-1"))
                while head and not self.trie.exists(s[:head]):
                    head -= 1
                self.shorter[t] = self.trie.get(s[:head]) if head else -1
        self.trie.make_automaton()
        self.fits = lru_cache(maxsize=1 << 20)(self._fits)

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both ends with exactly these two tokens.

        Undoes the later merge of the two, again and again, and asks whether the tokens then at the boundary would
        have merged with each other before.
        """
        limit = self.size + 1
        while True:
            if self.made.get((left, right), limit) < limit:
                return False
            undo_left = left > right
            for side in (undo_left, not undo_left):
                if side and self.halves[left][1] != left:
                    limit, left = left, self.halves[left][1]
                    break
                if not side and self.halves[right][0] != right:
                    limit, right = right + 1, self.halves[right][0]
                    break
            else:
                return True

    def _longest(self, s: str, at: int) -> int:
        end = at + self.trie.longest_prefix(s[at : at + self.longest]) if at < len(s) else at
        while end > at:
            t = self.trie.get(s[at:end], -1)
            if t >= 0:
                return t
            end -= 1
        return -1

    def encode_piece(self, b: bytes) -> list[int]:
        """The ids of one piece."""
        whole = self.ranks.get(b)
        if whole is not None:
            return [whole]
        s, sizes, fits, shorter = b.decode("latin-1"), self.bytes_of, self.fits, self.shorter
        dead = bytearray(len(b) + 1)
        out: list[int] = []
        at, token = 0, self._longest(s, 0)
        while at < len(b):
            last = out[-1] if out else -1
            while token >= 0 and (dead[at + len(sizes[token])] or (last >= 0 and not fits(last, token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += len(sizes[token])
                token = self._longest(s, at)
            else:
                dead[at] = 1
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                out.pop()
                at -= len(sizes[last])
                token = shorter[last]
        return out

    def _piece(self, p: str) -> bytes:
        ids = np.asarray(self.encode_piece(p.encode("utf-8", "surrogatepass")), "<u4").tobytes()
        if len(p) <= REMEMBERED_BYTES:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[p] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        get, piece = self.seen.get, self._piece
        return b"".join([get(p) or piece(p) for p in self.pieces(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file (base64 token, space, rank per line), once per process."""
    with open(path, "rb") as f:
        return Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    """Path and piece pattern of one of the machine's public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def encode_table(docs: DataFrame, path: str, pattern: str, text: str = "text", keep_ids: bool = True, digests: bool = False) -> DataFrame:
    """docs with `ids` (binary, 4 bytes each; keep_ids) or digests (n_tokens, ids_sha256, decoded_sha256) for the text.

    The path must be readable on every executor. One Arrow batch at a time is in memory.
    """
    with_workers(docs.sparkSession)
    fields = [T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField("ids", T.BinaryType())] * keep_ids
    fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] * digests
    made = {f.name for f in fields}
    keep = [c for c in docs.columns if c not in made and (keep_ids or c != text)]
    schema = T.StructType([docs.schema[c] for c in keep] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            counts, ids, first, second = [], [], [], []
            for x in batch.column(batch.schema.get_field_index(text)):
                e = own.encode(x.as_py() or "")
                counts.append(len(e) // 4)
                if keep_ids:
                    ids.append(e)
                if digests:
                    first.append(hashlib.sha256(e).hexdigest())
                    second.append(hashlib.sha256(own.decode(e)).hexdigest())
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(counts, pa.int64())]
            cols += [pa.array(ids, pa.binary())] * keep_ids + [pa.array(first, pa.string()), pa.array(second, pa.string())] * digests
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in schema.fields])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
