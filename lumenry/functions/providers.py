"""Models behind small protocols, with offline defaults that always give the same.

An encoder turns texts into unit vectors, a detector tells German, a tokenizer counts tokens, a batch client talks to a remote service.
Real models are passed in by the caller; each is made once per Python worker by its factory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Encoder(Protocol):
    def __call__(self, texts: list[str]) -> np.ndarray: ...


class Detector(Protocol):
    def __call__(self, text: str) -> str: ...


class Classifier(Protocol):
    def __call__(self, sentence: str, most_tokens: int) -> str: ...


class BatchClient(Protocol):
    """What the engine asks of a remote batch service; jobs are dicts as in sources.jobs.JOBS."""

    def submit(self, lines: list[str], key: str) -> dict:
        """A job of these lines; the same key gives the same job again."""
        ...

    def jobs(self, limit: int) -> list[dict]: ...
    def job(self, job_id: str) -> dict | None: ...
    def output(self, file_id: str) -> bytes: ...


def hashing_encoder(dimensions: int = 64) -> Callable[[], Encoder]:
    """Letters in threes, hashed to signed dimensions; texts that share letters are alike."""

    def make() -> Encoder:
        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dimensions), np.float64)
            for row, text in zip(out, texts, strict=True):
                padded = f"  {text.lower()}  "
                for k in range(len(padded) - 2):
                    h = int.from_bytes(hashlib.blake2b(padded[k : k + 3].encode(), digest_size=8).digest(), "little")
                    row[h % dimensions] += 1 if h >> 63 else -1
            return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

        return encode

    return make


#: Words by which the offline detector tells German from the other languages.
GERMAN = frozenset("der die das und ist nicht ein eine mit von zu den im auf für sich auch wir werden".split())
OTHERS = frozenset("the and of to in is that for with le la les des et un une que de el los en y".split())


def word_detector() -> Callable[[], Detector]:
    def make() -> Detector:
        def detect(text: str) -> str:
            words = re.findall(r"\w+", text.lower())
            german, other = sum(w in GERMAN for w in words), sum(w in OTHERS for w in words)
            return "de" if german > other else "xx"

        return detect

    return make


def piece_counter() -> Callable[[], Callable[[str], int]]:
    """Counts pieces of up to six letters or digits, and signs: no tokenizer's count, but near one."""
    return lambda: lambda text: len(re.findall(r"\w{1,6}|[^\w\s]", text))


def rank_file_counter(path: str, pattern: str) -> Callable[[], Callable[[str], int]]:
    """Counts by a BPE rank file that every executor can read."""

    def make() -> Callable[[str], int]:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(encoding.encode_ordinary(text))

    return make


#: Fixed value: the encoding of last resort.
DEFAULT_ENCODING = "cl100k_base"


def named_counter(name: str) -> Callable[[], Callable[[str], int]]:
    """Counts by an encoding's name, else by the encoding of a model of that name, else by the default encoding."""

    def make() -> Callable[[str], int]:
        import tiktoken

        for find, what in ((tiktoken.get_encoding, name), (tiktoken.encoding_for_model, name), (tiktoken.get_encoding, DEFAULT_ENCODING)):
            try:
                encoding = find(what)
                break
            except (KeyError, ValueError):
                continue
        else:
            raise ValueError(f"no encoding {name}, and no default one")
        return lambda text: len(encoding.encode(text, disallowed_special=()))

    return make


def device(available: Callable[[str], bool] = lambda kind: kind == "cpu") -> str:
    """The first kind of device that is available."""
    return next(kind for kind in ("cuda", "mps", "cpu") if kind == "cpu" or available(kind))


def classified(sentence: Column, factory: Callable[[], Classifier], most_tokens: int = 50) -> Column:
    """The answer of a model to each sentence, one call each; null for null and where a call fails."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ask = factory()

        def one(text: str | None) -> str | None:
            try:
                return None if text is None else ask(text, most_tokens)
            except Exception:  # noqa: BLE001  clients raise their own kinds
                return None

        for s in batches:
            yield s.map(one).astype(object)

    return run(sentence)


def embedded(text: Column, factory: Callable[[], Encoder], at_once: int = 1024) -> Column:
    """The vector of each text; null for null."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = factory()
        for s in batches:
            out = pd.Series([None] * len(s), dtype=object)
            have = np.flatnonzero(s.notna().to_numpy())
            for lo in range(0, len(have), at_once):
                some = have[lo : lo + at_once]
                for k, v in zip(some, encode(s.iloc[some].tolist()), strict=True):
                    out.iat[k] = v
            yield out

    return run(text)


def is_german(text: Column, factory: Callable[[], Detector]) -> Column:
    """Whether the first 10,000 characters are German; anything that fails is not."""

    @F.pandas_udf("boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        detect = factory()

        def one(t: str | None) -> bool:
            try:
                return bool(t) and detect(t) == "de"
            except Exception:  # noqa: BLE001  detectors raise their own kinds
                return False

        for s in batches:
            yield s.map(one)

    return run(F.substring(text, 1, 10_000))


def token_count(text: Column, factory: Callable[[], Callable[[str], int]]) -> Column:
    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = factory()
        for s in batches:
            yield s.map(lambda t: count(t or ""))

    return run(text)
