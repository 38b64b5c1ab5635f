"""Column expressions over score arrays and vectors. A null or NaN score never meets a threshold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column | str, least: float = 1e-12) -> Column:
    """The vector at unit length; a zero vector stays zero."""
    length = F.greatest(norm(a), F.lit(least))
    return F.transform(a, lambda x: x.cast("double") / length)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def rounded(score: Column, places: int = 2) -> Column:
    """Half-even rounding, as thresholds see scores; minus zero becomes zero."""
    return F.bround(score.cast("double"), places) + F.lit(0.0)


def usable(scores: Column) -> Column:
    """Scores with NaN as null."""
    return F.transform(scores, lambda x: F.when(~F.isnan(x), x))


def _any(scores: Column, test) -> Column:
    return F.coalesce(F.exists(scores, lambda x: F.coalesce(test(x) & ~F.isnan(x), F.lit(False))), F.lit(False))


def any_at_least(scores: Column, threshold: float | Column, single: bool = False) -> Column:
    """single: compared as 32-bit numbers, so that a threshold is met that differs beyond their seven digits only."""
    if single:
        least = (threshold if isinstance(threshold, Column) else F.lit(threshold)).cast("float")
        return _any(scores, lambda x: x.cast("float") >= least)
    return _any(scores, lambda x: x >= threshold)


def is_low(scores: Column, low: float = 0.3, high: float = 0.5) -> Column:
    """Some score above `low` and some, perhaps another, below `high`."""
    return _any(scores, lambda x: x > low) & _any(scores, lambda x: x < high)


def is_high(scores: Column, high: float = 0.5) -> Column:
    return any_at_least(scores, high)


def bucket_label(scores: Column, low: float = 0.3, high: float = 0.5) -> Column:
    return F.when(is_high(scores, high), F.lit(f"score>={high:g}")).otherwise(F.lit(f"{low:g}<score<{high:g}"))


def best(scores: Column) -> Column:
    """1-based place of the first greatest score; null if none counts."""
    return F.nullif(F.array_position(usable(scores), F.array_max(usable(scores))), F.lit(0))


def numeric(text: Column | str) -> Column:
    """A cell as double; null where it is no number."""
    value = (F.col(text) if isinstance(text, str) else text).try_cast("double")
    return F.when(~F.isnan(value), value)


def as_int(text: Column | str, default: int = 0) -> Column:
    return F.coalesce((F.col(text) if isinstance(text, str) else text).try_cast("int"), F.lit(default))
