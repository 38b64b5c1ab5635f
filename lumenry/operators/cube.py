"""An exact histogram of scores, from which counts at any threshold come without another look at the scores.

Scores have two decimals, so a score is one of 201 bins (score * 100) and nothing is lost. The cube has two tables, both sums that merge by adding: `bins` (by..., ref, bin, n), the
scores of each reference, and `extremes` (by..., low, high, n), how many rows have this least and this greatest bin, null where a row has no usable score. Whether a
row has a score at a threshold, or some score in a range, follows from its extremes, so coverage at any threshold is a sum over some thousands of cells a group. New rows make a
cube of their own that is added; the size of a cube depends on groups, references and bins, not on rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenry.functions.scores import usable

#: Bins of a score of 1.
SCALE = 100


def bin_of(score: Column) -> Column:
    return F.bround(score * SCALE).cast("int")


def score_of(bin_: Column) -> Column:
    """The score of a bin, the same double that rounding to two decimals gives."""
    return bin_.cast("double") / SCALE


@dataclass
class Cube:
    bins: DataFrame
    extremes: DataFrame
    by: list[str]


def build(scored: DataFrame, by: list[str], scores: str = "scores") -> Cube:
    """The cube of score arrays; ref is the place in the array. Sums are made before anything moves."""
    own = usable(F.col(scores))
    bins = scored.select(*by, F.posexplode(F.transform(own, bin_of)).alias("ref", "bin")).where("bin IS NOT NULL").groupBy(*by, "ref", "bin").agg(F.count("*").alias("n"))
    ends = scored.select(*by, bin_of(F.array_min(own)).alias("low"), bin_of(F.array_max(own)).alias("high"))
    return Cube(bins, ends.groupBy(*by, "low", "high").agg(F.count("*").alias("n")), by)


def added(a: Cube, b: Cube) -> Cube:
    """The cube of both sets of rows."""
    both = lambda x, y, keys: x.unionByName(y).groupBy(*keys).agg(F.sum("n").alias("n"))
    return Cube(both(a.bins, b.bins, [*a.by, "ref", "bin"]), both(a.extremes, b.extremes, [*a.by, "low", "high"]), a.by)


def rolled_up(cube: Cube, by: list[str]) -> Cube:
    """The cube by some of its groupings only."""
    less = lambda x, keys: x.groupBy(*keys).agg(F.sum("n").alias("n"))
    return Cube(less(cube.bins, [*by, "ref", "bin"]), less(cube.extremes, [*by, "low", "high"]), by)


def saved(cube: Cube, path: str) -> None:
    cube.bins.write.mode("overwrite").parquet(f"{path}/bins")
    cube.extremes.write.mode("overwrite").parquet(f"{path}/extremes")


def opened(spark, path: str) -> Cube:
    bins, extremes = (spark.read.parquet(f"{path}/{x}") for x in ("bins", "extremes"))
    return Cube(bins, extremes, [c for c in bins.columns if c not in ("ref", "bin", "n")])


def _if(test: Column) -> Column:
    return F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long")


def coverage(cube: Cube, thresholds: list[float], by: list[str] | None = None) -> DataFrame:
    """(by..., theta, total_rows, selected) for every threshold; rows without a score count in total_rows."""
    by = cube.by if by is None else by
    sums = cube.extremes.groupBy(*by).agg(F.sum("n").alias("total_rows"), *[_if(score_of(F.col("high")) >= t).alias(f"n{k}") for k, t in enumerate(thresholds)])
    each = F.array(*[F.struct(F.lit(float(t)).alias("theta"), "total_rows", F.col(f"n{k}").alias("selected")) for k, t in enumerate(thresholds)])
    return sums.select(*by, F.inline(each))


def buckets(cube: Cube, low: float, high: float, by: list[str] | None = None) -> DataFrame:
    """(by..., n_low, n_high): rows with some score above `low` and some below `high`, and rows with a score at `high`."""
    by = cube.by if by is None else by
    is_low = (score_of(F.col("high")) > low) & (score_of(F.col("low")) < high)
    return cube.extremes.groupBy(*by).agg(_if(is_low).alias("n_low"), _if(score_of(F.col("high")) >= high).alias("n_high"))


def reference_coverage(cube: Cube, thresholds: list[float], by: list[str] | None = None) -> DataFrame:
    """(by..., ref, theta, n_rows, selected): scores of each reference, and those at each threshold."""
    keys = [*(cube.by if by is None else by), "ref"]
    sums = cube.bins.groupBy(*keys).agg(F.sum("n").alias("n_rows"), *[_if(score_of(F.col("bin")) >= t).alias(f"n{k}") for k, t in enumerate(thresholds)])
    each = F.array(*[F.struct(F.lit(float(t)).alias("theta"), "n_rows", F.col(f"n{k}").alias("selected")) for k, t in enumerate(thresholds)])
    return sums.select(*keys, F.inline(each))


def quantiles(cube: Cube, q: list[float], by: list[str] | None = None) -> DataFrame:
    """(by..., ref, n_rows, quantiles): the least score that at least a share q of a reference's scores don't exceed; exact, from cumulated bins."""
    keys = [*(cube.by if by is None else by), "ref"]
    sums = cube.bins.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    # At most 201 bins a reference, in order.
    rows = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("h"), F.sum("n").alias("n_rows"))
    upto = F.transform("h", lambda _, k: F.aggregate(F.slice("h", F.lit(1), k + 1), F.lit(0).cast("long"), lambda s, x: s + x["n"]))
    first = lambda p: F.get("h", F.size(F.filter("upto", lambda c: c < F.greatest(F.ceil(F.lit(p) * F.col("n_rows")), F.lit(1)))))["bin"]
    return rows.withColumn("upto", upto).select(*keys, "n_rows", F.array(*[score_of(first(p)) for p in q]).alias("quantiles"))
