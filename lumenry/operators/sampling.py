"""Seeded samples that every engine can repeat: the rows of least md5(seed|key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def draw(key: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, or all if there are no more."""
    return df.orderBy(draw(F.col(key), seed), key).limit(n)


def sample_of(df: DataFrame, column: str, value: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """At most n of the rows whose column has the value, and all others."""
    return sample(df.where(F.col(column) == value), key, n, seed).unionByName(df.where(~F.col(column).eqNullSafe(value)))


def manifest(chosen: DataFrame, results: DataFrame, splits: DataFrame, key: str) -> DataFrame:
    """(key, dest_results, dest_splits) of chosen units; an absent side is the empty string."""
    joined = chosen.select(key).join(results.select(key, F.col("path").alias("_r")), key, "left").join(splits.select(key, F.col("path").alias("_s")), key, "left")
    return joined.select(key, F.coalesce("_r", F.lit("")).alias("dest_results"), F.coalesce("_s", F.lit("")).alias("dest_splits"))


def incomplete(listed: DataFrame) -> DataFrame:
    """(folders, incomplete): how many folders a manifest lists, and how many of them lack a file."""
    return listed.agg(F.count("*").alias("folders"), F.count_if((F.col("dest_results") == "") | (F.col("dest_splits") == "")).alias("incomplete"))
