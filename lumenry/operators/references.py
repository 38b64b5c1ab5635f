"""Dictionaries of references: order, merging, and the sets of names that filters use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenry.functions.scores import cosine
from lumenry.functions.text import digits_number, strip


def goal_order(refs: DataFrame, key: str = "key", given: str = "ord") -> DataFrame:
    """Adds place: keys by their digits as a number, ties in the order given; and the column name of each key."""
    return refs.withColumns({"place": F.row_number().over(Window.orderBy(digits_number(F.col(key)), given)) - 1, "column": F.concat(F.lit("sdg_"), key)})


def merged(base: DataFrame, over: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Both maps as one; where both have a key, `over` wins."""
    both = base.select(key, value, F.lit(0).alias("_rank")).unionByName(over.select(key, value, F.lit(1).alias("_rank")))
    return both.groupBy(key).agg(F.max_by(value, "_rank").alias(value))


def terms(*columns: tuple[DataFrame, Column]) -> DataFrame:
    """The distinct names of all columns, stripped, without blanks; arrays give each of their names."""
    out = None
    for df, column in columns:
        names = df.select(column.alias("term"))
        if names.schema["term"].dataType.typeName() == "array":
            names = names.select(F.explode("term").alias("term"))
        names = names.select(strip(F.col("term")).alias("term")).where("term <> ''")
        out = names if out is None else out.union(names)
    return out.distinct()


def resolve_columns(columns: DataFrame, allowed: DataFrame, exact: bool = False) -> DataFrame:
    """Columns (name, ord) whose name is allowed (term): exactly, or else whatever the case, the last of equal ones."""
    if exact:
        return columns.join(allowed, F.col("name") == F.col("term"), "left_semi")
    low = columns.groupBy(F.lower("name").alias("key")).agg(F.max_by("name", "ord").alias("name"), F.max("ord").alias("ord"))
    return low.join(allowed.select(F.lower("term").alias("key")).distinct(), "key", "left_semi")


def glossary(names: DataFrame, query: DataFrame, threshold: float = 0.5) -> DataFrame:
    """names (ref_key, vec, ...) as alike as the threshold to the vector of query (q), which is one row; adds similarity, not rounded."""
    alike = names.crossJoin(F.broadcast(query.select("q").limit(1))).withColumn("similarity", cosine("vec", "q"))
    return alike.where(F.col("similarity") >= threshold).drop("q")
