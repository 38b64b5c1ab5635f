"""What the operators share: table reading, lineage cuts, and the word pattern."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The column with null as the empty string."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; one beside the warehouse where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def settle(df: DataFrame, narrow: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut, and a lost executor loses nothing.

    narrow: the rows are much smaller than what they are made from, so they are gathered into fewer, even files first.
    The files go when the session ends.
    """
    spark = df.sparkSession
    df = df.hint("rebalance") if narrow else df
    path = f"{shared_folder(spark).rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes the files of settled tables that nothing reads any more, before the session ends."""
    for df in tables:
        context = df.sparkSession.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def with_workers(spark: SparkSession) -> None:
    """Lets Python workers import this library where it is not installed but lies on the same path."""
    have = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)


#: Rows that make a key heavy, at least, and how many keys can be heavy at most.
LEAST_HEAVY, MOST_HEAVY = 200, 100_000


def meet(rows: DataFrame, facts: DataFrame, key: str, total: int, most: int = MOST_HEAVY, light: Column | None = None) -> DataFrame:
    """rows joined with facts, unique by key, that hold in `n` how many of the `total` rows have the key; n is dropped.

    Heavy keys, at most `most` of them whatever the data, are sent to the rows, so that their rows stay where they are; the others meet by shuffle.
    light (never null): whether the facts of a key are small enough to be sent.
    """
    heavy = F.col("n") > max(LEAST_HEAVY, total // most)
    heavy = heavy if light is None else heavy & light
    sent = F.broadcast(facts.where(heavy).drop("n"))
    light = rows.join(sent.select(key), key, "left_anti").join(facts.where(~heavy).drop("n"), key)
    return rows.join(sent, key).unionByName(light)


#: Ids that may be broadcast (8 bytes each); with more, rows are joined by shuffle.
MANY_IDS = 4_000_000


def ids_sent(ids: DataFrame) -> DataFrame:
    """A settled table of ids, sent to the rows it is joined with if it has no more than MANY_IDS."""
    return F.broadcast(ids) if ids.count() <= MANY_IDS else ids


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with the place of each row, from 0, in the order: rows are sorted by ranges, and only a count of each range is looked at together."""
    dealt = settle(df.repartitionByRange(*order).withColumn("_o_part", F.spark_partition_id()))
    before = F.sum("n").over(Window.orderBy("_o_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = dealt.groupBy("_o_part").agg(F.count("*").alias("n")).select("_o_part", F.coalesce(before, F.lit(0)).alias("_o_before"))
    inside = F.row_number().over(Window.partitionBy("_o_part").orderBy(*order)) - 1
    return dealt.withColumn(name, inside).join(F.broadcast(sizes), "_o_part").withColumn(name, (F.col(name) + F.col("_o_before")).cast("long")).drop("_o_part", "_o_before")
