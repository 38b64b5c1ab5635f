"""Numbering rows in a global order, and what is known of remote batch jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenry.functions.lineage import cut
from lumenry.functions.scores import as_int
from lumenry.functions.text import job_id


def numbered(df: DataFrame, order: list[str], name: str = "row") -> DataFrame:
    """Adds the 0-based place of each row in the order.

    Rows are dealt by ranges and numbered within each; only the number of rows of each range is looked at in one place.
    """
    dealt = cut(df.repartitionByRange(*map(F.col, order)).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    first = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    sizes = sizes.select("_part", first.alias("_first"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_first") + inside).drop("_part", "_first")


def rotated(df: DataFrame, order: list[str], lines: int = 20_000) -> DataFrame:
    """Adds batch_no: a new batch after every `lines` rows of the order."""
    return numbered(df, order, "_row").withColumn("batch_no", F.floor(F.col("_row") / lines)).drop("_row")


def job_counts(counts: Column | str) -> list[Column]:
    """total, completed and failed of a struct of counts, 0 where anything is missing."""
    c = F.col(counts) if isinstance(counts, str) else counts
    return [as_int(c[k]).cast("long").alias(k) for k in ("total", "completed", "failed")]


def status(jobs: DataFrame) -> DataFrame:
    """A row for each job (id, status, total, completed, failed) with what remains, and an OVERALL row of sums; jobs in error don't count in it."""
    rest = F.greatest(F.col("total") - F.col("completed") - F.col("failed"), F.lit(0).cast("long")).alias("remain")
    each = jobs.select("id", "status", "total", "completed", "failed", rest)
    sums = jobs.where("status <> 'ERROR'").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("total", "completed", "failed")])
    return each.unionByName(sums.select(F.lit("OVERALL").alias("id"), F.lit("-").alias("status"), "total", "completed", "failed", rest))


def status_lines(rows: DataFrame) -> DataFrame:
    """A line for each row; of a job in error the counts aren't known."""
    shown = [F.when(F.col("status") == "ERROR", F.lit("-")).otherwise(F.col(c).cast("string")) for c in ("total", "completed", "failed", "remain")]
    return rows.select(F.format_string("%-38s %-12s %7s %7s %7s %7s", "id", "status", *shown).alias("line"))


def in_progress(jobs: DataFrame, n: int = 100) -> DataFrame:
    """The first n jobs of the listing, of these the ones in progress."""
    return jobs.orderBy("id").limit(n).where("status = 'in_progress'")


def logged_ids(lines: DataFrame, line: str = "value", place: str = "line_no") -> DataFrame:
    """(id, line_no) of the job ids in log lines, each at its first line."""
    found = lines.select(job_id(F.col(line)).alias("id"), place).where("id IS NOT NULL")
    return found.groupBy("id").agg(F.min(place).alias(place))
