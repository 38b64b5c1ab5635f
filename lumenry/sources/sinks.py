"""Score tables, request files, token counts, manifests and copies of report folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenry.functions.lineage import cut
from lumenry.operators.batching import rotated


def unfinished(units: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Units that have no output yet."""
    return units.join(done.select(*keys).distinct(), keys, "left_anti")


def write_scores(scored: DataFrame, path: str) -> None:
    """By company and year, sentences in order within each file; only the partitions that are written are replaced, each at once."""
    scored.sortWithinPartitions("company", "year", "sentence_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("company", "year").parquet(path)


def write_wide_csv(scored: DataFrame, keys: list[str], path: str, places: str = "%.2f") -> None:
    """sentence_id and a column for each reference, by company and year. Names may differ by case only, so the header is written as data."""
    names = F.lit(",".join(['"' + k.replace('"', '""') + '"' if set(k) & set(',"\n') else k for k in ["sentence_id", *keys]]))
    line = F.concat_ws(",", F.col("sentence_id").cast("string"), F.transform("scores", lambda x: F.coalesce(F.format_string(places, x), F.lit(""))))
    body = cut(scored.select("company", "year", F.col("sentence_id").alias("_id"), line.alias("value")))  # scores are made once, for the lines and the headers
    head = body.select("company", "year").distinct().select("company", "year", F.lit(-1).cast("long").alias("_id"), names.alias("value"))
    body.unionByName(head).repartition("company", "year").sortWithinPartitions("company", "year", "_id").select("company", "year", "value").write.mode("overwrite").partitionBy("company", "year").text(path)


def write_requests(requests: DataFrame, order: list[str], path: str, lines: int = 20_000, value: str = "request") -> int:
    """JSON lines in files of `lines` in the order given, one folder `batch_no=k` each; returns how many there are."""
    rows = rotated(requests, order, lines)
    rows.repartition("batch_no").sortWithinPartitions("batch_no", *order).select("batch_no", F.col(value).alias("value")).write.mode("overwrite").partitionBy("batch_no").text(path)
    last = requests.sparkSession.read.format("text").load(path).agg(F.max("batch_no")).first()[0] if rows.take(1) else None
    return 0 if last is None else int(last) + 1


def write_tokens(tokens: DataFrame, path: str) -> None:
    """In the order of company and year, over all files."""
    tokens.select("company", "year", "tokens").orderBy("company", "year").write.mode("overwrite").option("header", "true").csv(path)


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", "true").option("emptyValue", "").csv(path)


def write_object(rows: DataFrame, path: str) -> None:
    """A small table as one indented JSON document; characters beyond ASCII are kept."""
    rows.agg(F.to_json(F.collect_list(F.struct(*rows.columns)), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)


def copy_if_exists(spark: SparkSession, source: str, target: str, overwrite: bool = False) -> bool:
    """Copies a file within or between Hadoop file systems; an existing target stays unless overwritten. Whether the target is there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    if not a.getFileSystem(conf).exists(a):
        return False
    if overwrite or not b.getFileSystem(conf).exists(b):
        jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, overwrite, conf)
    return True
