"""Answers as they arrive: response files to the results table, each custom_id once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenry.functions.text import content, line_id
from lumenry.plans.stages import load_answers


def response_stream(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """(custom_id, content, batch_id) of the good lines of batch_*.jsonl, as files appear."""
    lines = spark.readStream.option("pathGlobFilter", "batch_*.jsonl").option("maxFilesPerTrigger", files_at_once).text(folder)
    rows = lines.select(line_id(F.col("value")).alias("custom_id"), content(F.col("value")).alias("content"), F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.jsonl$", 1).alias("batch_id"))
    return rows.where("custom_id IS NOT NULL AND content IS NOT NULL")


def ingest(stream: DataFrame, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends to the table what it hasn't yet. The table itself tells what is known, so no state grows, and a batch that runs again adds nothing."""

    def put(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        first = batch.groupBy("custom_id").agg(F.min_by(F.struct("content", "batch_id"), F.struct("batch_id", "content")).alias("x")).select("custom_id", "x.*")
        rows = load_answers(first.join(spark.table(table).select("custom_id"), "custom_id", "left_anti"))
        rows.write.mode("append").insertInto(table)

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def counted(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by window and type, with rows later than the watermark left out; for streams and tables alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
