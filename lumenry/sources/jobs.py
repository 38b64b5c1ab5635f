"""Remote batch jobs as a data source of Spark, over any client that lists and looks them up."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from lumenry.functions.providers import BatchClient

JOBS = "id string, status string, created_at bigint, endpoint string, output_file_id string, request_counts struct<total:int,completed:int,failed:int>"


def job_source(client: BatchClient, name: str = "batch_jobs") -> type[DataSource]:
    """A data source over the client, for spark.dataSource.register; option `limit` (100) goes to the service."""

    class Reader(DataSourceReader):
        def __init__(self, limit: int):
            self.limit = limit

        def read(self, partition) -> Iterator[tuple]:
            for job in client.jobs(self.limit):
                counts = job.get("request_counts")
                counts = counts and tuple(counts.get(k) for k in ("total", "completed", "failed"))
                yield (*(job.get(k) for k in ("id", "status", "created_at", "endpoint", "output_file_id")), counts)

    class Jobs(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return JOBS

        def reader(self, schema) -> DataSourceReader:
            return Reader(int(self.options.get("limit", 100)))

    return Jobs


def looked_up(ids: DataFrame, client: BatchClient) -> DataFrame:
    """The job of each id; one that can't be had has status ERROR."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for job_id in pdf["id"]:
                try:
                    job = client.job(job_id) or {"status": "ERROR"}
                except Exception:  # noqa: BLE001  clients raise their own kinds
                    job = {"status": "ERROR"}
                c = job.get("request_counts") or {}
                rows.append((job_id, job.get("status") or "-", job.get("output_file_id"), c.get("total") or 0, c.get("completed") or 0, c.get("failed") or 0))
            yield pd.DataFrame(rows, columns=["id", "status", "output_file_id", "total", "completed", "failed"])

    return ids.select("id").mapInPandas(run, "id string, status string, output_file_id string, total long, completed long, failed long")


def downloaded(jobs: DataFrame, client: BatchClient) -> DataFrame:
    """(batch_id, value) lines of the jobs' outputs; jobs without an output file give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for job_id, file_id in zip(pdf["id"], pdf["output_file_id"], strict=True):
                lines = client.output(file_id).decode("utf-8", "replace").splitlines()
                yield pd.DataFrame({"batch_id": [job_id] * len(lines), "value": lines})

    return jobs.where("output_file_id IS NOT NULL").select("id", "output_file_id").mapInPandas(run, "batch_id string, value string")


def submitted(spark: SparkSession, requests: str, client: BatchClient, log: str) -> list[tuple[int, str]]:
    """Submits each batch of written requests as a job, in order: [(batch_no, id)], each also as a line of the log.

    One batch at a time is on the driver, which does the calls itself, so no task that runs again submits twice; batches that the log names are left
    out, and the service gets a key by which it can tell a call that comes again.
    """
    done = {int(n) for n in re.findall(r"^batch (\d+) ", read_text(spark, log), re.M)}
    rows = spark.read.format("text").load(requests)
    out = []
    for n in sorted(r[0] for r in rows.select("batch_no").distinct().collect()):  # batches are some thousands of lines each
        if n in done:
            continue
        lines = [r.value for r in rows.where(F.col("batch_no") == n).select("value").toLocalIterator()]
        key = hashlib.sha256("\n".join([requests, str(n), *lines]).encode()).hexdigest()
        job = client.submit(lines, key)["id"]
        add_lines(spark, log, [f"batch {n} {key[:16]}", f"batch_job.id: {job}"])
        out.append((n, job))
    return out


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text; empty if there is none."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return ""
    stream = fs.open(at)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def add_lines(spark: SparkSession, path: str, lines: list[str]) -> None:
    """Adds lines to a small file, such as a log, which nothing ever truncates; it is written beside and renamed."""
    write_text(spark, path, read_text(spark, path) + "".join(f"{x}\n" for x in lines))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """The file is written beside and put in place in one step, so there is always the old one or the new one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf)
    at = fs.makeQualified(jvm.org.apache.hadoop.fs.Path(path))
    beside = at.suffix(".new")
    stream = fs.create(beside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    kinds = jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(kinds, 1)
    over[0] = kinds.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(beside, at, over)


def save_outputs(spark: SparkSession, jobs: DataFrame, client: BatchClient, folder: str) -> list[tuple[str, int]]:
    """Writes the output of each job that has one as <id>.jsonl: [(id, lines)]. One output at a time is on the driver."""
    out = []
    for r in jobs.where("output_file_id IS NOT NULL").select("id", "output_file_id").orderBy("id").collect():  # a listing's jobs
        text = client.output(r.output_file_id).decode("utf-8", "replace")
        write_text(spark, f"{folder.rstrip('/')}/{r.id}.jsonl", text)
        out.append((r.id, len(text.splitlines())))
    return out


def job_table(spark: SparkSession, client: BatchClient, limit: int = 100) -> DataFrame:
    spark.dataSource.register(job_source(client))
    return spark.read.format("batch_jobs").option("limit", limit).load().select("*", F.timestamp_seconds("created_at").alias("created"))
