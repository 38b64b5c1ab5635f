"""Changes of remote batch jobs as a stream, instead of asking for them by hand.

Each trigger asks the service for its listing. The offset of the stream is the state of all jobs that matter, so the changes between two offsets follow from the offsets alone: a batch that runs
again after a crash gives the same rows without the service, and a restart from a checkpoint neither loses nor repeats a change. A job that left the listing before it ended is looked up by
its id; one that ended and left the listing is forgotten, so an offset holds the listing and the open jobs.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from lumenry.functions.providers import BatchClient
from lumenry.sources import jobs

CHANGES = "id string, previous string, status string, created_at bigint, endpoint string, output_file_id string, total bigint, completed bigint, failed bigint"

#: States from which a job does not go on.
ENDED = ("completed", "failed", "expired", "cancelled")
#: Polls in a row that may fail before the stream does.
TOLERATED = 5


def state_of(job: dict) -> str:
    """What a change is told by and a row is made from, as text with one form."""
    c = job.get("request_counts") or {}
    return json.dumps([job.get("status"), job.get("created_at"), job.get("endpoint"), job.get("output_file_id"), *(c.get(k) for k in ("total", "completed", "failed"))])


def changes(start: dict, end: dict, progress: bool = False) -> list[tuple]:
    """A row for each job that is new or has another status or output, by id; with progress, also for other counts."""
    out = []
    for name, text in sorted(end["jobs"].items()):
        before, now = json.loads(start["jobs"].get(name, "null")), json.loads(text)
        told = now if progress else [now[0], now[3]]
        if before is None or told != (before if progress else [before[0], before[3]]):
            out.append((name, before and before[0], *now))
    return out


def polled(client: BatchClient, start: dict, limit: int) -> dict:
    """The offset after one poll."""
    listed = {j["id"]: state_of(j) for j in client.jobs(limit)}
    for name, text in start["jobs"].items():
        if name not in listed and json.loads(text)[0] not in ENDED:
            try:
                listed[name] = state_of(client.job(name) or {})
            except Exception:  # noqa: BLE001  clients raise their own kinds; it is looked up again
                listed[name] = text
    return {"jobs": listed}


def change_source(client: BatchClient, name: str = "batch_job_changes") -> type[DataSource]:
    """A streaming source over the client, for spark.dataSource.register; options `limit` (100), which goes to the service, and `progress` (false)."""

    class Reader(SimpleDataSourceStreamReader):
        def __init__(self, limit: int, progress: bool):
            self.limit, self.progress, self.failed = limit, progress, 0

        def initialOffset(self) -> dict:
            return {"jobs": {}}

        def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
            try:
                end, self.failed = polled(client, start, self.limit), 0
            except Exception:  # noqa: BLE001  the service may be away for a while
                self.failed += 1
                if self.failed > TOLERATED:
                    raise
                end = start
            if not (rows := changes(start, end, self.progress)):
                end = start  # nothing to tell, so no batch
            return iter(rows), end

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
            return iter(changes(start, end, self.progress))

    class Changes(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return CHANGES

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
            return Reader(int(self.options.get("limit", 100)), self.options.get("progress", "false").lower() == "true")

    return Changes


def job_changes(spark: SparkSession, client: BatchClient, limit: int = 100, progress: bool = False) -> DataFrame:
    spark.dataSource.register(change_source(client))
    return spark.readStream.format("batch_job_changes").option("limit", limit).option("progress", progress).load()


def follow(spark: SparkSession, client: BatchClient, history: str, outputs: str, checkpoint: str, every: str = "60 seconds", limit: int = 100, told: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Keeps the history of all changes, a folder `batch=n` for each batch, and saves the output of each job when it has one as <id>.jsonl, from where the response stream takes it.

    Both are written whole by name, so a batch that runs again replaces what it wrote. told: what else to do with each batch's changes.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            batch.write.mode("overwrite").parquet(f"{history.rstrip('/')}/batch={number}")
            jobs.save_outputs(batch.sparkSession, batch, client, outputs)
            if told:
                told(batch)
        finally:
            batch.unpersist()

    return job_changes(spark, client, limit).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def latest(history: DataFrame) -> DataFrame:
    """The state of each job by its last change; batches are numbered upwards."""
    rest = F.struct(*[c for c in history.columns if c not in ("id", "batch")])
    return history.groupBy("id").agg(F.max_by(rest, "batch").alias("x")).select("id", "x.*")


def changes_in(polls: DataFrame, *order: str) -> DataFrame:
    """The same for a table of polled states (id, status, ...) in an order of its own: the rows that change a job's status, with the one before in `previous`."""
    own = polls.withColumn("previous", F.lag("status").over(Window.partitionBy("id").orderBy(*order)))
    return own.where(~F.col("status").eqNullSafe(F.col("previous")))
