"""Requests and their answers as one stateful stream, by custom_id.

Each id's state holds when it was asked, the answer that stands, and what else came. The answer that stands is the least by (batch_id, content) of all that came, so arrival order, files that come
twice and restarts don't change it, and it is what a batch load over all files takes. Another answer of the same content is a repeat, one of another content makes a conflict. A timer ends the wait when the window
of the service has passed since the id was asked; an answer that comes after that counts still, as late, and one for an id that was never asked is kept as unasked.

Every change of an id gives one row a batch with a revision that rises; the last revision of each id is its state. State is kept for `keep`, or for ever, so that repeats are known.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lumenry.functions.text import line_id

#: The service's window in milliseconds.
DAY = 24 * 60 * 60 * 1000
_STATE = "asked long, expired boolean, batch_id string, content string, answers long, conflict boolean, late boolean, revision long"
TRACKED = "custom_id string, status string, content string, batch_id string, answers long, conflict boolean, asked long, revision long"


def asked_stream(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """(custom_id, asked) of request lines as files appear; asked is when the file was written, in milliseconds."""
    text = spark.readStream.option("maxFilesPerTrigger", files_at_once).option("recursiveFileLookup", "true").text(folder)
    return text.select(line_id(F.col("value")).alias("custom_id"), F.unix_millis("_metadata.file_modification_time").alias("asked")).where("custom_id IS NOT NULL")


class Tracker(StatefulProcessor):
    def __init__(self, window: int = DAY, keep: int | None = None):
        self.window, self.keep = window, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", _STATE, ttlDurationMs=self.keep) if self.keep else handle.getValueState("state", _STATE)

    def _now(self) -> list[Any]:
        held = self.state.get() if self.state.exists() else None
        return list(held) if held else [None, False, None, None, 0, False, False, 0]

    def _told(self, key: str, s: list[Any]) -> Row:
        s[7] += 1
        self.state.update(tuple(s))
        status = "expired" if s[1] else "waiting"
        if s[4]:
            status = "unasked" if s[0] is None else "late" if s[6] else "answered"
        return Row(custom_id=key, status=status, content=s[3], batch_id=s[2], answers=s[4], conflict=s[5], asked=s[0], revision=s[7])

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        s = self._now()
        for r in rows:
            if r.asked is not None:
                if s[0] is None or r.asked < s[0]:
                    s[0] = r.asked
                    if not s[4] and not s[1]:
                        self.handle.registerTimer(r.asked + self.window)
                continue
            own = (r.batch_id or "", r.content)
            if not s[4]:
                s[6] = s[1]
            elif r.content != s[3]:
                s[5] = True
            if not s[4] or own < (s[2], s[3]):
                s[2], s[3] = own
            s[4] += 1
        yield self._told(key[0], s)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        s = self._now()
        if not s[4] and not s[1] and s[0] is not None and s[0] + self.window <= expiredTimerInfo.getExpiryTimeInMs():
            s[1] = True
            yield self._told(key[0], s)

    def close(self) -> None:
        pass


def tracked(asked: DataFrame, answers: DataFrame, window: int = DAY, keep: int | None = None) -> DataFrame:
    """The changes of each id (see TRACKED), from streams (custom_id, asked) and (custom_id, content, batch_id)."""
    none = lambda kind: F.lit(None).cast(kind)
    both = asked.select("custom_id", "asked", none("string").alias("batch_id"), none("string").alias("content")).unionByName(answers.select("custom_id", none("long").alias("asked"), "batch_id", "content"))
    return both.groupBy("custom_id").transformWithState(Tracker(window, keep), TRACKED, "Update", "ProcessingTime")


def track(asked: DataFrame, answers: DataFrame, history: str, checkpoint: str, window: int = DAY, keep: int | None = None, once: bool = True) -> StreamingQuery:
    """Writes all changes to a folder `batch=n` for each batch, whole by name, so a batch that runs again replaces what it wrote. State lies in RocksDB, beyond memory.

    once: takes what is there and ends; waits then end in the next run that has something to take.
    """
    spark = asked.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{history.rstrip('/')}/batch={number}")

    # A stream with timers runs batches without data for ever, which a run that ends must not.
    how = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": str(not once).lower()}
    had = {k: spark.conf.get(k, None) for k in how}
    for k, v in how.items():
        spark.conf.set(k, v)
    try:
        writer = tracked(asked, answers, window, keep).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:  # the query has its own copy of the settings
        for k, v in had.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def current(history: DataFrame) -> DataFrame:
    """Each id's state by its last revision."""
    rest = F.struct(*[c for c in history.columns if c not in ("custom_id", "batch")])
    return history.groupBy("custom_id").agg(F.max_by(rest, "revision").alias("x")).select("custom_id", "x.*")


def standing(history: DataFrame) -> DataFrame:
    """(custom_id, content, batch_id) of the answers that stand, as load_answers takes them."""
    return current(history).where("answers > 0").select("custom_id", "content", "batch_id")
