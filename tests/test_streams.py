"""Jobs and answers as streams: nothing lost, nothing repeated, whatever the order and however often they start again."""

import itertools
import json
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from lumenry.plans import stages
from lumenry.sources import files, job_stream
from lumenry.streaming import ingest, tracking


class FileClient:
    """A service whose answers are files, so that the source's own process sees what a test changes."""

    def __init__(self, folder):
        self.folder = str(folder)

    def _read(self, name):
        with open(f"{self.folder}/{name}") as f:
            return json.load(f)

    def jobs(self, limit):
        return self._read("jobs.json")[:limit]

    def job(self, job_id):
        return self._read("all.json")[job_id]

    def output(self, file_id):
        return f"out of {file_id}\n".encode()

    def put(self, jobs, gone=()):
        for name, x in (("all.json", {j["id"]: j for j in [*jobs, *gone]}), ("jobs.json", jobs)):
            with open(f"{self.folder}/{name}.new", "w") as f:
                json.dump(x, f)
            os.replace(f"{self.folder}/{name}.new", f"{self.folder}/{name}")


def job(name, status, output=None, done=0):
    return {"id": name, "status": status, "created_at": 5, "endpoint": "/e", "output_file_id": output, "request_counts": {"total": 9, "completed": done, "failed": 0}}


def offset(*jobs):
    return {"jobs": {j["id"]: job_stream.state_of(j) for j in jobs}}


def test_changes_follow_from_offsets():
    a, b = offset(job("a", "in_progress"), job("b", "in_progress")), offset(job("a", "completed", "f"), job("b", "in_progress", done=3), job("c", "validating"))
    assert [(r[0], r[1], r[2], r[5]) for r in job_stream.changes(a, b)] == [("a", "in_progress", "completed", "f"), ("c", None, "validating", None)]
    assert [r[0] for r in job_stream.changes(a, b, progress=True)] == ["a", "b", "c"] and job_stream.changes(b, b, True) == []


def test_polls_follow_open_jobs(tmp_path):
    """An open job that left the listing is looked up; one that ended and left is forgotten; one that can't be had stays as it was."""
    client = FileClient(tmp_path)
    client.put([job("new", "validating")], [job("open", "completed", "f")])
    start = offset(job("open", "in_progress"), job("ended", "failed"), job("lost", "in_progress"))
    end = job_stream.polled(client, start, 100)
    assert sorted(end["jobs"]) == ["lost", "new", "open"] and end["jobs"]["lost"] == start["jobs"]["lost"]
    assert [(r[0], r[2]) for r in job_stream.changes(start, end)] == [("new", "validating"), ("open", "completed")]


def test_history_over_restarts(spark, tmp_path):
    """Every change once, over polls that tell nothing, a service that is away, a stop between, and a batch that runs again."""
    client = FileClient(tmp_path)
    at = lambda x: str(tmp_path / x)
    told = []

    def run(*polls):
        q = job_stream.follow(spark, client, at("history"), at("out"), at("ck"), every="0 seconds", told=lambda df: told.append(sorted(r.id for r in df.collect())))
        try:
            for p in polls:
                client.put(*p) if p else os.replace(f"{tmp_path}/jobs.json", f"{tmp_path}/away.json")
                q.processAllAvailable()
                if not p:
                    os.replace(f"{tmp_path}/away.json", f"{tmp_path}/jobs.json")
        finally:
            q.stop()

    client.put([job("a", "validating")])
    run([[job("a", "validating")]], [[job("a", "validating")]], [[job("a", "in_progress"), job("b", "validating")]])
    run([[job("a", "in_progress", done=4), job("b", "validating")]], [[job("b", "in_progress")], [job("a", "completed", "fa", 9)]])
    last = max(int(x.split("=")[1]) for x in os.listdir(at("history")) if x.startswith("batch="))
    os.remove(f"{at('ck')}/commits/{last}")  # as if the driver had gone before it noted the last batch
    for x in os.listdir(f"{at('ck')}/commits"):
        if x.startswith(f".{last}."):
            os.remove(f"{at('ck')}/commits/{x}")
    shutil.rmtree(at("history") + f"/batch={last}")
    run([[job("b", "completed", "fb", 9)]])
    history = spark.read.parquet(at("history"))
    got = [(r.id, r.previous, r.status) for r in history.collect()]
    want = [(x, *step) for x in "ab" for step in ((None, "validating"), ("validating", "in_progress"), ("in_progress", "completed"))]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r.id: (r.status, r.output_file_id) for r in job_stream.latest(history).collect()} == {"a": ("completed", "fa"), "b": ("completed", "fb")}
    assert sorted(x for x in os.listdir(at("out")) if not x.startswith(".")) == ["a.jsonl", "b.jsonl"]


def line(cid, content):
    return json.dumps({"custom_id": cid, "response": {"status_code": 200, "body": {"choices": [{"message": {"content": content}}]}}})


ANSWERS = {
    "batch_1": [("1", "[1, True]"), ("2", "[2, False]"), ("3", "[0, False]")],
    "batch_2": [("1", "[4, False]"), ("2", "[2, False]"), ("orphan", "[5, True]")],
    "batch_0": [("3", "[0, False]"), ("1", "[7, True]")],
}
LONG = 365 * tracking.DAY


def put_lines(folder, name, texts):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/.{name}", "w") as f:
        f.write("\n".join(texts) + "\n")
    os.replace(f"{folder}/.{name}", f"{folder}/{name}")


def states(spark, path):
    return {r.custom_id: (r.status, r.content, r.batch_id, r.answers, r.conflict) for r in tracking.current(spark.read.parquet(path)).collect()}


@pytest.mark.parametrize("seed", range(2))
def test_any_order_and_restarts_give_the_batch_load(spark, tmp_path, seed):
    """Files arrive in some order, some before the requests; the stream stops after each."""
    at = lambda x: str(tmp_path / x)
    order = list(itertools.permutations(ANSWERS))[seed * 2]
    steps = [("answers", n) for n in order]
    steps.insert(random.Random(seed).randrange(4), ("asked", None))
    for x in ("answers", "asked"):
        os.makedirs(at(x))
    for kind, name in steps:
        if kind == "asked":
            put_lines(at("asked"), "requests.jsonl", [json.dumps({"custom_id": k}) for k in ("1", "2", "3", "silent")])
        else:
            put_lines(at("answers"), f"{name}.jsonl", [line(*x) for x in ANSWERS[name]])
        tracking.track(tracking.asked_stream(spark, at("asked")), ingest.response_stream(spark, at("answers")), at("history"), at("ck"), window=LONG).awaitTermination()
    assert states(spark, at("history")) == {
        "1": ("answered", "[7, True]", "batch_0", 3, True), "2": ("answered", "[2, False]", "batch_1", 2, False),
        "3": ("answered", "[0, False]", "batch_0", 2, False), "silent": ("waiting", None, None, 0, False), "orphan": ("unasked", "[5, True]", "batch_2", 1, False),
    }
    history = spark.read.parquet(at("history"))
    batch = files.responses(spark, at("answers"))
    first = batch.groupBy("custom_id").agg(F.min(F.struct("batch_id", "content")).alias("x")).select("custom_id", "x.content", "x.batch_id")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(stages.load_answers(tracking.standing(history))) == rows(stages.load_answers(first))
    assert history.groupBy("custom_id", "revision").count().where("count > 1").isEmpty()


def test_waits_end_and_late_answers_count(spark, tmp_path):
    at = lambda x: str(tmp_path / x)
    os.makedirs(at("answers"))
    put_lines(at("asked"), "r.jsonl", [json.dumps({"custom_id": k}) for k in ("1", "silent")])
    past = os.path.getmtime(f"{at('asked')}/r.jsonl") - 2 * tracking.DAY / 1000
    os.utime(f"{at('asked')}/r.jsonl", (past, past))
    run = lambda: tracking.track(tracking.asked_stream(spark, at("asked")), ingest.response_stream(spark, at("answers")), at("history"), at("ck")).awaitTermination()
    run()
    put_lines(at("asked"), "more.jsonl", [json.dumps({"custom_id": "soon"})])
    run()  # a batch after the window ends the wait
    got = states(spark, at("history"))
    assert got["1"][0] == got["silent"][0] == "expired" and got["soon"][0] == "waiting"
    put_lines(at("answers"), "batch_1.jsonl", [line("1", "[1, True]"), line("soon", "[2, True]")])
    run()
    got = states(spark, at("history"))
    assert got["1"] == ("late", "[1, True]", "batch_1", 1, False) and got["soon"][0] == "answered" and got["silent"][0] == "expired"
    assert tracking.standing(spark.read.parquet(at("history"))).count() == 2
