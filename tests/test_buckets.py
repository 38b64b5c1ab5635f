"""The table in buckets: what changes write, what crashes leave, and two writers."""

import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumenry.operators import buckets, store


def ids(n, start=0):
    return [(f"task||{k}||c||2020", [k % 17], bool(k % 2), f"[{k % 17}, {bool(k % 2)}]", "batch_1") for k in range(start, start + n)]


@pytest.fixture
def made(spark, tmp_path):
    t = buckets.BucketTable(spark, str(tmp_path / "results"), store.RESULTS, buckets=16)
    t.append(spark.createDataFrame(ids(400), store.RESULTS))
    return t


def rows(df):
    return Counter((r.custom_id, tuple(r.sdgs) if r.sdgs is not None else None, r.is_ai, r.raw, r.batch_id) for r in df.collect())


def upd(spark, keys):
    return spark.createDataFrame([(f"task||{k}||c||2020", "new", [k], None) for k in keys], "custom_id string, new_raw string, new_sdgs array<int>, new_ai boolean")


def files_of(t):
    return {x for own in t.manifest()["files"].values() for x in own}


def test_updates_rewrite_what_they_meet(spark, made):
    before, had, updates = made.read().cache(), files_of(made), upd(spark, [3, 77, 5000])
    want = rows(store.updated(before, updates))
    since = made.version()
    made.update(updates)
    assert rows(made.read()) == want and sum(want.values()) == 400
    met = {r[0] for r in updates.select(made.bucket()).distinct().collect()}
    assert set(made.changed(since)) <= met and len(files_of(made) - had) <= len(met) <= 3
    assert rows(made.read(since)) == rows(before)  # the version before is still there
    assert made.update(upd(spark, [])) is None
    assert rows(made.find(updates)) == Counter({k: n for k, n in want.items() if k[0] in ("task||3||c||2020", "task||77||c||2020")})


def test_large_updates_by_shuffle(spark, made, monkeypatch):
    want = rows(store.updated(made.read(), upd(spark, range(0, 400, 2))))
    monkeypatch.setattr(buckets, "MOST_SENT", 0)
    made.update(upd(spark, range(0, 400, 2)))
    assert rows(made.read()) == want


def test_append_upsert_delete_compact_vacuum(spark, made):
    with pytest.raises(ValueError, match="twice"):
        made.append(spark.createDataFrame(ids(2, 399), store.RESULTS))
    with pytest.raises(ValueError, match="twice"):
        made.append(spark.createDataFrame(ids(1, 900) * 2, store.RESULTS))
    for k in range(3):
        made.append(spark.createDataFrame(ids(50, 400 + 50 * k), store.RESULTS))
    made.upsert(spark.createDataFrame([("task||1||c||2020", None, None, "up", "b2"), ("fresh", [1], True, "x", "b2")], store.RESULTS))
    made.delete(spark.createDataFrame([("task||2||c||2020",), ("nope",)], "custom_id string"))
    want = Counter({k: n for k, n in rows(spark.createDataFrame([*ids(550), ("fresh", [1], True, "x", "b2")], store.RESULTS)).items() if k[0] not in ("task||1||c||2020", "task||2||c||2020")})
    want["task||1||c||2020", None, None, "up", "b2"] += 1
    assert rows(made.read()) == want and max(map(len, made.manifest()["files"].values())) > 1
    made.compact()
    assert rows(made.read()) == want and max(map(len, made.manifest()["files"].values())) == 1
    assert made.vacuum(1) > 0 and rows(made.read()) == want and made.compact() is None
    again = buckets.BucketTable(spark, made.path, store.RESULTS, buckets=99)
    assert again.buckets == 16 and rows(again.read()) == want


def test_a_crash_leaves_the_version_before(spark, made, monkeypatch):
    want, version = rows(made.read()), made.version()
    with monkeypatch.context() as m:
        m.setattr(made, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("crash")))
        with pytest.raises(RuntimeError):
            made.update(upd(spark, range(100)))
    assert made.version() == version and rows(made.read()) == want
    made.update(upd(spark, [1]))
    made.vacuum(1)  # what the crash left goes
    assert made.read().count() == 400 and made.read().where("raw = 'new'").count() == 1


def test_the_second_writer_starts_again(spark, made):
    """A writer that another one overtakes sees what that one wrote: none of both updates is lost, and an id can't be added by both."""
    other = buckets.BucketTable(spark, made.path, store.RESULTS)
    first, commit = [True], made._commit

    def overtaken(base, manifest):
        if first.pop() if first else False:
            other.update(upd(spark, [3]))
        return commit(base, manifest)

    made._commit = overtaken
    made.update(upd(spark, [4]))
    assert {r.custom_id for r in made.read().where("raw = 'new'").collect()} == {"task||3||c||2020", "task||4||c||2020"}
    first.append(True)
    other.update = lambda _: other.append(spark.createDataFrame(ids(1, 700), store.RESULTS))
    with pytest.raises(ValueError, match="twice"):
        made.append(spark.createDataFrame(ids(1, 700), store.RESULTS))
    assert made.read().where("custom_id = 'task||700||c||2020'").count() == 1


def test_writers_at_once(spark, made):
    def write(k):
        buckets.BucketTable(spark, made.path, store.RESULTS).append(spark.createDataFrame(ids(5, 1000 + 10 * k), store.RESULTS))

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert made.read().count() == 420 and made.read().select("custom_id").distinct().count() == 420


def test_a_stream_batch_counts_once(spark, made):
    new = spark.createDataFrame(ids(3, 2000), store.RESULTS)
    assert made.append(new, "answers", 0) is not None and made.append(new, "answers", 0) is None
    assert made.append(spark.createDataFrame(ids(3, 3000), store.RESULTS), "answers", 1) is not None
    assert made.upsert(new.withColumn("raw", F.lit("u")), "fixes", 0) is not None and made.upsert(new, "fixes", 0) is None
    assert made.read().count() == 406 and made.read().where("raw = 'u'").count() == 3
