"""Files read by ranges give the same records wherever they are cut."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumenry.sources import files, ranges


def records(data: bytes) -> list[str] | None:
    """One character after another: the records of a whole file, None if it ends within quotes."""
    out, now, inside = [], "", False
    for c in data.decode("utf-8", "replace"):
        inside ^= c == '"'
        if c in "\r\n" and not inside:
            out.append(now)
            now = ""
        else:
            now += c
    return None if inside else [x for x in [*out, now] if x]


def made(seed: int, size: int) -> bytes:
    rng = random.Random(seed)
    end = rng.choice(["\n", "\r\n", "\r", "mixed"])
    cell = lambda: rng.choice(["", "0.5", "x y", "é😀", '"a, b"', '"two\nlines"', '"a ""b"" c"', '"\r\n\r\n"', '"' + "long\n" * 30 + '"', "-1.25"])
    rows = ["", "", "sentence_id,sdg_1," + ('"head\nof two"' if seed % 2 else "x")] + [f"{k},{cell()},{cell()}" if rng.random() > 0.1 else "" for k in range(size)]
    text = "".join(r + (rng.choice(["\n", "\r\n", "\r"]) if end == "mixed" else end) for r in rows)
    return (text if seed % 3 else text.rstrip("\r\n")).encode()


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("wide")
    data = {f"c{k}": made(k, 6 + 5 * (k % 3)) for k in range(6)} | {"broken": b'sentence_id,a\n1,"x\n2,y\n', "blank": b"\n\n\r\n", "head": b'sentence_id,"a\nb"', "bytes": b"sentence_id,a\n1,\xff\xfe\n", "other": b"id,a\n1,2\n", "one": b"sentence_id\n1\n"}
    for name, x in data.items():
        p = root / name / "2020" / "similarity_scores.csv"
        p.parent.mkdir(parents=True)
        p.write_bytes(x)
    (root / "none").mkdir()
    (root / "none" / "empty.csv").write_bytes(b"")
    return str(root), data


@pytest.fixture(params=[64, 500, 1 << 27])
def cut_at(request, spark):
    """Files are cut after so many bytes."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(k) for k in keys]
    for k in keys:
        spark.conf.set(k, request.param)
    yield request.param
    for k, v in zip(keys, old, strict=True):
        spark.conf.set(k, v)


def company(path: str) -> str:
    return path.split("/")[-3]


def test_records(spark, tree, cut_at):
    root, data = tree
    found = ranges.Files(spark, root, "*.csv")
    got = {}
    for r in sorted(found.records.collect(), key=lambda r: (r.path, r["at"], r.seq, r.sub)):
        got.setdefault(company(r.path), []).append(r.record)
    assert got == {k: rows for k, x in data.items() if (rows := records(x))}
    heads = {company(r.path): (r.head, r.broken) for r in found.heads.collect()}
    assert heads == {k: ((rows := records(x)) and rows[0] or None, rows is None) for k, x in data.items()}
    if cut_at == 64:
        assert found.records.select("path", "at").distinct().groupBy("path").count().agg(F.max("count")).first()[0] > 5


def test_many_ranges_and_large_headers_by_shuffle(spark, tree, cut_at, monkeypatch):
    if cut_at != 500:
        pytest.skip("one size will do")
    root, _ = tree
    want = Counter(map(tuple, files.score_rows(spark, root).collect()))
    monkeypatch.setattr(ranges, "MOST_RANGES", 0)
    monkeypatch.setattr(ranges, "MOST_BYTES", 0)
    assert Counter(map(tuple, files.score_rows(spark, root).collect())) == want and sum(want.values()) > 50


def test_scores_and_reasons(spark, tree, cut_at):
    import csv
    import io

    if cut_at == 64:
        pytest.skip("records are compared at that size")
    root, data = tree
    want = Counter()
    for name, x in data.items():
        rows = list(csv.reader(io.StringIO("\n".join(y.replace("\r\n", "\n").replace("\r", "\n") for y in records(x)), newline=""))) if records(x) else []
        if rows and "sentence_id" in rows[0]:
            for row in rows[1:]:
                for k, (h, c) in enumerate(zip(rows[0], row, strict=True)):
                    if k:
                        try:
                            want[name, int(row[0]), h, k, float(c)] += 1
                        except ValueError:
                            want[name, int(row[0]), h, k, None] += 1
    got = Counter((r.company, r.sentence_id, r.ref_key.replace("\r\n", "\n"), r.ord, r.score) for r in files.score_rows(spark, root).collect())
    assert got == want
    reasons = {(r.company, r.reason) for r in files.unusable_scores(spark, root).collect()}
    assert reasons == {("broken", "ends within quotes"), ("blank", "empty"), ("other", "no id column"), ("one", "no score column")}
    arrays = {(r.company, r.sentence_id): r.scores for r in files.score_arrays(spark, root, ["x", "nowhere", "sdg_1"]).where("sentence_id = 3").collect()}
    long = {(r.company, r.ref_key): r.score for r in files.score_rows(spark, root).where("sentence_id = 3").collect()}
    assert arrays and all(v == [long.get((c, "x")), None, long.get((c, "sdg_1"))] for (c, _), v in arrays.items())


def test_lines_keep_their_numbers(spark, tmp_path, cut_at):
    rng = random.Random(1)
    text = "\n".join("x" * rng.randrange(0, 90) + f" batch_job.id: j{k}" for k in range(40)) + "\n"
    (tmp_path / "log").write_text(text)
    got = sorted((r.line_no, r.value) for r in files.log_lines(spark, str(tmp_path / "log")).collect())
    assert got == list(enumerate(text.splitlines()))
    assert files.log_lines(spark, str(tmp_path / "none")).count() == 0


def test_years_in_three_forms(spark, tmp_path):
    for year in ("2020", "FY21"):
        p = tmp_path / "a" / year / "similarity_scores.csv"
        p.parent.mkdir(parents=True)
        p.write_text("sentence_id,x\n1,0.5\n")
    rows = lambda kind: {r.year for r in files.score_rows(spark, str(tmp_path), year=kind).collect()}
    assert rows("tolerant") == {2020, None} and rows("string") == {"2020", "FY21"}
    with pytest.raises(Exception, match="no year: FY21"):
        rows("strict")


def test_a_large_file_is_many_tasks(spark, tmp_path, monkeypatch):
    """Quoted cells over line ends in a file of many ranges, none of which reads it whole."""
    p = tmp_path / "big" / "2020" / "similarity_scores.csv"
    p.parent.mkdir(parents=True)
    with p.open("w") as f:
        f.write("sentence_id,a,note\n")
        for k in range(20_000):
            f.write(f'{k},0.{k % 100:02d},"line {k}\nand ""more"", of it\n"\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", 50_000)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        found = ranges.Files(spark, str(tmp_path), "*.csv")
        assert found.records.rdd.getNumPartitions() >= p.stat().st_size // 50_000
        rows = files.score_rows(spark, str(tmp_path)).where("ref_key = 'a'")
        assert rows.agg(F.count("*"), F.countDistinct("sentence_id"), F.round(F.sum("score"), 2)).first()[:] == (20_000, 20_000, round(200 * sum(k / 100 for k in range(100)), 2))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
