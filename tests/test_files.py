import json

import pytest
from pyspark.sql import functions as F

from lumenry.functions import providers
from lumenry.operators import store
from lumenry.plans import stages
from lumenry.sources import files, jobs, sinks
from lumenry.streaming import ingest


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("texts")

    def put(path, data):
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data) if isinstance(data, bytes) else p.write_text(data, encoding="utf-8")

    put("Acme Co/2020/results.txt", "the cat and the dog is of in")
    put("Acme Co/2020/splits.json", json.dumps({"10": "ten", "2": "two", "3": ""}))
    put("Büro/2021/results.txt", "der Hund und die Katze ist nicht")
    put("Büro/2021/old_results.txt", "x")
    put("Büro/2021/splits.json", "{}")
    return str(root)


def test_trees(spark, tree):
    texts = {(r.company, r.year, r.path.rsplit("/", 1)[1]) for r in files.report_texts(spark, tree).collect()}
    assert ("Büro", 2021, "old_results.txt") in texts and ("Acme Co", 2020, "results.txt") in texts
    rows = files.sentences(spark, tree).orderBy("sentence_id").collect()
    assert [(r.company, r.sentence_id, r.sentence) for r in rows] == [("Acme Co", 2, "two"), ("Acme Co", 3, ""), ("Acme Co", 10, "ten")]
    assert files.folders(spark, tree).count() == 2


def test_undecodable_bytes(spark, tmp_path):
    p = tmp_path / "Cut" / "2019" / "results.txt"
    p.parent.mkdir(parents=True)
    p.write_bytes(b"ok \xff\xfe end")
    assert {r.text for r in files.lenient_texts(spark, str(tmp_path)).collect()} == {"ok  end"}
    with pytest.raises(Exception, match="UTF-?8"):
        files.report_texts(spark, str(tmp_path)).collect()


def test_wide_scores_round_trip(spark, tmp_path):
    keys = ["sdg_1.1", "Deep Learning", "deep learning", "Test, and (TEVV) ", 'say "x"']
    rows = spark.createDataFrame([("c", 2020, 1, [0.1, 0.25, 0.5, 1.0, None]), ("c", 2020, 10, [0.0, -0.5, 0.3, 0.2, 0.9]), ("d", 2021, 1, [0.0] * 5)], "company string, year int, sentence_id long, scores array<double>")
    sinks.write_wide_csv(rows, keys, str(tmp_path / "w"))
    for company, year in (("c", 2020), ("d", 2021)):
        part = next((tmp_path / "w" / f"company={company}" / f"year={year}").glob("part-*"))
        target = tmp_path / "csv" / company / str(year) / "similarity_scores.csv"
        target.parent.mkdir(parents=True)
        target.write_bytes(part.read_bytes())
    got = {(r.company, r.sentence_id, r.ref_key): r.score for r in files.score_rows(spark, str(tmp_path / "csv")).collect()}
    assert len(got) == 15 and got["c", 10, "Deep Learning"] == -0.5 and got["c", 1, "deep learning"] == 0.5 and got["c", 1, "Test, and (TEVV) "] == 1.0 and got["c", 1, 'say "x"'] is None


def test_score_files_with_odd_cells(spark, tmp_path):
    p = tmp_path / "c" / "2020" / "a.csv"
    p.parent.mkdir(parents=True)
    p.write_text("sentence_id,sdg_1,x\n1,,abc\n2,0.5,NaN\n")
    (p.parent / "b.csv").write_text("other,sdg_1\n1,2\n")
    got = {(r.sentence_id, r.ref_key): r.score for r in files.score_rows(spark, str(tmp_path)).collect()}
    assert got == {(1, "sdg_1"): None, (1, "x"): None, (2, "sdg_1"): 0.5, (2, "x"): None}


def test_dictionary_last_value_wins(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"b": "1", "a": "2"}')
    assert [(r.key, r.value) for r in files.dictionary(spark, str(tmp_path / "d.json")).orderBy("ord").collect()] == [("b", "1"), ("a", "2")]


def line(cid, content, status=200):
    return json.dumps({"custom_id": cid, "response": {"status_code": status, "body": {"choices": [{"message": {"content": content}}]}}})


@pytest.fixture
def outputs(tmp_path):
    folder = tmp_path / "out"
    folder.mkdir()
    (folder / "batch_1.jsonl").write_text("\n".join([line("1", "[1, True]"), "", "{bad", line("", "x"), line(None, "x"), line("2", "[3]", 500), line("3", [{"text": "[0, False]"}])]))
    (folder / "batch_10.jsonl").write_text(line("1", "[2, True]") + "\n" + line("4", "[0, 3, True]"))
    (folder / "note.txt").write_text(line("9", "x"))
    return str(folder)


def test_responses(spark, outputs):
    got = {(r.custom_id, r.content, r.batch_id) for r in files.responses(spark, outputs).collect()}
    assert got == {("1", "[1, True]", "batch_1"), ("3", "[0, False]", "batch_1"), ("1", "[2, True]", "batch_10"), ("4", "[0, 3, True]", "batch_10")}
    assert files.responses(spark, outputs, audit=True).count() == 7


def test_stream_ingest_takes_each_id_once(spark, outputs, tmp_path):
    spark.sql("DROP TABLE IF EXISTS s_results")
    store.create(spark, "s_results")
    for _ in range(2):
        ingest.ingest(ingest.response_stream(spark, outputs), "s_results", str(tmp_path / "ck")).awaitTermination()
    got = {r.custom_id: (r.sdgs, r.raw) for r in spark.table("s_results").collect()}
    assert got == {"1": ([1], "[1, True]"), "3": ([], "[0, False]"), "4": ([], "[0, 3, True]")}
    fixes = stages.repairs(spark.table("s_results"))
    store.replace(store.updated(spark.table("s_results"), fixes), "s_results")
    assert {r.raw for r in spark.table("s_results").where("custom_id = '4'").collect()} == {"[0, False]"}
    spark.sql("DROP TABLE s_results")


def test_log(spark, tmp_path):
    from lumenry.operators.batching import logged_ids

    (tmp_path / "log").write_text("x\nbatch_job.id: b_1 y\nbatch_job.id: a-2\nbatch_job.id: b_1\n")
    assert [(r.id, r.line_no) for r in logged_ids(files.log_lines(spark, str(tmp_path / "log"))).orderBy("line_no").collect()] == [("b_1", 1), ("a-2", 2)]
    assert logged_ids(files.log_lines(spark, str(tmp_path / "none"))).count() == 0


class Client:
    """A batch service in memory."""

    known = {"a": {"id": "a", "status": "completed", "created_at": 5, "endpoint": "/e", "output_file_id": "f", "request_counts": {"total": 3, "completed": 2, "failed": 1}}, "b": {"id": "b", "status": "in_progress"}}

    def jobs(self, limit):
        return list(self.known.values())[:limit]

    def job(self, job_id):
        return self.known[job_id]

    def output(self, file_id):
        return b"one\ntwo \xff\n"

    def submit(self, lines, key):
        return {"id": f"job-{len(lines)}"}


def test_jobs(spark, tmp_path):
    listed = {r.id: r for r in jobs.job_table(spark, Client()).collect()}
    assert listed["a"].request_counts.completed == 2 and listed["b"].request_counts is None
    found = jobs.looked_up(spark.createDataFrame([("a",), ("zz",)], "id string"), Client())
    assert {r.id: r.status for r in found.collect()} == {"a": "completed", "zz": "ERROR"}
    assert [r.value for r in jobs.downloaded(found, Client()).collect()] == ["one", "two �"]
    at = lambda x: str(tmp_path / x)
    rows = spark.createDataFrame([("c", 2020, k, f"é{k}") for k in range(3)], "company string, year int, sentence_id int, request string")
    sinks.write_requests(rows, ["company", "year", "sentence_id"], at("r"), 2)
    (tmp_path / "log").write_text("earlier line\n")
    assert jobs.submitted(spark, at("r"), Client(), at("log")) == [(0, "job-2"), (1, "job-1")]
    assert jobs.submitted(spark, at("r"), Client(), at("log")) == []  # the log has them
    assert (tmp_path / "log").read_text().startswith("earlier line\nbatch 0 ") and (tmp_path / "log").read_text().count("batch_job.id: job-") == 2
    assert jobs.save_outputs(spark, found, Client(), at("out")) == [("a", 2)] and (tmp_path / "out" / "a.jsonl").read_text() == "one\ntwo \ufffd\n"


def test_remote_commands(spark, tmp_path, capsys):
    from lumenry import cli

    (tmp_path / "log").write_text("batch_job.id: a\nbatch_job.id: nope\n")
    at = lambda x: str(tmp_path / x)
    cli.main(["status", "--log", at("log"), "--client", "tests.test_files:Client"])
    out = capsys.readouterr().out
    assert "ERROR" in out and "OVERALL" in out
    cli.main(["status", "--client", "tests.test_files:Client"])
    assert "in_progress" in capsys.readouterr().out
    cli.main(["poll", at("log"), at("out"), "--client", "tests.test_files:Client"])
    assert (tmp_path / "out" / "a.jsonl").exists()
    rows = spark.createDataFrame([("c", 2020, 1, "x")], "company string, year int, sentence_id int, request string")
    sinks.write_requests(rows, ["sentence_id"], at("r"))
    cli.main(["submit", at("r"), at("log"), "--client", "tests.test_files:Client"])
    assert "job-1" in (tmp_path / "log").read_text()


def test_odd_files(spark, tmp_path):
    """Records over line ends, files that give nothing, folders without files, U+FFFD that stands in a file, years that are none."""
    for name, text in (("a", 'sentence_id,"two\nlines"\n1,0.5\n'), ("b", "x,y\n1,2\n"), ("c", "\n"), ("d", "sentence_id\n1\n")):
        p = tmp_path / "csv" / name / "2020" / "similarity_scores.csv"
        p.parent.mkdir(parents=True)
        p.write_text(text)
    assert [(r.company, r.ref_key, r.score) for r in files.score_rows(spark, str(tmp_path / "csv")).collect()] == [("a", "two\nlines", 0.5)]
    assert {(r.company, r.reason) for r in files.unusable_scores(spark, str(tmp_path / "csv")).collect()} == {("b", "no id column"), ("c", "empty"), ("d", "no score column")}
    (tmp_path / "csv" / "e" / "xx").mkdir(parents=True)
    found = files.folders(spark, str(tmp_path / "csv"))
    assert ("e", "xx") in {tuple(r) for r in found.collect()} and found.count() == 5
    assert {r.year for r in files.with_year(found).collect()} == {2020, None} and {r.year for r in files.with_year(found, "string").collect()} == {"2020", "xx"}
    with pytest.raises(Exception, match="no year: xx"):
        files.with_year(found, "strict").collect()
    p = tmp_path / "texts" / "f" / "2020" / "results.txt"
    p.parent.mkdir(parents=True)
    p.write_bytes("a\ufffdb".encode() + b"\xff.")
    assert files.lenient_texts(spark, str(tmp_path / "texts")).first().text == "a\ufffdb."
    with pytest.raises(FileNotFoundError):
        files.lenient_texts(spark, str(tmp_path / "texts" / "f"))


def test_models_behind_protocols(spark, monkeypatch):
    import tiktoken

    df = spark.createDataFrame([("ok",), ("bad",), (None,)], "t string")

    def make():
        def ask(text, most):
            if text == "bad":
                raise RuntimeError
            return f"[{len(text)}, True] {most}"

        return ask

    assert [r.a for r in df.select(providers.classified(F.col("t"), make).alias("a")).collect()] == ["[2, True] 50", None, None]
    assert providers.device(lambda kind: kind == "mps") == "mps" and providers.device() == "cpu"
    known = {"o": "by encoding", "m": "by model", providers.DEFAULT_ENCODING: "default"}
    used = []

    class Encoding:
        def __init__(self, name):
            self.name = name

        def encode(self, text, disallowed_special):
            used.append(known[self.name])
            return text.split()

    def find(names, error):
        def get(name):
            if name not in names:
                raise error(name)
            return Encoding(name)

        return get

    monkeypatch.setattr(tiktoken, "get_encoding", find({"o", providers.DEFAULT_ENCODING}, ValueError))
    monkeypatch.setattr(tiktoken, "encoding_for_model", find({"m"}, KeyError))
    assert [providers.named_counter(x)()("a b") for x in ("o", "m", "zz")] == [2, 2, 2] and used == ["by encoding", "by model", "default"]


def test_skipped_units_and_objects(spark, tmp_path):
    one = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k string")
    assert {tuple(r) for r in stages.skipped(one("a", "b", "c"), one("a", "b"), one("a"), ["k"]).collect()} == {("b", "no scores"), ("c", "no sentences")}
    sinks.write_object(one("é", "x"), str(tmp_path / "o"))
    text = next((tmp_path / "o").glob("part-*")).read_text()
    assert json.loads(text) == [{"k": "é"}, {"k": "x"}] and text.count("\n") > 4 and "é" in text


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("c", 2020, k, f"é{k}") for k in range(5)], "company string, year int, sentence_id int, request string")
    assert sinks.write_requests(rows, ["company", "year", "sentence_id"], str(tmp_path / "r"), 2) == 3
    assert [x.value for x in spark.read.text(str(tmp_path / "r" / "batch_no=1")).collect()] == ["é2", "é3"]
    scored = rows.select("company", "year", "sentence_id")
    sinks.write_scores(scored, str(tmp_path / "s"))
    sinks.write_scores(scored.withColumn("year", F.lit(2021)), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 10
    assert sinks.unfinished(spark.createDataFrame([("c", 2020), ("d", 1)], "company string, year int"), scored, ["company", "year"]).collect()[0].company == "d"
    (tmp_path / "a").write_text("1")
    assert sinks.copy_if_exists(spark, str(tmp_path / "a"), str(tmp_path / "b")) and (tmp_path / "b").read_text() == "1"
    (tmp_path / "a").write_text("2")
    sinks.copy_if_exists(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert (tmp_path / "b").read_text() == "1" and not sinks.copy_if_exists(spark, str(tmp_path / "no"), str(tmp_path / "b"))
    sinks.copy_if_exists(spark, str(tmp_path / "a"), str(tmp_path / "b"), True)
    assert (tmp_path / "b").read_text() == "2"
    sinks.write_manifest(spark.createDataFrame([("x", "", "y")], "k string, dest_results string, dest_splits string"), str(tmp_path / "m"))
    assert "x\t\ty" in next((tmp_path / "m").glob("part-*")).read_text()


def test_score_select_request(spark, tree, tmp_path):
    """From report folders to request lines, by the offline models."""
    (tmp_path / "g.json").write_text(json.dumps({"1": "ten", "2": "no such thing"}))
    (tmp_path / "d.json").write_text(json.dumps({"1.1": "two"}))
    (tmp_path / "ai.json").write_text(json.dumps({"robot": "Roboter"}))
    encoder, detector = providers.hashing_encoder(), providers.word_detector()
    refs = {g: stages.references(spark, [str(tmp_path / "g.json"), str(tmp_path / "d.json")], str(tmp_path / "ai.json"), g, encoder) for g in (False, True)}
    assert [r.ref_key for r in refs[True].orderBy("ord").collect()] == ["sdg_1", "sdg_2", "sdg_1.1", "Roboter", "robot"]
    reports, sentences = files.report_texts(spark, tree, "results.txt"), files.sentences(spark, tree)
    scored = stages.score_reports(reports, sentences, refs, detector, encoder)
    rows = {r.sentence_id: r for r in scored.collect()}
    assert len(rows) == 3 and not rows[2].german and len(rows[2].scores) == 4 and rows[10].max_sdg == 1.0
    out = stages.requests(scored, sentences, 0.9, "m").collect()
    assert sorted(r.custom_id for r in out) == ["task||10||Acme Co||2020", "task||2||Acme Co||2020"]
    assert json.loads(out[0].request)["body"]["messages"][1]["content"] in ("ten", "two")


def test_detectors(spark):
    df = spark.createDataFrame([("der Hund und die Katze",), ("the cat of",), ("",), (None,)], "t string")
    assert [r.g for r in df.select(providers.is_german(F.col("t"), providers.word_detector()).alias("g")).collect()] == [True, False, False, False]
    assert [r.n for r in df.select(providers.token_count(F.col("t"), providers.piece_counter()).alias("n")).collect()] == [5, 3, 0, 0]


def test_thresholds_reach_the_scan(spark, tmp_path):
    from lumenry.operators.scoring import with_maxima

    rows = spark.createDataFrame([("c", 2020, 1, [0.1, 0.7])], "company string, year int, sentence_id long, scores array<double>")
    sinks.write_scores(with_maxima(rows, sdg=F.col("scores")), str(tmp_path / "s"))
    plan = spark.read.parquet(str(tmp_path / "s")).where("max_sdg >= 0.5 AND year = 2020").select("sentence_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(max_sdg,0.5)" in plan and "PartitionFilters: [isnotnull(year" in plan and "scores" not in plan.split("ReadSchema")[1]
