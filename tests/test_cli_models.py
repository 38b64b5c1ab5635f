import json

from lumenry import cli
from lumenry.sources import sinks


def test_learned_models_and_histograms(spark, tmp_path, capsys):
    """Models are learned, score reports with them, and coverage at any threshold comes from the histogram; wide files lead to the same table."""
    at = lambda x: str(tmp_path / x)
    for name, text in (("A", "the cat and the dog of the house"), ("B", "der Hund und die Katze des Hauses")):
        d = tmp_path / "texts" / name / "2020"
        d.mkdir(parents=True)
        (d / "results.txt").write_text(text)
        (d / "splits.json").write_text(json.dumps({"1": "no poverty", "2": "clean water for all"}))
    (tmp_path / "g.json").write_text(json.dumps({"1": "no poverty", "6": "clean water"}))
    (tmp_path / "ai.json").write_text(json.dumps({"robot": "Roboter"}))
    known = [("the bird and the house of a man", "en"), ("the dog of the house", "en"), ("das Haus und der Hund des Mannes", "de"), ("die Katze und der Vogel", "de")]
    spark.createDataFrame(known, "text string, lang string").write.parquet(at("known"))
    cli.main(["learn-language", at("known"), at("language")])
    assert "|de  |de   |2  |" in capsys.readouterr().out
    spark.createDataFrame([("no poverty anywhere",), ("clean water",), ("water for all",), ("robot poverty",)], "text string").write.parquet(at("corpus"))
    cli.main(["learn-encoder", at("corpus"), at("encoder"), "--dim", "8"])
    cli.main(["score", at("texts"), at("scores"), "--goals", at("g.json"), "--glossary", at("ai.json"), "--language", at("language"), "--encoder", at("encoder")])
    rows = {(r.company, r.sentence_id): r for r in spark.read.parquet(at("scores")).collect()}
    assert rows["A", 1].german is False and rows["B", 1].german is True and len(rows["B", 1].scores) == 4 and rows["A", 1].scores[0] == 1.0
    cli.main(["histogram", at("scores"), at("cube")])
    assert "|4   |" in capsys.readouterr().out
    cli.main(["coverage", at("cube"), "--thresholds", "0.9", "1.01"])
    said = capsys.readouterr().out
    assert "|A      |1.01 |2         |0       |" in said and "|A      |0.9  |2         |" in said
    sinks.write_wide_csv(spark.read.parquet(at("scores")).where("company = 'A'").select("company", "year", "sentence_id", "scores"), ["sdg_1", "sdg_6", "robot"], at("wide"))
    part = next((tmp_path / "wide" / "company=A" / "year=2020").glob("part-*"))
    target = tmp_path / "csv" / "A" / "2020" / "similarity_scores.csv"
    target.parent.mkdir(parents=True)
    target.write_bytes(part.read_bytes())
    cli.main(["import-scores", at("csv"), at("taken"), "--names", "sdg_1", "sdg_6", "robot"])
    assert {r.sentence_id: list(r.scores) for r in spark.read.parquet(at("taken")).collect()} == {k: list(r.scores) for (c, k), r in rows.items() if c == "A"}


def test_streams(spark, tmp_path, capsys):
    at = lambda x: str(tmp_path / x)
    for folder, name, lines in (("req", "r.txt", [{"custom_id": "1"}, {"custom_id": "2"}]), ("out", "batch_1.jsonl", [{"custom_id": "1", "response": {"status_code": 200, "body": {"choices": [{"message": {"content": "[1, True]"}}]}}}])):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / name).write_text("\n".join(map(json.dumps, lines)))
    cli.main(["track", at("req"), at("out"), at("history"), at("ck")])
    said = capsys.readouterr().out
    assert "|answered|false   |1  |" in said and "|waiting |false   |1  |" in said
    cli.main(["follow", at("jobs"), at("saved"), at("ck2"), "--client", "tests.test_files:Client", "--every", "0 seconds", "--seconds", "12"])
    assert "completed" in capsys.readouterr().out and (tmp_path / "saved" / "a.jsonl").exists()


def test_results_in_buckets(spark, tmp_path, capsys):
    from lumenry.operators import buckets, store

    (tmp_path / "out").mkdir()
    answer = lambda i, c: json.dumps({"custom_id": i, "response": {"status_code": 200, "body": {"choices": [{"message": {"content": c}}]}}})
    (tmp_path / "out" / "batch_1.jsonl").write_text("\n".join([answer("a", "[0, 3, True]"), *(answer(f"b{k}", "[1, True]") for k in range(20))]))
    cli.main(["load", str(tmp_path / "out"), "--buckets", str(tmp_path / "b")])
    assert "|batch_1 |21  |" in capsys.readouterr().out
    cli.main(["repair", "--buckets", str(tmp_path / "b")])
    assert "|1       |1      |" in capsys.readouterr().out
    rows = {r.custom_id: r.raw for r in buckets.BucketTable(spark, str(tmp_path / "b"), store.RESULTS).read().collect()}
    assert len(rows) == 21 and rows["a"] == "[0, False]" and rows["b3"] == "[1, True]"
