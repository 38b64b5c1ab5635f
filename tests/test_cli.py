import json

from lumenry import cli


def test_commands(spark, tmp_path, capsys):
    """Score, count, select, load, audit and repair, one after another."""
    for name, year, text in (("A", 2020, "the cat of in"), ("B", 2021, "der Hund und die Katze")):
        d = tmp_path / "texts" / name / str(year)
        d.mkdir(parents=True)
        (d / "results.txt").write_text(text)
        (d / "splits.json").write_text(json.dumps({"1": "no poverty", "2": "zzz"}))
    (tmp_path / "g.json").write_text(json.dumps({"1": "no poverty"}))
    (tmp_path / "ai.json").write_text(json.dumps({"robot": "Roboter"}))
    at = lambda x: str(tmp_path / x)
    cli.main(["score", at("texts"), at("scores"), "--goals", at("g.json"), "--glossary", at("ai.json")])
    cli.main(["score", at("texts"), at("scores"), "--goals", at("g.json"), "--glossary", at("ai.json")])  # nothing left to do
    assert spark.read.parquet(at("scores")).count() == 4
    cli.main(["counts", at("scores"), "--thresholds", "0.9"])
    assert "|0.9  |4     |2         |" in capsys.readouterr().out
    cli.main(["firms", at("scores"), "--zero"])
    capsys.readouterr()
    cli.main(["examples", at("scores"), at("texts"), "--goals", at("g.json"), "--glossary", at("ai.json")])
    assert "sentence 1: sdg_1 = 1.000" in capsys.readouterr().out
    cli.main(["glossary", at("ai.json"), "robots", at("kept"), "--threshold", "0.3"])
    assert "Roboter" in capsys.readouterr().out
    cli.main(["select", at("scores"), at("texts"), at("req"), "--threshold", "0.9", "--batch-lines", "1"])
    lines = [json.loads(r.value) for r in spark.read.text(at("req")).collect()]
    assert sorted(x["custom_id"] for x in lines) == ["task||1||A||2020", "task||1||B||2021"]
    cli.main(["tokens", at("texts"), at("tok")])
    (tmp_path / "out").mkdir()
    answer = lambda i, c: json.dumps({"custom_id": i, "response": {"status_code": 200, "body": {"choices": [{"message": {"content": c}}]}}})
    (tmp_path / "out" / "batch_1.jsonl").write_text(answer("task||1||A||2020", "[0, 3, True]") + "\n" + answer("task||1||B||2021", "[1, True]"))
    spark.sql("DROP TABLE IF EXISTS c_results")
    cli.main(["load", at("out"), "--table", "c_results"])
    capsys.readouterr()
    cli.main(["audit", "--from-table", "c_results", "--texts", at("texts")])
    assert "no poverty" in (said := capsys.readouterr().out) and "0 with other numbers" in said
    cli.main(["repair", "--table", "c_results"])
    assert {r.raw for r in spark.table("c_results").collect()} == {"[0, False]", "[1, True]"}
    cli.main(["sample", at("texts"), at("some"), "--n", "1"])
    assert len(list((tmp_path / "some").glob("*/*/results.txt"))) == 1
    spark.sql("DROP TABLE c_results")
