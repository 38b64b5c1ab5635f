import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenry.functions import scores as S
from lumenry.functions import text as X
from lumenry.operators import batching, references, reports, sampling, scoring, store

NAN = float("nan")


@pytest.fixture(scope="module")
def scored(spark):
    rows = [("a", 1, 1, [0.9, 0.1], "t1"), ("a", 1, 2, [0.3, 0.2], "t2"), ("a", 1, 3, [0.5, 0.5], "t3"), ("a", 1, 4, [0.4, 0.4], ""), ("b", 1, 1, [NAN, None], "u"), ("b", 1, 2, None, "v"), ("c", 2, 5, [], "w"), ("c", 2, 6, [0.45, 0.1], "z")]
    return spark.createDataFrame(rows, "company string, year int, sentence_id long, scores array<double>, text string")


def test_predicates(scored):
    s = F.col("scores")
    got = {(r.company, r.sentence_id): tuple(r)[2:] for r in scored.select("company", "sentence_id", S.any_at_least(s, 0.5), S.is_low(s), S.is_high(s), S.best(s)).collect()}
    assert got["a", 1] == (True, True, True, 1)  # 0.9 above the low mark, 0.1 below the high one
    assert got["a", 2] == (False, False, False, 1)
    assert got["a", 3] == (True, False, True, 1)  # the first of equal ones
    assert got["b", 1] == (False, False, False, None) and got["b", 2] == (False, False, False, None) and got["c", 5] == (False, False, False, None)


def test_counts_and_coverage(scored):
    got = {r.theta: (r.n_rows, r.n_selected) for r in reports.threshold_counts(scored, [0.5, 0.3]).collect()}
    assert got == {0.5: (8, 2), 0.3: (8, 5)}
    cover = reports.coverage(scored, 0.5, ["company"])
    assert {r.company for r in reports.uncovered(cover).collect()} == {"b", "c"}
    assert [r.company for r in reports.top(cover, n=2).collect()] == ["a", "b"]


def test_examples(scored):
    rows = reports.examples(scored, ["x", "y"], ["company", "year"]).orderBy("company", "rank").collect()
    assert [(r.company, r["rank"], r.sentence_id, r.bucket, r.ref_key) for r in rows] == [("a", 1, 1, "0.3<score<0.5", "x"), ("a", 2, 3, "score>=0.5", "x"), ("c", 1, 6, "0.3<score<0.5", "x")]


def test_rounding_is_half_even_and_before_thresholds(spark):
    got = spark.createDataFrame([(0.125,), (0.135,), (-0.001,), (0.495001,)], "x double").select(S.rounded(F.col("x")).alias("y")).collect()
    assert [r.y for r in got] == [0.12, 0.14, 0.0, 0.5] and math.copysign(1, got[2].y) == 1


def test_matrix_scores_equal_native(spark):
    rng = np.random.default_rng(1)
    vectors, refs = rng.normal(size=(50, 8)), rng.normal(size=(5, 8))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)] + [(99, None)], "id int, vec array<float>").repartition(3)
    keys, m = scoring.reference_table(spark.createDataFrame([(f"r{k}", v.tolist(), k) for k, v in enumerate(refs)], "ref_key string, vec array<float>, ord int"))
    rows = {r.id: r.scores for r in scoring.with_scores(df, m).collect()}
    assert keys == [f"r{k}" for k in range(5)] and rows[99] is None
    for k, v in enumerate(vectors.astype(np.float32).astype(float)):
        assert np.allclose(rows[k], v @ m.T, atol=0.00501)


def test_goal_order_with_ties(spark):
    keys = ["1", "2", "11", "1.1", "x", "12", "1.2"]
    got = references.goal_order(spark.createDataFrame(list(zip(keys, range(7), strict=True)), "key string, ord int")).orderBy("place").collect()
    assert [r.key for r in got] == ["x", "1", "2", "11", "1.1", "12", "1.2"] and got[1]["column"] == "sdg_1"


def test_column_sets(spark):
    columns = spark.createDataFrame([("Deep Learning", 0), ("deep learning", 1), ("Other", 2)], "name string, ord int")
    allowed = spark.createDataFrame([("deep learning",)], "term string")
    assert [r.name for r in references.resolve_columns(columns, allowed).collect()] == ["deep learning"]
    assert [r.ord for r in references.resolve_columns(columns, allowed, exact=True).collect()] == [1]
    names = references.terms((spark.createDataFrame([(["a ", " ", "b"],)], "v array<string>"), F.col("v")), (spark.createDataFrame([("b",), (None,)], "v string"), F.col("v")))
    assert {r.term for r in names.collect()} == {"a", "b"}


def test_custom_ids(spark):
    rows = spark.createDataFrame([("task||07||c||2020",), ("a||b||c",), ("task||1||c||2||more",), (None,)], "v string").select(X.custom_id_parts(F.col("v")).alias("p")).collect()
    assert [tuple(r.p) for r in rows] == [("07", "c", "2020"), (None,) * 3, ("1", "c", "2"), (None,) * 3]


def test_content_kinds(spark):
    body = lambda content: '{"custom_id":"i","response":{"status_code":200,"body":{"choices":[{"message":{"content":%s}}]}}}' % content  # noqa: E731, UP031
    lines = [body('"[1, True]"'), body('[{"text":"x"}]'), body('""'), body("null"), body("[]"), body("5"), body('[{"text":3}]'), body('"a"').replace("200", "500"), "{bad", "", '{"response":{"status_code":200,"body":{"choices":[]}}}']
    got = [r.c for r in spark.createDataFrame([(x,) for x in lines], "v string").select(X.content(F.col("v")).alias("c")).collect()]
    assert got == ["[1, True]", "x", "", None, None, None, None, None, None, None, None]


@pytest.mark.parametrize(("n", "files"), [(0, 0), (6, 2), (7, 3)])
def test_rotation(spark, n, files):
    rows = batching.rotated(spark.range(n).repartition(4), ["id"], 3).collect()
    assert {r.id: r.batch_no for r in rows} == {k: k // 3 for k in range(n)} and len({r.batch_no for r in rows}) == files


def test_job_status(spark):
    raw = spark.createDataFrame([("a", "completed", (5, 6, 1)), ("b", "in_progress", None), ("c", "ERROR", (9, 0, 0)), ("d", "in_progress", (4, 1, None))], "id string, status string, request_counts struct<total:int,completed:int,failed:int>")
    got = {r.id: r for r in batching.status(raw.select("id", "status", *batching.job_counts("request_counts"))).collect()}
    assert (got["a"].remain, got["b"].remain, got["d"].remain) == (0, 0, 3)
    assert (got["OVERALL"].total, got["OVERALL"].completed, got["OVERALL"].failed, got["OVERALL"].remain) == (9, 7, 1, 1)
    assert batching.status_lines(batching.status(raw.select("id", "status", *batching.job_counts("request_counts")))).where("line like 'a %'").first().line.endswith("      5       6       1       0")


def test_samples_repeat(spark):
    df = spark.range(100).withColumn("kind", F.when(F.col("id") % 2 == 0, "z").otherwise("y"))
    assert [r.id for r in sampling.sample(df, "id", 7).collect()] == [r.id for r in sampling.sample(df.repartition(5), "id", 7).collect()]
    assert sampling.sample(df, "id", 1000).count() == 100
    assert sampling.sample_of(df, "kind", "z", "id", 3).count() == 53


def test_store(spark):
    spark.sql("DROP TABLE IF EXISTS t_results")
    store.create(spark, "t_results")
    rows = spark.createDataFrame([("1", [1, 5], True, "r", "b"), ("2", [], None, "r", "b"), ("3", None, None, None, "b"), ("4", [2, 2], False, "r", "b")], store.RESULTS)
    store.append(rows, "t_results")
    with pytest.raises(ValueError, match="twice"):
        store.append(rows.limit(1), "t_results")
    store.create_view(spark, "t_results", "t_exploded")
    assert sorted((r.custom_id, r.sdg) for r in spark.table("t_exploded").collect()) == [("1", 1), ("1", 5), ("4", 2), ("4", 2)]
    updates = spark.createDataFrame([("1", "n", None, None), ("9", "x", [], True)], "custom_id string, new_raw string, new_sdgs array<int>, new_ai boolean")
    store.replace(store.updated(spark.table("t_results"), updates), "t_results")
    got = {r.custom_id: (r.raw, r.sdgs, r.is_ai) for r in spark.table("t_results").collect()}
    assert len(got) == 4 and got["1"] == ("n", None, None) and got["4"] == ("r", [2, 2], False)
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):  # a write that fails leaves the table as it is
        store.replace(spark.table("t_results").withColumn("raw", (F.lit(1) / F.lit(0)).cast("string")), "t_results")
    assert spark.table("t_results").count() == 4
    store.compact(spark, "t_results")
    assert spark.table("t_results").count() == 4 and len(spark.table("t_results").inputFiles()) == 1
    spark.sql("DROP TABLE t_results")
