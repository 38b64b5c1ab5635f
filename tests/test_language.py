"""The language model against the same sums in plain Python, and on texts it hasn't seen."""

import math
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumenry.functions import language

SF = "/root/testdata/sf0.01"
TEXTS = [("the cat and the dog", "en"), ("THE bird 😀😀 sang", "en"), ("der Hund und die Katze", "de"), ("für Österreich", "de"), ("le chat et la souris", "fr"), ("", "fr"), (None, "de"), ("lost", None), ("ab", "en")]


def classes(text):
    points = [63 if ord(c) > 0xFFFF else ord(c) for c in (text or "").translate({c: c + 32 for c in range(65, 91)})]
    return [(a * language.FIRST + b * language.SECOND + c) % language.BUCKETS for a, b, c in zip(points, points[1:], points[2:])]


def brute(rows, asked):
    known = [(t, g) for t, g in rows if g is not None]
    found = {g: Counter() for _, g in known}
    for t, g in known:
        found[g].update(classes(t))
    weight = lambda p: round(1000 * math.log(p))
    out = []
    for t in asked:
        best = None
        for g in sorted(found):
            size = found[g].total() + language.BUCKETS
            s = weight(sum(x == g for _, x in known) / len(known)) + sum(weight((found[g][c] + 1) / size) for c in classes(t))
            if best is None or s > best[0]:
                best = s, g
        out.append(best[1])
    return out


def test_sums(spark, tmp_path):
    df = spark.createDataFrame(TEXTS, "text string, lang string")
    got = Counter((r.lang, r.bucket, r.n) for r in language.counts(df).collect())
    want = Counter((g, c) for t, g in TEXTS if g for c in classes(t)) + Counter((g, None) for _, g in TEXTS if g)
    assert got == Counter((g, c, n) for (g, c), n in want.items())
    model = language.learn(df)
    model.saved(spark, str(tmp_path / "m"))
    asked = [t for t, _ in TEXTS] + ["the hund", "Katze", "xx", "aaa"]
    for m in (model, language.opened(spark, str(tmp_path / "m"))):
        rows = spark.createDataFrame(list(enumerate(asked)), "k int, t string").select("k", m.language(F.col("t")).alias("g")).orderBy("k").collect()
        assert [r.g for r in rows] == brute(TEXTS, asked)
    with pytest.raises(ValueError):
        language.learn(df.where("lang is null"))


def test_ties_go_to_the_first(spark):
    df = spark.createDataFrame([("same text", "b"), ("same text", "a")], "text string, lang string")
    assert {r.g for r in df.select(language.learn(df).language(F.col("text")).alias("g")).collect()} == {"a"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_texts(spark):
    """Learned on four fifths of the documents, the language of the others is found; copies stay on one side."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) >= 100").withColumn("fold", F.crc32("text") % 5)
    model = language.learn(docs.where("fold < 4"))
    rows = language.held_out(docs.where("fold = 4"), model).collect()
    right, total = sum(r.n for r in rows if r.lang == r.found), sum(r.n for r in rows)
    assert total > 100 and right / total >= 0.95


def test_it_stays_an_expression(spark):
    model = language.learn(spark.createDataFrame(TEXTS, "text string, lang string"))
    plan = spark.range(1).select(model.is_german(F.col("id").cast("string")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
