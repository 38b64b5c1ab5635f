"""The engine's three ways through: score reports, select and request, load and repair answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lumenry.functions import providers
from lumenry.functions.answers import answered
from lumenry.functions.language import Model
from lumenry.functions.lineage import cut
from lumenry.functions.scores import any_at_least
from lumenry.functions.text import custom_id, request
from lumenry.operators.references import goal_order, merged
from lumenry.operators.scoring import reference_table, with_maxima, with_scores
from lumenry.sources import files


def references(spark: SparkSession, goals: list[str], glossary: str, german: bool, encoder: Callable) -> DataFrame:
    """(ref_key, kind, vec, ord): goals in number order, then glossary terms by code point. For German reports the glossary's German names join the English ones."""
    base = files.dictionary(spark, goals[0])
    for path in goals[1:]:
        more = files.dictionary(spark, path).withColumn("ord", F.col("ord") + 1000)
        base = merged(base.withColumn("value", F.struct("value", "ord")), more.withColumn("value", F.struct("value", "ord"))).select("key", "value.*")
    sdg = goal_order(base).select(F.col("column").alias("ref_key"), F.lit("sdg").alias("kind"), F.col("value").alias("text"), F.col("place").alias("n"))
    terms = files.dictionary(spark, glossary)
    names = terms.select("key").union(terms.select("value")).distinct() if german else terms.select("key")
    ai = names.select(F.col("key").alias("ref_key"), F.lit("ai").alias("kind"), F.col("key").alias("text"), F.lit(0).alias("n"))
    both = sdg.unionByName(ai)
    vectors = both.select("text").distinct().withColumn("vec", providers.embedded(F.col("text"), encoder))  # equal texts are embedded once
    place = F.struct(F.col("kind") == "ai", "n", "ref_key")
    return both.join(vectors, "text").select("ref_key", "kind", "vec", place.alias("ord"))


def score_reports(reports: DataFrame, sentences: DataFrame, refs: dict[bool, DataFrame], detector: Callable | Model, encoder: Callable) -> DataFrame:
    """(company, year, sentence_id, german, scores, max_sdg, max_ai): sentences of reports against the references of their language, which a learned model or a detector tells."""
    german = detector.is_german(F.substring("text", 1, 10_000)) if isinstance(detector, Model) else providers.is_german(F.col("text"), detector)
    routed = cut(reports.select("company", "year", german.alias("german")))
    rows = sentences.join(routed, ["company", "year"]).withColumn("vec", providers.embedded(F.col("sentence"), encoder))
    out = None
    for german, r in refs.items():
        keys, matrix = reference_table(r)
        goals = sum(1 for k in keys if k.startswith("sdg_"))
        scored = with_scores(rows.where(F.col("german") == german).select("company", "year", "sentence_id", "german", "vec"), matrix)
        scored = with_maxima(scored, sdg=F.slice("scores", 1, goals), ai=F.slice("scores", F.lit(goals + 1), F.size("scores")))
        out = scored if out is None else out.unionByName(scored)
    return out


def requests(scored: DataFrame, sentences: DataFrame, threshold: float, model: str) -> DataFrame:
    """(company, year, sentence_id, custom_id, request) of sentences that aren't empty and have a score at the threshold."""
    chosen = scored.where(any_at_least(F.col("scores"), threshold, single=True)).select("company", "year", "sentence_id")
    rows = chosen.join(sentences.select("company", "year", "sentence_id", "sentence"), ["company", "year", "sentence_id"]).where("sentence <> ''")
    rows = rows.withColumn("custom_id", custom_id(F.col("sentence_id"), F.col("company"), F.col("year")))
    return rows.select("company", "year", "sentence_id", "custom_id", request(F.col("custom_id"), F.col("sentence"), model).alias("request"))


def load_answers(responses: DataFrame) -> DataFrame:
    """Rows of the results table from (custom_id, content, batch_id)."""
    rows = answered(responses.withColumnRenamed("content", "raw"))
    return rows.select("custom_id", "answer.sdgs", "answer.is_ai", "raw", "batch_id")


def repairs(results: DataFrame) -> DataFrame:
    """(custom_id, new_raw, new_sdgs, new_ai) of the results that a repair changes."""
    return answered(results.select("custom_id", "raw")).where("answer.changed").select("custom_id", "answer.new_raw", "answer.new_sdgs", "answer.new_ai")


def repaired(results: DataFrame, seen: Observation | None = None) -> DataFrame:
    """The results with every repair in place, in one projection over each row. `seen` counts rows, repairs and invalid answers in the pass that uses the result, which then needs no second look."""
    fixed = answered(results)
    if seen is not None:
        changed = F.count_if(F.col("answer.changed")).alias("changed")
        fixed = fixed.observe(seen, F.count(F.lit(1)).alias("rows"), changed, F.count_if(F.col("answer.reason").isNotNull()).alias("invalid"))
    new = {"raw": "new_raw", "sdgs": "new_sdgs", "is_ai": "new_ai"}
    return fixed.select(*[F.when(F.col("answer.changed"), F.col(f"answer.{new[c]}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in results.columns])


def skipped(units: DataFrame, sentences: DataFrame, scored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, reason) of units that give nothing: without sentences, or with sentences but no scores."""
    have = lambda df: df.select(*keys).distinct()
    bare = units.select(*keys).distinct().join(have(sentences), keys, "left_anti").withColumn("reason", F.lit("no sentences"))
    unscored = units.select(*keys).distinct().join(have(sentences), keys, "left_semi").join(have(scored), keys, "left_anti").withColumn("reason", F.lit("no scores"))
    return bare.unionByName(unscored)
