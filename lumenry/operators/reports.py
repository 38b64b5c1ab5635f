"""Counts, coverage and examples from score arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenry.functions.scores import any_at_least, best, bucket_label, is_high, is_low, usable


def threshold_counts(scored: DataFrame, thresholds: list[float], scores: str = "scores") -> DataFrame:
    """(theta, n_rows, n_selected) for each threshold, from one pass."""
    got = scored.agg(F.count("*").alias("n_rows"), *[F.count_if(any_at_least(F.col(scores), t)).alias(f"n{k}") for k, t in enumerate(thresholds)])
    rows = F.array(*[F.struct(F.lit(float(t)).alias("theta"), F.col("n_rows"), F.col(f"n{k}").alias("n_selected")) for k, t in enumerate(thresholds)])
    return got.select(F.inline(rows))


def coverage(scored: DataFrame, threshold: float, by: list[str], scores: str = "scores") -> DataFrame:
    """Per group: total_rows and selected, the rows with a score at the threshold."""
    return scored.groupBy(*by).agg(F.count("*").alias("total_rows"), F.count_if(any_at_least(F.col(scores), threshold)).alias("selected"))


def uncovered(counts: DataFrame) -> DataFrame:
    return counts.where("total_rows > 0 AND selected = 0")


def top(counts: DataFrame, by: str = "company", n: int = 10) -> DataFrame:
    return counts.orderBy(F.desc("selected"), by).limit(n)


def best_reference(scored: DataFrame, keys: list[str], scores: str = "scores") -> DataFrame:
    """Adds ref_key and score of the first greatest score."""
    place = best(F.col(scores))
    return scored.withColumns({"ref_key": F.get(F.array(*map(F.lit, keys)), place.cast("int") - 1), "score": F.array_max(usable(F.col(scores)))})


def examples(scored: DataFrame, keys: list[str], unit: list[str], low: float = 0.3, high: float = 0.5, most: int = 2, scores: str = "scores") -> DataFrame:
    """Up to `most` sentences (sentence_id, text not empty) of each unit: its first low one, its first high one, then others of either kind.

    Adds rank, bucket, ref_key and score.
    """
    s = F.col(scores)
    rows = scored.where(F.coalesce(F.col("text"), F.lit("")) != "").withColumns({"low": is_low(s, low, high), "high": is_high(s, high)}).where("low OR high")
    whole = Window.partitionBy(*unit)
    rows = rows.withColumns({"first_low": F.min(F.when(F.col("low"), F.col("sentence_id"))).over(whole), "first_high": F.min(F.when(F.col("high"), F.col("sentence_id"))).over(whole)})
    kind = F.when(F.col("sentence_id") == F.col("first_low"), 0).when(F.col("sentence_id") == F.col("first_high"), 1).otherwise(2)
    rows = rows.withColumn("kind", kind)
    rows = rows.withColumn("rank", F.row_number().over(whole.orderBy("kind", "sentence_id"))).where(F.col("rank") <= most)
    label = F.when(F.col("kind") == 0, F.lit(f"{low:g}<score<{high:g}")).when(F.col("kind") == 1, F.lit(f"score>={high:g}")).otherwise(bucket_label(s, low, high))
    return best_reference(rows.withColumn("bucket", label), keys, scores).drop("low", "high", "first_low", "first_high", "kind")


def reason_counts(answers: DataFrame) -> DataFrame:
    return answers.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def with_sentence(invalid: DataFrame, sentences: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the sentence of each row, `<sentence not found>` where it is missing or empty."""
    found = sentences.select(*keys, F.col("sentence").alias("_found"))
    return invalid.join(found, keys, "left").withColumn("sentence", F.coalesce(F.nullif(F.col("_found"), F.lit("")), F.lit("<sentence not found>"))).drop("_found")


def token_totals(reports: DataFrame, tokens) -> DataFrame:
    return reports.groupBy("company").agg(F.sum(tokens).alias("tokens"))


def example_lines(picked: DataFrame, unit: list[str]) -> DataFrame:
    """line: the unit, rank, bucket, sentence_id, reference and score to three places of each example, in order."""
    own = F.concat_ws("/", *[F.col(c).cast("string") for c in unit])
    return picked.select(*unit, "rank", F.format_string("%s #%d [%s] sentence %d: %s = %.3f", own, "rank", "bucket", "sentence_id", "ref_key", "score").alias("line"))


def selection_counts(scored: DataFrame, sentences: DataFrame, threshold: float, unit: list[str], keys: list[str], lines: int = 20_000, scores: str = "scores") -> DataFrame:
    """(selected, files, batches) from one pass over the scores: sentences that are chosen, units that were looked at (with or without a hit), files they fill."""
    chosen = F.coalesce(any_at_least(F.col(scores), threshold, single=True) & (F.col("sentence") != ""), F.lit(False))
    rows = scored.join(sentences.select(*keys, "sentence"), keys, "left")
    got = rows.agg(F.count_if(chosen).alias("selected"), F.countDistinct(*unit).alias("files"))
    return got.select("selected", "files", F.ceil(F.col("selected") / lines).alias("batches"))
