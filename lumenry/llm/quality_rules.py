"""Quality rules: an ordered decision list learned by sequential covering.

Every figure of a text is a native expression. Rules are conjunctions of thresholds on these figures; they are
grown by information gain and pruned on a held-out third of the labelled rows that pass the base rule, from counts that Spark
aggregates by (figure, bin). The driver sees those counts only, at most figures x (TOP x GRID + 1) rows. A threshold lies midway
between the values on its two sides.

Null texts count as empty. A text without words has all figures 0 and fails the base rule. Rows that repeat are
judged alike, each by its own text; an empty table gives an empty result; input columns that share a name with a
figure are replaced in `annotate` and never read. Labels that are null are left out; without labels of both
classes the list is empty and the base rule alone decides.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenry.llm.common import SPACE, WORD, ids_sent, settle, text_of

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the learned thresholds compare; each is null-free.
FIGURES = ("symbol_rate", "dup_line_rate", "repeat_rate", "mean_length", "capital_rate", "sentence_rate", "line_words")
#: Bins to one unit of a figure, and the value from which all share the last bin.
GRID, TOP = 1000, 64


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the base counts (long) and `_` columns for the learner's figures, beside all its own columns."""
    drop = [c for c in docs.columns if c.lower() in {*BASE, *FIGURES} or c.startswith("_q_")]
    t, n = F.col("_q_text"), F.col("_q_n")
    df = docs.drop(*drop).withColumn("_q_text", text_of(text))
    df = df.withColumns(
        {
            "_q_words": F.regexp_extract_all(t, F.lit(WORD), F.lit(0)),
            "_q_lines": F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD)),
            "word_chars": F.length(F.regexp_replace(t, SPACE, "")).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
            "_q_capital": F.regexp_count(t, F.lit(r"\p{Lu}")),
            "_q_sentences": F.regexp_count(t, F.lit(r"[.!?](?=[\x20\x09-\x0D]|$)")),
        }
    )
    df = df.withColumn("_q_n", F.size("_q_words"))
    # Windows of three words as (hash, place): equal windows meet once sorted, in n log n for any text.
    at = lambda i: F.get(F.col("_q_words"), i)
    window = F.transform(F.slice("_q_words", F.lit(1), F.greatest(n - 2, F.lit(0))), lambda w, i: F.struct(F.xxhash64(w, at(i + 1), at(i + 2)).alias("h"), i.alias("p")))
    df = df.withColumn("_q_sorted", F.sort_array(window))
    same = lambda x, i: F.get(F.col("_q_sorted"), i)["h"] == x["h"]
    twice = F.filter("_q_sorted", lambda x, i: F.coalesce((i > 0) & same(x, i - 1), F.lit(False)) | F.coalesce(same(x, i + 1), F.lit(False)))
    df = df.withColumn("_q_places", F.sort_array(F.transform(twice, lambda x: x["p"])))
    gap = F.transform("_q_places", lambda p, i: F.least(F.coalesce(F.get(F.col("_q_places"), i + 1) - p, F.lit(3)), F.lit(3)))
    df = df.withColumns(
        {
            "n_words": n.cast("long"),
            "n_repeat_words": F.aggregate(gap, F.lit(0).cast("long"), lambda a, x: a + x),
            "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
            "_q_n_lines": F.size("_q_lines"),
        }
    )
    return df.drop("_q_text", "_q_words", "_q_sorted", "_q_places", "_q_lines", "_q_n")


def figures(df: DataFrame) -> DataFrame:
    """measured() with the rates that rules compare in place of its helper columns."""
    rate = lambda a, b: F.round(F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0)), 6)
    return df.withColumns(
        {
            "symbol_rate": rate("n_symbols", "n_words"),
            "dup_line_rate": rate("n_dup_lines", "_q_n_lines"),
            "repeat_rate": rate("n_repeat_words", "n_words"),
            "mean_length": rate("word_chars", "n_words"),
            "capital_rate": rate("_q_capital", "word_chars"),
            "sentence_rate": rate("_q_sentences", "n_words"),
            "line_words": rate("n_words", "_q_n_lines"),
        }
    ).drop("_q_capital", "_q_sentences", "_q_n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    figure: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.figure) >= self.threshold if self.above else F.col(self.figure) < self.threshold

    def __str__(self) -> str:
        return f"{self.figure} {'>=' if self.above else '<'} {self.threshold:g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction; documents that meet it are rejected."""

    conditions: tuple[Condition, ...]
    precision: float = 0.0

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, (c.column() for c in self.conditions))

    def __str__(self) -> str:
        return " AND ".join(map(str, self.conditions))


def rule_number(rules: list[Rule]) -> Column:
    """The 1-based number of the first rule that a row meets, as one ordered CASE; null if it meets none."""
    out = F.lit(None).cast("int")
    for k in range(len(rules), 0, -1):
        out = F.when(rules[k - 1].column(), F.lit(k)).otherwise(out)
    return out


def learn(labelled: DataFrame, max_rules: int = 8, max_conditions: int = 3, least_precision: float = 0.9, least_share: float = 0.002) -> list[Rule]:
    """Sequential covering over labelled (doc_id, bad 0/1, FIGURES...).

    A rule must reach least_precision (with one doubtful row added) on the growing two thirds and on the pruning third, and
    cover least_share of the bad rows. Rows that a rule covers leave before the next is grown.
    """
    rows = settle(labelled.where(F.col("bad").isNotNull()).select("bad", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("held"), *FIGURES))
    total = rows.agg(F.sum("bad").alias("bad"), F.count("*").alias("n")).first()
    if not total["bad"] or total["bad"] == total["n"]:
        return []
    rules: list[Rule] = []
    least = max(3, least_share * total["bad"])
    for _ in range(max_rules):
        left = rows.where(~F.coalesce(reduce(lambda a, b: a | b, (r.column() for r in rules)), F.lit(False))) if rules else rows
        conditions: list[Condition] = []
        for _ in range(max_conditions):
            grow = left.where(~F.col("held"))
            if conditions:
                grow = grow.where(Rule(tuple(conditions)).column())
            best = best_condition(histograms(grow), least)
            if best is None:
                break
            conditions.append(best[0])
            if best[1]:  # no good row left to exclude
                break
        rule = _prune(left, conditions, least_precision, least)
        if rule is None:
            break
        rules.append(rule)
    return rules


def histograms(grow: DataFrame) -> dict[str, np.ndarray]:
    """For each figure its bins in order: bad rows, all rows, least and greatest value."""
    bins = [F.struct(F.lit(f).alias("figure"), F.col(f).alias("x")) for f in FIGURES]
    of = F.floor(F.least(F.col("b.x"), F.lit(float(TOP))) * GRID)
    counted = grow.select("bad", F.explode(F.array(*bins)).alias("b")).groupBy("b.figure", of.alias("bin")).agg(F.sum("bad"), F.count("*"), F.min("b.x"), F.max("b.x")).collect()
    return {f: np.array([r[2:] for r in sorted((r for r in counted if r[0] == f), key=lambda r: r[1])], float).reshape(-1, 4) for f in FIGURES}


def best_condition(counted: dict[str, np.ndarray], least: float) -> tuple[Condition, bool] | None:
    """The condition with the greatest information gain, and whether it covers bad rows only; ties go by the order of figures and bins."""
    found = None
    for f, (bad, n, low, high) in ((f, h.T) for f, h in counted.items()):
        if len(n) < 2 or not bad.sum():
            continue
        before = math.log2(bad.sum() / n.sum())
        for above in (True, False):
            p, m = (np.cumsum(c)[:-1] for c in (bad, n))
            if above:
                p, m = bad.sum() - p, n.sum() - m
            gain = np.where(p >= max(2, least * 2 / 3), p * (np.log2(np.maximum(p, 1) / (m + 0.5)) - before), 0)
            k = int(gain.argmax())
            if gain[k] > 1e-9 and (found is None or gain[k] > found[0] + 1e-9):
                found = (gain[k], Condition(f, above, float(high[k] + low[k + 1]) / 2), bool(p[k] == m[k]))
    return found and found[1:]


def _prune(left: DataFrame, conditions: list[Condition], least_precision: float, least: float) -> Rule | None:
    """The shortest prefix of the conditions that is best on the held-out rows, if it is precise enough on both parts."""
    if not conditions:
        return None
    aggs = []
    for k in range(1, len(conditions) + 1):
        hit = Rule(tuple(conditions[:k])).column()
        for part, held in (("g", False), ("h", True)):
            aggs += [F.count_if(hit & (F.col("held") == held) & (F.col("bad") == b)).alias(f"{part}{b}_{k}") for b in (0, 1)]
    got, best = left.agg(*aggs).first(), None
    for k in range(1, len(conditions) + 1):
        g0, g1, h0, h1 = (got[f"{x}_{k}"] for x in ("g0", "g1", "h0", "h1"))
        worth = (h1 - h0) / (h1 + h0 + 1)
        if g1 + h1 >= least and g1 / (g1 + g0 + 1) >= least_precision - 1 / (g1 + 2) and h1 / max(1, h1 + h0) >= least_precision and (best is None or worth > best[0] + 1e-9):
            best = (worth, Rule(tuple(conditions[:k]), (g1 + h1) / (g1 + h1 + g0 + h0)))
    return best and best[1]


def fit(measures: DataFrame, labels: DataFrame, **how) -> list[Rule]:
    """The list learned from the labelled documents (quality 0 is bad) that pass the base rule, all of them."""
    bad = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("bad"))
    return learn(measures.where(~base_failed()).join(bad, "doc_id"), **how)


def labelled_only(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that have a label; what a list is learned from needs no others."""
    ids = settle(labels.where("quality is not null and doc_id is not null").select("doc_id").distinct())
    return docs.join(ids_sent(ids), "doc_id", "left_semi")


def judge(measures: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds base_failed, rule (number of the first rule met) and kept."""
    return measures.withColumns({"base_failed": base_failed(), "rule": rule_number(rules)}).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def measure_table(docs: DataFrame) -> DataFrame:
    """doc_id and all figures of each row, settled in the shared folder without the texts."""
    df = figures(measured(docs.select("doc_id", "text")))
    return settle(df.select("doc_id", *BASE, *FIGURES), narrow=True)
