"""Mixing sources to target weights by entropy balancing.

Sources get targets in tokens: weights share the total, each target stops at `cap` times its source, and the excess is
shared again until no source is above its limit. Within a
source the document rates stay as close to 1 as they can (in relative entropy) while their tokens meet the target:
rate = min(cap, exp(lambda * size / largest size)). The dual in lambda is convex; its Newton steps, kept within a
bracket, run for all sources at once over the counts by (source, size). Rates become copies in two steps: running
sums over sizes round each (source, size) cell, and passes move single copies until the tokens meet
the target as nearly as sizes allow. Cells deal their copies to documents by hash, in buckets that are as many as the root
of the row count, so no cell's documents meet in one task.

Null texts have size 0 and are never taken; a null source is a source of its own, last in order; repeated rows are separate
documents that share a bucket; an empty table gives an empty result. Copies depend on doc_id, source and size alone, so
reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenry.llm.common import WORD, numbered, settle, text_of

MICRO = 1_000_000


def sized(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, source, size) of every row, settled; size is the number of words."""
    return settle(docs.select("doc_id", F.col(source).cast("string").alias("source"), F.regexp_count(text_of(text), F.lit(WORD)).cast("long").alias("size")))


def targets(rows: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(rank, source, source_size, target) of each source of sized rows, settled; a row for each source.

    The level falls on sources above their limit one aggregation after another, until none is above: each stops at least one more source.
    """
    by = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = numbered(by, "rank", F.col("source").asc_nulls_last())
    by = by.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    by = settle(by.withColumn("limit", F.col("source_size") * F.lit(float(cap))))
    left, stopped = float(by.agg(F.sum("source_size")).first()[0] or 0) * share, -1
    level = math.inf
    while True:
        held = F.col("limit") < F.lit(level) * F.col("w") if level < math.inf else F.lit(False)
        now = by.agg(F.count_if(held).alias("stopped"), F.sum(F.when(held, F.col("limit"))).alias("given"), F.sum(F.when(~held, F.col("w"))).alias("w")).first()
        if now["stopped"] == stopped or not now["w"]:
            break
        stopped = now["stopped"]
        level = (left - (now["given"] or 0.0)) / now["w"]
    return by.select("rank", "source", "source_size", F.least(F.col("limit"), F.lit(level) * F.col("w")).alias("target"))


def _tilts(cells: DataFrame, cap: float, steps: int = 4, most: int = 400) -> DataFrame:
    """(rank, tilt) by Newton steps on the dual of each source that isn't at its cap or empty.

    Steps that leave the bracket halve it, so a few dozen meet any target; that `most` do not is an error.
    """
    state = cells.select("rank").distinct().select("rank", F.lit(0.0).alias("tilt"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
    for _ in range(math.ceil(most / steps)):
        for _ in range(steps):
            rate = F.exp(F.col("tilt") * F.col("z"))
            tokens = F.col("n") * F.col("size")
            moments = cells.join(state, "rank").groupBy("rank", "tilt", "lo", "hi", "target").agg(
                F.sum(tokens * F.least(rate, F.lit(cap))).alias("got"),
                F.sum(F.when(rate < cap, tokens * F.col("z") * rate).otherwise(0.0)).alias("slope"),
            )
            off = F.col("got") - F.col("target")
            moments = moments.withColumn("off", off).withColumns({"lo": F.when(off < 0, F.col("tilt")).otherwise(F.col("lo")), "hi": F.when(off > 0, F.col("tilt")).otherwise(F.col("hi"))})
            newton = F.when(F.col("slope") > 0, F.col("tilt") - F.col("off") / F.col("slope"))
            inside = newton.isNotNull() & (F.abs(newton - F.col("tilt")) < 64) & (F.col("lo").isNull() | (newton > F.col("lo"))) & (F.col("hi").isNull() | (newton < F.col("hi")))
            step = F.when(inside, newton).otherwise(F.coalesce((F.col("lo") + F.col("hi")) / 2, F.when(F.col("lo").isNull(), 2 * F.col("tilt") - 1).otherwise(2 * F.col("tilt") + 1)))
            met = F.abs(F.col("off")) <= 1e-9 * F.col("target")
            state = moments.select("rank", F.when(met, F.col("tilt")).otherwise(step).alias("tilt"), "lo", "hi", met.alias("met"))
            last, state = state, state.drop("met")
        last = settle(last)
        state = last.drop("met")
        if last.where(~F.col("met")).isEmpty():
            return state.select("rank", "tilt")
    raise RuntimeError(f"a source's target isn't met within {most} steps")


def rates(rows: DataFrame, goals: DataFrame, cap: float = 2.0) -> DataFrame:
    """(rank, source, source_size, target, size, n, rate) by cell, settled; rates are whole millionths, so sums of them are exact."""
    cells = rows.groupBy("source", "size").agg(F.count("*").alias("n"))
    largest = rows.groupBy("source").agg(F.max("size").alias("largest"))
    g = goals.join(largest.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2").withColumnRenamed("source", "s1")
    cells = settle(cells.join(g, F.col("source").eqNullSafe(F.col("s1"))).drop("s1").withColumn("z", F.col("size") / F.col("largest")))
    free = cells.where((F.col("size") > 0) & (F.col("target") > 0) & (F.col("target") < F.col("source_size") * cap * (1 - 1e-12)))
    tilt = _tilts(free, cap)
    fixed = F.when(F.col("target") > 0, F.lit(float(cap))).otherwise(0.0)
    rate = F.coalesce(F.least(F.exp(F.col("tilt") * F.col("z")), F.lit(float(cap))), fixed)
    return cells.join(tilt, "rank", "left").withColumn("rate", F.when(F.col("size") > 0, F.round(rate * MICRO).cast("long")).otherwise(F.lit(0).cast("long"))).select("rank", "source", "source_size", "target", "size", "n", "rate")


def copies_by_cell(cells: DataFrame, cap: int = 2) -> DataFrame:
    """Adds m, the copies that a cell's n documents have together, settled.

    Each pass brings a source nearer to its target by copies of the largest size that fits; passes end when none fits any more.
    """
    along = Window.partitionBy("rank").orderBy(F.desc("size"))
    upto = F.sum(F.col("n") * F.col("rate")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    whole = lambda c: F.floor((c + MICRO // 2) / MICRO)
    out = cells.withColumn("upto", upto).withColumn("m", F.greatest(F.lit(0), F.least(whole(F.col("upto")) - whole(F.col("upto") - F.col("n") * F.col("rate")), cap * F.col("n"))))
    out = out.drop("upto")
    of_source = Window.partitionBy("rank")
    moved = True
    while moved:
        for _ in range(2):
            out = out.withColumn("left", F.col("target") - F.sum(F.col("m") * F.col("size")).over(of_source))
            fits = (F.col("size") > 0) & (F.col("size") <= F.abs("left")) & F.when(F.col("left") > 0, F.col("m") < cap * F.col("n")).otherwise(F.col("m") > 0)
            out = out.withColumn("pick", F.max(F.when(fits, F.col("size"))).over(of_source))
            units = F.floor(F.abs("left") / F.col("size"))
            more, less = F.least(units, cap * F.col("n") - F.col("m")), F.least(units, F.col("m"))
            out = out.withColumn("m", F.when(F.col("size") == F.col("pick"), F.when(F.col("left") > 0, F.col("m") + more).otherwise(F.col("m") - less)).otherwise(F.col("m")))
        out = settle(out)
        moved = not out.where("pick is not null").isEmpty()
        out = out.drop("left", "pick")
    return out


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2, source: str = "source", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, copies (0 to cap), taken (copies * size)."""
    rows = sized(docs, source, text)
    cells = copies_by_cell(rates(rows, targets(rows, weights, share, cap), cap), cap)
    buckets = max(1, math.isqrt(rows.count()))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    dealt = rows.groupBy("source", "size", "bucket").agg(F.count("*").alias("here"))
    c = cells.select(F.col("source").alias("s1"), F.col("size").alias("z1"), "source_size", "target", "n", "m")
    dealt = dealt.join(c, F.col("source").eqNullSafe(F.col("s1")) & (F.col("size") == F.col("z1"))).drop("s1", "z1")
    before = F.sum("here").over(Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    rest = F.col("m") % F.col("n")
    quota = F.floor(F.col("before") * rest / F.col("n")) - F.floor((F.col("before") - F.col("here")) * rest / F.col("n"))
    dealt = dealt.withColumn("before", before).select(
        F.col("source").alias("s1"), F.col("size").alias("z1"), F.col("bucket").alias("b1"), "source_size", "target", F.floor(F.col("m") / F.col("n")).alias("base"), quota.alias("quota")
    )
    place = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy(F.xxhash64("doc_id", "size"), "doc_id"))
    out = rows.join(dealt, F.col("source").eqNullSafe(F.col("s1")) & (F.col("size") == F.col("z1")) & (F.col("bucket") == F.col("b1"))).withColumn("place", place)
    copies = F.when(F.col("size") > 0, F.col("base") + (F.col("place") <= F.col("quota")).cast("long")).otherwise(F.lit(0).cast("long"))
    return out.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take(docs: DataFrame, source: str = "source", text: str = "text", **how) -> DataFrame:
    """docs with each row as often as mix() takes it. Rows that share doc_id, source and size are told apart by number."""
    taken = settle(mix(docs, source=source, text=text, **how))
    key = ["doc_id", "source", "size"]
    left = docs.withColumns({"_m_source": F.col(source).cast("string"), "_m_size": F.regexp_count(text_of(text), F.lit(WORD)).cast("long")})
    same = F.col("doc_id").eqNullSafe(F.col("_t_doc_id")) & F.col("_m_source").eqNullSafe(F.col("_t_source")) & (F.col("_m_size") == F.col("_t_size"))
    right = taken.select(*[F.col(c).alias(f"_t_{c}") for c in key], F.col("copies").alias("_t_copies"))
    if not taken.groupBy(*key).count().where("count > 1").isEmpty():
        left = left.withColumn("_m_row", F.row_number().over(Window.partitionBy("doc_id", "_m_source", "_m_size").orderBy(F.xxhash64(text))))
        right = right.withColumn("_t_row", F.row_number().over(Window.partitionBy(*[f"_t_{c}" for c in key]).orderBy(F.desc("_t_copies"))))
        same = same & (F.col("_m_row") == F.col("_t_row"))
    out = left.join(right.where("_t_copies > 0"), same)
    return out.withColumn("_m_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_t_copies")))).select(*docs.columns)
