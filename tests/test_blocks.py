"""Products of blocks against one product, and the cube against the scores it was made from."""

import math
import random
from collections import Counter
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenry.operators import blocks, cube, reports, scoring


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.floats(-1, 1), st.integers(-2000, 2000).map(lambda k: k / 2000), st.integers(-200, 200).map(lambda k: k / 200)), min_size=1, max_size=20))
def test_rounding(scores):
    want = [float(Decimal(repr(x)).quantize(Decimal("0.01"), ROUND_HALF_EVEN)) + 0.0 for x in scores]
    assert blocks.half_even(np.array(scores, np.float64)).tolist() == want


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(4)
    vector = lambda: [rng.gauss(0, 1) for _ in range(8)]
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    refs = [(f"r{k}", k, vector()) for k in range(60)]
    refs += [(f"again{k}", 60 + k, refs[k][2]) for k in range(20)] + [("none", 99, None)]
    rows = [(k, f"c{k % 3}", unit(vector())) for k in range(150)] + [(7, "c1", unit(refs[3][2])), (7, "c1", unit(refs[3][2])), (200, "c0", None)]
    return spark.createDataFrame(rows, "sentence_id long, company string, vec array<double>"), spark.createDataFrame(refs, "ref_key string, ord long, vec array<double>")


def of_dictionary(sides):
    sentences, refs = sides
    keys, matrix = scoring.reference_table(refs.where("vec is not null"))
    return scoring.with_scores(sentences, matrix), keys


@pytest.mark.parametrize("size", [(7, 9), (1000, 1000), (64, 5)])
def test_blocks_equal_a_dictionary(spark, sides, size, monkeypatch):
    monkeypatch.setattr(blocks, "AT_ONCE", 3)
    grid = blocks.Grid(*sides, group=size[0], block=size[1])
    scored, keys = of_dictionary(sides)
    scored = scored.where("scores is not null")
    row = lambda r: (r.sentence_id, r.company, r.ref_key, r.score)
    assert Counter(map(row, blocks.best(grid).collect())) == Counter(map(row, reports.best_reference(scored, keys).collect()))
    long = scoring.long_scores(scored, keys).where("score >= 0.5")
    assert Counter(map(row, blocks.pairs_at_least(grid, 0.5).collect())) == Counter(map(row, long.collect()))
    thetas = [-1.0, 0.2, 0.57, 0.9, 1.0]
    key = lambda r: (r.theta, r.n_rows, r.n_selected)
    assert set(map(key, blocks.threshold_counts(grid, thetas).collect())) == set(map(key, reports.threshold_counts(scored, thetas).collect()))


def test_nothing_is_copied_for_each_block(spark, sides):
    """Rows that are written for a shuffle are as many as sentences, references and results, whatever the number of groups and blocks."""

    def written() -> int:
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty()
        stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    thetas = [k / 20 for k in range(21)]
    for job in (lambda g: blocks.threshold_counts(g, thetas), blocks.best, lambda g: blocks.pairs_at_least(g, 0.9)):
        before = written()
        job(blocks.Grid(*sides, group=7, block=9)).collect()
        assert written() - before < 3 * (152 + 80)


def test_best_deals_sides_as_they_lie(spark, sides):
    """Sentences and references are checkpointed, but neither goes through a shuffle: what is written for one is a few rows a partition, for the count of rows."""

    def written() -> int:
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty()
        stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    sentences, refs = (x.repartition(3).localCheckpoint() for x in sides)
    before = written()
    grid = blocks.Grid(sentences, refs, group=3, block=9)
    assert (grid.slices > 1, grid.passes) == (True, 1)
    got = blocks.best(grid, ["sentence_id"])
    assert got.columns == ["sentence_id", "ref_key", "ord", "score"] and len(got.collect()) == 152
    assert written() - before < 20


@pytest.mark.parametrize("shuffled", [False, True])
def test_however_sides_lie(spark, sides, shuffled, monkeypatch):
    """Uneven and empty partitions, dealt as they lie or by a shuffle; blocks in one partition or in several."""
    if shuffled:
        monkeypatch.setattr(blocks, "UNEVEN", 0)
    sentences, refs = sides
    scored, keys = of_dictionary(sides)
    row = lambda r: (r.sentence_id, r.company, r.ref_key, r.score)
    want = Counter(map(row, reports.best_reference(scored.where("scores is not null"), keys).collect()))
    sentences = sentences.repartitionByRange(2, "sentence_id").where("sentence_id < 0").unionAll(sentences.where("sentence_id >= 20").coalesce(1)).unionAll(sentences.where("sentence_id < 20").coalesce(1))
    refs = refs.where("ord < 3").coalesce(1).unionAll(refs.where("ord >= 3").repartition(5, "ord"))
    for group, block in ((3, 4), (30, 4), (100, 4), (1000, 1000)):
        grid = blocks.Grid(sentences, refs, group=group, block=block)
        assert (grid.slices == 0) == shuffled
        assert Counter(map(row, blocks.best(grid).collect())) == want
        assert Counter(map(row, blocks.best(grid, ["sentence_id", "company"]).collect())) == want


def test_ties_between_blocks(spark, monkeypatch):
    """Of equal best scores the reference of least ord, then of least key, wherever it lies; a vector without a score has none."""
    monkeypatch.setattr(blocks, "REFS_AT_ONCE", 3)
    refs = [(f"r{k:02d}", k // 4, [1.0, 0.0] if k > 9 else [0.0, 1.0]) for k in range(40)]
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [math.nan, 1.0]), (3, [0.6, 0.8])]
    sides = spark.createDataFrame(rows, "sentence_id long, vec array<double>"), spark.createDataFrame(refs, "ref_key string, ord long, vec array<double>")
    got = {r.sentence_id: (r.ref_key, r.ord, r.score) for r in blocks.best(blocks.Grid(*sides, group=1, block=3)).collect()}
    assert got == {0: ("r10", 2, 1.0), 1: ("r00", 0, 1.0), 2: (None, None, None), 3: ("r00", 0, 0.8)}


def test_no_references(spark, sides):
    sentences, refs = sides
    grid = blocks.Grid(sentences, refs.where("false"))
    assert {r.ref_key for r in blocks.best(grid).collect()} == {None} and blocks.pairs_at_least(grid, -1.0).count() == 0


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(9)
    score = lambda: rng.choice([None, float("nan"), *[round(rng.uniform(-1, 1), 2) + 0.0 for _ in range(6)]])
    rows = [(f"c{rng.randrange(4)}", 2015 + rng.randrange(3), k, [score() for _ in range(5)]) for k in range(400)]
    rows += [("bare", 2020, 900, []), ("bare", 2020, 901, None), ("bare", 2020, 902, [None, float("nan")])]
    return spark.createDataFrame(rows, "company string, year int, sentence_id long, scores array<double>").repartition(3)


THETAS = [k / 100 for k in range(-100, 101)]


def test_any_threshold(scored):
    """Every threshold of two decimals, and some between, as a scan counts them."""
    thetas = [*THETAS, 0.125, 0.299999, 0.300001]
    made = cube.build(scored, ["company", "year"])
    rows = {(r.company, r.theta): (r.total_rows, r.selected) for r in cube.coverage(made, thetas, ["company"]).collect()}
    held = [(r.company, [x for x in r.scores or [] if x is not None and x == x]) for r in scored.collect()]
    for t in thetas:
        for c in {c for c, _ in held}:
            assert rows[c, t] == (sum(h == c for h, _ in held), sum(h == c and any(x >= t for x in v) for h, v in held))
    whole = cube.coverage(made, [0.3], [])
    assert [r.selected for r in whole.collect()] == [r.n_selected for r in reports.threshold_counts(scored, [0.3]).collect()]


def test_ranges_references_and_quantiles(scored):
    made = cube.build(scored, ["company", "year"])
    held = [(r.company, r.year, [x if x is not None and x == x else None for x in r.scores or []]) for r in scored.collect()]
    got = {r.company: (r.n_low, r.n_high) for r in cube.buckets(made, 0.3, 0.5, ["company"]).collect()}
    low = lambda v: any(x > 0.3 for x in v if x is not None) and any(x < 0.5 for x in v if x is not None)
    assert got == {c: (sum(h == c and low(v) for h, _, v in held), sum(h == c and any(x >= 0.5 for x in v if x is not None) for h, _, v in held)) for c, _, _ in held}
    refs = {(r.ref, r.theta): (r.n_rows, r.selected) for r in cube.reference_coverage(made, [0.1], []).collect()}
    each = {k: sorted(v[k] for _, _, v in held if k < len(v) and v[k] is not None) for k in range(5)}
    assert refs == {(k, 0.1): (len(v), sum(x >= 0.1 for x in v)) for k, v in each.items()}
    q = {r.ref: (r.n_rows, r.quantiles) for r in cube.quantiles(made, [0.0, 0.5, 0.9, 1.0], []).collect()}
    assert q == {k: (len(v), [v[max(math.ceil(p * len(v)), 1) - 1] for p in (0.0, 0.5, 0.9, 1.0)]) for k, v in each.items()}


def test_cubes_add_up(spark, scored, tmp_path):
    """The cube of all rows is that of its parts, saved and opened, and grouping less is adding up."""
    rows = lambda df: Counter(map(tuple, df.select(sorted(df.columns)).collect()))
    whole = cube.build(scored, ["company", "year"])
    first = cube.build(scored.where("sentence_id % 3 = 0"), ["company", "year"])
    cube.saved(first, str(tmp_path / "cube"))
    both = cube.added(cube.opened(spark, str(tmp_path / "cube")), cube.build(scored.where("sentence_id % 3 > 0"), ["company", "year"]))
    assert rows(both.bins) == rows(whole.bins) and rows(both.extremes) == rows(whole.extremes)
    less = cube.rolled_up(whole, ["company"])
    assert rows(less.bins) == rows(cube.build(scored, ["company"]).bins) and rows(less.extremes) == rows(cube.build(scored, ["company"]).extremes)
    assert cube.coverage(less, [0.5]).agg(F.sum("total_rows")).first()[0] == scored.count()
