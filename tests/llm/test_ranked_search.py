"""Ranked search against brute force, and bounds that hold."""

import math
import re
from collections import Counter, defaultdict

from lumenry.llm import queries as q
from lumenry.llm import ranked_search as rs
from tests.llm.conftest import benchmark, documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, k=10):
    terms = [(i, Counter(TERM.findall((t or "").translate(LOW)))) for i, t in docs]
    terms = [(i, c) for i, c in terms if c]
    n_docs, n_terms = len(terms), sum(c.total() for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    own = defaultdict(set)
    for i, t in items:
        own[i] |= set(TERM.findall((t or "").translate(LOW)))
    out = Counter()
    for item, wanted in own.items():
        scored = []
        for i, c in terms:
            m = 10 + (90 * c.total() * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in wanted if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        for rank, (s, null, i) in enumerate(sorted(scored)[:k], 1):
            out[item, rank, None if null else i, -s] += 1
    return out


def found(df):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def test_op11(spark, edge_dir):
    assert found(q.op11_ranked_search(spark, edge_dir)) == brute([(i, t) for i, t, *_ in documents()], [(i, t) for i, t, _ in benchmark()])


def made(n=400):
    """Documents of many lengths, a third of them copies of one text, so that scores tie."""
    word = lambda k: f"t{k * k % 97}"
    return [(k, "t1 t4 t9 common Common" if k % 3 == 0 else " ".join(word(k * j + j) for j in range(1 + k * 7 % 211)) + (" rare" if k % 50 == 1 else "")) for k in range(n)]


ITEMS = [(k, " ".join(f"t{(k * 5 + j) ** 2 % 97}" for j in range(k % 9 + 1)) + (" rare common" if k % 4 == 0 else "")) for k in range(30)]


def test_ties_blocks_and_sets_do_not_show(spark, monkeypatch):
    docs, items = made(), ITEMS
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    monkeypatch.setattr(rs, "BLOCK_DOCS", 7)
    index = rs.build(df)
    assert index.blocks.count() > 50
    assert found(rs.search(index, asked)) == want
    assert found(rs.search(index, asked, most_terms=20)) == want
    assert found(rs.search(index, asked, k=3)) == brute(docs, items, 3)


def test_bounds_hold_and_tell_documents_apart(spark):
    """Exact scores lie within the bounds of the bytes, and few documents beyond the k best are scored."""
    index = rs.build(spark.createDataFrame([x for x in made(600) if x[0] % 3], "doc_id long, text string"))
    names = sorted({t for _, text in ITEMS for t in text.encode().split()})
    items = rs.Items([(0, t) for t in names[::3]])
    items.weights[:] = 1000
    scored = least = 0
    for row in index.blocks.collect():
        block = rs.Block({k: v if k == "ids" else bytes(v) for k, v in row.asDict().items()})
        for _, places, weights in rs._met(block, items):
            upper, lower = rs._bounds(block, places, weights)
            exact = rs._exact(block, places, weights, np_all(block))
            assert (lower <= exact).all() and (exact <= upper).all()
            kth = sorted(lower.tolist())[-10] if len(lower) >= 10 else 0
            scored, least = scored + int((upper >= kth).sum()), least + len(upper)
    assert 10 <= scored < least / 2


def np_all(block):
    import numpy as np

    return np.arange(len(block.m))


def test_level_one_goes_without_the_counts(spark):
    """The passes for bounds read the bytes and leave the exact level unread."""
    index = rs.build(spark.createDataFrame(made(50), "doc_id long, text string"))
    assert set(index.blocks.columns) == {"ids", "m", "terms", "term_at", "starts", "docs", "tfs", "impacts", "tops"}
    got = rs.search(index, spark.createDataFrame(ITEMS[:3], "item_id long, text string"))
    assert got.count() <= 30 and dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
