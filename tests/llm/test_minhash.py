"""MinHash classes against all pairs, and the parts they rest on."""

import random
from fractions import Fraction

import numpy as np

from lumenry.llm import minhash
from lumenry.llm import queries as q
from tests.llm.conftest import documents


def shingle_set(text, width=4):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute(rows, at=Fraction(4, 5)):
    """Sorted (doc_id, n_shingles, component_id, kept) by all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= at * len(sets[i] | sets[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(root(k), []).append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    out = [(i, len(sets[k]), least[root(k)] if sets[k] else i) for k, (i, _) in enumerate(rows)]
    return sorted(((*r, r[0] == r[2]) for r in out), key=str)


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def test_op12(spark, edge_dir):
    assert found(q.op12_minhash_near_dedup(spark, edge_dir)) == brute([(i, t) for i, t, *_ in documents()])


def families(seed=7, n=420):
    """Chains, stars and crowds of texts about as alike as the threshold, with exact copies and short texts between them."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    rows = []
    base = [word() for _ in range(220)]
    while len(rows) < n:
        kind = rng.randrange(5)
        if kind == 0:
            base = [word() for _ in range(rng.choice((5, 12, 60, 220)))]
        elif kind == 1 and rows:
            rows.append(rows[rng.randrange(len(rows))])
            continue
        text = list(base)
        for _ in range(rng.randrange(0, 1 + max(1, len(base) // 22))):
            text[rng.randrange(len(text))] = word()
        if kind == 4:
            base = text  # a chain goes on from here
        rows.append(" ".join(text))
    return list(enumerate([*rows, "one", "One", "one two three", "", "a b c d"]))


def test_classes_equal_all_pairs(spark):
    rows = families()
    want = brute(rows)
    assert 30 < len({r[2] for r in want}) < len(rows) - 100
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(minhash.near_duplicates(df)) == want


def test_crowded_groups_in_parts_give_the_same(spark, monkeypatch):
    """Residents stay and others visit, whatever the size of a part."""
    rows = families(3, 260)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    monkeypatch.setattr(minhash, "PART", 3)
    monkeypatch.setattr(minhash, "PART_SETS", 4)
    assert found(minhash.near_duplicates(df)) == brute(rows)


def test_parts_find_every_pair(spark):
    """Pairs of a crowd whose sets are all alike but of classes of their own: each part holds some, and all pairs with a visitor are met."""
    import pyarrow as pa

    measure, least = minhash.Measure(0.8), minhash.least_matches(0.8)
    own = [np.unique(np.r_[np.arange(200, dtype=np.uint64), np.uint64(1000 + k)] * np.uint64(0x9E3779B97F4A7C15)) for k in range(40)]
    sigs = [minhash.signature(x) for x in own]
    rows = [("g", p, v, k, k, len(own[k]), sigs[k]) for p in range(4) for v in (False, True) for k in range(40) if (k % 4 == p) != v]
    names = ["grp", "part", "visits", "id", "root", "size", "sig"]
    batches = [pa.RecordBatch.from_arrays([pa.array([ord(r[0][0]) if c == 0 else r[c] for r in rows[a : a + 7]]) for c in range(7)], names) for a in range(0, len(rows), 7)]
    met = set()
    for b in minhash._spanning(measure, least)(iter(batches)):
        met |= set(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
    seen, todo = {0}, [0]
    while todo:
        x = todo.pop()
        for u, v in met:
            for y in (u, v):
                if x in (u, v) and y not in seen:
                    seen.add(y)
                    todo.append(y)
    assert len(seen) == 40


def test_signatures_tell_similarity():
    rng = np.random.default_rng(1)
    least = minhash.least_matches(0.8)
    assert least == sorted(least) and 8 <= least[0] <= 16 and 70 <= least[-1] <= 85
    for share, stays in ((0.95, True), (0.8, True), (0.3, False)):
        same = []
        for _ in range(60):
            x = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
            both = int(2 * share / (1 + share) * 450)
            a, b = (np.unique(v) for v in (x[:450], x[450 - both : 900 - both]))
            sig = np.frombuffer(minhash.signature(a) + minhash.signature(b), "<u2").reshape(2, -1)
            same.append((sig[0] == sig[1]).mean())
            left = minhash.survivors(sig, sig, np.array([0]), np.array([1]), least)[0]
            assert bool(len(left)) == stays
        assert abs(np.mean(same) - share) < 0.03


def test_posterior_equals_counting():
    """The chance of the least number stays above MISS, that of one less below it, by integration of the posterior."""
    s = np.linspace(0, 1, 200_001)
    for n, m in zip(range(32, 129, 32), minhash.least_matches(0.8), strict=True):
        for k, above in ((m, True), (m - 1, False)):
            like = s**k * (1 - s) ** (n - k)
            assert (like[s >= 0.8].sum() / like.sum() >= minhash.MISS) == above
