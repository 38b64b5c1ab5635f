"""The learned encoder against numpy's decomposition, and what it is for: texts alike in words."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenry.functions import factors, providers

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").repartition(3)


@pytest.fixture(scope="module")
def learned(docs):
    return factors.learn(docs, dim=24, buckets=1024)


def test_it_keeps_what_the_best_basis_keeps(docs, learned):
    x = factors.matrix([r.text for r in docs.collect()], learned.rarity)
    best = (np.linalg.svd(x, compute_uv=False) ** 2)[:24].sum()
    kept = (np.linalg.norm(x @ learned.basis, axis=1) ** 2).sum()
    assert np.allclose(learned.basis.T @ learned.basis, np.eye(24), atol=1e-8)
    assert 0.99 * best <= kept <= best * (1 + 1e-9)


def test_rarity(docs, learned):
    have = np.zeros((docs.count(), 1024), bool)
    for k, r in enumerate(docs.collect()):
        have[k, factors.row(r.text, 1024)[0]] = True
    n = have.any(axis=1).sum()
    assert np.allclose(learned.rarity, np.log((n + 1) / (have.sum(axis=0) + 1)) + 1)


def test_near_copies_are_neighbours(spark, docs, learned, tmp_path):
    """Of each text with a few words changed, the nearest text is the one it was made from, or a copy of it; saved, the encoder is the same."""
    learned.saved(spark, str(tmp_path / "e"))
    again = factors.opened(spark, str(tmp_path / "e"))
    assert np.array_equal(again.basis, learned.basis) and np.array_equal(again.rarity, learned.rarity)
    texts = [r.text for r in docs.where("length(text) > 300").collect()]
    changed = [" ".join("changed" if k % 17 == 5 else w for k, w in enumerate(t.split())) for t in texts]
    a, b = np.array(again.encode(texts)), np.array(again.encode(changed))
    nearest = (b @ a.T).argmax(axis=1)
    assert np.mean([texts[i] == t or len(set(texts[i].split()) & set(t.split())) > 0.7 * len(set(t.split())) for i, t in zip(nearest, texts, strict=True)]) >= 0.95
    assert np.allclose(np.linalg.norm(a, axis=1), 1) and again.encode(["", "  "]) == [[0.0] * 24] * 2
    rows = docs.where("length(text) > 300").select("text", providers.embedded(F.col("text"), again.factory()).alias("v")).collect()
    assert np.allclose([r.v for r in rows], again.encode([r.text for r in rows]))


def test_the_deal_of_texts_does_not_show(docs, learned):
    other = factors.learn(docs.repartition(7), dim=24, buckets=1024)
    angles = np.linalg.svd(other.basis[:, :12].T @ learned.basis, compute_uv=False)
    assert angles.min() > 0.999
