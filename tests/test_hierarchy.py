"""Ward linkage in rounds against the matrix of one task."""

import numpy as np
import pytest

from wordloom.operators import clustering, hierarchy

FOLDER = "/root/testdata/sf0.1"


def partition(labels):
    groups = {}
    for k, c in enumerate(labels):
        groups.setdefault(c, set()).add(k)
    return {frozenset(g) for g in groups.values()}


def test_merges_of_real_vectors(spark):
    """2,000 vectors of the embeddings: the same merges as in one matrix, with tiles and a last matrix of 400 at most."""
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").orderBy("vec_id").select("embedding").limit(2000).collect()
    x = np.array([r.embedding for r in rows], float)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, emb array<double>")
    got = sorted((r.height, r.a, r.b) for r in hierarchy.ward_merges(table, block=500, most=400).collect())
    want = sorted(hierarchy.merges_of(x, np.ones(len(x))))
    assert np.allclose([h for h, _, _ in got], [h for h, _, _ in want]) and {(a, b) for _, a, b in got} == {(a, b) for _, a, b in want}


@pytest.mark.parametrize("n,most", [(60, 9), (1, 1), (2, 1)])
def test_cut_equals_labels(spark, n, most):
    x = np.random.default_rng(n).normal(size=(n, 3))
    table = spark.createDataFrame([(f"n{k:03}", v.tolist()) for k, v in enumerate(x)], "node string, emb array<double>")
    for k in (1, 7) if n > 7 else (1,):
        got = [r.label for r in clustering.ward(table, k, block=16, most=most).orderBy("node").collect()]
        assert got == clustering.ward_labels(x, k).tolist()


def test_ties_and_copies(spark):
    """Equal points and equal distances must neither stop the rounds nor lose a merge."""
    x = np.array([[a, b] for a in range(5) for b in range(5)] * 3, float)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, emb array<double>")
    merges = hierarchy.ward_merges(table, block=10, most=4).collect()
    assert len(merges) == len(x) - 1 and sum(r.height < 1e-9 for r in merges) == 50
    labels = {r.id: r.label for r in hierarchy.ward_cut(table, 25, block=10, most=4).collect()}
    assert partition([labels[k] for k in range(75)]) == {frozenset(range(k, 75, 25)) for k in range(25)}
    assert hierarchy.ward_cut(table.limit(0), 3).count() == 0
