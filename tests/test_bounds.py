"""Trees, signatures and bounds against plain versions, with the work that they save."""

import itertools
import random

import numpy as np
import pytest

from wordloom.functions.phones import units_as_text
from wordloom.operators import cftree, clustering, evaluate, pairwise, quantise
from wordloom.sources.catalog import Catalog, RunKey


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def sequences(seed=0, n=160):
    rng = random.Random(seed)
    base = [[rng.randrange(40) for _ in range(rng.randint(0, 24))] for _ in range(n // 4)]
    out = list(base)
    while len(out) < n:
        x = list(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            at = rng.randint(0, len(x))
            x[at : at + rng.randint(0, 1)] = [rng.randrange(40)] * rng.randint(0, 1)
        out.append(x)
    return out


@pytest.mark.parametrize("threshold", [0.1, 0.25, 0.4, 0.65])
def test_edit_graph_by_signatures(spark, threshold):
    units = sequences()
    table = spark.createDataFrame(list(enumerate(units)), "node_id long, units array<int>")
    got = {(r.i, r.j): r.w for r in pairwise.edit_graph(table, threshold).collect()}
    want = {}
    for (i, a), (j, b) in itertools.combinations(enumerate(units), 2):
        d = edits(a, b) / max(len(a), len(b), 1)
        if d < threshold:
            want[i, j] = 1 - d
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    if threshold <= 0.25:
        kinds = table.select(units_as_text(table.units).alias("s")).distinct().selectExpr("s", "char_length(s) AS n").cache()
        assert pairwise.edit_candidates(kinds, threshold).count() < 0.1 * kinds.count() ** 2 / 2


def test_dtw_bounds(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(8, 6))
    rows = [(k, (centres[k % 8] + 0.3 * rng.normal(size=(rng.integers(1, 6), 6))).tolist()) for k in range(60)]
    table = spark.createDataFrame(rows, "node_id long, frames array<array<double>>")
    whole = {(r.i, r.j): r.dist for r in pairwise.dtw_pairs(table, block=16).collect()}
    below = float(np.quantile(list(whole.values()), 0.1))
    got = {(r.i, r.j): r.dist for r in pairwise.dtw_pairs(table, block=16, below=below).collect()}
    assert set(got) == {p for p, d in whole.items() if d < below} and all(abs(got[p] - whole[p]) < 1e-12 for p in got)
    work = pairwise.dtw_work(table, below, block=16).first()
    assert work.pairs == len(whole) == 60 * 59 // 2 and len(got) <= work.finished < 0.4 * work.pairs


@pytest.mark.parametrize("neighbours", [1, 3, None])
def test_sparse_path_is_the_dense_one(neighbours):
    rng = np.random.default_rng(2)
    book, codes = rng.normal(size=(20, 5)), rng.permutation(20)
    for lmbda in (0.0, 0.7, 5.0):
        for n in (1, 2, 30):
            x = rng.normal(size=(n, 5))
            far = ((x[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
            keep = min(neighbours or 20, 20)
            allowed = np.full(far.shape, np.inf)
            for t in range(n):
                near = np.lexsort((codes, far[t]))[:keep]
                allowed[t, near] = far[t, near]
            cost = allowed[0]
            for t in range(1, n):
                cost = np.minimum(cost - lmbda, cost.min()) + allowed[t]
            path = [int(np.flatnonzero(codes == c)[0]) for c in quantise.viterbi(x, book, codes, lmbda, neighbours)]
            total = sum(allowed[t, p] for t, p in enumerate(path)) - lmbda * sum(a == b for a, b in itertools.pairwise(path))
            assert total == pytest.approx(cost.min())


def test_tree_of_clustering_features():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 4))[rng.integers(0, 40, 3000)] * 3 + 0.05 * rng.normal(size=(3000, 4))
    tree = cftree.Tree(0.3, 5)
    for part in np.array_split(x, 7):
        tree.add(np.ones(len(part)), part, (part**2).sum(axis=1))
    n, sums, squares = tree.entries()
    assert len(n) == tree.leaves and n.sum() == 3000 and np.allclose(sums.sum(axis=0), x.sum(axis=0)) and squares.sum() == pytest.approx((x**2).sum())
    assert (squares / n - ((sums / n[:, None]) ** 2).sum(axis=1) <= 0.3**2 + 1e-9).all() and 30 <= len(n) <= 400
    assert tree.depth() <= 2 + np.log(len(n)) / np.log(5 / 2)
    todo = [tree.root]
    while todo:  # no node has too many entries, and each entry is the total of its child
        node = todo.pop()
        assert 1 <= len(node.n) <= 5
        for k, child in enumerate(node.children or []):
            assert child.total()[0] == node.n[k] and np.allclose(child.total()[1], node.sums[k])
            todo.append(child)
    assert tree.shrunk(20).leaves <= 20 and tree.shrunk(20).entries()[0].sum() == 3000
    same = cftree.Tree(0.0, 3)
    same.add(np.ones(50), np.ones((50, 2)), np.full(50, 2.0))
    assert same.leaves == 1
    apart = cftree.Tree(0.0, 3)
    y = np.arange(40.0)[:, None]
    apart.add(np.ones(40), y, (y**2).sum(axis=1))
    assert apart.leaves == 40 and apart.entries()[0].sum() == 40


def test_leaves_on_spark(spark):
    x = np.random.default_rng(1).normal(size=(500, 3))
    table = spark.createDataFrame([(f"{k:03}", v.tolist()) for k, v in enumerate(x)], "node string, emb array<double>").repartition(9)
    for most in (4096, 20):
        rows = clustering.birch_leaves(table, 0.2, most, 6).collect()
        assert len(rows) <= most and sum(r.n for r in rows) == 500
        assert np.allclose(np.sum([r.sums for r in rows], axis=0), x.sum(axis=0)) and sum(r.squares for r in rows) == pytest.approx((x**2).sum())
    assert clustering.birch_leaves(table.limit(0)).count() == 0


@pytest.mark.parametrize("threshold", [0.05, 0.5, 1.5])
def test_cosine_graph_skips_tiles(spark, threshold):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(12, 16))[rng.integers(0, 12, 400)] + 0.1 * rng.normal(size=(400, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7], x[8] = 0, x[8] * 3  # not of unit length: never skipped
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "node_id long, emb array<double>").repartition(3)
    sims = x @ x.T
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if sims[i, j] > 1 - threshold}
    rows = pairwise.cosine_graph(table, threshold, block=40, pivots=24).collect()
    assert {(r.i, r.j) for r in rows} == want and len(rows) == len(want) and all(abs(r.w - sims[r.i, r.j]) < 1e-12 for r in rows)
    tiles = pairwise.cosine_tiles(table, threshold, block=40, pivots=24)[1]
    if threshold < 0.1:
        assert tiles.where("skipped").count() > 0.6 * tiles.count()


@pytest.mark.parametrize("tile", [2, 2048])
def test_distances_in_a_giant_cluster(spark, tile):
    rng = random.Random(3)
    rows = [(k % 2 * (k % 7 == 0), [rng.choice("abcd") for _ in range(rng.randint(0, 5))]) for k in range(120)]
    kinds = evaluate._kinds(spark.createDataFrame(rows, "cluster int, phones array<string>"))
    got = sorted((r.cluster, min(r.n_a, r.n_b), max(r.n_a, r.n_b), round(r.d, 9)) for r in evaluate._distances(kinds, tile).collect())
    want, counts = [], {}
    for c, p in rows:
        counts[c, tuple(p)] = counts.get((c, tuple(p)), 0) + 1
    for ((c, a), m), ((d, b), n) in itertools.combinations(counts.items(), 2):
        if c == d:
            want.append((c, min(m, n), max(m, n), round(edits(a, b) / max(len(a), len(b)), 9) if a and b else 1.0))
    assert got == sorted(want)


def test_tiles_of_a_changed_word_alone_are_made_again(spark, tmp_path):
    rng = np.random.default_rng(8)
    words = {f"w{k:02}": rng.normal(size=(rng.integers(1, 4), 3)).tolist() for k in range(35)}
    store = Catalog(spark, str(tmp_path)).tiles(RunKey("pairs", "", "x", "", ""))

    def kept(words):
        table = spark.createDataFrame([(k, n, f) for k, (n, f) in enumerate(sorted(words.items()))], "node_id long, node string, frames array<array<double>>")
        got = {(r.i, r.j): r.dist for r in pairwise.kept_dtw_pairs(store, table, 10).collect()}
        want = {(r.i, r.j): r.dist for r in pairwise.dtw_pairs(table, 10).collect()}
        assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-12 for p in got)
        return store.finished().count()

    first = kept(words)
    assert kept(words) == first
    changed = kept(words | {"w07": [[1.0, 2.0, 3.0]]})
    assert 0 < changed - first <= 4  # the tiles of one of four blocks
    added = kept(words | {"a_new": [[1.0, 0.0, 0.0]]})  # comes first and moves every number
    assert 0 < added - changed <= 4 and kept(words) == added
