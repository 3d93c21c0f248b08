"""Hand-computed cases, metamorphic properties and brute-force comparisons."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.functions import phones as ph
from wordloom.functions.vectors import pair_of_index
from wordloom.operators import clustering, communities, evaluate, features, intervals, lookup, pairwise, quantise
from wordloom.operators.leiden import leiden


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def strings(*xs):
    return F.array(*map(F.lit, xs))


def test_clean_phones(spark):
    assert one(spark, ph.clean_phones(strings("sil", "AH0", "SIL", "1", ""))) == ["ah", "sil", ""]
    assert one(spark, ph.clean_phones(strings("sil", "a1", "SP"), mandarin=True)) == ["a1", "SP"]
    assert one(spark, ph.clean_phones_stripped(strings(" sil", "AH0 "))) == ["ah"]


def test_frame_bounds(spark):
    for t, frame in ((0.58, 28), (0.29, 14), (0.30, 15)):
        assert one(spark, intervals.frame_bounds(F.lit(t), F.lit(1.0))[0]) == frame
    a, b = intervals.frame_bounds(F.lit(0.401), F.lit(0.419))
    assert one(spark, a) == one(spark, b) == 20


def test_speech_segments(spark):
    w = spark.createDataFrame([("f", 0, 0.0, 1.0), ("f", 1, 1.00005, 2.0), ("f", 2, 2.5, 3.0)], "filename string, word_id int, word_start double, word_end double")
    got = sorted((r.seg_id, r.start, r.end) for r in intervals.speech_segments(w).collect())
    assert got == [(0, 0.0, 2.0), (1, 2.5, 3.0)]


@pytest.mark.parametrize("gold,disc,expected", [((0, 0.10), (0.07, 0.20), True), ((0, 0.05), (0.03, 0.20), False), ((0, 1), (0.2, 0.4), True)])
def test_boundary_predicate(spark, gold, disc, expected):
    assert one(spark, ph.boundary_matches(*[F.lit(float(x)) for x in (*gold, *disc)])) is expected


def test_pair_index(spark):
    for n in (2, 4, 7, 50):
        rows = spark.range(n * (n - 1) // 2).select("id", pair_of_index(F.col("id"), F.lit(n)).alias("p")).orderBy("id").collect()
        assert [(r.p.i, r.p.j) for r in rows] == list(itertools.combinations(range(n), 2))


def test_interval_join_makes_each_pair_once(spark):
    rng = np.random.default_rng(0)
    left = [("f", i, float(a), float(a + rng.random() * 200)) for i, a in enumerate(rng.random(60) * 500)]
    right = [("f", i, float(a), float(a + rng.random() * 200)) for i, a in enumerate(rng.random(60) * 500)]
    a = spark.createDataFrame(left, "filename string, a int, l_start double, l_end double")
    b = spark.createDataFrame(right, "filename string, b int, r_start double, r_end double")
    got = intervals.interval_join(a, b, lambda: (F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end"))).select("a", "b").collect()
    expected = {(x[1], y[1]) for x in left for y in right if x[2] < y[3] and y[2] < x[3]}
    assert len(got) == len(expected) and {(r.a, r.b) for r in got} == expected


def test_viterbi():
    frames, book, codes = np.array([[0.1], [0.6], [0.1]]), np.array([[0.0], [1.0]]), np.array([0, 1])
    assert quantise.viterbi(frames, book, codes, 0, None) == [0, 1, 0]
    assert quantise.viterbi(frames, book, codes, 1, None) == [0, 0, 0]


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x, book = rng.random((4, 2)), rng.random((3, 2))
        lmbda = rng.random()
        far = ((x[:, None] - book[None]) ** 2).sum(2)

        def cost(p, far=far, lmbda=lmbda):
            return sum(far[t, c] for t, c in enumerate(p)) - lmbda * sum(a == b for a, b in zip(p, p[1:]))

        got = quantise.viterbi(x, book, np.arange(3), lmbda, None)
        assert math.isclose(cost(got), min(map(cost, itertools.product(range(3), repeat=4))))


def test_without_repeats(spark):
    assert one(spark, quantise.without_repeats(F.array(*[F.lit(x) for x in (1, 1, 2, 2, 1)]))) == [1, 2, 1]
    assert one(spark, quantise.without_repeats(F.array().cast("array<int>"))) == []


def test_edit_graph(spark):
    units = spark.createDataFrame([(0, [1, 2, 3]), (1, [1, 3]), (2, []), (3, []), (4, [1, 2, 3])], "node_id long, units array<int>")
    got = {(r.i, r.j): round(r.w, 6) for r in pairwise.edit_graph(units, 0.4).collect()}
    assert got == {(0, 1): round(2 / 3, 6), (1, 4): round(2 / 3, 6), (0, 4): 1.0, (2, 3): 1.0}
    assert one(spark, ph.normalised_edit(F.lit(""), F.lit(""))) == 0.0
    assert one(spark, ph.either_empty_is_one(F.lit(""), F.lit(""))) == 1.0


def test_edit_graph_bands_lose_nothing(spark):
    rng = np.random.default_rng(5)
    data = [(i, [int(x) for x in rng.integers(0, 3, rng.integers(0, 9))]) for i in range(60)]
    units = spark.createDataFrame(data, "node_id long, units array<int>")

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    for theta in (0.3, 0.65):
        expected = {(i, j) for (i, a), (j, b) in itertools.combinations(data, 2) if (lev(a, b) / max(len(a), len(b)) if a or b else 0) < theta}
        assert {(r.i, r.j) for r in pairwise.edit_graph(units, theta).collect()} == expected


def test_cosine_tiles(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(70, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    emb = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "node_id long, emb array<double>")
    sims = x @ x.T
    expected = {(i, j) for i, j in itertools.combinations(range(70), 2) if sims[i, j] > 0.6}
    for block in (16, 1000):
        assert {(r.i, r.j) for r in pairwise.cosine_graph(emb, 0.4, block).collect()} == expected


def test_dtw():
    a = np.array([[[1.0, 0], [0, 1.0]]])
    assert pairwise.dtw_distance(a, np.array([[[1.0, 0], [1.0, 0], [0, 1.0]]]))[0] == pytest.approx(0)
    assert pairwise.dtw_distance(a, np.array([[[1.0, 0], [1.0, 0]]]))[0] == pytest.approx(0.25)


def test_dtw_tiles_store_every_pair(spark):
    rng = np.random.default_rng(2)
    words = [(i, rng.normal(size=(int(rng.integers(1, 5)), 3)).tolist()) for i in range(23)]
    df = spark.createDataFrame(words, "node_id long, frames array<array<double>>")
    got = {(r.i, r.j): r.dist for r in pairwise.dtw_pairs(df, block=6).collect()}
    for (i, a), (j, b) in itertools.combinations(words, 2):
        assert got.pop((i, j)) == pytest.approx(pairwise.dtw_distance(np.array([a]), np.array([b]))[0])
    assert not got


def test_ward_against_plain_merging():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 3))
    groups = [[i] for i in range(40)]
    while len(groups) > 6:
        def rise(p):
            a, b = x[groups[p[0]]], x[groups[p[1]]]
            return len(a) * len(b) / (len(a) + len(b)) * ((a.mean(0) - b.mean(0)) ** 2).sum()

        i, j = min(itertools.combinations(range(len(groups)), 2), key=rise)
        groups[i] += groups.pop(j)
    labels = clustering.ward_labels(x, 6)
    assert {frozenset(np.flatnonzero(labels == k).tolist()) for k in range(6)} == {frozenset(g) for g in groups}


def blobs(spark):
    rng = np.random.default_rng(7)
    rows = [(f"{c}_{i}", [float(v) for v in rng.normal(5 * c, 0.1, 2)]) for c in range(4) for i in range(15)]
    return spark.createDataFrame(rows, "node string, emb array<double>")


@pytest.mark.parametrize("how", [lambda p: clustering.kmeans(p, 4), lambda p: clustering.birch(p, 4), lambda p: clustering.ward(p, 4)])
def test_clusterings_find_blobs(spark, how):
    found = {}
    for r in how(blobs(spark)).collect():
        found.setdefault(r.label, set()).add(r.node.split("_")[0])
    assert sorted(map(sorted, found.values())) == [["0"], ["1"], ["2"], ["3"]]


def objective(label, edges, gamma):
    inside = sum(w for i, j, w in edges if label[i] == label[j])
    return inside - gamma * sum(n * (n - 1) / 2 for n in np.bincount(label))


def test_leiden_never_falls_below_its_start():
    rng = np.random.default_rng(9)
    edges = [(i, j, float(rng.random())) for i, j in itertools.combinations(range(30), 2) if rng.random() < 0.2]
    i, j, w = (np.array(x) for x in zip(*edges))
    for gamma in (0.05, 0.3, 0.7):
        start = rng.integers(0, 5, 30)
        got = leiden(30, i, j, w, gamma, start)
        assert objective(got, edges, gamma) >= objective(np.unique(start, return_inverse=True)[1], edges, gamma) - 1e-9
        assert objective(got, edges, gamma) >= objective(np.arange(30), edges, gamma) - 1e-9


def test_cpm_splits_cliques(spark):
    nodes = spark.range(10).select(F.col("id").alias("node_id"))
    edges = [(i, j, 1.0) for g in (range(5), range(5, 10)) for i, j in itertools.combinations(g, 2)] + [(4, 5, 0.1)]
    graph = spark.createDataFrame(edges, "i long, j long, w double")
    got = {}
    for r in communities.cpm_partition(nodes, graph, 2, tolerance=0).collect():
        got.setdefault(r.label, set()).add(r.node_id)
    assert sorted(map(sorted, got.values())) == [list(range(5)), list(range(5, 10))]


def test_components(spark):
    nodes = spark.range(60).select(F.col("id").alias("node_id"))
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "i long, j long")
    got = {r.node_id: r.component for r in communities.components(nodes, path).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == i for i in range(41, 60))


def test_scores(spark):
    rows = [("a", 0), ("a", 0), ("b", 0), ("b", 1)]
    labels = spark.createDataFrame(rows, "true string, pred int")
    assert evaluate.purity(labels).first()[0] == 0.75
    assert evaluate.majority_completeness(labels).first()[0] == 0.75
    assert tuple(evaluate.v_measure(labels).first()) == (0.31128, 0.38369, 0.34371)
    swapped = labels.select(F.col("pred").alias("true"), F.col("true").alias("pred"))
    assert tuple(evaluate.v_measure(swapped).first())[:2] == (0.38369, 0.31128)
    words = spark.createDataFrame([(0.0, 2.0)], "word_start double, word_end double")
    assert evaluate.bitrate(labels, words).first()[0] == pytest.approx(1.62256, abs=1e-5)


def test_ned(spark):
    ab, ac = ["a", "b"], ["a", "c"]
    m = spark.createDataFrame([(0, ab), (0, ab), (0, ac), (1, ab)], "cluster long, phones array<string>")
    assert evaluate.ned(m).first()[0] == 0.33333
    gold = spark.createDataFrame([(0, ab), (0, ab), (1, ac)], "cluster long, phones array<string>")
    assert evaluate.ned(gold).first()[0] == 0.0
    long = spark.createDataFrame([(0, "d-ih-m-ae-n-d-ih-d".split("-")), (0, "d-ih-m-ae-n-d-ah-d".split("-"))], "cluster long, phones array<string>")
    assert evaluate.ned(long).first()[0] == 0.125


def test_pooling(spark):
    frames = spark.createDataFrame([("a", 0, [3.0, 0.0]), ("a", 1, [3.0, 8.0]), ("z", 0, [0.0, 0.0])], "node string, frame int, vec array<double>")
    got = {r.node: r.emb for r in features.pool(frames).collect()}
    assert got["a"] == pytest.approx([0.6, 0.8]) and got["z"] == [0.0, 0.0]


def test_pca_keeps_inner_products(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(30, 4))
    frames = spark.createDataFrame([(str(i), 0, [float(v) for v in r]) for i, r in enumerate(x)], "node string, frame int, vec array<double>")
    z = (x - x.mean(0)) / x.std(0)
    got = {int(r.node): r.vec for r in features.project(frames, 350).collect()}
    y = np.array([got[i] for i in range(30)])
    assert np.allclose(y @ y.T, z @ z.T)


def test_first_appearance_codes_of_a_text_of_over_a_million_tokens(spark, tmp_path):
    from wordloom import registry

    spark.createDataFrame([(0, "a " * 1_000_001 + "late"), (1, "early a")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    codes = {r.token: r.code for r in registry.QUERIES["first_appearance_codes"](spark, str(tmp_path)).collect()}
    assert codes == {"a": 0, "late": 1, "early": 2}


def test_dtw_tiles_are_resumed(spark, tmp_path):
    from wordloom.sources.catalog import Catalog, RunKey

    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=(int(rng.integers(1, 4)), 3)).tolist()) for k in range(20)]
    words = spark.createDataFrame(rows, "node_id long, frames array<array<double>>")
    whole = {(r.i, r.j): r.dist for r in pairwise.dtw_pairs(words, 6).collect()}
    store = Catalog(spark, str(tmp_path / "cat")).tiles(RunKey("pairs", "", "x", "", ""))
    made = []

    def broken(batch):
        made.append(batch.count())
        if len(made) == 2:
            raise RuntimeError("stopped")
        return pairwise.dtw_pairs(words, 6, tiles=batch)

    side = spark.range(4)
    tiles = side.selectExpr("id AS tile_a", "explode(sequence(id, 3L)) AS tile_b")
    with pytest.raises(RuntimeError):
        store.fill(tiles, broken, tiles_a_round=4)
    assert store.finished().count() == 4 and made == [4, 4]
    got = {(r.i, r.j): r.dist for r in store.fill(tiles, lambda batch: pairwise.dtw_pairs(words, 6, tiles=batch), 4).collect()}
    assert got == whole and store.finished().count() == 10 and store.finished().where("seconds > 0").count() == 10


def test_units_and_labels_beyond_the_basic_plane(spark):
    from wordloom.functions.phones import UNITS, units_as_text

    rows = [(0, [0, 35328, 45568, UNITS - 1]), (1, [0, 35329, 45568, UNITS - 1]), (2, [0, 35328, 45569, 5])]
    table = spark.createDataFrame(rows, "node_id long, units array<int>")
    got = {(r.i, r.j): round(r.w, 6) for r in pairwise.edit_graph(table, 0.9).collect()}
    assert got == {(0, 1): 0.75, (0, 2): 0.5, (1, 2): 0.25}
    with pytest.raises(Exception, match="units must lie"):
        table.select(units_as_text(F.array(F.lit(UNITS)))).collect()
    many = spark.createDataFrame([(0, [f"p{k}" for k in range(7000)])], "cluster int, phones array<string>")
    coded = evaluate.phone_codes(many).first().coded
    assert len(set(coded)) == 7000


def test_codebook_by_batches(spark):
    rng = np.random.default_rng(2)
    means = np.eye(3) * 20
    rows = [(f"f{k}", t, (means[(k + t) % 3] + rng.normal(size=3) * 0.1).tolist()) for k in range(30) for t in range(3)]
    frames = spark.createDataFrame(rows, "node string, frame int, vec array<double>")
    book = np.array([r.vec for r in quantise.train_codebook_by_batches(frames, 12, batch_files=8).collect()])
    assert len(book) == 12 and all(np.abs(means[:, None] - book[None]).max(axis=2).min(axis=1) < 1)
    near = quantise.nearest_codes(frames, quantise.train_codebook_by_batches(frames, 12, batch_files=100), 2).collect()
    assert all(len(r.codes) == 2 and r.codes[0].d <= r.codes[1].d for r in near)


def test_resample_keeps_a_tone():
    from wordloom.sources.features import resample

    for rate in (8000, 22050, 44100, 48000):
        tone = np.sin(np.arange(rate) * 2 * np.pi * 440 / rate)
        out = resample(tone, rate)
        assert len(out) == 16000 and np.abs(out - np.sin(np.arange(16000) * 2 * np.pi * 440 / 16000))[200:-200].max() < 0.01
    high = np.sin(np.arange(48000) * 2 * np.pi * 15000 / 48000)
    assert np.abs(resample(high, 48000))[200:-200].max() < 0.05


def test_merge_keeps_pos_of_phones_at_one_time(spark):
    """Phones without length have equal starts and ends; their pos decides, not their label."""
    words = spark.createDataFrame([("f", 1, 0.0, 0.02, "chase")], "filename string, word_id int, word_start double, word_end double, text string")
    phones = spark.createDataFrame([("f", 0.0, 0.01, "c", 0), ("f", 0.01, 0.01, "h", 1), ("f", 0.01, 0.01, "a", 2), ("f", 0.01, 0.02, "s", 3)], "filename string, start double, end double, phone string, pos int")
    assert intervals.merge_overlap(words, phones).first().phones == ["c", "h", "a", "s"]
    assert intervals.merge_overlap(words, phones.where("pos <> 2").drop("pos")).first().phones == ["c", "h", "s"]


def test_kmeans_makes_its_points_once(spark):
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(len(b))
            yield b

    points = spark.createDataFrame([(f"n{k:02d}", [float(k // 10 * 50 + k % 10), 0.0]) for k in range(40)], "node string, emb array<double>")
    labels = clustering.kmeans(points.mapInPandas(run, points.schema), 4)
    assert labels.groupBy("label").count().count() == 4 and made.value == 40
    clustering.lloyd(points.mapInPandas(run, points.schema), [[0.0, 0.0], [60.0, 0.0]], 5)[0].count()
    assert made.value == 80


def test_swaps_leave_a_local_optimum(spark):
    """Two centres in one group and one for two groups: Lloyd rounds stay there, a swap does not."""
    points = spark.createDataFrame([(f"n{g}{k}", [g * 10.0 + k * 0.1, 0.0]) for g in range(4) for k in range(6)], "node string, emb array<double>").cache()
    stuck = clustering._lloyd(points, [[0.0, 0.0], [0.4, 0.0], [10.0, 0.0], [25.0, 0.0]], 10)
    groups = lambda run: run[0].groupBy("label").agg(F.countDistinct(F.substring("node", 2, 1)).alias("n")).where("n > 1").count()
    assert groups(stuck) == 1 and groups(clustering._swapped(points, stuck, 0, 10)) == 0


def test_tiles_of_large_tables_are_few():
    from wordloom.operators import hierarchy

    assert [hierarchy.blocks_of(n, 64) for n in (0, 64, 139, 150_000, 1 << 20)] == [1, 1, 3, 16, 64]
    assert [pairwise.dtw_block(n, 256) for n in (0, 537, 32_000, 1 << 20)] == [256, 256, 1000, 2048]


def test_equal_sequences_are_one_node(spark, monkeypatch):
    """Communities of unit sequences get no edge for each pair of copies, and are no worse than the types."""
    from wordloom.plans import flows

    kinds = [[1, 1, 1], [1, 1, 2], [5, 6, 7], [5, 6, 8], [9, 9, 9, 9]]
    rows = [(f"n{k:03d}", "abcde"[k % 5], kinds[k % 5]) for k in range(150)]
    units = spark.createDataFrame(rows, "node string, text string, units array<int>")
    seen, inner = [], communities.cpm_partition
    monkeypatch.setattr(communities, "cpm_partition", lambda nodes, edges, *a, **k: seen.append(edges.count()) or inner(nodes, edges, *a, **k))
    own = lookup.node_ids(units)
    edges = pairwise.edit_graph(own.select("node_id", "units"), 0.4).cache()
    at = lambda x, gamma: communities.cpm_objective(edges, x, gamma).first().objective
    typed = own.select("node_id", F.hash("text").alias("label"))
    for found in (flows.graph_from_types(units, 0.4), flows.graph_of_replicas(units, 0.4)):
        assert found.select("node_id").distinct().count() == 150 and at(found, 0.3) >= at(typed, 0.3)
        assert found.select("label").distinct().count() == 3
    whole = inner(own.select("node_id"), edges, 5, 0.3)
    assert abs(at(whole, 0.3) - at(found, 0.3)) < 1e-6 and seen == [2, 2]


def test_idealised_flows(spark):
    """Communities that start from the types, and of replicas, are no worse than the types; replicas of a type stay together."""
    from wordloom import registry

    folder = "/root/testdata/sf0.001"
    units = lookup.node_ids(registry._typed_units(spark, folder))
    typed = units.select("node_id", F.hash("text").alias("label"))
    for labels, own in ((registry.hacked_graph_clusters(spark, folder), units), (registry.hacked_representation_graph(spark, folder), lookup.node_ids(lookup.replicate_sample(units.drop("node_id"))))):
        assert labels.count() == own.count() and labels.select("node_id").distinct().count() == own.count()
        edges = pairwise.edit_graph(own.select("node_id", "units"), registry.EDIT).cache()
        at = lambda x: communities.cpm_objective(edges, x, 0.3).first().objective
        assert at(labels) >= at(typed) - 1e-9
    assert labels.join(own, "node_id").groupBy("text").agg(F.countDistinct("label").alias("n")).where("n > 1").isEmpty()


def test_swaps_do_not_hang_on_one_draw(spark):
    """Groups of rows of unlike noise, so that a centre drawn among the noisy ones may gather these alone."""
    rng = np.random.default_rng(3)
    means = rng.normal(scale=0.0137, size=(3, 64))
    x = np.concatenate([m + (0.005 + 0.01 * rng.random((300, 1))) * rng.normal(size=(300, 64)) for m in means])
    points = spark.createDataFrame([(f"{'abc'[k // 300]}{k}", row.tolist()) for k, row in enumerate(x)], "node string, emb array<double>").coalesce(2).cache()
    middle, side = (means[0] + means[1]) / 2, rng.normal(scale=0.001, size=64)
    stuck = clustering._lloyd(points, [middle.tolist(), (means[2] + side).tolist(), (means[2] - side).tolist()], 15)
    for seed in range(3):
        labels = clustering._swapped(points, stuck, seed, 15)[0]
        assert labels.select(F.substring("node", 1, 1).alias("g"), "label").distinct().count() == 3, seed


@pytest.mark.parametrize("n", [1, 40, 47])
def test_dtw_blocks_meet_without_copies(spark, n):
    """Each pair once, for odd and even numbers of blocks, and no shuffle of a block for each of its tiles."""
    rng = np.random.default_rng(n)
    words = spark.createDataFrame([(k, rng.normal(size=(1 + k % 3, 4)).tolist()) for k in range(n)], "node_id long, frames array<array<double>>")
    pairs = pairwise.dtw_pairs(words, 10)
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.i, r.j) for r in pairs.collect()) == list(itertools.combinations(range(n), 2))
