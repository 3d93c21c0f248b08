"""The command line from alignments to scores, on a small made-up corpus."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.plans import cli

WORDS = ["go", "on", "go", "up", "on", "go"]


@pytest.fixture
def corpus(tmp_path):
    rng = np.random.default_rng(0)
    (tmp_path / "ali").mkdir()
    (tmp_path / "npy").mkdir()
    means = {w: rng.normal(size=6) * 5 for w in set(WORDS)}
    wrd, phn = [], []
    for f in ("a", "b"):
        frames = []
        for k, w in enumerate(WORDS):
            wrd.append(f"{f} {k * 0.2:.2f} {(k + 1) * 0.2:.2f} {w}")
            phn += [f"{f} {k * 0.2 + i * 0.1:.2f} {k * 0.2 + (i + 1) * 0.1:.2f} {c}" for i, c in enumerate(w)]
            frames += [means[w] + rng.normal(size=6) * 0.05 for _ in range(10)]
        np.save(tmp_path / "npy" / f"{f}.npy", np.array(frames, np.float32))
    (tmp_path / "ali" / "x.wrd").write_text("\n".join(wrd) + "\n")
    (tmp_path / "ali" / "x.phn").write_text("\n".join(phn) + "\n")
    return tmp_path


def test_flow(spark, corpus):
    at = lambda name: str(corpus / name)
    words = cli.run(spark, ["boundaries", "mandarin", at("ali"), at("b")]).collect()
    assert len(words) == 12 and {tuple(r.phones) for r in words} == {("g", "o"), ("o", "n"), ("u", "p")}
    assert [(r.filename, r.start, r.end) for r in cli.run(spark, ["vad", at("b"), at("v")]).orderBy("filename").collect()] == [("a", 0.0, 1.2), ("b", 0.0, 1.2)]
    frames = cli.run(spark, ["cut", at("npy"), at("b"), at("f")])
    assert frames.select("node").distinct().count() == 12
    for args in (["avg", at("f"), at("b"), at("p1"), "agg"], ["graph", at("f"), at("b"), at("p2"), "cos", "0.4"], ["graph", at("f"), at("b"), at("p3"), "ed", "0.4", "--k", "3", "--lmbda", "1"], ["graph", at("f"), at("b"), at("p4"), "dtw", "0.3"]):
        scores = cli.run(spark, args).first()
        assert (scores.ned, scores.purity, scores.v) == (0.0, 1.0, 1.0), args
    assert cli.run(spark, ["evaluate", at("p1"), at("b"), "--phone_level"]).first().n_true == 3
    with pytest.raises(ValueError):
        cli.run(spark, ["graph", at("f"), at("b"), at("p5"), "ed", "0.4"])


def test_second_run_makes_nothing_again(spark, corpus, monkeypatch):
    from wordloom.operators import pairwise, quantise

    at = lambda name: str(corpus / name)
    cli.run(spark, ["boundaries", "mandarin", at("ali"), at("b")])
    cli.run(spark, ["cut", at("npy"), at("b"), at("f")])
    common = ["--catalog", at("cat"), "--k", "3", "--lmbda", "1", "--language", "mandarin"]
    first = [cli.run(spark, ["graph", at("f"), at("b"), at(f"q{k}"), d, "0.4", *common]).first() for k, d in enumerate(("ed", "dtw", "cos"))]

    def stop(*_, **__):
        raise AssertionError("made again")

    for module, name in ((quantise, "train_codebook"), (quantise, "quantise"), (pairwise, "edit_graph"), (pairwise, "dtw_pairs"), (pairwise, "cosine_graph"), (cli.flows.communities, "cpm_partition")):
        monkeypatch.setattr(module, name, stop)
    again = [cli.run(spark, ["graph", at("f"), at("b"), at(f"r{k}"), d, "0.4", *common]).first() for k, d in enumerate(("ed", "dtw", "cos"))]
    assert [(x.ned, x.v) for x in first] == [(x.ned, x.v) for x in again] == [(0.0, 1.0)] * 3
    with pytest.raises(AssertionError):
        cli.run(spark, ["graph", at("f"), at("b"), at("s"), "ed", "0.3", *common])
    # tables that are there are read and left as they are
    monkeypatch.setattr(cli.intervals, "containment_join", stop)
    monkeypatch.setattr(cli.intervals, "cut_frames", stop)
    assert cli.run(spark, ["boundaries", "mandarin", at("ali"), at("b")]).count() == 12
    assert cli.run(spark, ["cut", at("npy"), at("b"), at("f")]).select("node").distinct().count() == 12
    with pytest.raises(AssertionError):  # fewer words than boundaries: cut again
        spark.read.parquet(at("f")).where("node <> 'a_0'").write.parquet(at("f2"))
        cli.run(spark, ["cut", at("npy"), at("b"), at("f2")])


def test_words_without_frames_are_cut_once(spark, corpus, monkeypatch):
    at = lambda name: str(corpus / name)
    cli.run(spark, ["boundaries", "mandarin", at("ali"), at("b")])
    longer = spark.read.csv(at("b"), header=True).limit(1).withColumn("word_id", F.lit("99")).withColumn("word_start", F.lit("900.0")).withColumn("word_end", F.lit("901.0"))
    spark.read.csv(at("b"), header=True).unionByName(longer).write.csv(at("b2"), header=True)
    assert cli.run(spark, ["cut", at("npy"), at("b2"), at("f")]).select("node").distinct().count() == 12
    monkeypatch.setattr(cli.intervals, "cut_frames", lambda *_: 1 / 0)
    assert cli.run(spark, ["cut", at("npy"), at("b2"), at("f")]).select("node").distinct().count() == 12


def test_results_are_known_by_what_they_are_made_from(spark, corpus, monkeypatch):
    """Changed frames, words or training frames, or batches, under the same names, are other results; tiles of other words stay."""
    from wordloom.operators import pairwise, quantise

    at = lambda name: str(corpus / name)
    cli.run(spark, ["boundaries", "mandarin", at("ali"), at("b")])
    cli.run(spark, ["cut", at("npy"), at("b"), at("f")])
    made = []
    for module, name in ((quantise, "train_codebook"), (quantise, "train_codebook_by_batches"), (pairwise, "edit_graph")):
        monkeypatch.setattr(module, name, lambda *a, f=getattr(module, name), n=name, **k: made.append(n) or f(*a, **k))
    common = ["--catalog", at("cat"), "--k", "3", "--lmbda", "1", "--language", "mandarin", "--dataset", "dev"]
    run = lambda out, *more, frames="f": made.clear() or cli.run(spark, ["graph", at(frames), at("b"), at(out), "ed", "0.4", *common, *more]) and list(made)
    assert run("o1") == ["train_codebook", "edit_graph"] and run("o2") == []
    assert run("o3", "--batch_files", "5") == ["train_codebook_by_batches", "edit_graph"]
    frames = spark.read.parquet(at("f"))
    frames.withColumn("vec", F.when(F.col("node") == "a_0", F.transform("vec", lambda x: x + 1)).otherwise(F.col("vec"))).write.parquet(at("g"))
    assert run("o4", frames="g") == ["train_codebook", "edit_graph"]
    assert run("o6", "--train_frames", at("g")) == ["edit_graph"]  # by the codebook of the changed frames, which is there


def test_units_folder_and_batches(spark, corpus):
    at = lambda name: str(corpus / name)
    cli.run(spark, ["boundaries", "mandarin", at("ali"), at("b")])
    cli.run(spark, ["cut", at("npy"), at("b"), at("f")])
    args = ["graph", at("f"), at("b"), at("p"), "ed", "0.4", "--k", "3", "--lmbda", "1", "--units", at("u"), "--batch_files", "5"]
    cli.run(spark, args)
    units = {r.node: r.units for r in spark.read.parquet(at("u")).collect()}
    assert len(units) == 12 and all(len(u) == 10 for u in units.values())
    with pytest.raises(ValueError):
        cli.run(spark, ["graph", at("f"), at("b"), at("p9"), "ed", "0.4", "--k", "3", "--lmbda", "1", "--language", "latin"])


@pytest.mark.parametrize("kind", ["graph", "kmeans"])
def test_idealised_flows(spark, corpus, kind):
    at = lambda name: str(corpus / name)
    cli.run(spark, ["boundaries", "mandarin", at("ali"), at("b")])
    cli.run(spark, ["cut", at("npy"), at("b"), at("f")])
    common = [kind, "--k", "3", "--lmbda", "1"]
    for command, more in (("oracle_types", []), ("oracle_types", ["--phone_level"]), ("oracle_means", [])):
        out = at(f"{command}{len(more)}")
        scores = cli.run(spark, [command, at("f"), at("b"), out, *common, *more]).first()
        # unit vectors about means that are not normalised may settle in a lesser optimum
        assert scores.purity > 0.8 if (kind, command) == ("kmeans", "oracle_types") else (scores.purity, scores.v) == (1.0, 1.0)
    scores = cli.run(spark, ["oracle_means", at("f"), at("b"), at("oracle_means0"), kind, "--res", "0.3"]).first()
    assert scores.purity == 1.0


def test_extract(spark, tmp_path):
    import wave

    at = lambda name: str(tmp_path / name)
    (tmp_path / "audio").mkdir()
    for name, rate in (("x", 16000), ("y", 8000)):
        with wave.open(at(f"audio/{name}.wav"), "wb") as f:
            f.setnchannels(1)
            f.setsampwidth(2)
            f.setframerate(rate)
            f.writeframes((np.sin(np.arange(rate) * 2 * np.pi * 100 / rate) * 20000).astype("<i2").tobytes())
    base = ["--encoder", "tests.encoders:layers"]
    whole = {r.node: np.array(r.frames) for r in cli.run(spark, ["extract", "english", at("audio"), at("o1"), "wavlm-large", "2", *base, "--suffix", "wav"]).collect()}
    assert set(whole) == {"x", "y"} and all(len(v) == 50 for v in whole.values())
    assert np.abs(whole["x"][5:-5] - whole["y"][5:-5]).max() < 0.02 and whole["x"][:, 1].max() == pytest.approx(2 * 20000 / 32768 / 2**0.5, rel=0.02)
    spark.createDataFrame([(0, "x", 0.0, 0.5), (1, "x", 0.5, 1.0), (2, "x", 5.0, 6.0), (0, "y", 0.1, 0.3)], "seg_id int, filename string, start double, end double").write.csv(at("vad"), header=True)
    args = ["extract", "mandarin", at("audio"), at("o2"), "hubert-soft", "7", *base, "--segments", at("vad")]
    parts = {r.node: len(r.frames) for r in cli.run(spark, args).collect()}
    assert parts == {"x_0": 25, "x_1": 25, "y_0": 10}
    # a segment without samples has no features, which is no reason to make all again
    assert {r.node for r in cli.run(spark, [*args[:6], "--encoder", "tests.encoders:missing", "--segments", at("vad")]).collect()} == set(parts)
    capped = cli.run(spark, ["extract", "english", at("audio"), at("o3"), "mhubert", "1", *base, "--suffix", "wav", "--for_kmeans"])
    assert capped.count() == 2
    with pytest.raises(ValueError):
        cli.run(spark, ["extract", "latin", at("audio"), at("o4"), "mhubert", "1", *base])
    with pytest.raises(ValueError):
        cli.run(spark, ["extract", "mandarin", at("audio"), at("o4"), "mhubert", "1", *base])
