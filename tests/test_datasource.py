"""Files read and written through Spark's data source interface."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_sources import LONG
from wordloom.sources import alignments, datasource, features, partitions


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def formats(spark):
    return datasource.register(spark).read


def test_textgrids_equal_the_binary_reader(spark, formats, tmp_path):
    (tmp_path / "x").mkdir()
    for k in range(5):
        (tmp_path / "x" / f"f{k}.TextGrid").write_text(LONG.replace('"go"', f'"go ""{k}"""'))
    (tmp_path / "bad.TextGrid").write_text("nonsense")
    (tmp_path / "_hidden.TextGrid").write_text(LONG)
    (tmp_path / "other.txt").write_text(LONG)
    got = formats.format("wordloom_textgrid").option("bytes", 2000).load(str(tmp_path))
    assert rows(got) == rows(alignments.read_textgrids(spark, str(tmp_path)).where("filename <> '_hidden'"))
    assert 1 < got.rdd.getNumPartitions() < 6


def test_filters_leave_files_unread(formats, tmp_path):
    for k in range(4):
        (tmp_path / f"f{k}.TextGrid").write_text(LONG)
        np.save(tmp_path / f"n{k}.npy", np.full((2, 3), k))
    grids = formats.format("wordloom_textgrid").option("bytes", 1).load(str(tmp_path))
    some = grids.where("filename IN ('f1', 'f2', 'none') AND tier = 'phones' AND pos > 0")
    assert some.rdd.getNumPartitions() == 2
    assert [tuple(r)[:3] for r in some.orderBy("filename", "pos").collect()] == [(f, "phones", k) for f in ("f1", "f2") for k in (1, 2)]
    one = formats.format("wordloom_npy").option("bytes", 1 << 20).load(str(tmp_path)).where("node = 'n3'")
    assert one.rdd.getNumPartitions() == 1 and [tuple(r.vec) for r in one.collect()] == [(3.0,) * 3] * 2
    assert grids.where("filename = 'none'").isEmpty()


@pytest.mark.parametrize("size", [1, 40, 100, 1000, 1 << 20])
def test_matrices_are_split_between_rows(spark, formats, tmp_path, size):
    made = np.random.default_rng(1)
    np.save(tmp_path / "a.npy", made.normal(size=(37, 5)))
    np.save(tmp_path / "b.npy", made.normal(size=(4, 3)).astype(np.float32))
    np.save(tmp_path / "column.npy", np.asfortranarray(made.normal(size=(6, 2))))
    np.save(tmp_path / "empty.npy", np.zeros((0, 4)))
    np.save(tmp_path / "flat.npy", np.arange(7))
    np.save(tmp_path / "single.npy", np.float64(2.5))
    got = formats.format("wordloom_npy").option("bytes", size).load(str(tmp_path))
    assert rows(got) == rows(features.as_frames(features.read_npy(spark, str(tmp_path))).select("node", "frame", "vec"))


def test_broken_matrices_are_errors(formats, tmp_path):
    np.save(tmp_path / "a.npy", np.ones((20, 5)))
    whole = (tmp_path / "a.npy").read_bytes()
    (tmp_path / "a.npy").write_bytes(whole[:-8])
    with pytest.raises(Exception, match="ends within row 19"):
        formats.format("wordloom_npy").load(str(tmp_path)).collect()


@pytest.mark.parametrize("size", [1, 7, 50, 1 << 20])
def test_partition_files_are_split_between_blocks(spark, formats, tmp_path, size):
    (tmp_path / "a.txt").write_bytes("lost 1 2\nClass 3\nf 0.5 1.25 the a,b\ng_1\tError\n\nClass x\nf 1 2 no\nClass 12 \r\nf 1 2\r\n  é one 3 x  y\n\nClass 13\n\nClass 3\nh 7 8 late".encode())
    (tmp_path / "b.txt").write_text("")
    (tmp_path / "_SUCCESS").write_text("")
    got = formats.format("wordloom_partition").option("bytes", size).load(str(tmp_path))
    assert rows(got) == rows(partitions.read_partition(spark, f"{tmp_path}/[ab].txt"))
    assert {r.filename for r in got.where("cluster = 3").collect()} == {"f", "h"}


def test_empty_folder_and_none(formats, tmp_path):
    (tmp_path / "x").mkdir()
    for name in ("textgrid", "npy", "partition"):
        assert formats.format(f"wordloom_{name}").load(str(tmp_path / "x")).isEmpty()
    with pytest.raises(Exception, match="FileNotFoundError|none"):
        formats.format("wordloom_npy").load(str(tmp_path / "none")).collect()


def test_textgrids_written(spark, formats, tmp_path):
    want = [(f"f{k}", t, p, p / 3, (p + 1) / 3, label, None) for k in range(20) for t in ("words", "phones") for p, label in enumerate(("a", 'say "x"', "", "ü"))]
    tiers = spark.createDataFrame(want, alignments.TIERS)
    datasource.write_textgrids(tiers, str(tmp_path / "t"))
    read = formats.format("wordloom_textgrid")
    assert rows(read.load(str(tmp_path / "t"))) == sorted(want, key=repr) == rows(alignments.read_textgrids(spark, str(tmp_path / "t")))
    datasource.write_textgrids(tiers.where("filename IN ('f1', 'f2')").withColumn("label", F.lit("new")), str(tmp_path / "t"), "overwrite")
    assert {(r.filename, r.label) for r in read.load(f"file://{tmp_path}/t").collect()} == {("f1", "new"), ("f2", "new")}
    assert [p.name for p in (tmp_path / "t").iterdir() if p.name.startswith(".")] == []


def test_matrices_written(spark, formats, tmp_path):
    words = spark.createDataFrame([("a", [[1.0, 2.0], [3.0, 4.0]]), ("b", [[5.0, 6.0]]), ("none", []), ("null", None)], "node string, frames array<array<double>>")
    datasource.write_npy(words, str(tmp_path / "n"))
    got = formats.format("wordloom_npy").load(str(tmp_path / "n"))
    assert rows(got) == [("a", 0, [1.0, 2.0]), ("a", 1, [3.0, 4.0]), ("b", 0, [5.0, 6.0])]
    datasource.write_npy(words.where("node = 'b'").withColumn("node", F.lit("c")), str(tmp_path / "n"))
    assert {r.node for r in got.sparkSession.read.format("wordloom_npy").load(str(tmp_path / "n")).collect()} == {"a", "b", "c"}


def test_partitions_written(spark, formats, tmp_path):
    words = spark.createDataFrame([(f"f{k}", k, k / 2, k / 2 + 1, "the", ["a", "b"]) for k in range(40)], "filename string, word_id long, word_start double, word_end double, text string, phones array<string>")
    members = words.select("filename", "word_id", (F.col("word_id") % 7).alias("cluster")).union(spark.createDataFrame([("lost", 1, 3)]))
    lines = partitions.partition_lines(members, words, decimals=2)
    datasource.write_partitions(lines, str(tmp_path / "d"))
    partitions.write_partition(members, words, str(tmp_path / "p"), decimals=2)
    text = lambda folder: sorted(b for p in folder.glob("part-*") for b in p.read_text().split("\n\n"))
    assert [b for b in text(tmp_path / "d") if b] == [b for b in text(tmp_path / "p") if b]
    assert rows(formats.format("wordloom_partition").load(str(tmp_path / "d"))) == rows(partitions.read_partition(spark, str(tmp_path / "p")))


def test_failed_write_leaves_old_files(spark, formats, tmp_path):
    good = spark.createDataFrame([("a", "x", 0, 0.0, 1.0, "l", None)], alignments.TIERS)
    datasource.write_textgrids(good, str(tmp_path / "t"))
    bad = spark.createDataFrame([("b", None, 0, 0.0, 1.0, "l", None)], alignments.TIERS)
    with pytest.raises(Exception, match="without filename or tier"):
        datasource.write_textgrids(bad, str(tmp_path / "t"), "overwrite")
    assert [p.name for p in (tmp_path / "t").iterdir() if p.suffix == ".TextGrid"] == ["a.TextGrid"]


def test_textgrids_go_through_batches(spark, formats, tmp_path):
    """Neither way makes a row object of an interval: tiers go on from batch to batch, small files share one."""
    want = [(f"f{k}", t, p, p / 3, (p + 1) / 3, f"{k}", None) for k in range(9) for t in ("phones", "words") for p in range(50)]
    made = spark.createDataFrame(want, alignments.TIERS).coalesce(1).toArrow()
    options = {"path": str(tmp_path / "t")}
    source = datasource.TextGridSource(options)
    writer = source.writer(spark.createDataFrame([], alignments.TIERS).schema, False)
    writer.commit([writer.write(iter(made.to_batches(max_chunksize=7)))])
    reader = source.reader(None)
    batches = [b for part in reader.partitions() for b in reader.read(part)]
    assert len(batches) == 1 and sorted(tuple(r.values()) for r in batches[0].to_pylist()) == sorted(want)
    spoken = formats.format("wordloom_textgrid").load(str(tmp_path / "t"))
    assert rows(spoken) == sorted(want, key=repr)
