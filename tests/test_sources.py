"""Round trips through files."""

import datetime
import time

import numpy as np

from wordloom.operators import intervals
from wordloom.sources import alignments, features, partitions
from wordloom.sources.catalog import Catalog, RunKey
from wordloom.streaming.segments import session_segments, stream_segments

LONG = """File type = "ooTextFile"
Object class = "TextGrid"

xmin = 0
xmax = 1
tiers? <exists>
size = 2
item []:
    item [1]:
        class = "IntervalTier"
        name = "words"
        xmin = 0
        xmax = 1
        intervals: size = 2
        intervals [1]:
            xmin = 0
            xmax = 0.4
            text = "go"
        intervals [2]:
            xmin = 0.4
            xmax = 1
            text = ""
    item [2]:
        class = "IntervalTier"
        name = "phones"
        xmin = 0
        xmax = 1
        intervals: size = 3
        intervals [1]:
            xmin = 0
            xmax = 0.2
            text = "G"
        intervals [2]:
            xmin = 0.2
            xmax = 0.4
            text = "OW1"
        intervals [3]:
            xmin = 0.4
            xmax = 1
            text = "sil"
"""


def test_textgrid(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "good.TextGrid").write_text(LONG)
    (tmp_path / "bad.TextGrid").write_text("nonsense")
    tiers = alignments.read_textgrids(spark, str(tmp_path)).cache()
    assert [r.filename for r in tiers.where("corrupt is not null").collect()] == ["bad"]
    joined = intervals.overlap_join(alignments.textgrid_words(tiers), alignments.textgrid_phones(tiers)).collect()
    assert [(r.word_id, r.text, r.phones) for r in joined] == [(1, "go", ["g", "ow"])]


def test_lines(spark, tmp_path):
    (tmp_path / "m.wrd").write_text("a 0.0 0.5 x\na 0.5 1.0 y\nb 0.0 1.0 z\nbroken line\na 1.0 2.0 w\n")
    lines = alignments.read_lines(spark, str(tmp_path / "m.wrd"))
    got = [(r.filename, r.word_id) for r in intervals.run_ordinals(lines).orderBy("line_no").collect()]
    assert got == [("a", 0), ("a", 1), ("b", 0), ("a", 0)]


def test_boundaries_csv(spark, tmp_path):
    words = spark.createDataFrame([(1, "f", 0.1, 0.2, "go", ["g", "ow"]), (2, "f", 0.2, 0.3, "um", [])], "word_id int, filename string, word_start double, word_end double, text string, phones array<string>")
    alignments.write_boundaries(words, str(tmp_path / "b"))
    got = {r.word_id: r.phones for r in alignments.read_boundaries(spark, str(tmp_path / "b")).collect()}
    assert got == {1: ["g", "ow"], 2: None}


def test_npy(spark, tmp_path):
    np.save(tmp_path / "f_1.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    rows = features.as_frames(features.read_npy(spark, str(tmp_path))).orderBy("frame").collect()
    assert [(r.node, r.vec) for r in rows] == [("f_1", [0.0, 1.0]), ("f_1", [2.0, 3.0]), ("f_1", [4.0, 5.0])]


def test_partition_files(spark, tmp_path):
    words = spark.createDataFrame([("f", 1, 0.1, 0.2, "go", ["g", "ow"])], "filename string, word_id int, word_start double, word_end double, text string, phones array<string>")
    members = spark.createDataFrame([("f", 1, 7), ("f", 2, 7), ("f", 1, 8)], "filename string, word_id int, cluster long")
    partitions.write_partition(members, words, str(tmp_path / "p"))
    got = sorted((r.cluster, r.filename, r.start, r.end, r.rest) for r in partitions.read_partition(spark, str(tmp_path / "p")).collect())
    assert got == [(7, "f", 0.1, 0.2, "go g,ow"), (8, "f", 0.1, 0.2, "go g,ow")]


def test_large_block_is_parsed_once(spark):
    """A block is not split again for each of its lines (20,000 lines would take minutes)."""
    n = 20_000
    text = "Class 7\n" + "\n".join(f"f{k} {k}.0 {k}.5 go g,ow" for k in range(n)) + "\n\nClass x\nf 1 2 a b\nClass 8\n\nf 1 2\nf 3"
    began = time.monotonic()
    got = partitions.parse_partition(spark.createDataFrame([(text,)], "value string")).collect()
    assert time.monotonic() - began < 30
    assert len(got) == n + 1 and {r.cluster for r in got} == {7, 8}


def test_partition_texts_are_pieces(spark):
    words = spark.createDataFrame([("f", k, k / 10, k / 10 + 0.1, "go", ["g", "ow"]) for k in range(1, 24)], "filename string, word_id int, word_start double, word_end double, text string, phones array<string>")
    members = words.select("filename", "word_id", (words["word_id"] % 2).cast("long").alias("cluster"))
    lines = partitions.partition_lines(members, words, decimals=1)
    for c in (0, 1):
        assert [r.position for r in lines.where(f"cluster = {c}").orderBy("position").collect()] == list(range(len([k for k in range(1, 24) if k % 2 == c]) + 1))
    texts = partitions.partition_texts(lines, piece=5)
    assert texts.count() == 6 and max(r.value.count("\n") for r in texts.collect()) == 5
    got = sorted((r.cluster, r.start) for r in partitions.parse_partition(texts).collect())
    assert got == sorted((k % 2, k / 10) for k in range(1, 24))


def test_catalog(spark, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/c")
    key = RunKey("graph", "english", "test", "m", "1", "cos", 0.4, resolution=0.3)
    made = []
    for _ in range(2):
        catalog.get_or_make(key, lambda: made.append(1) or spark.range(3))
    assert len(made) == 1 and catalog.find(key)[0].count() == 3
    assert catalog.find(RunKey("graph", "english", "test", "m", "1", "cos", 0.4, resolution=0.5)) is None


def test_hours_budget(spark):
    files = spark.createDataFrame([("a1", 20.0), ("a2", 20.0), ("b1", 20.0), ("b2", 1.0)], "name string, hours double")
    assert sorted(r.name for r in features.within_budget(files).collect()) == ["a1", "a2"]


def test_words_without_length_do_not_open_sessions(spark):
    """A word of length 0 and the next one start together; whichever row comes first, the pause counts from the longer one's end."""
    rows = [("f", 100, 60), ("f", 100, 0), ("f", 160, 10)]
    for order in (rows, rows[::-1], [rows[1], rows[0], rows[2]]):
        got = session_segments(spark.createDataFrame(order, "filename string, start_cs long, dur long").coalesce(1)).collect()
        assert [(r.start, r.end, r.n_words) for r in got] == [(1.0, 1.7, 3)]


def test_stream(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [("a", t + datetime.timedelta(hours=h)) for h in (0, 1, 9, 30)] + [("a", t + datetime.timedelta(days=9))]
    spark.createDataFrame(rows, "filename string, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("filename string, ts timestamp").parquet(str(tmp_path / "in"))
    query = stream_segments(stream).writeStream.format("memory").queryName("segs").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.n_words for r in spark.table("segs").collect())[-1] == 2
