"""Phrases against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_documents import FOLD, frame
from wordloom.llm import phrases

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def plain(rows, least, percent, top):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts.update((lang, *words[i : i + m]) for m in range(1, 5) for i in range(len(words) - m + 1))
    found = {g: a for g, a in counts.items() if len(g) > 2 and a >= least}
    covered = Counter()
    for (lang, *g), a in found.items():
        for m in range(2, len(g)):
            for i in range(len(g) - m + 1):
                covered[lang, *g[i : i + m]] = max(covered[lang, *g[i : i + m]], a)
    lists = {}
    for (lang, *g), a in found.items():
        if 100 * covered[lang, *g] >= percent * a and covered[lang, *g]:
            continue
        cuts = [(2_000_000 * a // (counts[lang, *g[:k]] + counts[lang, *g[k:]]), k) for k in range(1, len(g))]
        score, k = min(cuts)
        lists.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), counts[lang, *g[:k]], counts[lang, *g[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, totals[lang], -s) for lang, xs in lists.items() for i, (s, a, p, l, r) in enumerate(sorted(xs)[:top]))


def texts(seed=0):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "The", "alpha", "beta", "É", "中文", "x-y", "a b", "(so)", "\U0001f600", "zeta"]
    weights = [30, 20, 10, 8, 7, 3, 3, 2, 2, 2, 1, 1]
    out = []
    for _ in range(160):
        words = rng.choices(vocabulary, weights, k=rng.randint(0, 40))
        out.append("".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]) for w in words))
    out += ["one fixed passage that many documents share here"] * 12 + ["the the the the the the"] * 5
    return [*out, None, "", " \t", "...", "w" * 100_000, " ".join(rng.choices(vocabulary, weights, k=20_000))]


def check(spark, least, percent=80, top=2000):
    docs = frame(spark, texts()).repartition(4)
    got = phrases.collocations(docs, least, percent, top)
    assert tuple(got.columns) == COLUMNS and [t for _, t in got.dtypes] == ["string", "bigint", "string", *["bigint"] * 5]
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, least, percent, top)


@pytest.mark.parametrize("least,percent,top", [(3, 80, 2000), (2, 101, 7), (5, 1, 2000)])
def test_phrases(spark, least, percent, top):
    check(spark, least, percent, top)


def test_split_pivots_and_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BUCKET_WORDS", 40)
    monkeypatch.setattr(phrases, "TASK_WORDS", 400)
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 3000)
    check(spark, 3)


def test_dictionary_joined_by_key(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SENT_WORDS", 0)
    monkeypatch.setattr(phrases, "SENT_ROWS", 0)
    monkeypatch.setattr(phrases, "BUCKET_WORDS", 100)
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 3000)
    check(spark, 3)


def test_nothing_to_find(spark):
    assert phrases.collocations(frame(spark, [])).count() == 0
    assert phrases.collocations(frame(spark, [None, "", "a b"])).count() == 0
    odd = frame(spark, ["a b, a b", "a b"]).withColumnRenamed("key", "w1").withColumnRenamed("rep", "rank")
    assert [(r.phrase, r.a) for r in phrases.collocations(odd.withColumn("lang", F.lit(None)), 3).collect()] == [("a b", 3)]


def test_fragments_hold_each_phrase_once():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 5, 4000)
    want = Counter(tuple(g) for m in (2, 3, 4) for g in np.lib.stride_tricks.sliding_window_view(ids, m).tolist() if min(g) > 0)
    rows, counts = phrases.fragments_of(ids.astype("<u4"))
    rows, counts = [c.astype(np.uint64) for c in rows], counts.astype(np.uint64)
    for split in (0, 2, 9):
        got = Counter()
        for words, sums, whole in phrases.mine(rows, counts, 1, split):
            assert (whole == (np.max(np.stack(words), axis=0) > split)).all()
            got.update({tuple(int(c[k]) for c in words): int(sums[k]) for k in range(len(sums))})
        assert got == want


def test_wide_rows_end_row_groups(spark):
    """A row group of chunks ends at its bytes, not at 100 rows; reader and writer hold one whole."""
    import pyarrow.dataset as ds

    from wordloom.llm._shared import spool

    wide = spark.range(0, 20, 1, 1).select("id", F.repeat(F.sha2(F.col("id").cast("string"), 256), 8192).alias("text"))
    made = spool(wide, "wide", "zstd", group_bytes=16 << 10)
    files = [f.removeprefix("file://") for f in made.inputFiles()]
    assert made.count() == 20 and sum(f.count_rows() and len(f.row_groups) for f in ds.dataset(files).get_fragments()) > 1


def test_chunks_are_dealt_in_small_batches(spark, monkeypatch):
    seen = []
    inner = phrases.spool
    monkeypatch.setattr(phrases, "spool", lambda df, name, *a, **k: seen.append((name, spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))) or inner(df, name, *a, **k))
    docs = spark.createDataFrame([("en", "red fox runs. " * 40)], "lang string, text string")
    assert phrases.collocations(docs).count() == 1
    assert [size for name, size in seen if name == "phrases"][0] == str(phrases.CHUNK_BYTES)
