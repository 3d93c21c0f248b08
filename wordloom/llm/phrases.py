"""Phrase collocations by pivot partitioning.

Texts are cut once into chunks of word numbers with the chunk's own dictionary;
the dictionaries give the frequency of every word of a language.  Words of at
least ``least`` occurrences are numbered by falling frequency, over all
languages, and no phrase can hold another word.

The pivot of a phrase is its rarest word, the one of the greatest number, at
its first place if it stands there more than once.  An occurrence of a word is
routed to that word with the fragment that its phrases can use: up to three
words before it, all more frequent than it, and up to three after it, none
rarer.  Every occurrence of a phrase so lies in exactly one fragment.  Equal
fragments of a chunk are counted before the exchange.  A bucket of pivots mines
its fragments alone, two words first: a side whose two words are too rare for
the whole corpus is cut off before longer phrases are counted.

A pivot of more occurrences than a bucket should hold is split by a hash of the
fragment; the counts of its parts are added up afterwards.  How far words are
split follows from at most 40 counts of the dictionary, so nothing that grows
is sent to the tasks, but the dictionary where it is counted to be small; a
larger one is joined to the chunks' dictionaries by key.

Defined results: a null text is empty, a null lang is ``und``; ids play no part,
so null and repeated ids and rows each count; a word or text of any length is
taken whole (a text is in one chunk); phrases of equal score and frequency are
ordered by their UTF-8 bytes; an empty table gives an empty result; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm._bytes import GOLDEN, LOWER, binary_array, mix, numbered, text_slices
from wordloom.llm._shared import small_batches, spool
from wordloom.operators.lookup import node_ids

LEAST, PERCENT, TOP, LONGEST = 30, 80, 2000, 4
#: Bytes of text in a chunk.
CHUNK_BYTES = 4 << 20
#: Word occurrences for a task of the exchange, and for one of the buckets it mines one by one.
TASK_WORDS, BUCKET_WORDS = 1 << 20, 1 << 17
#: A dictionary of at most so many words and bytes is sent to all tasks.
SENT_WORDS, SENT_BYTES = 1_000_000, 64 << 20
#: A table of at most so many rows is sent to all tasks of a join.
SENT_ROWS = 100_000
#: Parts of the ranking of a language before the last one.
RANK_PARTS = 64

CHUNKS = "chunk long, langs array<string>, words array<string>, counts array<long>, codes binary, totals array<struct<lang:string,n:long>>"
_FRAGMENTS = pa.schema([("bucket", pa.int64()), ("n", pa.int64()), ("fragments", pa.binary())])
_PHRASES = pa.schema([(c, pa.int64()) for c in ("w1", "w2", "w3", "w4", "a")] + [("whole", pa.bool_())])
KEY = ("w1", "w2", "w3", "w4")

_BREAK, _GAP = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP[[0x20, 0x09]] = True


def _list_of(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _chunks() -> Callable:
    """Rows of CHUNKS: ``codes`` numbers the chunk's (lang, word) pairs from 1; 0 is a border."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            lang = batch.column("lang").dictionary_encode()
            names, lang_row = lang.dictionary.to_pylist(), lang.indices.to_numpy().astype(np.int64)
            for first, _, offsets, data in text_slices(batch.column("text"), CHUNK_BYTES):
                apart = _BREAK[data] | _GAP[data]
                word = ~apart
                opens = word.copy()
                opens[1:] &= apart[:-1]
                heads = offsets[:-1][offsets[:-1] < len(data)]
                opens[heads] |= word[heads]
                starts = np.flatnonzero(opens)
                if not len(starts):
                    continue
                closes = word.copy()
                closes[:-1] &= apart[1:]
                tails = offsets[1:][offsets[1:] > 0] - 1
                closes[tails] |= word[tails]
                ends = np.flatnonzero(closes) + 1
                row = np.searchsorted(offsets, starts, "right") - 1
                number, distinct = numbered(binary_array(LOWER[data[word]], ends - starts))
                pair = number * len(names) + lang_row[first + row]
                code, pairs = numbered(pa.array(pair))
                pairs = pairs.to_numpy()
                count = np.bincount(code, minlength=len(pairs))
                breaks = np.concatenate([[0], np.cumsum(_BREAK[data])])
                border = np.flatnonzero((row[1:] != row[:-1]) | (breaks[starts[1:]] > breaks[ends[:-1]])) + 1
                codes = np.insert(code + 1, border, 0).astype("<u4")
                langs = pa.array(names, pa.string()).take(pa.array(pairs % len(names)))
                totals = np.bincount(pairs % len(names), weights=count, minlength=len(names)).astype(np.int64).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([base + made], pa.int64()),
                        _list_of(langs),
                        _list_of(distinct.take(pa.array(pairs // len(names))).cast(pa.large_string()).cast(pa.string())),
                        _list_of(pa.array(count, pa.int64())),
                        pa.array([codes.tobytes()], pa.binary()),
                        pa.array([[{"lang": x, "n": n} for x, n in zip(names, totals, strict=True) if n]], pa.list_(pa.struct([("lang", pa.string()), ("n", pa.int64())]))),
                    ],
                    names=["chunk", "langs", "words", "counts", "codes", "totals"],
                )
                made += 1

    return run


def fragments_of(ids: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Seven columns (three words before, the pivot, three after; 0 is none) of the different
    fragments of a sequence of word numbers, and how often each occurs."""
    padded = np.pad(ids, 3)
    n = len(ids)
    pivot = padded[3 : 3 + n]
    columns: dict[int, np.ndarray] = {0: pivot}
    for side in (-1, 1):
        open_ = np.ones(n, bool)
        for step in (1, 2, 3):
            near = padded[3 + side * step : 3 + side * step + n]
            open_ = open_ & (near > 0) & ((near < pivot) if side < 0 else (near <= pivot))
            columns[side * step] = np.where(open_, near, near.dtype.type(0))
    used = np.flatnonzero((pivot > 0) & ((columns[-1] > 0) | (columns[1] > 0)))
    rows = [columns.pop(k)[used] for k in range(-3, 4)]
    order = np.argsort(fragment_hashes(rows), kind="stable")
    for k in range(7):
        rows[k] = rows[k][order]
    # equal hashes only bring equal fragments together; all seven words decide
    fresh = np.ones(len(order), bool)
    if len(order):
        fresh[1:] = np.any([c[1:] != c[:-1] for c in rows], axis=0)
    at = np.flatnonzero(fresh)
    return [c[at] for c in rows], np.diff(np.append(at, len(order))).astype(ids.dtype)


def fragment_hashes(rows: list[np.ndarray]) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.zeros(len(rows[0]), np.uint64)
        for c in rows:
            h = mix((h ^ c.astype(np.uint64)) * GOLDEN + np.uint64(1))
    return h


def _deal(buckets: int, split: list[int], width: str, sent=None) -> Callable:
    """Fragments of chunks, dealt to buckets by pivot; ``split[j]`` words are split into 2**(j + 1) parts or more."""

    def numbers(batch: pa.RecordBatch, row: int) -> np.ndarray:
        if sent is None:
            number = np.zeros(batch.column("n_words")[row].as_py() + 1, np.int64)
            number[np.array(batch.column("places")[row].as_py(), np.int64) + 1] = batch.column("ids")[row].as_py()
            return number
        known = sent.value
        words = pc.binary_join_element_wise(batch.column("langs")[row].values, batch.column("words")[row].values, "\t")
        return np.concatenate([[0], pc.fill_null(pc.index_in(words, known), -1).to_numpy().astype(np.int64) + 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                codes = np.frombuffer(batch.column("codes")[row].as_py(), "<u4")
                rows, count = fragments_of(numbers(batch, row).astype(width)[codes])
                pivot = rows[3].astype(np.uint64)
                with np.errstate(over="ignore"):
                    shares = np.zeros(len(pivot), np.uint64)
                    for top in split:
                        shares += pivot <= np.uint64(top)
                    part = fragment_hashes(rows) & ((np.uint64(1) << shares) - np.uint64(1))
                    bucket = (mix(pivot * GOLDEN + part) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                table = np.stack([c[order] for c in (*rows, count)])
                at = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                borders = [*at.tolist(), len(order)]
                blobs = [table[:, a:b].tobytes() for a, b in zip(borders[:-1], borders[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[order][at], pa.int64()), pa.array(np.diff(borders), pa.int64()), pa.array(blobs, pa.binary())], schema=_FRAGMENTS)

    return run


def _tally(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(columns of the different rows, sum of counts of each, number of each row's one)."""
    code = np.zeros(len(counts), np.int64)
    for c in columns:
        # both numbers are below the count of rows, so the product stays in 64 bits
        own = np.unique(c, return_inverse=True)[1]
        code = np.unique(code * (len(c) + 1) + own, return_inverse=True)[1]
    n = int(code.max()) + 1 if len(code) else 0
    first = np.zeros(n, np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    sums = np.zeros(n, np.uint64)
    np.add.at(sums, code, counts)
    return [c[first] for c in columns], sums, code


def mine(rows: list[np.ndarray], counts: np.ndarray, least: int, split: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """(words, counts, whole) of the phrases of 2 to 4 words that the fragments' pivots own.

    Phrases of a whole pivot are those of ``least`` occurrences; pivots of numbers up to ``split`` give parts.
    """
    at = {k: c.copy() for k, c in zip(range(-3, 4), rows, strict=True)}
    middle = np.ones(len(counts), bool)
    for size in (2, 3, 4):
        spans = [(a, a + size - 1) for a in range(1 - size, 1)]
        held = [np.flatnonzero((at[a] > 0) & (at[b] > 0) & (middle | (a == 0) | (b == 0))) for a, b in spans]
        columns = [np.concatenate([at[a + k][h] for (a, _), h in zip(spans, held, strict=True)]) for k in range(size)]
        pivot = np.concatenate([at[0][h] for h in held])
        found, sums, code = _tally(columns, np.concatenate([counts[h] for h in held]))
        owner = np.zeros(len(sums), np.uint64)
        owner[code] = pivot
        whole = owner > np.uint64(split)
        good = (sums >= np.uint64(least)) | ~whole
        yield [c[good] for c in found], sums[good], whole[good]
        # what is longer than a phrase that is too rare is too rare as well
        ends = np.cumsum([len(h) for h in held])
        for (a, b), h, end in zip(spans, held, ends.tolist(), strict=True):
            rare = h[~good[code[end - len(h) : end]]]
            if b == 0:
                for k in range(-3, a + 1):
                    at[k][rare] = 0
            elif a == 0:
                for k in range(b, 4):
                    at[k][rare] = 0
            elif size == 3:
                middle[rare] = False


def _mine(least: int, split: int, width: str) -> Callable:
    def of_bucket(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(b, width).reshape(8, -1) for b in blobs]
        table = np.concatenate(parts, axis=1).astype(np.uint64)
        for words, sums, whole in mine(list(table[:7]), table[7], least, split):
            columns = [*words, *[np.zeros(len(sums), np.uint64)] * (LONGEST - len(words)), sums]
            yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64)) for c in columns), pa.array(whole)], schema=_PHRASES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blobs = None, []
        for batch in batches:
            for b, blob in zip(batch.column("bucket").to_pylist(), batch.column("fragments").to_pylist(), strict=True):
                if b != bucket and blobs:
                    yield from of_bucket(blobs)
                    blobs = []
                bucket = b
                blobs.append(blob)
        if blobs:
            yield from of_bucket(blobs)

    return run


def frequent_phrases(chunks: DataFrame, dictionary: DataFrame, n_words: int, n_all: int, sent_bytes: int, least: int) -> DataFrame:
    """w1, w2, w3, w4 (numbers of words, 0 is none), a: phrases of 2 to 4 words with at least ``least`` occurrences."""
    spark = chunks.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_all // TASK_WORDS))
    buckets = tasks * max(TASK_WORDS // BUCKET_WORDS, 1)
    width = "<u4" if max(n_words, n_all) < 1 << 32 else "<u8"
    levels = [F.count(F.when(F.col("f") > BUCKET_WORDS * 2**j, 1)).alias(f"level{j}") for j in range(40)]
    split = [n for n in dictionary.agg(*levels).first() if n]
    if n_words <= SENT_WORDS and sent_bytes <= SENT_BYTES:
        listed = dictionary.orderBy("id").select(F.concat_ws("\t", "lang", "word").alias("w")).toArrow().column("w").combine_chunks()
        dealt = chunks.select("codes", "langs", "words").mapInArrow(_deal(buckets, split, width, spark.sparkContext.broadcast(listed)), "bucket long, n long, fragments binary")
    else:
        pairs = chunks.select("chunk", F.posexplode(F.arrays_zip("langs", "words")).alias("place", "x")).select("chunk", "place", "x.langs", "x.words")
        known = pairs.join(dictionary, (F.col("langs") == F.col("lang")) & (F.col("words") == F.col("word")))
        lists = known.groupBy("chunk").agg(F.collect_list(F.struct("place", "id")).alias("x"))
        rows = chunks.select("chunk", "codes", F.size("words").alias("n_words")).join(lists, "chunk")
        rows = rows.select("codes", "n_words", F.col("x.place").alias("places"), F.col("x.id").alias("ids"))
        dealt = rows.mapInArrow(_deal(buckets, split, width), "bucket long, n long, fragments binary")
    mined = dealt.repartition(tasks, "bucket").sortWithinPartitions("bucket").select("bucket", "fragments")
    with small_batches(spark, 10_000, CHUNK_BYTES):  # chunks and fragments are as wide as texts
        parts = spool(mined.mapInArrow(_mine(least, split[0] if split else 0, width), "w1 long, w2 long, w3 long, w4 long, a long, whole boolean"), "phrases")
    added = parts.where(~F.col("whole")).groupBy(*KEY).agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return spool(parts.where("whole").drop("whole").unionByName(added), "phrases")


def _struct(words: list[Column]) -> list[Column]:
    """The words under the names of KEY, filled up with 0."""
    return [c.alias(k) for c, k in zip([*words, *[F.lit(0).cast("long")] * (LONGEST - len(words))], KEY, strict=True)]


def _exact(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")


def collocations(docs: DataFrame, least: int = LEAST, percent: int = PERCENT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language of ``docs`` (lang, text).

    ``n`` counts the words of a language, ``a`` the phrase, ``l`` and ``r`` the
    two parts of its lowest-scoring cut; score is floor(2000000 * a / (l + r)).
    Phrases inside a longer one of at least ``percent`` per cent of their
    occurrences are left out.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    with small_batches(docs.sparkSession, 10_000, CHUNK_BYTES):
        chunks = spool(rows.mapInArrow(_chunks(), CHUNKS), "phrase-chunks", "zstd", group_bytes=2 * CHUNK_BYTES)
    totals = chunks.select(F.inline("totals")).groupBy("lang").agg(F.sum("n").alias("n"))
    counted = chunks.select(F.inline(F.arrays_zip("langs", "words", "counts"))).groupBy(F.col("langs").alias("lang"), F.col("words").alias("word")).agg(F.sum("counts").alias("f"))
    frequent = counted.where(F.col("f") >= least).withColumn("node", F.struct((-F.col("f")).alias("f"), "lang", "word"))
    dictionary = spool(node_ids(frequent, "node").select((F.col("node_id") + 1).alias("id"), "lang", "word", "f"), "phrase-words")
    size = dictionary.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("lang") + F.octet_length("word") + 1), F.lit(0))).first()
    n_all = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    phrases = frequent_phrases(chunks, dictionary, size[0], n_all, size[1], least)
    n_phrases = phrases.count()
    near = lambda df, n: F.broadcast(df) if n <= SENT_ROWS else df

    words = [F.col(k) for k in KEY]
    n = F.when(F.col("w4") > 0, 4).when(F.col("w3") > 0, 3).otherwise(2)
    cut = lambda k, m: F.struct(F.lit(k).alias("k"), F.struct(*_struct(words[:k])).alias("first"), F.struct(*_struct(words[k:m])).alias("rest"))
    cuts = F.when(n == 2, F.array(cut(1, 2))).when(n == 3, F.array(cut(1, 3), cut(2, 3))).otherwise(F.array(cut(1, 4), cut(2, 4), cut(3, 4)))
    counts = phrases.select(F.struct(*KEY).alias("key"), F.col("a").alias("f")).unionByName(dictionary.select(F.struct(*_struct([F.col("id")])).alias("key"), "f"))
    sides = {side: near(counts.select(F.col("key").alias(side), F.col("f").alias(name)), n_phrases + size[0]) for side, name in (("first", "l"), ("rest", "r"))}
    scored = phrases.select(*KEY, "a", F.inline(cuts)).join(sides["first"], "first").join(sides["rest"], "rest")
    score = F.expr("(2000000 * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = scored.groupBy(*KEY, "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))

    inner = lambda at, m: F.struct(*_struct(words[at : at + m]))
    subs = F.when(n == 3, F.array(inner(0, 2), inner(1, 2))).otherwise(F.array(inner(0, 2), inner(1, 2), inner(2, 2), inner(0, 3), inner(1, 3)))
    longer = phrases.where("w3 > 0").select("a", F.explode(subs).alias("s")).groupBy("s").agg(F.max("a").alias("longer")).select("s.*", "longer")
    # an explicit left join; nothing longer keeps the phrase
    kept = best.join(longer, list(KEY), "left").where(F.col("longer").isNull() | (_exact("longer") * 100 < _exact("a") * percent))
    kept = spool(kept.select(*KEY, "a", "best.score", "best.l", "best.r"), "phrases")

    spelled = kept.select(*KEY, F.posexplode(F.array(*KEY)).alias("place", "id")).where("id > 0").join(near(dictionary.drop("f"), size[0]), "id")
    texts = spelled.groupBy(*KEY).agg(F.min("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    named = kept.join(texts, list(KEY)).withColumn("part", F.pmod(F.xxhash64(*KEY), F.lit(RANK_PARTS)))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    for group in (["lang", "part"], ["lang"]):
        named = named.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return named.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
