"""Quality rules: distribution divergence from language references.

For each language the reference is the pooled histogram of all its documents
that pass the base rules and the length guard: of character classes, and of
common function words.  A document's histograms are compared with those of its
language by Jensen-Shannon distance (the square root of the divergence in base
2, so within 0..1).  A document under the length guard is not judged by
distance, for its histogram says little; nor is one whose language has no
reference.

Words, lines and windows are told apart byte for byte, never by hashes.

Defined results: a null or empty text has no words and fails the base rules; a
null language is a language of its own; rows with repeated ids are judged each
by itself; extra columns are kept by ``filter_documents`` and ignored by
``quality_rules``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm._bytes import IS_SPACE, LOWER, binary_array, numbered, text_slices, window_codes, word_bounds, words_of
from wordloom.llm._native import let
from wordloom.llm._shared import small_batches, spool

#: Common function words of the four languages.
COMMON_WORDS = {
    "en": "the of and to in is that it for was on are as with he be at by this from or an not have which",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus",
    "fr": "de la le et les des en un du une que est pour qui dans par sur pas au plus ce il ne se avec",
    "es": "de la que el en y los del se las por un para con no una su al lo como más o sus le ha",
}
DIMENSIONS = sorted({w for words in COMMON_WORDS.values() for w in words.split()})
#: Classes of code points: a-z, A-Z, 0-9, white space, sentence marks, other ASCII, beyond ASCII.
CLASSES = ("lower", "upper", "digit", "space", "mark", "symbol", "wide")
WINDOW = 8
PREFIX = "wordloom_quality_"
MIN_WORDS, REPEAT_PERCENT = 20, 30
#: Documents with fewer words are not judged by divergence.
GUARD_WORDS = 50
#: Largest Jensen-Shannon distances of a clean document.  A short text's word histogram differs
#: from any reference by chance, so its limit also has a share that falls with the root of length.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE, WORD_CHANCE = 0.283, 0.27, 0.9

_COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, classes array<long>, common array<long>"
_COUNT_FIELDS = [(c.split()[0], pa.list_(pa.int64()) if "array" in c else pa.int64()) for c in _COUNTS.split(", ")]

_class = np.full(256, CLASSES.index("symbol"), dtype=np.int64)
_class[0x61:0x7B], _class[0x41:0x5B], _class[0x30:0x3A] = 0, 1, 2
_class[[0x20, *range(0x09, 0x0E)]] = 3
_class[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_class[0x80:0xC0] = 7  # inside a code point
_class[0xC0:] = 6
_symbol = np.zeros(256, dtype=bool)
_symbol[[ord(c) for c in "#*$%&|<>"]] = True


def _equal_earlier(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(has an equal earlier entry in its row, has any equal other entry in its row)."""
    order = np.lexsort((keys, rows))
    k, r = keys[order], rows[order]
    same = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    earlier, other = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    earlier[order[1:]] = same
    other[order[1:]] = same
    other[order[:-1]] |= same
    return earlier, other


def _counts(offsets: np.ndarray, data: np.ndarray, dims: pa.Array) -> list:
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    row_of_byte = np.repeat(np.arange(n), lengths)
    starts, ends, rows = word_bounds(offsets, data)
    n_words = np.bincount(rows, minlength=n)
    kind = _class[data]
    classes = np.bincount(row_of_byte * 8 + kind, minlength=n * 8).reshape(n, 8)[:, :7]
    word_chars = classes.sum(axis=1) - classes[:, 3]
    symbols = np.bincount(row_of_byte[_symbol[data]], minlength=n)
    # words in windows that the text has twice
    exact, _ = numbered(words_of(data, starts, ends, lower=False))
    covered = np.zeros(n, np.int64)
    if len(exact) >= WINDOW:
        key = window_codes(exact, WINDOW)
        inside = np.flatnonzero(rows[: len(key)] == rows[WINDOW - 1 :])
        _, other = _equal_earlier(key[inside], rows[inside])
        edge = np.zeros(len(exact) + 1, np.int64)
        np.add.at(edge, inside[other], 1)
        np.add.at(edge, inside[other] + WINDOW, -1)
        covered = np.bincount(rows[np.cumsum(edge[:-1]) > 0], minlength=n)
    # lines with a word, equal to an earlier line of the text
    cut = data == 0x0A
    line_start = np.union1d(offsets[:-1][lengths > 0], np.flatnonzero(cut) + 1)
    line_start = line_start[line_start < len(data)]
    line_end = np.append(line_start[1:], len(data)) if len(line_start) else line_start
    line_row = np.searchsorted(offsets, line_start, "right") - 1
    ends_cut = cut[line_end - 1] if len(line_end) else np.zeros(0, bool)
    line, _ = numbered(binary_array(data[~cut], line_end - ends_cut - line_start))
    has_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    earlier, _ = _equal_earlier(line[has_word], line_row[has_word])
    dup_lines = np.bincount(line_row[has_word][earlier], minlength=n)
    # common words, without marks at the end of a word
    solid = ~IS_SPACE[data]
    trimmed = np.flatnonzero(_class[data[ends - 1]] == 4) if len(ends) else ends
    solid[ends[trimmed] - 1] = False
    length = ends - starts
    length[trimmed] -= 1
    at = pc.index_in(binary_array(LOWER[data[solid]], length), value_set=dims).fill_null(-1).to_numpy().astype(np.int64)
    hit, width = at >= 0, len(dims)
    common = np.bincount(rows[hit] * width + at[hit], minlength=n * width).reshape(n, width)
    return [n_words, word_chars, symbols, dup_lines, covered, classes, np.column_stack([common, n_words - common.sum(axis=1)])]


def _measure(prefix: str, keep_text: bool) -> Callable:
    """Appends the counts, their names under ``prefix``, to all columns (or all but the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims = pa.array([w.encode() for w in DIMENSIONS], pa.large_binary())
        for batch in batches:
            for first, end, offsets, data in text_slices(batch.column("text")):
                part = batch.slice(first, end - first)
                keep = [(f.name, part.column(i)) for i, f in enumerate(part.schema) if keep_text or f.name != "text"]
                for (name, kind), x in zip(_COUNT_FIELDS, _counts(offsets, data, dims), strict=True):
                    if pa.types.is_list(kind):
                        column = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                    else:
                        column = pa.array(x, pa.int64())
                    keep.append((prefix + name, column))
                yield pa.RecordBatch.from_arrays([c for _, c in keep], names=[n for n, _ in keep])

    return run


def _base_failed(prefix: str = "") -> Column:
    n_words, repeated = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (n_words < MIN_WORDS) | (100 * repeated > REPEAT_PERCENT * n_words)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the counts of each document; no shuffle."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    measured = rows.mapInArrow(_measure("", False), f"doc_id long, lang string, {_COUNTS}")
    return measured.withColumn("base_failed", _base_failed())


def references(measured: DataFrame, guard_words: int = GUARD_WORDS) -> DataFrame:
    """wordloom_ref_lang, wordloom_ref_classes, wordloom_ref_common: shares pooled over all documents of a language that pass.

    The sums are of fixed width, so partial aggregation sends one row for each
    language and task; the result has one row for each language.
    """
    clean = measured.where(~F.col("base_failed") & (F.col("n_words") >= guard_words))
    sums = [F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))]
    sums += [F.sum(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(len(DIMENSIONS) + 1)]
    pooled = clean.groupBy("lang").agg(*sums)
    return pooled.select(
        F.col("lang").alias("wordloom_ref_lang"),
        shares(F.array(*[f"c{i}" for i in range(len(CLASSES))])).alias("wordloom_ref_classes"),
        shares(F.array(*[f"w{i}" for i in range(len(DIMENSIONS) + 1)])).alias("wordloom_ref_common"),
    )


def shares(counts: Column) -> Column:
    """Each count over their sum, which is worked out once; nulls if that is 0."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, v: s + v)
    return let(F.struct(counts.alias("counts"), total.alias("total")), lambda x: F.transform(x["counts"], lambda v: F.try_divide(v, x["total"])))


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of an array of counts from an array of shares; null if either has no sum."""

    def half(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(p * 0)

    def term(p: Column, q: Column) -> Column:
        return let(F.struct(p.alias("p"), q.alias("q"), ((p + q) / 2).alias("m")), lambda x: half(x["p"], x["m"]) + half(x["q"], x["m"]))

    total = F.aggregate(F.zip_with(shares(counts), reference, term), F.lit(0.0), lambda s, v: s + v)
    return F.sqrt(F.greatest(total / 2, total * 0))


def _judged(measured: DataFrame, refs: DataFrame, guard_words: int, limits: tuple[float, float, float], prefix: str = "") -> DataFrame:
    """``measured`` with base_failed, class_distance, word_distance and kept under ``prefix``."""
    name = lambda c: F.col(prefix + c)
    # a written table with one row for each language: Spark broadcasts it only under its threshold
    joined = measured.join(refs, F.col("lang").eqNullSafe(F.col("wordloom_ref_lang")), "left")
    joined = joined.withColumns({
        prefix + "base_failed": _base_failed(prefix),
        prefix + "class_distance": distance(name("classes"), F.col("wordloom_ref_classes")),
        prefix + "word_distance": distance(name("common"), F.col("wordloom_ref_common")),
    })
    most_class, most_word, chance = limits
    odd = (name("class_distance") > most_class) | (name("word_distance") > most_word + chance / F.sqrt(F.greatest(name("n_words"), F.lit(1))))
    return joined.withColumn(prefix + "kept", ~name("base_failed") & ~((name("n_words") >= guard_words) & F.coalesce(odd, F.lit(False))))


def quality_rules(
    docs: DataFrame,
    guard_words: int = GUARD_WORDS,
    max_class_distance: float = MAX_CLASS_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    word_chance: float = WORD_CHANCE,
) -> DataFrame:
    """doc_id, the counts, base_failed, class_distance, word_distance, kept.

    The counts are written once and read for both the references and the verdict.
    """
    with small_batches(docs.sparkSession):
        measured = spool(measure(docs), "quality")
    refs = spool(references(measured, guard_words), "quality")
    judged = _judged(measured, refs, guard_words, (max_class_distance, max_word_distance, word_chance))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept")


def filter_documents(docs: DataFrame, guard_words: int = GUARD_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`quality_rules` keeps; each row is judged by itself.

    The rows are written once with their counts, which serve the references and
    the verdict; they are not shuffled.
    """
    names = [c.split()[0] for c in _COUNTS.split(", ")]
    counts = ", ".join(PREFIX + c for c in _COUNTS.split(", "))
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(counts).fields])
    with small_batches(docs.sparkSession):
        measured = spool(docs.mapInArrow(_measure(PREFIX, True), schema), "quality", "snappy")
    plain = measured.select("lang", *[F.col(PREFIX + c).alias(c) for c in names]).withColumn("base_failed", _base_failed())
    refs = spool(references(plain, guard_words), "quality")
    judged = _judged(measured, refs, guard_words, (MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE, WORD_CHANCE), PREFIX)
    return judged.where(PREFIX + "kept").select(*[F.col(f"`{c}`") for c in docs.columns])
