"""Interval joins, gaps and islands, and slices of frame sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.phones import boundary_matches, clean_phones

#: Seconds; an interval join deals both sides into bins of this length.
BIN_SECONDS = 60.0
#: Words whose border lies closer than this are one stretch of speech.
GAP = 1e-4
FRAMES_PER_SECOND = 50


def _bins(start: Column, end: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(end / width)))


def interval_join(left: DataFrame, right: DataFrame, condition: Callable[[], Column], width: float = BIN_SECONDS) -> DataFrame:
    """Inner join on filename of intervals that share a time bin and meet ``condition``.

    Both sides have start and end columns l_start, l_end and r_start, r_end; the
    condition must imply that they touch.  An interval is in each bin it meets;
    a pair is made in the first bin of both only, so no pair comes twice.  The
    join is on (filename, bin): a long file is dealt over many tasks.
    """
    a = left.withColumn("bin", _bins(F.col("l_start"), F.col("l_end"), width))
    b = right.withColumnRenamed("filename", "r_filename").withColumn("r_bin", _bins(F.col("r_start"), F.col("r_end"), width))
    first = F.greatest(F.floor(F.col("l_start") / width), F.floor(F.col("r_start") / width))
    on = (F.col("filename") == F.col("r_filename")) & (F.col("bin") == F.col("r_bin")) & (F.col("bin") == first) & condition()
    return a.join(b, on).drop("bin", "r_bin", "r_filename")


def _words(words: DataFrame) -> DataFrame:
    return words.select("filename", "word_id", F.col("word_start").alias("l_start"), F.col("word_end").alias("l_end"), "text")


def _with_phones(words: DataFrame, phones: DataFrame, condition: Callable[[], Column]) -> DataFrame:
    right = phones.select("filename", F.col("start").alias("r_start"), F.col("end").alias("r_end"), "phone", "pos")
    joined = interval_join(_words(words).select("filename", "word_id", "l_start", "l_end"), right, condition)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "phone"))), lambda x: x["phone"])
    return joined.groupBy("filename", "word_id").agg(ordered.alias("phones"))


def overlap_join(words: DataFrame, phones: DataFrame) -> DataFrame:
    """Words with the phones that overlap them, in order and cleaned; words left without phones drop out.

    A phone counts once for each word it overlaps; touching is not overlapping.
    """
    meets = lambda: (F.col("r_end") > F.col("l_start")) & (F.col("r_start") < F.col("l_end"))
    found = _with_phones(words, phones, meets).select("filename", "word_id", clean_phones(F.col("phones")).alias("phones")).where(F.size("phones") > 0)
    return words.drop("phones").join(found, ["filename", "word_id"])


def merge_overlap(words: DataFrame, phones: DataFrame) -> DataFrame:
    """The analysis variant of :func:`overlap_join`: words without a text or with <unk> are left out, phones go by start.

    Phones need no pos; where there is one, it orders phones of equal start and
    end.  Phone labels are cleaned as for the other joins.
    """
    spoken = words.where(F.col("text").isNotNull() & ~F.col("text").isin("", "<unk>"))
    order = [c for c in ("start", "end", "pos") if c in phones.columns]
    return overlap_join(spoken, phones.withColumn("pos", F.struct(*order)))


def gold_intervals(words: DataFrame) -> tuple[DataFrame, int]:
    """The words that have phones, as gold intervals, and how many they are."""
    kept = words.where(F.col("phones").isNotNull()).select("filename", "word_id", "word_start", "word_end", "text", "phones")
    return kept, kept.count()


def containment_join(words: DataFrame, phones: DataFrame) -> DataFrame:
    """Words with the phones that lie within them, cleaned as mandarin; words without phones stay, with none."""
    within = lambda: (F.col("r_start") >= F.col("l_start")) & (F.col("r_end") <= F.col("l_end"))
    found = _with_phones(words, phones, within).select("filename", "word_id", clean_phones(F.col("phones"), mandarin=True).alias("phones"))
    none = F.array().cast("array<string>")
    return words.drop("phones").join(found, ["filename", "word_id"], "left").withColumn("phones", F.coalesce("phones", none))


def file_ordinals(intervals: DataFrame) -> DataFrame:
    """word_id from 1 over all intervals of a file, silence included, given before silence drops out."""
    order = Window.partitionBy("filename").orderBy("start", "end")
    return intervals.withColumn("word_id", F.row_number().over(order)).where(~F.lower("text").isin("", "sil", "sp", "spn"))


def run_ordinals(lines: DataFrame) -> DataFrame:
    """word_id from 0 that starts anew whenever the filename differs from that of the line before.

    ``lines`` carries shard and line_no: the line order is that within a shard
    (an input file), so a shard and not the whole input is what a task orders.
    """
    order = Window.partitionBy("shard").orderBy("line_no")
    changed = F.coalesce((F.lag("filename").over(order) != F.col("filename")).cast("int"), F.lit(1))
    runs = lines.withColumn("run", changed).withColumn("run", F.sum("run").over(order))
    return runs.withColumn("word_id", F.row_number().over(Window.partitionBy("shard", "run").orderBy("line_no")) - 1)


def speech_segments(words: DataFrame, gap: float = GAP) -> DataFrame:
    """seg_id (from 0), filename, start, end: maximal runs of consecutive words that follow without a gap.

    A word continues a segment if it starts where the word before it ended; the
    segment ends where its last word ends.
    """
    order = Window.partitionBy("filename").orderBy("word_id")
    apart = F.abs(F.lag("word_end").over(order) - F.col("word_start")) >= gap
    flagged = words.select("filename", "word_id", "word_start", "word_end", F.coalesce(apart.cast("int"), F.lit(0)).alias("new"))
    numbered = flagged.withColumn("seg_id", F.sum("new").over(order).cast("int"))
    return numbered.groupBy("filename", "seg_id").agg(F.min_by("word_start", "word_id").alias("start"), F.max_by("word_end", "word_id").alias("end"))


def frame_bounds(start: Column, end: Column) -> tuple[Column, Column]:
    """First frame and the frame after the last; seconds are truncated to frames in double arithmetic."""
    return (start * FRAMES_PER_SECOND).cast("int"), (end * FRAMES_PER_SECOND).cast("int")


def cut_frames(words: DataFrame, frames: DataFrame) -> DataFrame:
    """filename, word_id, frame (from 0), vec: the frames of each word of an utterance.

    ``frames`` holds filename, frame, vec.  A word's frames are made as keys and
    joined, so the work is that of the frames cut out, not of word-frame pairs.
    Words without frames give none.
    """
    first, after = frame_bounds(F.col("word_start"), F.col("word_end"))
    keyed = words.select("filename", "word_id", first.alias("first"), after.alias("after")).where("after > first")
    keyed = keyed.select("filename", "word_id", "first", F.explode(F.sequence(F.col("first"), F.col("after") - 1)).alias("frame"))
    return keyed.join(frames, ["filename", "frame"]).select("filename", "word_id", (F.col("frame") - F.col("first")).alias("frame"), "vec")


def cut_segment_frames(words: DataFrame, segments: DataFrame, frames: DataFrame) -> DataFrame:
    """As :func:`cut_frames` for frames kept by segment (filename, seg_id, frame, vec).

    A word belongs to the segment that contains it; offsets count from its start.
    """
    left = words.select("filename", "word_id", F.col("word_start").alias("l_start"), F.col("word_end").alias("l_end"))
    right = segments.select("filename", "seg_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    within = lambda: (F.col("l_start") >= F.col("r_start")) & (F.col("l_end") <= F.col("r_end"))
    placed = interval_join(left, right, within)
    first, after = frame_bounds(F.col("l_start") - F.col("r_start"), F.col("l_end") - F.col("r_start"))
    keyed = placed.select("filename", "seg_id", "word_id", first.alias("first"), after.alias("after")).where("after > first")
    keyed = keyed.select("filename", "seg_id", "word_id", "first", F.explode(F.sequence(F.col("first"), F.col("after") - 1)).alias("frame"))
    return keyed.join(frames, ["filename", "seg_id", "frame"]).select("filename", "word_id", (F.col("frame") - F.col("first")).alias("frame"), "vec")


def match_fragments(fragments: DataFrame, gold: DataFrame) -> DataFrame:
    """Each fragment with the first gold word (by start, end, text) that it overlaps and matches.

    ``fragments``: frag_id, filename, start, end, cluster; ``gold``: filename,
    word_start, word_end, text, phones.  Fragments without a match drop out.
    """
    left = fragments.select("filename", "frag_id", "cluster", F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    right = gold.select("filename", F.col("word_start").alias("r_start"), F.col("word_end").alias("r_end"), "text", "phones")
    meets = lambda: (F.col("r_start") < F.col("l_end")) & (F.col("l_start") < F.col("r_end")) & boundary_matches(F.col("r_start"), F.col("r_end"), F.col("l_start"), F.col("l_end"))
    found = interval_join(left, right, meets)
    best = found.groupBy("frag_id").agg(F.min(F.struct("r_start", "r_end", "text", "phones", "filename", "cluster")).alias("m"))
    return best.select("frag_id", "m.filename", "m.cluster", F.col("m.r_start").alias("gold_start"), F.col("m.r_end").alias("gold_end"), "m.text", "m.phones")


def unmatched(fragments: DataFrame, matched: DataFrame) -> DataFrame:
    return fragments.join(matched.select("frag_id"), "frag_id", "left_anti")
