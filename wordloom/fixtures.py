"""Adapters from the generated tables to alignments, frames and fragments.

Each has a twin in SQL in :mod:`wordloom.registry`.  All of them use whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as timed words: one file a user, word after word, a second's pause after each error.

    Times are counted in whole hundredths, so equal borders are equal numbers.
    """
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    dur = F.round(F.col("value") * 100).cast("long")
    pause = F.when(F.col("event_type") == "error", 100).otherwise(0)
    timed = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("filename"),
        (F.row_number().over(order) - 1).alias("word_id"),
        F.col("event_type").alias("text"),
        F.coalesce(F.sum(dur + pause).over(before), F.lit(0)).alias("start_cs"),
        dur.alias("dur"),
    )
    chars = F.filter(F.split("text", ""), lambda c: c != "")
    return timed.withColumn("word_start", F.col("start_cs") / 100).withColumn("word_end", (F.col("start_cs") + F.col("dur")) / 100).withColumn("phones", chars)


def raw_phones(w: DataFrame) -> DataFrame:
    """filename, word_id, raw: labels with stress digits, silences and other noise."""
    noisy = F.transform("phones", lambda c, k: F.when(k % 3 == 0, F.concat(F.upper(c), F.lit("1"))).when(k % 3 == 2, F.concat(c, F.lit("0"))).otherwise(c))
    return w.select("filename", "word_id", F.concat(F.array(F.lit("sil")), noisy, F.array(F.lit(""), F.lit("SIL"), F.lit("1"))).alias("raw"))


def phones(w: DataFrame) -> DataFrame:
    """Phone intervals: a word's time in even parts, and a silence in each pause."""
    n = F.size("phones")
    parts = F.transform(
        "phones",
        lambda c, k: F.struct(
            (F.col("start_cs") + F.floor(F.col("dur") * k / n)).cast("long").alias("a"),
            (F.col("start_cs") + F.floor(F.col("dur") * (k + 1) / n)).cast("long").alias("b"),
            F.when(k % 3 == 0, F.concat(F.upper(c), F.lit("1"))).when(k % 3 == 2, F.concat(c, F.lit("0"))).otherwise(c).alias("phone"),
            k.alias("k"),
        ),
    )
    end = F.col("start_cs") + F.col("dur")
    pause = F.when(F.col("text") == "error", F.array(F.struct(end.alias("a"), (end + 100).alias("b"), F.lit("sil").alias("phone"), F.lit(15).alias("k")))).otherwise(F.slice(parts, 1, 0))
    rows = w.select("filename", "word_id", F.explode(F.concat(parts, pause)).alias("p"))
    return rows.select("filename", (F.col("p.a") / 100).alias("start"), (F.col("p.b") / 100).alias("end"), F.col("p.phone").alias("phone"), (F.col("word_id") * 16 + F.col("p.k")).cast("int").alias("pos"))


def fragments(w: DataFrame) -> DataFrame:
    """Discovered fragments: words moved by up to 0.04 s, under made-up clusters."""
    shift = (F.col("word_id") % 5 - 2) * 2
    return w.select(
        F.concat_ws("_", "filename", "word_id").alias("frag_id"),
        "filename",
        ((F.col("start_cs") + shift) / 100).alias("start"),
        ((F.col("start_cs") + F.col("dur") + shift) / 100).alias("end"),
        ((F.col("word_id") % 3) * 10 + F.char_length("text")).cast("long").alias("cluster"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as frames: one file a label, in order of id."""
    order = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("L"), F.col("label").cast("string")).alias("filename"),
        "label",
        (F.row_number().over(order) - 1).alias("frame"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )


def word_frames(f: DataFrame) -> DataFrame:
    """node, filename, word_id, frame, vec: three to five frames make a word."""
    span = 3 + F.col("label") % 3
    word = F.floor(F.col("frame") / span)
    return f.select(F.concat_ws("_", "filename", word).alias("node"), "filename", word.cast("int").alias("word_id"), (F.col("frame") % span).cast("int").alias("frame"), "vec")


def frame_words(f: DataFrame) -> DataFrame:
    """filename, word_id, word_start, word_end in seconds, of the words of frames."""
    span = 3 + F.col("label") % 3
    keyed = f.select("filename", span.alias("span"), F.floor(F.col("frame") / span).cast("int").alias("word_id")).distinct()
    return keyed.select("filename", "word_id", (F.col("word_id") * F.col("span") / F.lit(50.0)).alias("word_start"), ((F.col("word_id") + 1) * F.col("span") / F.lit(50.0)).alias("word_end"))


def nested(wf: DataFrame) -> DataFrame:
    """node, frames: each word's frames in order."""
    return wf.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "vec"))), lambda x: x["vec"]).alias("frames"))
