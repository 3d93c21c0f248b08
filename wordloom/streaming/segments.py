"""Speech segments with a least pause, for batches and for streams (an extension of ours)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAUSE_CS = 50


def session_segments(words: DataFrame, pause_cs: int = PAUSE_CS) -> DataFrame:
    """filename, start, end, n_words: words less than a pause apart, by whole hundredths of seconds.

    A word without length comes before one that starts with it.
    """
    order = Window.partitionBy("filename").orderBy("start_cs", "dur")
    gap = F.col("start_cs") - F.lag(F.col("start_cs") + F.col("dur")).over(order)
    runs = words.withColumn("new", F.coalesce((gap >= pause_cs).cast("int"), F.lit(0))).withColumn("run", F.sum("new").over(order))
    grouped = runs.groupBy("filename", "run").agg(F.min("start_cs").alias("a"), F.max(F.col("start_cs") + F.col("dur")).alias("b"), F.count(F.lit(1)).alias("n_words"))
    return grouped.select("filename", (F.col("a") / 100).alias("start"), (F.col("b") / 100).alias("end"), "n_words")


def stream_segments(words: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """filename, start, end, n_words of a stream of (filename, ts): session windows behind a watermark."""
    sessions = words.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "filename").agg(F.count(F.lit(1)).alias("n_words"))
    return sessions.select("filename", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n_words")
