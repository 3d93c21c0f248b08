"""Partition files: blocks of ``Class <id>`` and member lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators.lookup import node_ids


def partition_lines(members: DataFrame, words: DataFrame, decimals: int | None = None, joiner: str = ",") -> DataFrame:
    """cluster, position, line: a header (position 0) and a line for each member (filename, word_id, cluster).

    A member without a word gets an error line, which readers skip.  Positions
    come from a sort by ranges, so no cluster is one task's.
    """
    shown = (lambda c: F.format_string(f"%.{decimals}f", c)) if decimals is not None else (lambda c: c.cast("string"))
    known = words.select("filename", "word_id", "word_start", "word_end", "text", F.array_join("phones", joiner).alias("phones"))
    joined = members.select("cluster", "filename", "word_id").join(known, ["filename", "word_id"], "left")
    line = F.when(
        F.col("word_start").isNull(), F.concat(F.col("filename"), F.lit("_"), F.col("word_id").cast("string"), F.lit("\tError"))
    ).otherwise(F.concat_ws(" ", "filename", shown(F.col("word_start")), shown(F.col("word_end")), "text", "phones"))
    named = joined.withColumn("line", line)
    placed = node_ids(named.select("cluster", "line", F.struct("cluster", "filename", "word_id", "line").alias("node")))
    firsts = placed.groupBy("cluster").agg(F.min("node_id").alias("first"))
    position = (F.col("node_id") - F.col("first") + 1).cast("int").alias("position")
    body = placed.join(firsts.withColumnRenamed("cluster", "own"), F.col("cluster").eqNullSafe(F.col("own"))).select("cluster", position, "line")
    return firsts.select("cluster", F.lit(0).alias("position"), F.concat(F.lit("Class "), F.col("cluster").cast("string")).alias("line")).unionByName(body)


#: Lines of a text that :func:`partition_texts` makes.
PIECE = 10_000


def partition_texts(lines: DataFrame, piece: int = PIECE) -> DataFrame:
    """value: texts of at most ``piece`` members of a cluster each, with its header, of :func:`partition_lines`."""
    heads = lines.where("position = 0").select("cluster", F.col("line").alias("head"))
    own = F.floor((F.col("position") - 1) / piece).alias("piece")
    parts = lines.where("position > 0").groupBy("cluster", own).agg(F.array_sort(F.collect_list(F.struct("position", "line"))).alias("x"))
    return parts.join(heads, "cluster").select(F.concat_ws("\n", "head", F.array_join(F.transform("x", lambda x: x["line"]), "\n")).alias("value"))


def write_partition(members: DataFrame, words: DataFrame, path: str, decimals: int | None = None, joiner: str = ",") -> None:
    """Whole blocks, a blank line after each; clusters are spread over files."""
    lines = partition_lines(members, words, decimals, joiner)
    blocks = lines.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("position", "line"))).alias("x"))
    blocks.select(F.concat(F.array_join(F.transform("x", lambda x: x["line"]), "\n"), F.lit("\n")).alias("value")).write.mode("errorifexists").text(path)


def parse_partition(texts: DataFrame) -> DataFrame:
    """cluster, filename, start, end, rest of the text column ``value``; lines of fewer than three parts are skipped."""
    blocks = texts.select(F.explode(F.split("value", r"(?m)^Class ")).alias("block"))
    lines = F.split("block", r"\r?\n")
    body = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1)))
    # the header is repeated before lines are taken apart: read off afterwards, it would split the block once for each line
    heads = F.array_repeat(F.trim(F.element_at(lines, 1)).try_cast("long"), F.size(body))
    named = blocks.select(F.inline(F.arrays_zip(heads.alias("cluster"), body.alias("line"))))
    part = F.split(F.trim("line"), " ")
    return named.where(F.col("cluster").isNotNull() & (F.size(part) >= 3)).select(
        "cluster", part[0].alias("filename"), part[1].try_cast("double").alias("start"), part[2].try_cast("double").alias("end"), F.array_join(F.slice(part, 4, 1 << 20), " ").alias("rest")
    )


def read_partition(spark: SparkSession, path: str) -> DataFrame:
    return parse_partition(spark.read.text(path, wholetext=True))
