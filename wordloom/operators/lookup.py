"""Node numbering, type codes, lookups and group samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.sources.catalog import materialise


def node_ids(nodes: DataFrame, key: str = "node") -> DataFrame:
    """``nodes`` with node_id, the position of ``key`` (distinct) in order, from 0.

    The table is sorted by ranges and written; positions are counted within the
    partitions, and only their totals meet in one place.
    """
    placed = materialise(nodes.orderBy(key).withColumn("place", F.monotonically_increasing_id()), "nodes")
    parts = placed.groupBy(F.shiftright("place", 33).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    joined = placed.withColumn("part", F.shiftright("place", 33)).join(before, "part")
    return joined.withColumn("node_id", F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "place", "before")


def type_count(words: DataFrame, column: str = "text") -> DataFrame:
    """n_types: distinct values, null being one of them."""
    null = F.max(F.col(column).isNull().cast("long"))
    return words.agg((F.countDistinct(column) + F.coalesce(null, F.lit(0))).alias("n_types"))


def first_appearance_codes(words: DataFrame, column: str = "text", order: str = "pos") -> DataFrame:
    """column, code: types numbered from 0 by where they first appear; one row for each type."""
    firsts = words.groupBy(column).agg(F.min(order).alias("first"))
    numbered = node_ids(firsts, "first")
    return numbered.select(column, F.col("node_id").alias("code"))


def true_types(nodes: DataFrame, words: DataFrame, codes: DataFrame, column: str = "text") -> DataFrame:
    """node_id, code: the type of each node; nodes without a word get codes of their own, after all others."""
    typed = nodes.join(words.select("filename", "word_id", column), ["filename", "word_id"], "left").join(codes, column, "left")
    top = codes.agg(F.max("code")).first()[0]
    lone = typed.where("code is null").select("node_id", (F.lit(-1 if top is None else top) + 1 + F.col("node_id")).alias("code"))
    return typed.where("code is not null").select("node_id", "code").unionByName(lone)


def lookup_words(members: DataFrame, words: DataFrame) -> DataFrame:
    """Members (filename, word_id) with their word; a miss keeps nulls."""
    return members.join(words, ["filename", "word_id"], "left")


def clusters_by_first_member(labels: DataFrame) -> DataFrame:
    """cluster (renumbered by the least member), node_id; input has node_id, label."""
    heads = labels.groupBy("label").agg(F.min("node_id").alias("head"))
    order = node_ids(heads, "head").select("label", F.col("node_id").alias("cluster"))
    return labels.join(order, "label").select("cluster", "node_id")


def gold_partition(words: DataFrame) -> DataFrame:
    """phones (joined by -), n, first word: one cluster for each phone sequence."""
    key = F.array_join("phones", "-")
    return words.groupBy(key.alias("phones")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("filename", "word_id")).alias("x")).select("phones", "n", F.col("x.filename").alias("filename"), F.col("x.word_id").alias("word_id"))


def phone_type_counts(words: DataFrame) -> DataFrame:
    key = F.array_join("phones", "-")
    return words.agg(F.count(key).alias("n_words"), F.countDistinct(key).alias("n_types"))


def one_per_type(units: DataFrame, column: str = "text", seed: int = 42) -> DataFrame:
    """One row for each type, drawn by a keyed hash of its node; rows without a type drop out."""
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), "node"))
    best = units.where(F.col(column).isNotNull()).groupBy(column).agg(F.min_by("units", F.struct(draw, "node")).alias("units"))
    return best


def replicate_sample(units: DataFrame, column: str = "text", seed: int = 42) -> DataFrame:
    """node, text, units: every member of a type gets the units of the one drawn."""
    return units.drop("units").join(one_per_type(units, column, seed), column).select("node", column, "units")
