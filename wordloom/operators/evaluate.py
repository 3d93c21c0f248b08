"""Scores of a clustering: distances within clusters, contingency and entropy measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.phones import code_point, either_empty_is_one

#: First code point, of private use, that stands for a label of several characters, and how many there are.
LABEL_BASE, LABELS = 0xF0000, 0x20000
#: Distinct sequences of a cluster in a block; two blocks are what one key of the pairs' join holds.
TILE = 2048


def phone_codes(sequences: DataFrame, phones: str = "phones") -> DataFrame:
    """``sequences`` with coded: phones as code points, one for each distinct label.

    A label of one character is its own code; longer ones are numbered in the
    table of distinct labels, the inventory of a language, which joins by label.
    """
    exploded = sequences.select(F.col(phones).alias("key")).distinct().select("key", F.posexplode("key").alias("pos", "label"))
    kinds = exploded.where(F.char_length("label") != 1).select("label").distinct()
    numbered = kinds.withColumn("code", F.row_number().over(Window.orderBy("label")))
    wrong = F.raise_error(F.lit(f"more than {LABELS} labels")).cast("string")
    symbol = F.when(F.col("code") < LABELS, code_point(F.col("code").cast("long") + LABEL_BASE)).when(F.col("code") >= LABELS, wrong)
    named = exploded.join(numbered, "label", "left").withColumn("symbol", F.coalesce(symbol, F.col("label")))
    coded = named.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "symbol"))), lambda x: x["symbol"]), "").alias("coded"))
    return sequences.join(coded, sequences[phones] == coded["key"], "left").drop("key").withColumn("coded", F.coalesce("coded", F.lit("")))


def _kinds(matched: DataFrame) -> DataFrame:
    return phone_codes(matched.groupBy("cluster", "phones").agg(F.count(F.lit(1)).alias("n")))


def _distances(kinds: DataFrame, tile: int = TILE) -> DataFrame:
    """cluster, n_a, n_b, d of the pairs of distinct sequences of a cluster.

    A cluster's sequences are dealt into blocks of about ``tile``; a pair of blocks
    is a key of the join, so a cluster of any size is many tasks.
    """
    sizes = kinds.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("coded"), F.col("blocks")).cast("int")
    dealt = kinds.select("cluster", "coded", "n").join(sizes, "cluster").withColumn("own", own)
    a = dealt.select("cluster", F.col("coded").alias("a"), F.col("n").alias("n_a"), F.col("own").alias("tile_a"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("tile_b"))
    b = dealt.select("cluster", F.col("coded").alias("b"), F.col("n").alias("n_b"), F.col("own").alias("tile_b"), F.explode(F.sequence(F.lit(0), "own")).alias("tile_a"))
    pairs = a.join(b, ["cluster", "tile_a", "tile_b"]).where((F.col("tile_a") < F.col("tile_b")) | (F.col("a") < F.col("b")))
    return pairs.select("cluster", "n_a", "n_b", either_empty_is_one(F.col("a"), F.col("b")).alias("d"))


def ned(matched: DataFrame) -> DataFrame:
    """ned: the mean distance over all pairs within clusters (all pooled), to 5 places; 0.0 without pairs.

    Pairs are made of distinct sequences only and weighed by how often they
    occur; equal sequences are at distance 0.
    """
    kinds = _kinds(matched)
    apart = _distances(kinds).agg(F.coalesce(F.sum(F.col("n_a") * F.col("n_b") * F.col("d")), F.lit(0.0)).alias("total"))
    pairs = matched.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
    one = F.lit(1)
    return apart.withColumn("k", one).join(pairs.withColumn("k", one), "k").select(F.round(F.when(F.col("pairs") > 0, F.col("total") / F.col("pairs")).otherwise(F.lit(0.0)), 5).alias("ned"))


def variants(matched: DataFrame) -> DataFrame:
    """cluster, size, ned (to 5 places), phones, share: of clusters with a distance, each sequence's share."""
    kinds = _kinds(matched)
    apart = _distances(kinds).groupBy("cluster").agg(F.sum(F.col("n_a") * F.col("n_b") * F.col("d")).alias("total")).where("total > 0")
    sized = kinds.withColumn("size", F.sum("n").over(Window.partitionBy("cluster")))
    mean = F.round(F.col("total") / (F.col("size") * (F.col("size") - 1) / 2), 5)
    return sized.join(apart, "cluster").select("cluster", "size", mean.alias("ned"), F.array_join("phones", "-").alias("phones"), F.round(F.col("n") / F.col("size"), 5).alias("share"))


def contingency(labels: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    return labels.groupBy(F.col(true).alias("t"), F.col(pred).alias("c")).agg(F.count(F.lit(1)).alias("n"))


def _majority(table: DataFrame, by: str) -> DataFrame:
    return table.groupBy(by).agg(F.max("n").alias("top"), F.sum("n").alias("all")).agg(F.round(F.sum("top") / F.sum("all"), 5).alias("share"))


def purity(labels: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    return _majority(contingency(labels, true, pred), "c").select(F.col("share").alias("purity"))


def majority_completeness(labels: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    """As purity with the roles swapped."""
    return _majority(contingency(labels, true, pred), "t").select(F.col("share").alias("completeness_star"))


def _entropies(labels: DataFrame, true: str, pred: str) -> DataFrame:
    """One row: n, h_t, h_c and h_tc in nats.  Sums run over the cells of the contingency table."""
    table = contingency(labels, true, pred)
    plog = lambda n: F.sum(n * F.log(n))

    def log_sum(by: list[str], name: str) -> DataFrame:
        return table.groupBy(*by).agg(F.sum("n").alias("m")).agg(plog(F.col("m")).alias(name), F.sum("m").alias("n")).withColumn("k", F.lit(1))

    both = log_sum(["t", "c"], "s_tc").join(log_sum(["t"], "s_t").drop("n"), "k").join(log_sum(["c"], "s_c").drop("n"), "k")
    h = lambda s: F.log("n") - F.col(s) / F.col("n")
    return both.select("n", h("s_t").alias("h_t"), h("s_c").alias("h_c"), h("s_tc").alias("h_tc"))


def _ratio(joint: Column, other: Column, own: Column) -> Column:
    return F.when(own <= 1e-12, F.lit(1.0)).otherwise(1 - (joint - other) / own)


def v_measure(labels: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    """homogeneity, completeness, v: entropy measures, to 5 places."""
    e = _entropies(labels, true, pred)
    hc = e.select(_ratio(F.col("h_tc"), F.col("h_c"), F.col("h_t")).alias("h"), _ratio(F.col("h_tc"), F.col("h_t"), F.col("h_c")).alias("c"))
    v = F.when(F.col("h") + F.col("c") <= 1e-12, F.lit(0.0)).otherwise(2 * F.col("h") * F.col("c") / (F.col("h") + F.col("c")))
    tidy = lambda x: F.abs(F.round(x, 5))  # noqa: E731  no negative zero
    return hc.select(tidy(F.col("h")).alias("homogeneity"), tidy(F.col("c")).alias("completeness"), tidy(v).alias("v"))


def bitrate(matched: DataFrame, words: DataFrame, pred: str = "pred") -> DataFrame:
    """bitrate: bits of the cluster entropy times matched fragments, over the seconds of all words."""
    sizes = matched.groupBy(pred).agg(F.count(F.lit(1)).alias("m"))
    bits = sizes.agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.log2("m")).alias("s")).select((F.col("n") * F.log2("n") - F.col("s")).alias("bits"), F.lit(1).alias("k"))
    time = words.agg(F.sum(F.col("word_end") - F.col("word_start")).alias("seconds")).withColumn("k", F.lit(1))
    return bits.join(time, "k").select((F.col("bits") / F.col("seconds")).alias("bitrate"))


def cluster_counts(labels: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    counts = labels.agg(F.countDistinct(pred).alias("n_pred"), F.countDistinct(true).alias("n_true"))
    return counts.withColumn("difference", F.abs(F.col("n_pred") - F.col("n_true")))


def report(matched: DataFrame, words: DataFrame, phone_level: bool = False) -> DataFrame:
    """All scores of matched fragments (cluster, text, phones) as one row; null where nothing matched."""
    true = F.array_join("phones", "-") if phone_level else F.col("text")
    labels = matched.withColumn("true", true).withColumn("pred", F.col("cluster"))
    tables = [ned(matched), purity(labels), majority_completeness(labels), v_measure(labels), bitrate(labels, words), cluster_counts(labels)]
    out = tables[0].withColumn("k", F.lit(1))
    for t in tables[1:]:
        out = out.join(t.withColumn("k", F.lit(1)), "k")
    return out.drop("k")
