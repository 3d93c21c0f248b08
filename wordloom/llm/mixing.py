"""Mixing sources to target weights by Poisson replication, in Spark expressions only.

A source with target weight w (of the weights' sum) and n documents gets the
mean repetition rate  budget * w / n.  Each document draws a uniform number
from a keyed hash of its id and text, inverts the Poisson distribution with
that mean, and is repeated that many times; a second hash orders all copies.
The draw depends only on the document and the seed, so a lost task repeats it.

Rates at or over ``NORMAL_FROM`` are split into whole parts and a remainder
below it, each part its own draw; a sum of Poisson draws is a Poisson draw.

Defined results: a null source is a source of its own (weight under the key
None); sources without a weight get ``default_weight``; rows with equal id and
text share their draw, each row being repeated; a null text is kept as null;
extra columns are kept, with names as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm._native import let
from wordloom.llm._shared import spool, tasks_for

#: Largest mean that one inversion handles, and the terms it looks at.
PART_MEAN, TERMS = 8.0, 48
PREFIX = "wordloom_mix_"


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) with 52 bits of the md5 digest of seed and parts."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("\\0")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson(u: Column, mean: Column) -> Column:
    """The least k with P(X <= k) > u for X ~ Poisson(mean), mean <= PART_MEAN; ``u`` is worked out once."""

    def inverted(x: Column) -> Column:
        start = F.struct(x["none"].alias("term"), x["none"].alias("sum"), F.lit(0).alias("k"))
        step = lambda s, i: F.when(s["sum"] > x["u"], s).otherwise(
            F.struct((s["term"] * x["mean"] / i).alias("term"), (s["sum"] + s["term"] * x["mean"] / i).alias("sum"), i.alias("k"))
        )
        return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step)["k"]

    return let(F.struct(u.alias("u"), mean.alias("mean"), F.exp(-mean).alias("none")), inverted)


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None, default_weight: float, budget: float) -> DataFrame:
    """source, n, rate: one row for each source, counted over all documents."""
    counts = spool(docs.groupBy(F.col("source").alias("source")).agg(F.count(F.lit(1)).alias("n")), "mixing")
    weight = F.lit(float(default_weight))
    for name, value in (weights or {}).items():
        weight = F.when(F.col("source").isNull() if name is None else F.col("source") == name, F.lit(float(value))).otherwise(weight)
    weighed = counts.withColumn("weight", weight)
    whole = weighed.agg(F.sum("weight").alias("w"), F.sum("n").alias("n")).first()
    if not whole["w"]:
        return weighed.select("source", "n", F.lit(0.0).alias("rate"))
    return weighed.select("source", "n", (F.lit(budget * whole["n"] / whole["w"]) * F.col("weight") / F.col("n")).alias("rate"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, default_weight: float = 1.0, budget: float = 1.0, seed: int = 7) -> DataFrame:
    """All columns of ``docs`` with copy_id (from 0) and source_rate, in a shuffled order.

    If ``docs`` has a column of such a name, it stays and the new one is called wordloom_mix_*.

    ``budget`` is the expected number of copies as a multiple of the documents.
    The rates, a row for each source, are a written table, so Spark knows their
    size: it sends them to all executors only under its broadcast threshold and
    joins by key otherwise.  The one exchange of texts is then the shuffle.
    """
    rates = spool(source_rates(docs, weights, default_weight, budget), "mixing")
    rates = rates.select(F.col("source").alias(PREFIX + "key"), F.col("rate").alias(PREFIX + "source_rate"))
    rated = docs.join(rates, docs["source"].eqNullSafe(rates[PREFIX + "key"]), "left")
    mark = F.md5(F.coalesce(F.col("text"), F.lit("")))
    parts = F.greatest(F.ceil(F.col(PREFIX + "source_rate") / PART_MEAN).cast("int"), F.lit(1))
    draws = F.transform(F.sequence(F.lit(1), parts), lambda j: poisson(uniform(seed, F.col("doc_id"), F.col(PREFIX + "mark"), j), F.col(PREFIX + "source_rate") / parts))
    copies = F.aggregate(draws, F.lit(0), lambda a, k: a + k)
    counted = rated.withColumn(PREFIX + "mark", mark)
    # an outer explosion: Spark would work out the copies again for the filter it derives from an inner one
    spread = counted.select("*", F.posexplode_outer(F.array_repeat(F.lit(0), copies)).alias(PREFIX + "copy", PREFIX + "one"))
    spread = spread.where(F.col(PREFIX + "copy").isNotNull()).withColumn(PREFIX + "copy_id", F.col(PREFIX + "copy").cast("long"))
    place = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col(PREFIX + "mark"), F.col(PREFIX + "copy_id"))
    tasks = tasks_for(docs)
    shuffled = spread.withColumn(PREFIX + "place", place).repartition(tasks, PREFIX + "place").sortWithinPartitions(PREFIX + "place")
    added = [F.col(PREFIX + c).alias(PREFIX + c if c in docs.columns else c) for c in ("copy_id", "source_rate")]
    return shuffled.select(*[F.col(f"`{c}`") for c in docs.columns], *added)
