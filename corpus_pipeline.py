"""A corpus pipeline: quality rules, near-dedup, PII surrogates, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.  All but the last return
the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import minhash, mixing, packing, pii, quality
from wordloom.llm._shared import spool

#: Target weights of the mixing stage; other sources have weight 1.
WEIGHTS = {"src0": 2.0, "src1": 4.0, "src2": 0.5}
#: Keys the surrogates; to be replaced by a secret of the corpus's owner.
PII_SECRET = "of the example pipeline"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    safe = pii.surrogate(docs, PII_SECRET)
    if "n_chars" in docs.columns:
        safe = safe.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return safe.select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, WEIGHTS).select(*[F.col(f"`{c}`") for c in docs.columns])


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("pii", replace_pii),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]
#: Tokens are beyond SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = spool(stage(spark, docs, sf_dir), f"pipeline-{name}", "snappy")
    return docs
