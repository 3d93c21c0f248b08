"""The registered queries of this subpackage: thin adapters from operators to result columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import ann, bpe, chat, minhash, mixing, oracles, packing, phrases, pii, quality, secret_scan, suffixes, trie, warc
from wordloom.llm._shared import spool


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), size=2)


def op2_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"))


def op3_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = quality.quality_rules(_table(spark, sf_dir, "documents"))
    return rules.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: Simulated damage of the audit query: one record in so many is altered or lost.
WARC_ALTERED, WARC_LOST = 64, 128


def op4_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    index = spool(warc.archive(pages), "warc-index")
    other = spool(warc.damaged(pages, index, "replica", WARC_ALTERED, WARC_LOST), "warc-index")
    found = warc.audit(index, other)
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "length", "other_n", "other_length")]
    return found.select("file_id", "offset", "status", *numbers, F.coalesce("digest", F.lit("")).alias("digest"), F.coalesce("other_digest", F.lit("")).alias("other_digest"))


def op5_suffix_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffixes.remove_repeats(_table(spark, sf_dir, "documents"))
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, n: s + n)
    return left.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("\\### Assistant: </turn> ok")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), said.alias("text"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    chats = chat.format_chats(turns)
    return chat.read_back(chats).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_blocks",
    )


#: Target weights of the mixing query; the other sources share the default weight.
MIX_WEIGHTS = {"src0": 2.0, "src1": 4.0, "src2": 0.5}


def op7_mix_poisson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), MIX_WEIGHTS).select("doc_id", "copy_id", "source", "lang", "n_chars", "text")


def op8_secret_randomness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secret_scan.span_text(F.col("base")), 256).alias("base_sha256"),
        secret_scan.span_text(F.array_sort(F.concat("base", "found"))).alias("spans"),
    )


#: Keys the surrogates of this query alone; a real corpus needs a secret of its own.
PII_SECRET = "of the registered query"


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    safe = pii.surrogate(_table(spark, sf_dir, "documents"), PII_SECRET)
    counts = [F.element_at("pii_counts", F.lit(kind)).alias(f"n_{kind}") for kind, _ in pii.TYPES]
    return safe.select("doc_id", *counts, "lang", "source", "text")


def op10_pack_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_bpe_backtrack(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents")))
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_phrase_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes_of(*trie.branched(_table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash_odd_sketch, op2_ann_forest, op3_quality_divergence, op4_warc_fixity, op5_suffix_radix, op6_chat_format, op7_mix_poisson, op8_secret_randomness, op9_pii_surrogates, op10_pack_online, op11_bpe_backtrack, op12_phrase_pivots, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return oracles.oracles(MIX_WEIGHTS, WARC_ALTERED, WARC_LOST)
