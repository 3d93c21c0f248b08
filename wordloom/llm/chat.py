"""Relational chat formatting with Spark expressions only.

A conversation's turn structs are collected and sorted by (turn, role, text);
an array aggregation marks where the role changes, so that adjacent turns of
one role share a block; the blocks are concatenated.  The layout is

    <chat><block ROLE>TEXT<next>TEXT</block><block ROLE>TEXT</block></chat>

``<next>`` keeps the border between merged turns, so reading back gives every
turn.  In texts and roles ``&``, ``<`` and ``>`` become ``&amp;``, ``&lt;`` and
``&gt;``: no control string survives inside a text, and the change is reversible.

The loss mask is an array of (start, length) spans in code points of the
formatted string, one for each assistant text that is not empty.

Defined results: a null text counts as empty, a null role as the empty role, a
null turn sorts first, rows with equal turns are ordered by role and text, a
null conv_id is a conversation of its own.  A conversation is one output row,
so its whole text is held by one task; nothing else is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm._native import let, running_starts

ASSISTANT = "assistant"
OPEN, NEXT, CLOSE, HEAD, TAIL = "<block ", "<next>", "</block>", "<chat>", "</chat>"


def escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    for raw, safe in ((">", "&gt;"), ("<", "&lt;"), ("&", "&amp;")):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def format_chats(turns: DataFrame, trained_role: str = ASSISTANT) -> DataFrame:
    """One row per conv_id: formatted, loss_spans array<struct<start,length>>, n_blocks.

    Starts of spans are 0-based code points of ``formatted``.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    # role of the turn before: the array shifted by one, so no step looks back by index
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice(F.col("t.role"), 1, F.greatest(F.size("t") - 1, F.lit(0))))
    parts = F.zip_with(
        "t",
        before,
        lambda t, b: F.struct(
            F.when(b.isNull(), F.concat(F.lit(HEAD + OPEN), escape(t["role"]), F.lit(">")))
            .when(b.eqNullSafe(t["role"]), F.lit(NEXT))
            .otherwise(F.concat(F.lit(CLOSE + OPEN), escape(t["role"]), F.lit(">")))
            .alias("mark"),
            escape(t["text"]).alias("text"),
            (t["role"] == trained_role).alias("trained"),
            (~b.eqNullSafe(t["role"])).cast("int").alias("opens"),
        ),
    )
    chats = chats.select("conv_id", parts.alias("parts"))
    formatted = F.concat(F.array_join(F.transform("parts", lambda p: F.concat(p["mark"], p["text"])), ""), F.lit(CLOSE + TAIL))
    n_blocks = F.aggregate("parts", F.lit(0), lambda n, p: n + p["opens"]).cast("long")
    return chats.select("conv_id", formatted.alias("formatted"), _spans().alias("loss_spans"), n_blocks.alias("n_blocks"))


def _spans() -> Column:
    """Spans of the trained texts that are not empty."""
    lengths = F.transform("parts", lambda p: (F.char_length(p["mark"]) + F.char_length(p["text"])).cast("long"))
    spans = F.zip_with(
        "parts",
        running_starts(lengths),
        lambda p, s: F.struct((s + F.char_length(p["mark"])).alias("start"), F.char_length(p["text"]).cast("long").alias("length"), p["trained"].alias("trained")),
    )
    kept = F.filter(spans, lambda x: x["trained"] & (x["length"] > 0))
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))


def read_back(chats: DataFrame, page: int = 4096) -> DataFrame:
    """conv_id, turns array<struct<role,text>>, formatted_chars, n_blocks and loss_text, read from ``formatted`` and ``loss_spans``, both unescaped.

    For the spans, the string is first cut into pages of ``page`` code points,
    so that each span touches only the pages it lies on.
    """
    body = F.expr(f"substring(formatted, {len(HEAD) + 1}, char_length(formatted) - {len(HEAD + TAIL)})")
    blocks = F.filter(F.split(body, CLOSE), lambda b: b != "")

    def turns_of(block: Column) -> Column:
        role = unescape(F.regexp_extract(block, "^<block ([^>]*)>", 1))
        texts = F.split(F.regexp_replace(block, "^<block [^>]*>", ""), NEXT)
        return F.transform(texts, lambda text: F.struct(role.alias("role"), unescape(text).alias("text")))

    def under(span: Column, pages: Column) -> Column:
        first = F.floor(span["start"] / page).cast("int")
        last = F.floor((span["start"] + span["length"] - 1) / page).cast("int")
        text = F.array_join(F.slice(pages, first + 1, last - first + 1), "")
        return text.substr((span["start"] - first.cast("long") * page + 1).cast("int"), span["length"].cast("int"))

    # bound once: an expression that a lambda mentions is worked out for each element
    pages = F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{page}}}"), F.lit(0))
    loss = let(pages, lambda cut: F.array_join(F.transform("loss_spans", lambda span: under(span, cut)), ""))
    turns = let(blocks, lambda found: F.flatten(F.transform(found, turns_of)))
    return chats.select("conv_id", turns.alias("turns"), F.char_length("formatted").cast("long").alias("formatted_chars"), "n_blocks", unescape(loss).alias("loss_text"))
