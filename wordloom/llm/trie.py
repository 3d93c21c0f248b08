"""Prefix trie of conversations by heavy-path decomposition.

A node is a distinct sequence of first turns.  Its key is the exclusive or of
four 64-bit hashes of (depth, SHA-256 of the turn) over the sequence, gathered by
running totals, so a conversation of any length is spread over tasks; rows that
share a key must also agree in depth and in 128 bits of their last turn, else
the job fails instead of joining what differs.

A node is named by its smallest conversation and its depth.  The heavy child of
a node is the one with most conversations (then the smallest name); every other
edge is light and at least halves the number of conversations, so a way down
from the root has at most log2 of that number of light edges.  The heavy edges
form paths, each from its top to a leaf; a path is named by its leaf's
conversation and lies on the level that counts the light edges above it.  From
the deepest level up, sums over subtrees are suffix sums along the paths, and
what a path's top holds is added to its parent before the next level's turn.

Defined results: turns are ordered by turn (null first), then role and text; a
null role or text is empty; rows with a null conv_id are left out; repeated rows
are turns of their own; a conversation without turns is a member of the root
alone; an empty table gives an empty result; extra columns are ignored, whatever
their names; a very long text is hashed whole, in one expression.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm._running import running_totals
from wordloom.llm._shared import spool

#: A table of at most so many rows is sent to all tasks of a join.
SENT_ROWS = 200_000
#: Members that one block of a joined list holds.
BLOCK = 1 << 14
KEY = ("k1", "k2", "k3", "k4")
PARENT = ("p1", "p2", "p3", "p4")


def _near(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SENT_ROWS else df


def ordered(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), digest, bytes of each turn of ``turns`` (conv_id, turn, role, text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
    )
    told = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = rows.select("*", F.unhex(told).alias("digest"), F.octet_length("text").cast("long").alias("bytes"), F.lit(1).cast("long").alias("place"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = running_totals(rows, "conv_id", order, ["place"], "trie-turns", ["conv_id", "digest", "bytes", "place"])
    return placed.select("conv_id", F.col("place_total").alias("place"), "digest", "bytes")


def whole(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, alone) for :func:`nodes_of`: the conversations as they are."""
    placed = ordered(turns)
    lengths = placed.groupBy("conv_id").agg(F.max("place").alias("length"))
    rows = placed.join(_near(lengths, lengths.count()), "conv_id")
    rows = spool(rows.select("conv_id", F.col("place").alias("depth"), "digest", "bytes", (F.col("place") == F.col("length")).alias("last")), "trie-rows")
    return rows, rows.select("conv_id").limit(0)


def branched(turns: DataFrame, most: int = 9, family: int = 5) -> tuple[DataFrame, DataFrame]:
    """(rows, alone) for :func:`nodes_of`: each conversation c starts with the first
    h turns of conversation c - c % ``family`` and goes on with its own after its first h.

    h is the CRC-32 of c's decimal digits modulo ``most``.
    """
    placed = ordered(turns)
    sizes = placed.groupBy("conv_id").agg(F.max("place").alias("own"))
    sizes = sizes.select("conv_id", "own", (F.crc32(F.col("conv_id").cast("string")) % most).alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    bases = sizes.where("conv_id = base").select("base", F.col("own").alias("base_n"))
    convs = spool(sizes.join(bases, "base", "left").withColumn("head", F.least("h", F.coalesce("base_n", F.lit(0)))), "trie-convs")
    n = convs.count()
    heads = placed.where((F.col("conv_id") % family == 0) & (F.col("place") < most)).select(F.col("conv_id").alias("base"), "place", "digest", "bytes")
    first = heads.join(convs, "base").where("place <= head").select("conv_id", F.col("place").alias("depth"), "digest", "bytes", ((F.col("place") == F.col("head")) & (F.col("own") <= F.col("h"))).alias("last"))
    rest = placed.join(_near(convs, n), "conv_id").where("place > h").select("conv_id", (F.col("head") + F.col("place") - F.col("h")).alias("depth"), "digest", "bytes", (F.col("place") == F.col("own")).alias("last"))
    return spool(first.unionByName(rest), "trie-rows"), convs.where("head = 0 and own <= h").select("conv_id")


def _blocks() -> Callable:
    """Sorted (key, conv_id) rows to blocks of joined decimal ids."""
    names = [*KEY, "part", "block", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, key, ids = TaskContext.get().partitionId(), 0, None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(names, [*key, part, block, ",".join(ids)], strict=True))], schema=pa.schema([*((n, pa.int64()) for n in names[:-1]), ("ids", pa.string())]))

        for batch in batches:
            for *own, conv in zip(*(batch.column(c).to_pylist() for c in (*KEY, "conv_id")), strict=True):
                if key is not None and (own != key or len(ids) == BLOCK):
                    yield out()
                    block, ids = block + 1, []
                key = own
                ids.append(str(conv))
        if ids:
            yield out()

    return run


def _digests() -> Callable:
    """Blocks of a key, in order, to the SHA-256 of all of them joined by commas."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for *own, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
                if own == key:
                    state.update(b"," + ids.encode())
                else:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = own, hashlib.sha256(ids.encode())
            if done:
                yield _digest_rows(done)
        if key is not None:
            yield _digest_rows([(*key, state.hexdigest())])

    return run


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.string())], names=[*KEY, "ends_sha256"])


def ends_of(rows: DataFrame, alone: DataFrame) -> DataFrame:
    """k1..k4, ends_sha256 of the nodes at which a conversation ends.

    Members are sorted by ranges and joined in blocks, so that the members of one
    node are spread over tasks; a node's blocks, not its members, meet in one.
    """
    ends = rows.where("last").select(*KEY, "conv_id").unionByName(alone.select(*[F.lit(0).cast("long").alias(k) for k in KEY], "conv_id"))
    dealt = ends.repartitionByRange(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1), *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    keys = ", ".join(f"{k} long" for k in KEY)
    blocks = dealt.mapInArrow(_blocks(), f"{keys}, part long, block long, ids string")
    met = blocks.repartition(*KEY).sortWithinPartitions(*KEY, "part", "block").select(*KEY, "ids")
    return met.mapInArrow(_digests(), f"{keys}, ends_sha256 string")


def nodes_of(rows: DataFrame, alone: DataFrame) -> DataFrame:
    """The trie of ``rows`` (conv_id, depth from 1, digest, bytes, last) and of the
    conversations ``alone`` (conv_id) that have no turns.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256 of every node.
    """
    lanes = [F.xxhash64(F.lit(k), "depth", "digest").alias(k) for k in KEY]
    checks = [F.xxhash64(F.lit(c), "digest").alias(c) for c in ("c1", "c2")]
    kept = ["conv_id", "depth", "bytes", "last", "c1", "c2", *KEY]
    run = running_totals(rows.select("*", *lanes, *checks), "conv_id", [F.col("depth")], list(KEY), "trie-keys", kept, xor=True)
    run = run.select(*kept[:6], *[F.col(f"{k}_total").alias(k) for k in KEY], *[F.col(f"{k}_total").bitwiseXOR(F.col(k)).alias(p) for k, p in zip(KEY, PARENT, strict=True)])

    same = reduce(lambda a, b: a & b, [F.min(c) == F.max(c) for c in ("depth", "c1", "c2")])
    grouped = run.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("bytes").alias("bytes"), same.alias("same"), *[F.min(p).alias(p) for p in PARENT])
    sure = F.when(F.col("same"), F.col("n_convs")).otherwise(F.raise_error(F.lit("different prefixes share a key")).cast("long"))
    members = run.select("conv_id").where("depth = 1").unionByName(alone)
    root = members.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    zero = lambda names: [F.lit(0).cast("long").alias(c) for c in names]
    nodes = grouped.withColumn("n_convs", sure).drop("same").unionByName(root.select(*zero(KEY), "n_convs", "conv_id", *zero(["depth", "bytes"]), *zero(PARENT)))
    nodes = spool(nodes, "trie-nodes")
    n = nodes.count()

    # of a node's children: how many, and which is heavy
    kids = nodes.where("depth > 0").groupBy(*PARENT).agg(F.count(F.lit(1)).alias("n_children"), F.max(F.struct("n_convs", (-F.col("conv_id")).alias("least"))).alias("top"))
    kids = kids.select(*[F.col(p).alias(k) for k, p in zip(KEY, PARENT, strict=True)], "n_children", (-F.col("top.least")).alias("heavy"))
    known = spool(nodes.join(kids, list(KEY), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-nodes")
    above = known.select(*[F.col(k).alias(p) for k, p in zip(KEY, PARENT, strict=True)], F.col("conv_id").alias("parent_conv_id"), F.col("heavy").alias("chosen"))
    below = known.where("depth > 0").join(_near(above, n), list(PARENT)).withColumn("light", F.col("conv_id") != F.col("chosen")).drop("chosen")
    tops = known.where("depth = 0").select("*", F.lit(None).cast("long").alias("parent_conv_id"), F.lit(False).alias("light"))
    known = spool(below.unionByName(tops.select(*below.columns)).drop("heavy", *PARENT), "trie-nodes")

    sums = _subtree_sums(run, known, n).select("conv_id", "depth", "n_leaves", "saved_tokens")
    ends = ends_of(run, alone)
    empty = hashlib.sha256(b"").hexdigest()
    out = known.join(sums, ["conv_id", "depth"]).join(ends, list(KEY), "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))


def _subtree_sums(run: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """n_leaves and saved_tokens over the subtree of each node, level by level."""
    leaves = known.where("n_children = 0").select(F.col("conv_id").alias("path"))
    own = known.select(*KEY, F.col("conv_id").alias("node"), "parent_conv_id", "light", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    ways = run.select(F.col("conv_id").alias("path"), "depth", *KEY).join(_near(leaves, n), "path").join(_near(own, n), list(KEY)).drop(*KEY)
    ways = spool(ways, "trie-ways")
    # a path begins below the last light edge of its leaf's way; the one without any begins at the root
    starts = ways.groupBy("path").agg(F.coalesce(F.max(F.when(F.col("light"), F.col("depth"))), F.lit(0)).alias("start"), F.sum(F.col("light").cast("long")).alias("level"))
    parts = ways.join(_near(starts, n), "path").where("depth >= start").select("path", "level", "depth", "node", "start", "parent_conv_id", "leaves", "saved")
    main = starts.where("level = 0").select("path")
    root = known.where("depth = 0").select(F.col("conv_id").alias("node"), (F.col("n_children") == 0).cast("long").alias("leaves"))
    root = root.join(main, F.lit(True), "left").select(F.coalesce("path", "node").alias("path"), F.lit(0).cast("long").alias("level"), F.lit(0).cast("long").alias("depth"), "node", F.lit(0).cast("long").alias("start"), F.lit(None).cast("long").alias("parent_conv_id"), "leaves", F.lit(0).cast("long").alias("saved"))
    parts = spool(parts.unionByName(root), "trie-paths", by="level")
    # where each path hangs: the path and depth of the node above its top
    hooks = parts.where("depth = start and start > 0").select(F.col("path").alias("below"), "level", F.col("parent_conv_id").alias("node"), (F.col("depth") - 1).alias("depth"))
    hooks = spool(hooks.join(_near(parts.select("node", "depth", "path"), n), ["node", "depth"]), "trie-hooks", by="level")

    deepest = parts.agg(F.max("level")).first()[0]
    done, arrived = [], None
    for level in range(-1 if deepest is None else deepest, -1, -1):
        here = parts.where(F.col("level") == level).select("path", "depth", "node", "leaves", "saved")
        if arrived is not None:
            more = arrived.groupBy("path", "depth").agg(F.sum("more_leaves").alias("more_leaves"), F.sum("more_saved").alias("more_saved"))
            here = here.join(more, ["path", "depth"], "left").select("path", "depth", "node", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")])
        totals = running_totals(here, "path", [F.col("depth").desc()], ["leaves", "saved"], f"trie-level-{level}", ["path", "depth", "node", "leaves", "saved"])
        done.append(totals.select(F.col("node").alias("conv_id"), "depth", F.col("leaves_total").alias("n_leaves"), F.col("saved_total").alias("saved_tokens")))
        hung = hooks.where(F.col("level") == level).select(F.col("below").alias("path"), F.col("path").alias("hook"), F.col("depth").alias("hook_depth"))
        top = totals.groupBy("path").agg(F.max("leaves_total").alias("more_leaves"), F.max("saved_total").alias("more_saved"))
        arrived = top.join(hung, "path").select(F.col("hook").alias("path"), F.col("hook_depth").alias("depth"), "more_leaves", "more_saved")
    if not done:
        return known.select("conv_id", "depth", F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
    return reduce(DataFrame.unionByName, done)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The nodes (see :func:`nodes_of`) of ``turns`` (conv_id, turn, role, text)."""
    return nodes_of(*whole(turns))
