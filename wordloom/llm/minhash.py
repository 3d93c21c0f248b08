"""Near-duplicate documents: banded MinHash, odd sketches, exact confirmation.

A document's set are its distinct word shingles.  Documents with equal sets form
a class, told by a SHA-256 of the set's words (through their BLAKE2b digests);
only the least document of a class goes on.  MinHash samples are cut into bands,
and classes that share a band are candidates.  The samples are also folded into
an odd sketch: each sample flips one bit of a parity bitmap.  Samples in which
two sets agree cancel in the XOR of their bitmaps, so its population count
estimates how many differ, which is precise at high similarity.  Candidates whose
count cannot come from similar sets (an error below 1e-7 for each pair) are
dropped; the others are confirmed on the texts, word by word: no hash decides.

Not all pairs of a bucket are made.  First each class takes the most similar
earlier class of its buckets; confirmed links join classes.  Then, around the
largest component of each bucket that still holds several, the members of the
others are compared with it and with each other, in tiles of two blocks.  A tile
first gets sketches alone and passes on the rows that some sketch of another
component comes near; only those rows' texts are sent to the tile, whose task
tests each pair that the sketches let through until its components are joined,
and passes on links only.  So no link between components is left out, pairs
within a component are never made, and rows are those of members.

Defined results: a document without words has an empty set and no links; a null
text counts as empty; rows that share an id are one document with the links of
all its texts; a null id has no component.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm._bytes import GOLDEN, SLICE_BYTES, digests, mix, numbered, text_buffers, text_slices, window_codes, word_bounds, words_of
from wordloom.llm._shared import small_batches, spool, tasks_for
from wordloom.llm.components import components

BANDS, ROWS = 32, 5
#: Samples behind the odd sketch (the first BANDS * ROWS of them also make the bands) and its bits.
SAMPLES, SKETCH_BITS = 320, 1024
#: Rows that a block of a bucket or around a hub holds, on average; blocks of large hubs grow to MOST_BLOCK.
BLOCK, MOST_BLOCK = 512, 8192
#: Shingles that a block around a hub holds, on average.
BLOCK_SHINGLES = 1 << 19
#: A list of ids is sent to all executors only up to this many rows (8 MB of ids).
BROADCAST_ROWS = 1_000_000

_FACTORS = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * GOLDEN) | np.uint64(1)
_SALTS = mix(np.arange(1001, SAMPLES + 1001, dtype=np.uint64) * GOLDEN)


def sketch_limit(percent: int, samples: int = SAMPLES, bits: int = SKETCH_BITS, sigmas: float = 5.2) -> int:
    """The largest XOR population count that sets of this similarity can be expected to show.

    Two sources of spread: how many samples differ, and how their flips meet in the bitmap.
    """
    differ = samples * (1 - percent / 100)
    flips = 2 * differ
    expected = bits / 2 * (1 - (1 - 2 / bits) ** flips)
    slope = 2 * (1 - 2 / bits) ** flips
    met = bits / 4 * (1 - (1 - 4 / bits) ** flips) + bits**2 / 4 * ((1 - 4 / bits) ** flips - (1 - 2 / bits) ** (2 * flips))
    return math.ceil(expected + sigmas * math.sqrt(slope**2 * differ * percent / 100 + max(met, 0)))


def shingle_codes(ids: np.ndarray, rows: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, first word) of the distinct shingles of ``n`` texts, ordered by row and code.

    ``ids`` number the words, so equal codes mean equal shingles.  A text with fewer
    words than a shingle has its whole sequence as one, with a negative code.
    """
    counts = np.bincount(rows, minlength=n)
    begin = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    m = max(len(ids) - size + 1, 0)
    at = np.flatnonzero(rows[:m] == rows[len(rows) - m :])
    row, code = rows[at], window_codes(ids, size)[at] if m else ids[:0]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        known: dict[bytes, int] = {}
        wholes = [known.setdefault(ids[begin[k] : begin[k] + counts[k]].tobytes(), -1 - len(known)) for k in short.tolist()]
        row, code, at = np.concatenate([row, short]), np.concatenate([code, wholes]), np.concatenate([at, begin[short]])
    order = np.lexsort((code, row))
    row, code, at = row[order], code[order], at[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
    return row[new], code[new], at[new]


def exact_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted shingle codes of each text; codes are comparable within one call."""
    offsets, data = text_buffers(texts)
    starts, ends, rows = word_bounds(offsets, data)
    row, code, _ = shingle_codes(numbered(words_of(data, starts, ends, lower=True))[0], rows, len(texts), size)
    return np.split(code, np.searchsorted(row, np.arange(1, len(texts)))) if len(texts) else []


def _signatures(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for first, end, offsets, data in text_slices(batch.column("text")):
                    yield _signature_batch(batch.column("doc_id").slice(first, end - first), *_hashed_sets(offsets, data, size))

    return run


def _hashed_sets(offsets: np.ndarray, data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(row, hash) of the distinct shingles, ordered by both, and a digest of each row's set."""
    n = len(offsets) - 1
    starts, ends, rows = word_bounds(offsets, data)
    ids, words = numbered(words_of(data, starts, ends, lower=True))
    marks = digests(words)
    row, code, at = shingle_codes(ids, rows, n, size)
    length = np.where(code < 0, np.bincount(rows, minlength=n)[row], size)
    lanes = marks[:, 0][ids] if len(ids) else np.zeros(0, np.uint64)
    h = length.astype(np.uint64)
    for j in range(size):
        inside = length > j
        h[inside] = mix(h[inside] * GOLDEN + lanes[at[inside] + j])
    order = np.lexsort((h, row))
    row, h, at, length = row[order], h[order], at[order], length[order]
    cuts = np.searchsorted(row, np.arange(n + 1)).tolist()
    found = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a == b:
            found.append(b"")
            continue
        width = int(length[a])
        own = marks[ids[at[a:b, None] + np.arange(width)]]
        found.append(hashlib.sha256(width.to_bytes(8, "little") + own.tobytes()).digest())
    return row, h, found


def _signature_batch(ids: pa.Array, rows: np.ndarray, hashes: np.ndarray, sets: list[bytes] | None = None) -> pa.RecordBatch:
    n = len(ids)
    counts = np.bincount(rows, minlength=n)
    some = np.flatnonzero(counts)
    starts = np.concatenate([[0], np.cumsum(counts[some])[:-1]]).astype(np.int64) if len(some) else np.zeros(0, np.int64)
    samples = np.zeros((len(some), SAMPLES), np.uint64)
    for k in range(SAMPLES if len(some) else 0):
        samples[:, k] = np.minimum.reduceat(hashes * _FACTORS[k], starts)
    mixed = mix(samples + _SALTS)
    keys = np.zeros((len(some), BANDS), np.uint64)
    for j in range(ROWS):
        keys = mix(keys * GOLDEN + mixed[:, j : BANDS * ROWS : ROWS])
    bits = (mix(mixed ^ _SALTS) % np.uint64(SKETCH_BITS)).astype(np.int64)
    sketches: list = [None] * n
    bands: list = [None] * n
    for first in range(0, len(some), 128):
        part = bits[first : first + 128]
        flat = np.bincount((np.arange(len(part))[:, None] * SKETCH_BITS + part).ravel(), minlength=len(part) * SKETCH_BITS) & 1
        packed = np.packbits(flat.astype(np.uint8).reshape(-1, SKETCH_BITS), axis=1)
        for i, row in enumerate(some[first : first + 128].tolist()):
            sketches[row] = packed[i].tobytes()
            bands[row] = keys[first + i].view(np.int64)
    columns = [ids, pa.array(counts.astype(np.int64)), pa.array(sets or [b""] * n, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "digest", "bands", "sketch"])


SIGNATURES = "doc_id long, n_shingles long, digest binary, bands array<long>, sketch binary"


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, band keys and odd sketch; no shuffle."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_signatures(size), SIGNATURES)


def _words(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), SKETCH_BITS // 64)


def _differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """XOR population counts of all rows of a with all rows of b."""
    out = np.zeros((len(a), len(b)), np.int32)
    for k in range(a.shape[1]):
        out += np.bitwise_count(a[:, k, None] ^ b[None, :, k])
    return out


#: What names a tile: its hub, members with stragglers (0) or stragglers alone (1), and its two blocks.
TILE = ["hub", "kind", "i", "j"]


def _runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Tables of rows with equal keys, from sorted batches; a run is held whole."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in by])
        cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            key = tuple(keys[a].tolist())
            if key != at and held:
                yield pa.Table.from_batches(held)
                held = []
            at = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _nearest_earlier(limit: int) -> Callable:
    """For each block of a bucket: each member's most similar earlier member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for t in _runs(batches, ["key", "block"]):
            ids = t.column("rep").to_numpy()
            sketch = _words(t.column("sketch").to_pylist())
            order = np.argsort(ids)
            ids, sketch = ids[order], sketch[order]
            for first in range(0, len(ids), BLOCK):  # hashing may fill a block beyond its mean
                d = _differences(sketch[first : first + BLOCK], sketch[: first + BLOCK])
                rows = np.arange(first, first + len(d))
                d[np.arange(d.shape[1])[None, :] >= rows[:, None]] = SKETCH_BITS + 1
                best = d.argmin(axis=1)
                low = d[np.arange(len(d)), best]
                ok = low <= limit
                found.append((ids[rows[ok]], ids[best[ok]], low[ok]))
            if len(found) > 2000:
                yield _pairs(found)
                found = []
        yield _pairs(found)

    return run


def _pairs(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b, d = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(d.astype(np.int64))], names=["a", "b", "differ"])


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |intersection| >= percent * |union| for sorted distinct codes."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


class _Unions:
    """Component labels that links join."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.root(x)] = self.root(y)


def _near_rows(limit: int) -> Callable:
    """Of each tile (rows of equal hub, kind, i, j), the rows whose sketch comes near one of the
    other side (of the tile, if it has one side) in another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, TILE):
            sides = t.column("side").to_numpy()
            comps, sketch = t.column("component").to_numpy(), _words(t.column("sketch").to_pylist())
            mine = np.flatnonzero(sides == 0)
            theirs = mine if t.column("one_sided")[0].as_py() else np.flatnonzero(sides == 1)
            near = np.zeros(len(sides), bool)
            for first in range(0, len(mine), BLOCK):
                own = mine[first : first + BLOCK]
                for other in range(0, len(theirs), BLOCK):
                    their = theirs[other : other + BLOCK]
                    hit = _differences(sketch[own], sketch[their]) <= limit
                    hit &= comps[own][:, None] != comps[their][None, :]
                    near[own[hit.any(axis=1)]] = True
                    near[their[hit.any(axis=0)]] = True
            if near.any():
                yield from t.filter(pa.array(near)).to_batches()

    return run


def _across(limit: int, percent: int, size: int) -> Callable:
    """Links between components within a tile: pairs are tested on their texts, the most similar
    sketches first, unless links found here have joined their components; only links are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, TILE):
            sides = t.column("side").to_numpy()
            ids, comps = t.column("rep").to_numpy(), t.column("component").to_numpy()
            sketch, sets = _words(t.column("sketch").to_pylist()), exact_sets(t.column("text").combine_chunks(), size)
            mine = np.flatnonzero(sides == 0)
            theirs = mine if t.column("one_sided")[0].as_py() else np.flatnonzero(sides == 1)
            unions, links = _Unions(), []
            for first in range(0, len(mine), BLOCK):
                own = mine[first : first + BLOCK]
                for other in range(0, len(theirs), BLOCK):
                    their = theirs[other : other + BLOCK]
                    d = _differences(sketch[own], sketch[their])
                    d[comps[own][:, None] == comps[their][None, :]] = SKETCH_BITS + 1
                    i, j = np.nonzero(d <= limit)
                    order = np.argsort(d[i, j], kind="stable")
                    for x, y in zip(own[i[order]].tolist(), their[j[order]].tolist(), strict=True):
                        p, q = unions.root(int(comps[x])), unions.root(int(comps[y]))
                        if p != q and _alike(sets[x], sets[y], percent):
                            unions.join(p, q)
                            links.append((max(int(ids[x]), int(ids[y])), min(int(ids[x]), int(ids[y]))))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _confirm(percent: int, size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).cast(pa.large_binary()) for c in ("text_a", "text_b"))
            ends = np.cumsum(np.diff(text_buffers(a)[0]) + np.diff(text_buffers(b)[0]))
            first = 0
            while first < batch.num_rows:
                end = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + SLICE_BYTES, "right")))
                n = end - first
                sets = exact_sets(pa.concat_arrays([a.slice(first, n), b.slice(first, n)]), size)
                mask = pa.array([bool(len(x) and len(y)) and _alike(x, y, percent) for x, y in zip(sets[:n], sets[n:], strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(first, n).filter(mask) for c in ("a", "b")], names=["a", "b"])
                first = end

    return run


def _checked(small: DataFrame) -> DataFrame:
    """``small`` for a broadcast if it is counted to be small; otherwise for a keyed join."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return left.join(_checked(pairs), "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(_confirm(percent, size), "a long, b long")


def _block(count: Column, row: Column) -> Column:
    """A number below count / BLOCK, by a hash of the row's id."""
    return F.pmod(F.xxhash64(row), F.ceil(count / BLOCK)).cast("long")


def _best(pairs: DataFrame) -> DataFrame:
    """a, b with a > b: the most similar pair of each a."""
    best = pairs.groupBy("a").agg(F.min(F.struct("differ", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    return best.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _blocks(count: Column, shingles: Column) -> Column:
    """How many blocks rows around a hub are dealt into."""
    rows = F.least(F.greatest(F.lit(BLOCK), F.ceil(count / 16)), F.lit(MOST_BLOCK))
    return F.greatest(F.ceil(count / rows), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1)).cast("int")


def _tiles(buckets: DataFrame, joined: DataFrame, sketches: DataFrame) -> DataFrame:
    """Rows around hubs, dealt into tiles: hub, kind, i, j, one_sided, side, rep, component, sketch.

    A bucket's hub is the largest component in it; the bucket's other members
    are the hub's stragglers.  Each hub has its members and stragglers, from all
    buckets, once; stragglers meet both.  So any two members of a bucket in
    different components meet in a tile, and rows are those of members, with
    sketches alone.
    """
    sizes = joined.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    labelled = buckets.join(joined.join(sizes, "component").select(F.col("node").alias("rep"), "component", "size"), "rep", "left")
    labelled = labelled.select("key", "rep", F.coalesce("component", "rep").alias("component"), F.coalesce("size", F.lit(1)).alias("size"))
    labelled = spool(labelled, "minhash")
    hubs = labelled.groupBy("key").agg(F.max(F.struct("size", "component")).alias("top"), F.min("component").alias("low"), F.max("component").alias("high"))
    hubs = hubs.where("low <> high").select("key", F.col("top.component").alias("hub"))
    around = labelled.join(_checked(spool(hubs, "minhash")), "key").select("hub", "rep", "component").distinct()
    held = spool(around.join(sketches, "rep"), "minhash")
    member = F.col("component") == F.col("hub")
    of = lambda mine, x: F.coalesce(F.sum(F.when(mine, x)), F.lit(0))
    counts = held.groupBy("hub").agg(
        _blocks(of(member, F.lit(1)), of(member, F.col("n_shingles"))).alias("member_blocks"),
        _blocks(of(~member, F.lit(1)), of(~member, F.col("n_shingles"))).alias("stray_blocks"),
    )
    rows = held.join(counts, "hub").withColumn("own", F.pmod(F.xxhash64("rep"), F.when(member, F.col("member_blocks")).otherwise(F.col("stray_blocks"))).cast("int"))
    payload = ["rep", "component", "sketch"]
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("other")
    tile = lambda kind, i, j, one, side: (F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), one.alias("one_sided"), side.alias("side"))
    own, other = F.col("own"), F.col("other")
    no = F.lit(False)
    members = rows.where(member).select("hub", "own", *payload, upto("stray_blocks")).select("hub", *tile(0, own, other, no, F.lit(0)), *payload)
    strays = rows.where(~member)
    to_members = strays.select("hub", "own", *payload, upto("member_blocks")).select("hub", *tile(0, other, own, no, F.lit(1)), *payload)
    to_strays = strays.select("hub", "own", *payload, upto("stray_blocks"))
    to_strays = to_strays.select("hub", *tile(1, F.least(own, other), F.greatest(own, other), own == other, (own > other).cast("int")), *payload)
    return members.union(to_members).union(to_strays)


def _open_links(buckets: DataFrame, joined: DataFrame, sketches: DataFrame, texts: DataFrame, tasks: int, limit: int, percent: int, size: int) -> DataFrame:
    """Links between components that share a bucket: sketches choose the rows of each tile, texts decide."""
    tiles = _tiles(buckets, joined, sketches)
    near = spool(tiles.repartition(tasks, *TILE).sortWithinPartitions(*TILE).mapInArrow(_near_rows(limit), tiles.schema), "minhash")
    both = near.join(texts, near["rep"] == texts["doc_id"]).drop("doc_id")
    return both.repartition(tasks, *TILE).sortWithinPartitions(*TILE).mapInArrow(_across(limit, percent, size), "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id reachable), kept (it is that id).

    Two documents are linked if 100 * |intersection| >= percent * |union| of
    their sets of ``size``-word shingles.
    """
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, size, percent)


def _near_duplicates(docs: DataFrame, size: int, percent: int) -> DataFrame:
    limit = sketch_limit(percent)
    tasks = tasks_for(docs)
    signed = spool(signatures(docs, size), "minhash")
    full = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    # equal sets have equal bands and sketches, so the least document's are those of the class
    classes = spool(full.groupBy("digest").agg(F.min("doc_id").alias("rep")), "minhash")
    own = classes.withColumnRenamed("rep", "doc_id")
    reps = full.join(own, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"])
    reps = spool(reps.select(F.col("doc_id").alias("rep"), "n_shingles", "bands", "sketch"), "minhash")
    banded = reps.select("rep", F.posexplode("bands").alias("band", "key")).select(F.xxhash64("band", "key").alias("key"), "rep").distinct()
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("least")).where("n > 1")
    buckets = spool(banded.join(shared, "key"), "minhash")
    members = _checked(spool(buckets.select("rep").distinct(), "minhash"))
    sketches = spool(reps.select("rep", "n_shingles", "sketch").join(members, "rep"), "minhash")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = spool(texts.join(members.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi"), "minhash", "snappy")

    # first pass: the nearest earlier class, and one link between the blocks of a large bucket
    blocks = buckets.join(sketches, "rep").select("key", _block(F.col("n"), F.col("rep")).alias("block"), "rep", "sketch")
    near = blocks.repartition(tasks, "key", "block").sortWithinPartitions("key", "block").mapInArrow(_nearest_earlier(limit), "a long, b long, differ long")
    firsts = buckets.where(F.col("n") > BLOCK).groupBy("key", "least", _block(F.col("n"), F.col("rep")).alias("block")).agg(F.min("rep").alias("a"))
    near = near.union(firsts.where("a <> least").select("a", F.col("least").alias("b"), F.lit(SKETCH_BITS).cast("long")))
    tested = spool(_best(near), "minhash")
    links = spool(_confirmed(tested, texts, percent, size), "minhash")
    joined = spool(components(links), "minhash")

    # then what lies in different components of a bucket
    found = spool(_open_links(buckets, joined, sketches, texts, tasks, limit, percent, size), "minhash")
    if not found.isEmpty():
        joined = spool(components(links.union(found)), "minhash")

    out = signed.join(classes, "digest", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, of the least document of each group of near-duplicates.

    Of rows that share an id one stays.  A null id has no group; its rows stay.
    """
    judged = spool(near_duplicates(docs, size, percent).select("doc_id", "kept").where("doc_id is not null"), "minhash")
    gone = _checked(judged.where("not kept").select("doc_id").distinct())
    left = docs.join(gone, "doc_id", "left_anti")
    repeated = spool(judged.where("kept").groupBy("doc_id").count().where("count > 1").select("doc_id"), "minhash")
    if not repeated.isEmpty():
        again = _checked(repeated)
        left = left.join(again, "doc_id", "left_anti").unionByName(left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
