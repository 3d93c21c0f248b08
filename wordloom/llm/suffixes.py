"""Repeated passages across documents: a depth-limited radix sort of suffixes.

Every byte position starts a suffix, of which only the first ``depth`` bytes
count; suffixes equal through that depth are the repeated windows.

1. Suffixes are dealt.  The deal of a suffix is the least hash among the
   ``SEED``-byte strings inside its first ``depth`` bytes.  It is a function of
   those bytes, so equal windows are dealt alike, and neighbouring suffixes of a
   text mostly share it: a run of suffixes is kept as one stretch of bytes.
   Documents go by id into groups of a few megabytes; a group sends each of its
   deals once, and learns which of them another document has.  The other
   suffixes are unique and drop out.
2. Runs under such a deal are cut out with their bytes and go to its bucket; of
   equal runs in a group only the document with the least id sends one, the
   others are repetitions.  A deal that very many groups have is refined at
   once: its suffixes go one by one, by a hash of all ``depth`` bytes.
3. A bucket's suffixes are sorted by digits of eight bytes, most
   significant first.  Each pass orders what the passes before left tied, and
   drops the groups that lie in one document alone.  What is tied after the last
   pass is a group of equal windows; all but those in the document with the
   least id are repetitions.  Hashes only deal: order and equality are of bytes.

A passage that every group has would put a row of every group into one bucket.
So a bucket takes ``FAN_IN`` groups at most at once: of more, shards of so many
are worked through first.  A shard sends on each of its deals once, with the
number of groups that have it; later it settles the repetitions that it can see
and sends on only runs of which something is not repeated in it, so one copy of
such a passage for a shard.

Defined results: a null text counts as empty and a text shorter than ``depth``
keeps all its bytes; rows that share an id are texts that take nothing from each
other; a null id counts as greater than all others; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm._bytes import mix, sliding_min, text_buffers, window_hashes
from wordloom.llm._shared import TASK_BYTES

DEPTH, SEED = 50, 22
#: Bytes of text in a group of documents, on average.
GROUP_BYTES = 2 << 20
#: Groups whose deals (or runs) one bucket takes, on average.
BUCKET_GROUPS = 8
#: A deal that more groups have is refined at once.
HOT_GROUPS = 512
#: Groups whose rows a bucket takes in one step.
FAN_IN = 1 << 14
#: Suffixes that the passes hold at a time, on average.
MATCHED = 500_000
#: Suffixes in a run at most: one bit of a mask each.
RUN = 32
NO_ID = np.iinfo(np.int64).max
_LOW = np.uint64((1 << 24) - 1)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys & _LOW) * np.uint64(buckets)) >> np.uint64(24)


def _texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, bytes, row of the table) of a group, in an order that depends on its rows alone."""
    table = table.combine_chunks()
    ids = table.column("doc_id").fill_null(NO_ID).to_numpy()
    texts = table.column("text").cast(pa.large_binary()).fill_null(b"")
    order = sorted(range(len(ids)), key=lambda k: (ids[k], texts[k].as_py())) if len(np.unique(ids)) < len(ids) else np.argsort(ids)
    order = np.asarray(order, np.int64)
    ordered = texts.take(pa.array(order)).combine_chunks()
    offsets, data = text_buffers(ordered.chunk(0) if isinstance(ordered, pa.ChunkedArray) else ordered)
    return ids[order], offsets, data, order


class Runs:
    """The runs of a group: first byte, suffixes, text and first deal of each."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, depth: int, seed: int):
        least = sliding_min(window_hashes(data, seed), depth - seed + 1)
        ends = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
        at = np.flatnonzero(np.arange(len(least)) + depth <= ends)
        deal = least[at]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (deal[1:] != deal[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(at)))
        pieces = -(-size // RUN)
        source = np.repeat(np.arange(len(first)), pieces)
        k = np.arange(len(source)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        self.start = at[first][source] + k * RUN
        self.n = np.minimum(size[source] - k * RUN, RUN)
        self.key = mix(deal[first][source] ^ np.uint64(0x5851F42D4C957F2D))
        self.text = np.searchsorted(offsets, self.start, "right") - 1


def _deals(depth: int, seed: int, buckets: int) -> Callable:
    """A group's deals, once each, by bucket; with a flag for those of several documents."""

    def run(table: pa.Table) -> pa.Table:
        ids, offsets, data, _ = _texts(table)
        runs = Runs(offsets, data, depth, seed)
        order = np.lexsort((ids[runs.text], runs.key))
        keys, docs = runs.key[order], ids[runs.text][order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(keys))[: len(first)] - 1
        several = docs[first] != docs[last]
        keys = keys[first]
        bucket = _bucket(keys, buckets)
        order = np.argsort(bucket, kind="stable")
        keys, several, bucket = keys[order], several[order], bucket[order]
        cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        some = np.flatnonzero(np.diff(cuts))
        high = (keys >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        rows = {
            "bucket": pa.array(some.astype(np.int32)),
            "source": pa.array(np.full(len(some), table.column("group")[0].as_py(), np.int64)),
            "deals": pa.array([high[cuts[b] : cuts[b + 1]].T.tobytes() for b in some], pa.binary()),
            "several": pa.array([np.packbits(several[cuts[b] : cuts[b + 1]]).tobytes() for b in some], pa.binary()),
        }
        return pa.table(rows)

    return run


def _unpack(packed: bytes) -> np.ndarray:
    n = len(packed) // 5
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :5] = np.frombuffer(packed, np.uint8).reshape(5, n).T
    return wide.view("<u8").ravel()


def _shared(hot_groups: int) -> Callable:
    """For each group, the deals of a bucket that other documents have too, and which of them are hot."""

    def run(table: pa.Table) -> pa.Table:
        sources = table.column("source").to_numpy()
        blobs = [_unpack(x) for x in table.column("deals").to_pylist()]
        flags = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(b)) for x, b in zip(table.column("several").to_pylist(), blobs, strict=True)]
        sizes = np.array([len(b) for b in blobs])
        deals, several = np.concatenate(blobs), np.concatenate(flags).astype(bool)
        order = np.argsort(deals, kind="stable")
        ordered = deals[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        count = np.diff(np.append(first, len(ordered)))
        both = (count > 1) | np.logical_or.reduceat(several[order], first)
        keep, hot = np.zeros(len(deals), bool), np.zeros(len(deals), bool)
        keep[order], hot[order] = np.repeat(both, count), np.repeat(count > hot_groups, count)
        out_group, out_deals, out_hot = [], [], []
        bucket = np.uint64(table.column("bucket")[0].as_py()) << np.uint64(40)
        for k, (a, b) in enumerate(zip(np.cumsum(sizes) - sizes, np.cumsum(sizes), strict=True)):
            if keep[a:b].any():
                out_group.append(int(sources[k]))
                out_deals.append((deals[a:b][keep[a:b]] | bucket).tobytes())
                out_hot.append(np.packbits(hot[a:b][keep[a:b]]).tobytes())
        return pa.table({"group": pa.array(out_group, pa.int64()), "deals": pa.array(out_deals, pa.binary()), "hot": pa.array(out_hot, pa.binary())})

    return run


def _held(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(deals, flags of deals, number of each row's deals) of rows of packed deals."""
    blobs = [_unpack(x) for x in table.column("deals").to_pylist()]
    flags = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(b)) for x, b in zip(table.column("several").to_pylist(), blobs, strict=True)]
    return np.concatenate(blobs), np.concatenate(flags).astype(bool), np.array([len(b) for b in blobs])


def _pack(deals: np.ndarray) -> bytes:
    return deals.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].T.tobytes()


def _merged(table: pa.Table) -> pa.Table:
    """The deals of a shard of a bucket, once each, with the number of groups that have them."""
    deals, several, _ = _held(table)
    known, at, groups = np.unique(deals, return_inverse=True, return_counts=True)
    flag = np.zeros(len(known), bool)
    flag[at[several]] = True
    row = {name: table.column(name).slice(0, 1).combine_chunks() for name in ("bucket", "shard")}
    blobs = {"deals": _pack(known), "several": np.packbits(flag).tobytes(), "groups": groups.astype("<u4").tobytes()}
    return pa.table({**row, **{name: pa.array([x], pa.binary()) for name, x in blobs.items()}})


def _told(hot_groups: int) -> Callable:
    """For each shard of a bucket, its deals that more than one document has, and which of them are hot."""

    def run(table: pa.Table) -> pa.Table:
        deals, several, sizes = _held(table)
        groups = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("groups").to_pylist()])
        _, at = np.unique(deals, return_inverse=True)
        total = np.bincount(at, weights=groups)  # whole numbers
        both = total > 1
        both[at[several]] = True
        ends = np.cumsum(sizes)
        parts = [np.arange(a, b)[both[at[a:b]]] for a, b in zip(ends - sizes, ends, strict=True)]
        hot = [np.packbits(total[at[x]] > hot_groups).tobytes() for x in parts]
        return pa.table({"bucket": table.column("bucket"), "shard": table.column("shard"), "deals": pa.array([_pack(deals[x]) for x in parts], pa.binary()), "hot": pa.array(hot, pa.binary())})

    return run


def _answered(table: pa.Table, reply: pa.Table) -> pa.Table:
    """What a shard was told, for each of its groups."""
    out: dict[str, list] = {"group": [], "deals": [], "hot": []}
    for blob, hot in zip(reply.column("deals").to_pylist(), reply.column("hot").to_pylist(), strict=True):
        known = _unpack(blob)  # in order, as merged
        flags = np.unpackbits(np.frombuffer(hot, np.uint8), count=len(known))
        for source, packed, bucket in zip(table.column("source").to_pylist(), table.column("deals").to_pylist(), table.column("bucket").to_pylist(), strict=True):
            own = _unpack(packed)
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            found = np.flatnonzero(known[at] == own) if len(known) else at[:0]
            if len(found):
                out["group"].append(source)
                out["deals"].append((own[found] | (np.uint64(bucket) << np.uint64(40))).tobytes())
                out["hot"].append(np.packbits(flags[at[found]]).tobytes())
    return pa.table({"group": pa.array(out["group"], pa.int64()), "deals": pa.array(out["deals"], pa.binary()), "hot": pa.array(out["hot"], pa.binary())})


_RUN_FIELDS = [("bucket", pa.int32()), ("source", pa.int64()), ("keys", pa.binary()), ("ids", pa.binary()), ("runs", pa.binary()), ("bits", pa.binary()), ("sizes", pa.binary()), ("bytes", pa.binary()), ("masks", pa.binary())]
_RUN_COLUMNS = "bucket int, source long, keys binary, ids binary, runs binary, bits binary, sizes binary, bytes binary, masks binary"


def _cut(depth: int, seed: int, buckets: int) -> Callable:
    """The runs of a group under shared deals, by bucket; and what the group alone can tell to be repeated."""

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        rows: dict[str, list] = {name: [] for name, _ in _RUN_FIELDS}
        if table.num_rows and replies.num_rows:
            _cut_group(table, replies, depth, seed, buckets, rows)
        return pa.table({name: pa.array(rows[name], kind) for name, kind in _RUN_FIELDS})

    return run


def _cut_group(table: pa.Table, replies: pa.Table, depth: int, seed: int, buckets: int, rows: dict[str, list]) -> None:
    ids, offsets, data, _ = _texts(table)
    runs = Runs(offsets, data, depth, seed)
    packed = [np.frombuffer(x, "<u8") for x in replies.column("deals").to_pylist()]
    known = np.concatenate(packed)
    hot = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)) for x, p in zip(replies.column("hot").to_pylist(), packed, strict=True)]).astype(bool)
    order = np.argsort(known)
    known, hot = known[order], hot[order]
    own = (_bucket(runs.key, buckets) << np.uint64(40)) | (runs.key >> np.uint64(24))
    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
    mine = np.flatnonzero(known[at] == own)
    start, n, doc, key, is_hot = runs.start[mine], runs.n[mine], ids[runs.text[mine]], runs.key[mine], hot[at[mine]]
    bit = np.zeros(len(mine), np.int64)
    if is_hot.any():  # suffixes one by one, under the next deal
        each = np.where(is_hot, n, 1)
        source = np.repeat(np.arange(len(mine)), each)
        bit = np.arange(len(source)) - np.repeat(np.cumsum(each) - each, each)
        start, doc, mine, key = start[source] + bit, doc[source], mine[source], key[source].copy()
        n = np.where(is_hot[source], 1, n[source])
        single = is_hot[source]
        key[single] = window_hashes(data, depth)[start[single]]
    size = n + depth - 1
    # equal stretches: the least id sends one, greater ids repeat it
    content = _stretch_hashes(data, start, size) + key
    order = np.lexsort((doc, content))
    first = np.concatenate([[True], content[order][1:] != content[order][:-1]]) if len(order) else np.zeros(0, bool)
    least = np.empty(len(order), np.int64)
    head = order[np.flatnonzero(first)][np.cumsum(first) - 1] if len(order) else order
    least[order] = head
    repeat = doc > doc[least]
    # hashes only propose: the bytes decide
    repeat[repeat] = [data[a : a + m].tobytes() == data[b : b + m].tobytes() for a, b, m in zip(start[repeat].tolist(), start[least[repeat]].tolist(), size[repeat].tolist(), strict=True)]
    full = (np.uint64(1) << n.astype(np.uint64)) - np.uint64(1)
    group = table.column("group")[0].as_py()
    if repeat.any():
        masks = (full[repeat] << bit[repeat].astype(np.uint64)).astype("<u8")
        _put(rows, bucket=int(group) % buckets, source=group, runs=mine[repeat].astype("<u4").tobytes(), masks=masks.tobytes())
    send = np.flatnonzero(~repeat)
    place = _bucket(key[send], buckets)
    send = send[np.argsort(place, kind="stable")]
    cuts = np.searchsorted(np.sort(place), np.arange(buckets + 1, dtype=np.uint64))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        x = send[cuts[b] : cuts[b + 1]]
        stretch = np.repeat(start[x] - (np.cumsum(size[x]) - size[x]), size[x]) + np.arange(int(size[x].sum()))
        _put(
            rows, bucket=b, source=group, keys=key[x].tobytes(), ids=doc[x].tobytes(), runs=mine[x].astype("<u4").tobytes(),
            bits=bit[x].astype(np.uint8).tobytes(), sizes=n[x].astype(np.uint8).tobytes(), bytes=data[stretch].tobytes(),
        )


def _put(rows: dict[str, list], **values: object) -> None:
    for name in rows:
        rows[name].append(values.get(name))


def _stretch_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each stretch of bytes, from hashes of its first and last 16 bytes and the run between."""
    if not len(start):
        return np.zeros(0, np.uint64)
    short = window_hashes(data, 16)
    out = size.astype(np.uint64)
    for k in range(0, int(size.max()) - 15, 16):
        out = mix(out + short[np.minimum(start + k, start + size - 16)])
    return out


def _match(depth: int) -> Callable:
    """The suffixes of a bucket that a document with a lesser id has too, as masks of runs by group."""

    def run(table: pa.Table) -> pa.Table:
        out: dict[str, list] = {"group": [], "runs": [], "masks": []}
        sent = []
        for r in table.to_pylist():
            if r["masks"] is not None:
                out["group"].append(r["source"])
                out["runs"].append(r["runs"])
                out["masks"].append(r["masks"])
            else:
                sent.append(r)
        if sent:
            _match_bucket(sent, depth, out)
        return pa.table({"group": pa.array(out["group"], pa.int64()), "runs": pa.array(out["runs"], pa.binary()), "masks": pa.array(out["masks"], pa.binary())})

    return run


def _settle(depth: int) -> Callable:
    """What a shard of a bucket can tell to be repeated, as masks, and the runs that its bucket has still to see."""

    def run(table: pa.Table) -> pa.Table:
        out: dict[str, list] = {"group": [], "runs": [], "masks": []}
        rows: dict[str, list] = {name: [] for name, _ in _RUN_FIELDS}
        sent = []
        for r in table.to_pylist():
            if r["masks"] is not None:
                _put(rows, **{name: r[name] for name, _ in _RUN_FIELDS})
            else:
                sent.append(r)
        if sent:
            _match_bucket(sent, depth, out, rows)
        for group, runs, masks in zip(out["group"], out["runs"], out["masks"], strict=True):
            _put(rows, bucket=sent[0]["bucket"], source=group, runs=runs, masks=masks)
        return pa.table({name: pa.array(rows[name], kind) for name, kind in _RUN_FIELDS})

    return run


def _match_bucket(sent: list[dict], depth: int, out: dict[str, list], later: dict[str, list] | None = None) -> None:
    join = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in sent])
    key, doc, runs, bit, n = join("keys", np.uint64), join("ids", np.int64), join("runs", "<u4"), join("bits", np.uint8), join("sizes", np.uint8).astype(np.int64)
    data = np.frombuffer(b"".join(r.pop("bytes") for r in sent), np.uint8)
    size = n + depth - 1
    begin = np.cumsum(size) - size
    masks = np.zeros(len(n), np.uint64)
    # deals in turn, so that the suffixes of a part of the bucket are held at a time
    parts = -(-int(n.sum()) // MATCHED) or 1
    part = mix(key) % np.uint64(parts)
    for k in range(parts):
        x = np.flatnonzero(part == np.uint64(k))
        own = np.cumsum(size[x]) - size[x]
        stretch = np.repeat(begin[x] - own, size[x]) + np.arange(int(size[x].sum()))
        run_of = np.repeat(np.arange(len(x)), n[x])
        offset = np.arange(len(run_of)) - np.repeat(np.cumsum(n[x]) - n[x], n[x])
        repeated = radix_groups(data[stretch], own[run_of] + offset, doc[x][run_of], depth)
        hit = run_of[repeated]
        np.bitwise_or.at(masks, x[hit], np.uint64(1) << (offset[repeated].astype(np.uint64) + bit[x[hit]].astype(np.uint64)))
    ends = np.cumsum([len(r["ids"]) // 8 for r in sent])
    for r, a, b in zip(sent, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        x = np.flatnonzero(masks[a:b]) + a
        if len(x):
            out["group"].append(r["source"])
            out["runs"].append(runs[x].astype("<u4").tobytes())
            out["masks"].append(masks[x].astype("<u8").tobytes())
        if later is not None:
            full = ((np.uint64(1) << n[a:b].astype(np.uint64)) - np.uint64(1)) << bit[a:b].astype(np.uint64)
            x = np.flatnonzero(masks[a:b] != full) + a
            if len(x):
                stretch = np.repeat(begin[x] - (np.cumsum(size[x]) - size[x]), size[x]) + np.arange(int(size[x].sum()))
                _put(
                    later, bucket=r["bucket"], source=r["source"], keys=key[x].tobytes(), ids=doc[x].tobytes(), runs=runs[x].tobytes(),
                    bits=bit[x].tobytes(), sizes=n[x].astype(np.uint8).tobytes(), bytes=data[stretch].tobytes(),
                )


def radix_groups(data: np.ndarray, at: np.ndarray, doc: np.ndarray, depth: int) -> np.ndarray:
    """Indices of the suffixes at ``at`` whose first ``depth`` bytes some suffix of a lesser doc has.

    Passes over digits of eight bytes, most significant first (the last one
    overlaps the one before); groups of a single document drop out after each.
    """
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) - 7, ">u8", data, strides=(1,))
    alive, group = np.arange(len(at)), np.zeros(len(at), np.int64)
    digits = [*range(0, depth - 8, 8), depth - 8]
    for k in digits:
        if not len(alive):
            break
        value = eight[at[alive] + k].astype(np.uint64)
        same = group[1:] == group[:-1]
        mixed = np.flatnonzero(same & (value[1:] != value[:-1]))
        if len(mixed):  # order the groups in which the digit differs
            unsettled = np.zeros(int(group[-1]) + 1, bool)
            unsettled[group[mixed]] = True
            part = np.flatnonzero(unsettled[group])
            order = part[np.lexsort((value[part], group[part]))] if group[-1] else np.argsort(value)
            alive[part], value[part] = alive[order], value[order]
        new = np.concatenate([[True], ~same | (value[1:] != value[:-1])])
        first = np.flatnonzero(new)
        docs = doc[alive]
        low, high = np.minimum.reduceat(docs, first), np.maximum.reduceat(docs, first)
        group = np.cumsum(new) - 1
        if k == digits[-1]:
            return alive[docs > low[group]]
        keep = (low < high)[group]
        alive, group = alive[keep], group[keep]
        group = np.cumsum(np.concatenate([[False], group[1:] != group[:-1]])) if len(group) else group
    return alive


def _remove(depth: int, seed: int) -> Callable:
    """Each text with the spans that repeat and what is left of it."""

    def run(table: pa.Table, marks: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "starts": pa.array([], pa.list_(pa.int64())), "ends": pa.array([], pa.list_(pa.int64())), "kept": pa.array([], pa.binary())})
        _, offsets, data, order = _texts(table)
        edge = np.zeros(len(data) + 1, np.int64)
        if marks.num_rows:
            runs = Runs(offsets, data, depth, seed)
            numbers = np.concatenate([np.frombuffer(x, "<u4") for x in marks.column("runs").to_pylist()])
            masks = np.concatenate([np.frombuffer(x, "<u8") for x in marks.column("masks").to_pylist()])
            for k in range(RUN):
                at = runs.start[numbers[(masks >> np.uint64(k)) & np.uint64(1) == 1]] + k
                np.add.at(edge, at, 1)
                np.add.at(edge, at + depth, -1)
        gone = np.cumsum(edge[:-1]) > 0
        ids = table.column("doc_id").combine_chunks().take(pa.array(order))
        starts, ends, kept = [], [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            own = gone[a:b]
            change = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
            starts.append(change[::2])
            ends.append(change[1::2])
            kept.append(data[a:b][~own].tobytes() if len(change) else data[a:b].tobytes())
        return pa.table({"doc_id": ids, "n_bytes": pa.array(np.diff(offsets)), "starts": pa.array(starts, pa.list_(pa.int64())), "ends": pa.array(ends, pa.list_(pa.int64())), "kept": pa.array(kept, pa.binary())})

    return run


def remove_repeats(docs: DataFrame, depth: int = DEPTH, seed: int = SEED, group_bytes: int = GROUP_BYTES, hot_groups: int = HOT_GROUPS, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, n_bytes, starts, ends (byte spans removed, ends exclusive), kept (the other bytes).

    Removed is each byte covered by a ``depth``-byte string that also starts in
    a document with a lesser id.  The texts are shuffled once, by group; all
    three uses read that exchange.  Groups and buckets hold a fixed amount each,
    so their number grows with the corpus and the memory of a task does not; one
    that more than ``fan_in`` groups meet in is taken in two steps.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = -(-total // group_bytes) or 1
    buckets = -(-groups // BUCKET_GROUPS)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    grouped = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("long").alias("group"), "doc_id", "text").repartition(tasks, "group")
    deals = grouped.groupBy("group").applyInArrow(_deals(depth, seed, buckets), "bucket int, source long, deals binary, several binary")
    shards = -(-groups // fan_in)
    reply = "group long, deals binary, hot binary"
    if shards > 1:
        deals = deals.withColumn("shard", F.pmod("source", F.lit(shards)).cast("int"))
        merged = deals.groupBy("bucket", "shard").applyInArrow(_merged, "bucket int, shard int, deals binary, several binary, groups binary")
        told = merged.groupBy("bucket").applyInArrow(_told(hot_groups), "bucket int, shard int, deals binary, hot binary")
        replies = deals.groupBy("bucket", "shard").cogroup(told.groupBy("bucket", "shard")).applyInArrow(_answered, reply)
    else:
        replies = deals.groupBy("bucket").applyInArrow(_shared(hot_groups), reply)
    cut = grouped.groupBy("group").cogroup(replies.repartition(tasks, "group").groupBy("group")).applyInArrow(_cut(depth, seed, buckets), _RUN_COLUMNS)
    if shards > 1:
        cut = cut.groupBy("bucket", F.pmod("source", F.lit(shards)).alias("shard")).applyInArrow(_settle(depth), _RUN_COLUMNS)
    marks = cut.groupBy("bucket").applyInArrow(_match(depth), "group long, runs binary, masks binary")
    out = "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary"
    return grouped.groupBy("group").cogroup(marks.repartition(tasks, "group").groupBy("group")).applyInArrow(_remove(depth, seed), out)
