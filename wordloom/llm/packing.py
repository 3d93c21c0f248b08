"""Bounded-space online packing of token streams into fixed windows.

Each partition keeps at most ``open_windows`` unfinished windows.  Whole
windows of a long document leave at once; its tail goes to the tightest open
window with room (best fit).  When no window has room and no more may be
opened, the fullest one leaves: filled up with the head of the tail if its gap
is at least ``min_cut`` tokens, else padded.  What is open at a partition's end
is merged in a second pass over groups of partitions, which finally cuts its
remainder into windows whose lengths are powers of two, so it needs no padding.

Defined results: a null or empty text is the end-of-document id alone; rows
with a null id or repeated ids are documents of their own; an empty table gives
an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm._bytes import IS_SPACE, LOWER, ByteTable, binary_array, numbered, piece_hashes, text_buffers, text_slices, word_bounds
from wordloom.llm._shared import small_batches, spool

CAPACITY = 2048
OPEN_WINDOWS = 32
MIN_CUT = 16
#: Partitions whose leftovers one task of the second pass merges.
MERGE_PARTITIONS = 64
#: Pieces of words whose ids a worker remembers.
KNOWN_PIECES = 400_000

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, leftover boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("leftover", pa.bool_())])


def tokenizer_path(name: str) -> str:
    """A path as it is; a bare file name is looked up among the installed public tokenizers."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


#: UTF-8 of one letter that is a lower-case ASCII letter or in U+00C0-U+017F, where only U+0130
#: changes its number of code points in lower case; U+00D7 and U+00F7 are no letters (fixed values).
_PLAIN_WORD = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|\xc5[\x80-\xbf])+")
_IS_MARK = np.zeros(256, bool)
_IS_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_IS_ALNUM = np.zeros(256, bool)
_IS_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: Words that one call of the tokenizer gets, joined by spaces.
JOINED_WORDS = 20_000
#: The one way of cutting texts that pieces of words are sound for (a fixed value).
_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def goes_by_words(tokenizer: dict) -> bool:
    """Whether a tokenizer, as its JSON tells, folds case, drops white space, never joins across it,
    takes a run of marks by itself and ends each word with a token of its own kind."""
    steps = lambda part, name: [x["type"] for x in (tokenizer.get(part) or {}).get(name, [])]
    cuts = [x for x in (tokenizer.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split"]
    model = tokenizer["model"]
    return (
        steps("normalizer", "normalizers") == ["NFC", "Replace", "Lowercase"]
        and steps("pre_tokenizer", "pretokenizers") == ["Split", "ByteLevel"]
        and [(x["pattern"].get("Regex"), x["behavior"], x["invert"]) for x in cuts] == [(_CUTS, "Removed", True)]
        and model["type"] == "BPE"
        and model.get("end_of_word_suffix") == "</w>"
        and not (model.get("continuing_subword_prefix") or model.get("dropout") or model.get("unk_token"))
        and all(x["content"].startswith("<|") for x in tokenizer.get("added_tokens", []))
    )


def _cut_marks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, word) of pieces: marks that end a word right after a letter or digit are cut off.

    They form a token of their own, whatever stands before.
    """
    last = np.maximum.accumulate(np.where(_IS_MARK[data], 0, np.arange(len(data))))[ends - 1]
    lead, tail = data[np.maximum(last - 1, 0)], data[last]
    wide = (last > starts) & (((lead == 0xC3) & (tail != 0x97) & (tail != 0xB7)) | ((lead == 0xC4) & (tail != 0xB0)) | (lead == 0xC5)) & (tail >= 0x80)
    cut = (last >= starts) & (last + 1 < ends) & ~_IS_MARK[tail] & (_IS_ALNUM[tail] | wide)
    count = 1 + cut
    word = np.repeat(np.arange(len(starts)), count)
    first, second = starts[word], ends[word]
    tails = (np.cumsum(count) - 1)[cut]
    first[tails] = last[cut] + 1
    second[tails - 1] = last[cut] + 1
    return first, second, word


class ChunkEncoder:
    """Ids of texts, looked up by pieces of words, byte for byte.

    Pieces are used for tokenizers that :func:`goes_by_words` approves; their ids
    are then those of the whole text (tests compare both).  Other tokenizers, and
    texts that may hold a special token, get whole texts.
    """

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        self.by_words = goes_by_words(json.loads(self.tokenizer.to_str()))
        self.ends_word = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.ends_word[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self, least: int = 0) -> None:
        """``known`` numbers the pieces; their ids stand in ``flat`` from ``at``, ``n`` of them."""
        self.known = ByteTable(max(KNOWN_PIECES, least))
        self.at, self.n = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.flat, self.used = np.zeros(1 << 16, "<u4"), 0

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, offsets: np.ndarray, data: np.ndarray) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text of a slice."""
        rows = len(offsets) - 1
        if not self.by_words:
            return self.whole([data[a:b].tobytes().decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
        starts, ends, word_row = word_bounds(offsets, data)
        if not len(starts):
            return [b""] * rows
        first, end, word = _cut_marks(data, starts, ends)
        # a letter before a byte of another script keeps its case: with a combining mark, the small letter may have a
        # composed form (U+01F0) that the capital lacks, and texts are composed before they are folded
        folded = LOWER[data]
        kept = np.flatnonzero(data[1:] >= 0x80)
        folded[kept] = data[kept]
        inverse, distinct = numbered(binary_array(folded[~IS_SPACE[data]], end - first))
        number = self._numbers(distinct)
        n = self.n[number][inverse]
        before = np.cumsum(n) - n
        ids = self.flat[np.repeat(self.at[number][inverse] - before, n) + np.arange(int(n.sum()))].tobytes()
        borders = np.concatenate([[0], np.cumsum(np.bincount(word_row[word], weights=n, minlength=rows))]).astype(np.int64) * 4
        out = [ids[a:b] for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)]
        special = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
        for row in np.unique(np.searchsorted(offsets, special, "right") - 1).tolist():
            out[row] = self.whole([data[offsets[row] : offsets[row + 1]].tobytes().decode()])[0]
        return out

    def _numbers(self, distinct: pa.Array) -> np.ndarray:
        """The numbers of distinct pieces; new ones are encoded."""
        offsets, data = text_buffers(distinct)
        if self.known.n + len(distinct) > len(self.known.hashes):
            self.forget(len(distinct))
        with np.errstate(over="ignore"):
            hashes = piece_hashes(data, offsets)
        number = self.known.find(data, offsets, hashes)
        fresh = np.flatnonzero(number < 0)
        if len(fresh):
            new = distinct.take(pa.array(fresh))
            new_offsets, new_data = text_buffers(new)
            number[fresh] = self.known.add(new_data, new_offsets, hashes[fresh])
            self._learn(new.to_pylist(), number[fresh])
        return number

    def _learn(self, words: list[bytes], numbers: np.ndarray) -> None:
        """Encode new pieces."""
        lengths, new = self.encode_pieces(words)
        self.flat = _room(self.flat, self.used + len(new))
        self.flat[self.used : self.used + len(new)] = new
        self.at, self.n = _room(self.at, self.known.n), _room(self.n, self.known.n)
        self.at[numbers], self.n[numbers] = self.used + np.cumsum(lengths) - lengths, lengths
        self.used += len(new)

    def encode_pieces(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each piece, all ids one after another)."""
        plain = [k for k, w in enumerate(words) if _PLAIN_WORD.fullmatch(w)]
        other = sorted(set(range(len(words))).difference(plain))
        found: list[np.ndarray] = [np.zeros(0, "<u4")] * len(words)
        for k in range(0, len(plain), JOINED_WORDS):
            part = plain[k : k + JOINED_WORDS]
            joined = b" ".join([words[i] for i in part]).decode()
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
            for i, own in zip(part, np.split(ids, np.flatnonzero(self.ends_word[ids])[:-1] + 1), strict=True):
                found[i] = own
        for i, e in zip(other, self.tokenizer.encode_batch_fast([words[i].decode() for i in other], add_special_tokens=False), strict=True):
            found[i] = np.array(e.ids, dtype="<u4")
        return np.array([len(x) for x in found], np.int64), np.concatenate(found)


def _room(values: np.ndarray, n: int) -> np.ndarray:
    """``values`` with room for ``n`` entries; the room doubles, so growing costs little."""
    while len(values) < n:
        values = np.concatenate([values, np.zeros_like(values)])
    return values


@lru_cache(maxsize=2)
def encoder(name: str) -> ChunkEncoder:
    return ChunkEncoder(name)


class Packer:
    """The open windows of one partition.  A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, first_id: int, capacity: int, open_windows: int, min_cut: int):
        self.next_id, self.capacity, self.most, self.min_cut = first_id, capacity, open_windows, min_cut
        self.open: list[tuple[int, int]] = []  # (room, key), tightest first
        self.pieces: dict[int, list[tuple]] = {}
        self.keys = 0
        self.out: list[tuple] = []

    def emit(self, pieces: list[tuple], leftover: bool = False) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.out.append((doc_id, start, n, ids, total, self.next_id, at, leftover))
            at += n
        self.next_id += 1

    def add(self, doc_id, start: int, ids: bytes, total: int) -> None:
        while ids:
            n = len(ids) // 4
            if n >= self.capacity:
                self.emit([(doc_id, start, ids[: 4 * self.capacity], total)])
                start, ids = start + self.capacity, ids[4 * self.capacity :]
                continue
            i = bisect.bisect_left(self.open, (n, -1))
            if i < len(self.open):
                room, key = self.open.pop(i)
            elif len(self.open) < self.most:
                room, key = self.capacity, self.keys
                self.keys += 1
                self.pieces[key] = []
            else:
                room, key = self.open.pop(0)
                if room < self.min_cut:
                    self.emit(self.pieces.pop(key))
                    continue
            head = ids[: 4 * room]
            self.pieces[key].append((doc_id, start, head, total))
            start, ids, room = start + len(head) // 4, ids[4 * room :], room - len(head) // 4
            if room:
                bisect.insort(self.open, (room, key))
            else:
                self.emit(self.pieces.pop(key))

    def leave_open(self) -> None:
        for key in [k for _, k in self.open]:
            self.emit(self.pieces.pop(key), leftover=True)
        self.open = []

    def close(self) -> None:
        """Join what is open and cut it into full windows and powers of two."""
        rest = [p for _, k in self.open for p in self.pieces.pop(k)]
        self.open = []
        left = sum(len(p[2]) // 4 for p in rest)
        window: list[tuple] = []
        room = 0
        for doc_id, start, ids, total in rest:
            while ids:
                if not room:
                    room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
                head = ids[: 4 * room]
                n = len(head) // 4
                window.append((doc_id, start, head, total))
                start, ids, room, left = start + n, ids[4 * n :], room - n, left - n
                if not room:
                    self.emit(window)
                    window = []

    def take(self) -> pa.RecordBatch:
        columns = zip(*self.out, strict=True) if self.out else [[] for _ in _ARROW]
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)
        self.out = []
        return batch


def _pack_documents(tokenizer: str, end_id: int, capacity: int, open_windows: int, min_cut: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        packer = Packer(TaskContext.get().partitionId() << 32, capacity, open_windows, min_cut)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, stop, offsets, data in text_slices(batch.column("text")):
                for doc_id, tokens in zip(ids[first:stop], encode(offsets, data), strict=True):
                    tokens += end
                    packer.add(doc_id, 0, tokens, len(tokens) // 4)
                yield packer.take()
        packer.leave_open()
        yield packer.take()

    return run


def _pack_leftovers(capacity: int, open_windows: int, min_cut: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(((1 << 20) + TaskContext.get().partitionId()) << 32, capacity, open_windows, min_cut)
        for batch in batches:
            for x in batch.to_pylist():
                packer.add(x["doc_id"], x["start"], x["ids"], x["doc_tokens"])
            yield packer.take()
        packer.close()
        yield packer.take()

    return run


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, capacity: int = CAPACITY, open_windows: int = OPEN_WINDOWS, min_cut: int = MIN_CUT) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): doc_id, start, length, ids (little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset.

    A window whose length is not a power of two is to be padded to ``capacity``.
    Only the leftovers of the partitions, at most ``open_windows`` each, are
    shuffled; one task merges those of ``MERGE_PARTITIONS`` partitions.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with small_batches(docs.sparkSession):
        packed = spool(rows.mapInArrow(_pack_documents(tokenizer, end_id, capacity, open_windows, min_cut), PIECES), "packing", "snappy")
    done, left = packed.where(~F.col("leftover")), packed.where("leftover")
    group = F.shiftright("sequence_id", 32)
    groups = left.agg(F.max(group)).first()[0]
    if groups is None:
        return done.drop("leftover")
    tasks = groups // MERGE_PARTITIONS + 1
    merged = (
        left.withColumn("slot", (group / MERGE_PARTITIONS).cast("long"))
        .repartition(tasks, "slot")
        .sortWithinPartitions("sequence_id", "offset")
        .drop("slot")
        .mapInArrow(_pack_leftovers(capacity, open_windows, min_cut), PIECES)
    )
    return done.unionByName(merged).drop("leftover")
