"""Exact BPE encoding by backtracking, and decoding by an offset table.

A pretoken is a string of byte symbols, with an end mark if the tokenizer's
tokens know the ends of words.  An Aho-Corasick automaton over the reversed
tokens gives the longest token that starts at each position.  The encoder goes
left to right, takes the longest token there, and keeps it only if merging
would leave a border between it and the token before; else it tries the longest
prefix of it that is a token, and where none is left it marks the position as
unreachable and takes back the token before.  A position is marked once, so the
time is linear in the length of the pretoken.

Two neighbours are compatible if no merge crosses their border: going back in
time from the two tokens, one merge at a time and the later one first, no pair
that ever touched at the border may have a merge that comes before the one that
swallowed either part.  Only the parts of the two tokens decide, so the answers
are kept in a table.  A sequence whose neighbours are all compatible is the one
that merging by rank gives.

Normalising and cutting into pretokens are the tokenizers library's own; special
tokens in a text become their ids.  Distinct pieces of words are encoded once a
worker, where the tokenizer allows it (see :mod:`wordloom.llm.packing`).

Defined results: a null text is an empty one and has no ids; rows with a null or
repeated doc_id are rows of their own; an empty table gives an empty result;
extra columns are ignored, whatever their names; a very long text is encoded
whole, in one task, and decoded in blocks.  A tokenizer whose merges are not
plain byte-pair merges (unknown tokens, dropout, prefixes, a token with two
merges) is refused.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm._bytes import text_slices
from wordloom.llm.packing import _PLAIN_WORD, ChunkEncoder, tokenizer_path

END = chr(256)
#: Compatible and incompatible pairs that a worker remembers.
KNOWN_PAIRS = 1_000_000
#: Ids decoded at a time.
DECODE_BLOCK = 1 << 17


def byte_letters() -> dict[str, str]:
    """The letter that stands for each byte in a byte-level vocabulary, mapped back onto that byte.

    Bytes that print stand for themselves, the others take the code points from 256 on in turn.
    """
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printed]
    return {chr(b): chr(b) for b in printed} | {chr(256 + k): chr(b) for k, b in enumerate(others)}


class PairMerges:
    """Vocabulary and merges of a tokenizer's JSON, as strings of byte symbols."""

    def __init__(self, tokenizer: dict):
        model = tokenizer["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("unk_token", "dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("only plain byte-pair merges are supported")
        vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.text: dict[int, str] = {}
        for token, i in vocab.items():
            if token in letters:
                self.text[i] = letters[token]
            elif self.suffix and token.removesuffix(self.suffix) in letters:
                self.text[i] = letters[token.removesuffix(self.suffix)] + END
        size = max(vocab.values()) + 1
        self.left, self.right, self.rank = [-1] * size, [-1] * size, [-1] * size
        self.pairs: dict[tuple[int, int], int] = {}
        for r, merge in enumerate(model["merges"]):
            a, b = (vocab[x] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            i = vocab[merge.replace(" ", "") if isinstance(merge, str) else "".join(merge)]
            if i in self.text or self.rank[a] >= r or self.rank[b] >= r:
                raise ValueError("a token with two merges, or merged before its parts")
            self.left[i], self.right[i], self.rank[i], self.text[i] = a, b, r, self.text[a] + self.text[b]
            self.pairs[a, b] = r
        self.ids = {t: i for i, t in self.text.items()}
        self.length, self.shorter = [0] * size, [-1] * size
        self.automaton = ahocorasick.Automaton()
        for i, t in self.text.items():
            self.length[i] = len(t)
            self.shorter[i] = next((self.ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ids), -1)
            self.automaton.add_word(t[::-1], i)
        self.automaton.make_automaton()
        self.known: dict[tuple[int, int], bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        answer = self.known.get((a, b))
        if answer is None:
            if len(self.known) >= KNOWN_PAIRS:
                self.known.clear()
            answer = self.known[a, b] = self._border_stays(a, b)
        return answer

    def _border_stays(self, a: int, b: int) -> bool:
        never = len(self.pairs)
        a_until = b_until = never  # ranks of the merges that swallow the parts a and b
        while True:
            r = self.pairs.get((a, b), never)
            # of merges of one rank, the leftmost comes first: a's own before this one, this one before b's
            if r < a_until and (r < b_until or r == b_until < never):
                return False
            if self.rank[a] < 0 and self.rank[b] < 0:
                return True
            if self.rank[a] > self.rank[b]:
                a, a_until = self.right[a], self.rank[a]
            else:
                b, b_until = self.left[b], self.rank[b]

    def encode(self, symbols: str) -> list[int]:
        """Ids of one pretoken."""
        whole = self.ids.get(symbols)
        if whole is not None:
            return [whole]
        n = len(symbols)
        longest = [-1] * (n + 1)
        for end, i in self.automaton.iter(symbols[::-1]):
            if longest[n - 1 - end] < 0 or self.length[i] > self.length[longest[n - 1 - end]]:
                longest[n - 1 - end] = i
        length, shorter, known, dead = self.length, self.shorter, self.known, bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            while token >= 0:
                if not dead[at + length[token]]:
                    fits = known.get((out[-1], token)) if out else True
                    if fits or (fits is None and self.compatible(out[-1], token)):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at]
            elif out:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
            else:
                raise ValueError("a byte without a token")
        return out


class BacktrackingEncoder(ChunkEncoder):
    """A :class:`ChunkEncoder` whose ids come from :class:`PairMerges`."""

    def __init__(self, name: str):
        super().__init__(name)
        described = json.loads(self.tokenizer.to_str())
        self.merges = PairMerges(described)
        self.letters = str.maketrans(byte_letters())
        added = described.get("added_tokens") or []
        if any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in added):
            raise ValueError("only special tokens that stand for exactly their own string are supported")
        self.special = {x["content"]: x["id"] for x in added}
        by_length = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(map(re.escape, by_length))})") if by_length else None

    def one(self, text: str) -> list[int]:
        ids: list[int] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                ids.append(self.special[part])
                continue
            plain = self.tokenizer.normalizer.normalize_str(part) if self.tokenizer.normalizer else part
            for letters, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain) if plain else ():
                ids += self.merges.encode(letters.translate(self.letters) + (END if self.merges.suffix else ""))
        return ids

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(self.one(t), "<u4").tobytes() for t in texts]

    def encode_pieces(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for w in words:
            if _PLAIN_WORD.fullmatch(w):  # one pretoken, composed already
                found.append(self.merges.encode(w.decode().lower().encode().decode("latin-1") + END))
            else:
                found.append(self.one(w.decode()))
        return np.array([len(x) for x in found], np.int64), np.array([i for x in found for i in x], "<u4")


class OffsetDecoder:
    """Strings of all tokens, one after another, and where each starts.

    A tokenizer without a decoder joins its tokens by spaces; the byte-level decoder joins their bytes.
    """

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path(name))
        described = json.loads(tokenizer.to_str())
        kind = (described.get("decoder") or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"the decoder {kind} is not supported")
        letters = byte_letters()
        self.gap = 1 if kind is None else 0
        tokens: list[bytes] = []
        for i in range(max(tokenizer.get_vocab(with_added_tokens=True).values()) + 1):
            token = tokenizer.id_to_token(i) or ""
            if kind is not None and all(c in letters for c in token):
                tokens.append("".join(letters[c] for c in token).encode("latin-1"))
            else:
                tokens.append((token + " " * self.gap).encode())
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def decode(self, ids: bytes) -> str:
        numbers, blocks = np.frombuffer(ids, "<u4"), []
        for k in range(0, len(numbers), DECODE_BLOCK):
            block = numbers[k : k + DECODE_BLOCK]
            n = self.lengths[block]
            before = np.cumsum(n) - n
            blocks.append(self.data[np.repeat(self.starts[block] - before, n) + np.arange(int(n.sum()))].tobytes())
        joined = b"".join(blocks)
        return joined[: len(joined) - self.gap if joined else 0].decode(errors="replace")


@lru_cache(maxsize=2)
def encoder(name: str) -> BacktrackingEncoder:
    return BacktrackingEncoder(name)


@lru_cache(maxsize=2)
def decoder(name: str) -> OffsetDecoder:
    return OffsetDecoder(name)


def _encode(tokenizer: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            for first, stop, offsets, data in text_slices(batch.column("text")):
                ids = encode(offsets, data)
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[first:stop], counts, pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return run


def _decode(tokenizer: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = decoder(tokenizer).decode
        for batch in batches:
            for first, stop, offsets, data in text_slices(batch.column("ids")):
                texts = pa.array([decode(data[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.slice(first, stop - first).columns, texts], names=[*batch.schema.names, "decoded"])

    return run


def encode(docs: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) of each row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encode(tokenizer), "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """doc_id, n_tokens, ids of ``encoded`` with decoded, the text that the ids stand for."""
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(_decode(tokenizer), "doc_id long, n_tokens long, ids binary, decoded string")
