"""Encoding and decoding against the tokenizers library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.test_documents import corpus, frame
from wordloom.llm import bpe, packing
from wordloom.llm._bytes import text_slices

ODD = ["a <|endoftext|> b", "<|startoftext|><|endoftext|>", "don't stop's.", "x<|ENDOFTEXT|>", "", "\u0000", "a b c", "ΟΔΟΣ ΣΑΣ", "ẹ́ q̣̇", "İstanbul", "ﬁ Å Ǆ", "😀😀 #️⃣", "ha" * 4000, "#" * 5000, "a" * 3001, "'s's'll", "</w> a</w>b"]
#: Capitals that have no composed form with a mark although the small letters have one.
COMBINED = ["J̌", "H̱", "T̈", "W̊", "Y̊", "XJ̌x", "J̣̌", "wJ̌, (H̱)."]


@pytest.fixture(scope="module", params=["word_bpe_49k.json", "byte_bpe_50k.json"])
def name(request):
    return request.param


def expected(tokenizer, text):
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_backtracking_equals_merging(name):
    e, d = bpe.encoder(name), bpe.decoder(name)
    rng = random.Random(1)
    alphabet = "abzABZ019  .,;:!?'’\"#$<|>éÉçß×÷İıŉſņ̃́̇̈̌ \t\n\x0b\x1c 　中文あ”“-_Σσς'sKJHTWY"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(rng.choice("aeinrst") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += [*ODD, *COMBINED, *[t or "" for t in corpus(4)]]
    got = [x for _, _, o, b in text_slices(pa.array(texts, pa.large_string()), 4000) for x in e.encode(o, b)]
    for text, ids in zip(texts, got, strict=True):
        assert ids == expected(e.tokenizer, text), text
        assert d.decode(ids) == e.tokenizer.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False), text


def test_pieces_of_words_with_capitals_and_marks():
    e = packing.ChunkEncoder("word_bpe_49k.json")
    for text in COMBINED:
        data = np.frombuffer(text.encode(), np.uint8)
        assert e.encode(np.array([0, len(data)]), data) == [expected(e.tokenizer, text)], text


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        e = bpe.encoder(name)
        assert e.whole([text]) == [expected(e.tokenizer, text)]


def test_blocks_do_not_show(monkeypatch):
    d = bpe.decoder("word_bpe_49k.json")
    ids = np.arange(1000, dtype="<u4").tobytes()
    whole = d.decode(ids)
    monkeypatch.setattr(bpe, "DECODE_BLOCK", 7)
    assert d.decode(ids) == whole and d.decode(b"") == ""


def test_a_token_with_two_merges_is_refused():
    vocab = {t: k for k, t in enumerate(["a", "b", "ab", "ba", "aba"])}
    merges = [["a", "b"], ["b", "a"], ["ab", "a"], ["a", "ba"]]
    with pytest.raises(ValueError, match="two merges"):
        bpe.PairMerges({"model": {"type": "BPE", "vocab": vocab, "merges": merges}})


def test_encode_and_decode_on_spark(spark, name):
    texts = [*corpus(6), *ODD, *COMBINED]
    ids = [None, 3, 3, *range(len(texts) - 3)]
    rows = bpe.decode(bpe.encode(frame(spark, texts, ids).repartition(3), name), name).collect()
    t = bpe.encoder(name).tokenizer
    want = []
    for i, text in zip(ids, texts, strict=True):
        tokens = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(tokens), np.array(tokens, "<u4").tobytes(), t.decode(tokens, skip_special_tokens=False)))
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    assert sorted([(r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in rows], key=key) == sorted(want, key=key)
    assert bpe.decode(bpe.encode(frame(spark, []), name), name).count() == 0


def test_query_equals_the_library(spark):
    from wordloom.llm.queries import op11_bpe_backtrack

    folder = "/root/testdata/sf0.001"
    t = bpe.encoder("word_bpe_49k.json").tokenizer
    want = []
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(tuple(r) for r in op11_bpe_backtrack(spark, folder).collect()) == sorted(want)
