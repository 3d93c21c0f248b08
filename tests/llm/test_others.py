"""Nearest neighbours, WARC audits, chats and the pipeline against plain Python."""

import gzip
import hashlib
import io
import random
import tempfile
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import compare
from wordloom.llm import _warcfile, ann, chat, packing, quality, queries, warc

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    compare(spark, queries.queries()[name], queries.oracle_sql()[name], FOLDER)


def test_ann_recall(spark):
    out = queries.op2_ann_forest(spark, FOLDER).collect()
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    vectors = {r.vec_id: np.array(r.embedding, float) for r in table}
    found, hits, wanted = {}, 0, 0
    for r in out:
        assert r.score == pytest.approx(float(vectors[r.query_id] @ vectors[r.vec_id]), abs=1e-12)
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert set(found) == {i for i in vectors if i % 20 == 0}
    for q, rows in found.items():
        assert sorted(k for k, _ in rows) == list(range(1, 21))
        best = sorted((i for i in vectors if i != q), key=lambda i: (-float(vectors[q] @ vectors[i]), i))[:20]
        hits += len({i for _, i in rows} & set(best))
        wanted += 20
    assert hits / wanted >= 0.9


def test_ann_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [1.0]), (20, [2.0, 0.0]), (20, [2.0, 0.0])]
    rows += [(100 + k, [1.0, 0.0]) for k in range(30)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("leaf", F.lit("clash"))
    got = {}
    for r in ann.search(table, table.where("vec_id % 20 = 0"), candidates=10**9).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got[0] == [(20, 2.0), (1, 1.0), *[(100 + k, 1.0) for k in range(18)]]
    assert [v for v, _ in got[20]] == [0, 1, *range(100, 118)] and 4 not in got
    assert ann.search(table.limit(0), table.limit(0)).count() == 0


def clustered(rng, n, lengths):
    centres = rng.normal(size=(60, 32))
    points = centres[rng.integers(0, 60, n)] + 0.2 * rng.normal(size=(n, 32))
    return points / np.linalg.norm(points, axis=1, keepdims=True) * lengths(n)[:, None]


@pytest.mark.parametrize("case", ["unit", "unequal", "foreign", "shapeless"])
def test_ann_of_every_kind(spark, case):
    """Recall and whole answers where the sample is a part of the table, for any lengths and queries not drawn from it."""
    rng = np.random.default_rng(5)
    lengths = (lambda n: rng.uniform(3.6, 7.1, n)) if case == "unequal" else np.ones
    points = rng.normal(size=(6000, 32)) if case == "shapeless" else clustered(rng, 6000, lengths)
    asked = rng.normal(size=(100, 32)) * 9 if case == "foreign" else points[::60]
    ids = [10**6 + k for k in range(100)] if case == "foreign" else list(range(0, 6000, 60))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(points)], "vec_id long, embedding array<double>")
    queries_ = spark.createDataFrame([(k, v.tolist()) for k, v in zip(ids, asked, strict=True)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(table, queries_, sample=2000).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    hits = 0
    for q, v in zip(ids, asked, strict=True):
        scores = points @ v
        if q < 6000:
            scores[q] = -np.inf
        assert sorted(k for k, _ in got[q]) == list(range(1, 21))
        hits += len({i for _, i in got[q]} & set(np.argsort(-scores)[:20].tolist()))
    assert hits / 2000 >= 0.95


@pytest.mark.parametrize("unequal", [False, True])
def test_ann_calibration(unequal):
    """Clustered vectors take few rows, whatever their lengths; vectors without structure never more than an exact search."""
    rng = np.random.default_rng(3)
    lengths = (lambda n: rng.uniform(3.6, 7.1, n)) if unequal else np.ones
    for points, most in ((clustered(rng, 6000, lengths), 0.2), (rng.normal(size=(6000, 32)), 1.0)):
        norm = float(np.linalg.norm(points, axis=1).max())
        forest = ann.Forest(ann._augment(points, norm), 10, 5)
        chosen = np.arange(0, 6000, 30)
        trees, rows = ann.calibrate(forest, points, points[chosen], chosen, norm, 20, 6000, 0.95)
        assert rows <= most * 6000
        own = forest.first(trees)
        leaves = own.leaves(ann._augment(points, norm))
        sizes = np.stack([np.bincount(x, minlength=32) for x in leaves])
        hits = 0
        for q in range(7, 6000, 100):
            taken = own.search(own.heights(ann._query_points(points[q : q + 1], norm))[0], sizes, rows)
            found = set(np.concatenate([np.flatnonzero(leaves[t] == x) for t, x in taken]).tolist())
            assert sum(sizes[t, x] for t, x in taken) <= max(rows + sizes.max(), 6000)
            scores = points @ points[q]
            scores[q] = -np.inf
            hits += len(found & set(np.argsort(-scores)[:20].tolist()))
        assert hits / (60 * 20) >= 0.9


def test_warc_audit(spark):
    rows = [(k, f"http://h{k % 3}/p{k}", "x" * (k % 50) + f"é{k}") for k in range(300)] + [(None, None, None), (7, "http://h1/p7", "x" * 7 + "é7"), (7, "http://h1/p7", "x" * 7 + "é7")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file_id", F.lit("clash"))
    index = warc.archive(pages, records_per_file=40).cache()
    assert index.count() == len(rows)
    by_file = {}
    for r in index.collect():
        by_file.setdefault(r.file_id, []).append((r.offset, r.length))
    for spans in by_file.values():  # records follow each other without gaps
        assert [a for a, _ in sorted(spans)] == np.cumsum([0, *[n for _, n in sorted(spans)]])[:-1].tolist()
    assert warc.audit(index, index).count() == 0
    plain = index.select("file_id", "offset", "length", "digest")
    keys = sorted((r.file_id, r.offset) for r in plain.collect())
    broken, gone = set(keys[::37]), set(keys[5::61])
    hit = F.struct("file_id", "offset").isin([F.struct(F.lit(a).cast("long"), F.lit(b).cast("long")) for a, b in broken])
    lost = F.struct("file_id", "offset").isin([F.struct(F.lit(a).cast("long"), F.lit(b).cast("long")) for a, b in gone])
    other = plain.where(~lost).withColumn("digest", F.when(hit, F.lit("bad")).otherwise(F.col("digest")))
    got = {(r.file_id, r.offset): r.status for r in warc.audit(plain, other).collect()}
    assert got == {**dict.fromkeys(broken, "altered"), **dict.fromkeys(gone, "missing")}
    back = {(r.file_id, r.offset): r.status for r in warc.audit(other, plain).collect()}
    assert {k for k, s in back.items() if s == "extra"} == gone
    empty = warc.archive(pages.limit(0))
    assert warc.audit(empty, empty).count() == 0


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc_files(spark, tmp_path, compression):
    """An index of stored bytes is that of the archive; damage to bytes is found where it is."""
    rows = [(k, f"http://h{k % 3}/p{k}", "x" * (k % 50) + f"é\r\n\r\nWARC/1.1 {k}") for k in range(200)] + [(None, None, None), (7, "u", "y" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("value", F.lit("clash"))
    warc.write_warc(pages, f"file://{tmp_path}/a", 40, compression)
    index = warc.archive(pages, 40).select("file_id", "offset", "length", "digest")
    kept = warc.read_index(spark, f"file://{tmp_path}/a")
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, index.collect())) and warc.audit(index, kept).count() == 0
    warc.write_warc(pages, f"file://{tmp_path}/b", 40, compression)
    path = next((tmp_path / "b" / "file_id=0").glob("part-*"))
    stored = path.read_bytes()
    content = bytearray(gzip.decompress(stored) if compression == "gzip" else stored)
    first, second = sorted(index.where("file_id = 0").collect(), key=lambda r: r.offset)[1:3]
    content[first.offset + first.length - 6] ^= 1
    content[second.offset : second.offset + 4] = b"????"  # no longer a record
    path.with_name(".part.crc").unlink(missing_ok=True)
    for crc in path.parent.glob(".*.crc"):
        crc.unlink()
    path.write_bytes(gzip.compress(bytes(content)) if compression == "gzip" else bytes(content))
    found = warc.audit(index, warc.read_index(spark, f"file://{tmp_path}/b")).collect()
    # a damaged head makes its payload's own "WARC/" look like the next record, within the bytes of the damaged one
    extra = [r for r in found if r.status == "extra"]
    assert {(r.file_id, r.offset): r.status for r in found if r not in extra} == {(0, first.offset): "altered", (0, second.offset): "altered"}
    assert all(r.file_id == 0 and second.offset < r.offset < second.offset + second.length for r in extra)
    warc.write_warc(pages.limit(0), f"file://{tmp_path}/c", 40, compression)


def test_warc_files_of_other_origin(spark, tmp_path):
    """Replicas in different folders are the same archive; only what differs is named."""
    one = lambda n: f"WARC/1.0\r\nContent-Length: {n}\r\n\r\n{'z' * n}\r\n\r\n".encode()
    for side in ("a", "b/c"):
        for k in range(4):
            path = tmp_path / side / f"crawl {k % 2}" / f"x{k}.warc"
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(b"".join(one(n + k) for n in (5, 70_000, 9)))
    a, b = (warc.read_index(spark, f"file://{tmp_path}/{side}") for side in ("a", "b/c"))
    assert a.count() == 12 and a.where("file_id < 0").count() == 0 and warc.audit(a, b).count() == 0
    (tmp_path / "b/c/crawl 1/x1.warc").write_bytes(one(6) + one(70_001) + one(11))
    found = warc.audit(a, warc.read_index(spark, f"file://{tmp_path}/b/c")).collect()
    assert [(r.status, r.length, r.other_length) for r in found] == [("altered", len(one(10)), len(one(11)))]


def test_chat_round_trip(spark):
    odd = ["</block><block user>", "&lt;", "<next>", "&", "", None, "a\nb", "中文 <chat>", "\\### Assistant: </turn> ok"]
    rows = [(1, k, r, t) for k, (r, t) in enumerate(zip(["user", "user", "assistant", "assistant", "assistant", None, "user", "a<b>&", "assistant"], odd, strict=True))]
    rows += [(2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (None, None, None, None), (3, 1, "assistant", None)]
    rows += [(4, k, "assistant" if k % 3 else "user", f"t{k} <{k}>") for k in range(900)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("t", F.lit("clash"))
    chats = chat.format_chats(turns)
    got = {r.conv_id: r for r in chat.read_back(chats, page=16).collect()}
    for conv in (1, 2, 3, 4, None):
        own = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert [(t.role, t.text) for t in got[conv].turns] == [(r, x) for _, r, x in own]
        assert got[conv].loss_text == "".join(x for _, r, x in own if r == "assistant")
    for r in chats.collect():
        assert all(0 <= s.start and s.start + s.length <= len(r.formatted) for s in r.loss_spans)
    assert {r.conv_id: r.n_blocks for r in chats.collect()}[1] == 6
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_pipeline(spark):
    """Each stage by its operator's own brute-force property, on what the stage before kept."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    kept = pipeline.keep_quality(spark, docs, FOLDER).cache()
    verdict = {r.doc_id for r in quality.quality_rules(docs).where("kept").collect()}
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == verdict
    single = pipeline.drop_near_duplicates(spark, kept, FOLDER).cache()
    from tests.llm.test_documents import linked

    texts = {r.doc_id: r.text for r in kept.collect()}
    expected = linked(list(texts), list(texts.values()), 5)
    assert single.columns == columns and {r.doc_id for r in single.collect()} == {i for i, c in expected.items() if i == c}
    safe = pipeline.replace_pii(spark, single, FOLDER).cache()
    assert safe.schema.simpleString() == single.schema.simpleString() and safe.count() == single.count()
    mixed = pipeline.mix_sources(spark, safe, FOLDER).cache()
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in safe.collect()}
    packed = pipeline.pack_windows(spark, mixed, FOLDER)
    tokens = packed.agg(F.sum("length")).first()[0]
    e = packing.encoder("word_bpe_49k.json")
    assert tokens == sum(len(e.tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed.collect())
    assert pipeline.run(spark, FOLDER).agg(F.sum("length")).first()[0] == tokens


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, columns with clashing names; and no rows at all."""
    pipeline = pytest.importorskip("corpus_pipeline")
    from tests.llm.test_documents import SCHEMA, corpus

    words = "the of and to in is that it for was on are as with he be at by this from river stone cloud paper".split()
    rng = np.random.default_rng(9)
    plain = [" ".join(words[i] for i in rng.integers(0, len(words), 60)) for _ in range(12)]
    texts = [*corpus(7)[:20], *plain, plain[0], None, "", " ".join(words[i] for i in rng.integers(0, len(words), 30_000))]
    rows = [(None if k % 9 == 8 else k, t, None if k % 4 == 3 else "en", None if k % 5 == 4 else "src1", None if t is None else len(t), None, "c", "0", "k", "r") for k, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, *rows[20:23]], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES:
        now = stage(spark, now, str(tmp_path)).cache()
        assert name == "packing" or (now.columns == docs.columns and now.schema.simpleString() == docs.schema.simpleString())
    assert now.count() > 0 and pipeline.run(spark, str(tmp_path)).agg(F.sum("length")).first()[0] == now.agg(F.sum("length")).first()[0]
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_long_and_repeated_rows(spark):
    """op2: long vectors and repeated ids; op7: a long text; op10: repeated and null ids."""
    from tests.llm.test_documents import frame
    from wordloom.llm import mixing

    rng = np.random.default_rng(1)
    rows = [(k % 30, rng.normal(size=5000).tolist()) for k in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(table, table.where("vec_id % 20 = 0")).collect()
    assert {r.query_id for r in got} == {0, 20} and len(got) == 40 and len({(r.query_id, r.vec_id) for r in got}) == 40
    long = "word " * 400_000
    mixed = mixing.mix(frame(spark, [long, long, "x"], [1, 1, None]), {"s0": 1.0}, budget=3.0).collect()
    assert all(r.text in (long, "x") for r in mixed) and sum(r.doc_id == 1 and r.wordloom_mix_copy_id == 0 for r in mixed) in (0, 1, 2)
    texts, ids = ["a b c", "a b c", "d e", None, long], [4, 4, None, None, 9]
    pieces = packing.pack(frame(spark, texts, ids), capacity=64).collect()
    assert sum(p.length for p in pieces) == 4 + 4 + 3 + 1 + 400_001 and {p.doc_id for p in pieces} == {4, None, 9}
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for spans in by.values():
        assert [a for a, _ in sorted(spans)] == np.cumsum([0, *[n for _, n in sorted(spans)]])[:-1].tolist()


def _entries_of(content: bytes):
    """(offset, length, digest) of records and of what lies between, from all bytes at once."""
    at = 0
    while at < len(content):
        end = -1
        head = content.find(b"\r\n\r\n", at) if content.startswith(b"WARC/", at) else -1
        if head >= 0:
            fields = [line.split(b":", 1) for line in content[at:head].split(b"\r\n")[1:] if b":" in line]
            size = {k.strip().lower(): v.strip() for k, v in fields}.get(b"content-length", b"")
            if size.isdigit() and content.startswith(b"\r\n\r\n", head + 4 + int(size)):
                end = head + 8 + int(size)
        if end < 0:
            found = content.find(b"\r\n\r\nWARC/", at + 1)
            end = found + 4 if found >= 0 else len(content)
        yield at, end - at, hashlib.sha256(content[at:end]).hexdigest()
        at = end


def _warc(size, claim=None):
    body = bytes(97 + k % 23 for k in range(size))
    return b"WARC/1.1\r\nWARC-Type: resource\r\ncontent-length : %d\r\n\r\n" % (size if claim is None else claim) + body + b"\r\n\r\n"


@pytest.mark.parametrize("packed", ["plain", "gzip", "members"])
def test_warc_streams(monkeypatch, packed):
    """Pieces of a few bytes give what all bytes at once give, whatever is damaged and whatever heads claim."""
    monkeypatch.setattr(_warcfile, "PIECE", 16)
    monkeypatch.setattr(_warcfile, "HELD", 120)
    rng = random.Random(3)
    parts = [_warc(0), _warc(5), _warc(90), _warc(700), _warc(60, 10**12), _warc(60, 10**40), _warc(300, 900), _warc(300, 20), b"WARC/1.0\r\n\r\n", b"WARC/", b"\r\n\r\n", b"stray", b"\r\n\r\nWAR", b"WARC/1.1\r\nContent-Length: x\r\n\r\n"]
    for _ in range(300):
        chosen = [rng.choice(parts) for _ in range(rng.randrange(9))]
        if packed == "members":
            stored = b"".join(gzip.compress(p) + rng.choice([b"", b"\0" * 40]) for p in chosen)
        else:
            stored = gzip.compress(b"".join(chosen)) if packed == "gzip" else b"".join(chosen)
        assert list(_warcfile.entries(io.BytesIO(stored))) == list(_entries_of(b"".join(chosen)))


def test_warc_streams_that_break_off():
    """A cut or spoiled gzip stream gives its records up to there; what is held stays small beside the file."""
    one, long = _warc(50), _warc(30 << 20)
    stored = gzip.compress(one) + gzip.compress(one + one)
    assert list(_warcfile.entries(io.BytesIO(stored[:-12])))[:2] == list(_entries_of(one * 2))
    spoiled = gzip.compress(one) + b"\x1f\x8b\x08" + b"?" * 500
    assert list(_warcfile.entries(io.BytesIO(spoiled))) == list(_entries_of(one))
    assert list(_warcfile.entries(io.BytesIO(b""))) == []
    with tempfile.TemporaryFile() as file:  # outside Python's own memory, as stored files are
        file.write(gzip.compress(long + long[:-1] + b"?" + one, 1))
        file.seek(0)
        tracemalloc.start()
        found = list(_warcfile.entries(file))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert [n for _, n, _ in found] == [len(long), len(long) + len(one)] and peak < 16 << 20
    assert found[0][2] == hashlib.sha256(long).hexdigest()


def test_warc_lengths_that_are_no_numbers(spark, tmp_path):
    """Extra files, empty ones and heads without a length do not stop a reading of the others."""
    nameless = b"WARC/1.1\r\nContent-Length: \xc2\xb2\r\n\r\n"
    for name, content in {"a.warc": _warc(3) + b"??", "b.warc": b"", "c.warc": nameless, "d é %20.warc": gzip.compress(_warc(4))}.items():
        (tmp_path / name).write_bytes(content)
    rows = warc.read_index(spark, f"file://{tmp_path}").collect()
    assert sorted(r.length for r in rows) == sorted([len(_warc(3)), 2, len(nameless), len(_warc(4))])
