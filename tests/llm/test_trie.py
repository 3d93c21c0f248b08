"""Prefix tries against plain Python."""

import hashlib
import random
import zlib

import pytest

from wordloom.llm import _running, queries, trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth string, path string, k1 string"


def plain(rows, branch):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = dict(own)
    if branch:
        for c in own:
            h = zlib.crc32(str(c).encode()) % 9
            built[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    members, ends, kids = {}, {}, {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
            if d:
                kids.setdefault(tuple(ts[: d - 1]), set()).add(tuple(ts[:d]))
        ends.setdefault(tuple(ts), []).append(c)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = kids.get(node, ())
        leaves[node] = sum(leaves[k] for k in below) if below else 1
        saved[node] = sum(saved[k] for k in below) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
    digest = lambda cs: hashlib.sha256(",".join(map(str, sorted(cs))).encode()).hexdigest()
    return sorted(
        (min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(kids.get(node, ())), leaves[node], saved[node], digest(ends.get(node, [])))
        for node, cs in members.items()
    )


def conversations(seed=0):
    rng = random.Random(seed)
    rows = []
    for c in range(60):
        for turn in range(rng.randint(1, 12)):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["a", "é", "中", None, "", "a:b"])))
    for c in range(60, 90):  # copies, and one common first turn
        rows += [(c, t, "user", "common" if t == 0 else f"x{t % 2}") for t in range(c % 4 + 1)]
    rows += [(101, None, None, None), (101, None, None, None), (102, 3, "u", "b"), (102, 3, "u", "a"), (None, 0, "u", "z"), (103, 0, "1:u", "a"), (104, 0, "1", ":ua")]
    rows += [(200, t, "user", "w" * (t % 7)) for t in range(900)] + [(201, t, "user", "w" * (t % 7)) for t in range(905)] + [(207, 0, "user", "x" * 200_000)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "n", "d", "p", "k") for r in rows], SCHEMA).repartition(5)


def key(rows):
    return sorted(tuple(r) for r in rows)


@pytest.mark.parametrize("branch", [False, True])
def test_trie(spark, branch):
    rows = conversations()
    docs = frame(spark, rows)
    out = trie.nodes_of(*trie.branched(docs)) if branch else trie.prefix_trie(docs)
    assert key(out.collect()) == plain(rows, branch)


def test_small_blocks_and_joins_by_key(spark, monkeypatch):
    monkeypatch.setattr(trie, "SENT_ROWS", 0)
    monkeypatch.setattr(trie, "BLOCK", 2)
    rows = conversations(1)[:400]
    assert key(trie.nodes_of(*trie.branched(frame(spark, rows))).collect()) == plain(rows, True)


def test_a_path_that_turns_at_every_node(spark):
    # a comb: each tooth is light, and teeth hang on teeth
    rows = [(c, t, "u", "s" if t < c else f"tooth{c}") for c in range(20) for t in range(c + 1)]
    rows += [(100 + 2 * c + k, t, "u", f"{t}{(c >> t) & 1}" if t < 4 else str(k)) for c in range(16) for k in (0, 1) for t in range(5)]
    assert key(trie.prefix_trie(frame(spark, rows)).collect()) == plain(rows, False)


def test_trie_of_little(spark):
    assert trie.prefix_trie(frame(spark, [])).collect() == []
    assert trie.nodes_of(*trie.branched(frame(spark, []))).collect() == []
    lone = [(c, 0, "u", "a") for c in (7,)]  # all its turns are replaced by those of a conversation that is not there
    assert key(trie.nodes_of(*trie.branched(frame(spark, lone))).collect()) == plain(lone, True)
    assert key(trie.prefix_trie(frame(spark, lone)).collect()) == plain(lone, False)


@pytest.mark.parametrize("xor", [False, True])
def test_running_totals_over_many_parts(spark, monkeypatch, xor):
    monkeypatch.setattr(_running, "tasks_for", lambda df: 7)
    rows = [(g, i, (i * 37 + g) % 101) for g, n in ((1, 500), (2, 1), (3, 3), (4, 900), (9, 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "g long, i long, v long").repartition(6)
    want, at = [], {}
    for g, i, v in sorted(rows):
        at[g] = at.get(g, 0) ^ v if xor else at.get(g, 0) + v
        want.append((g, i, v, at[g]))
    assert key(_running.running_totals(df, "g", [df.i], ["v"], "t", xor=xor).collect()) == want


def test_query_equals_plain(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert key(queries.op13_prefix_trie(spark, folder).collect()) == plain(rows, True)
