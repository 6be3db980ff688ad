"""The conversation trie against tries of plain Python dictionaries, on hard rows and on the driver's smallest tables."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest

from clipcurate.llm import prefix_trie
from clipcurate.llm.queries import op11_conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, depth int"


def hard_rows(seed=0):
    rng = np.random.default_rng(seed)
    openings = [("system", "Be kind."), ("user", "é" * 7), ("user", "")]
    rows = []
    for c in [*range(0, 60), *range(101, 140), *range(200, 230), 5000, 5001, -3, -100, -150, -199, 10**12 + 7]:
        n = int(rng.integers(1, 9))
        turns = [openings[rng.integers(0, 3)] if t < 2 else (("user", "assistant")[t % 2], f"t{rng.integers(0, 3)}") for t in range(n)]
        rows += [(c, t if rng.random() > 0.05 else None, *x) for t, x in enumerate(turns)]
    rows += [(5002, 0, None, None), (5003, 0, "", ""), (5004, 1, "user", None), (5004, 1, "user", None), (5004, 1, "a", "b"), (None, 0, "user", "x"), (None, None, None, None)]
    rows += [(6000 + c, t, "user", "the same") for c in range(1, 90) for t in range(3)]  # one conversation, many times, no base
    rows += [(7000, t, "user", "x" * (t % 5)) for t in range(700)] + [(7001, 0, "user", "long " * 20_000)]
    order = rng.permutation(len(rows))
    return [(*rows[i], "k", 1) for i in order]


def plain_trie(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    paths, members = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        paths[c] = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(paths[c]) + 1):
            members.setdefault(paths[c][:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    below = {p: [0, 0] for p in members}
    for p in sorted(members, key=len, reverse=True):
        below[p][0] += not children.get(p)
        below[p][1] += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        if p:
            below[p[:-1]][0] += below[p][0]
            below[p[:-1]][1] += below[p][1]
    ends = {p: hashlib.sha256(",".join(map(str, sorted(c for c in m if paths[c] == p))).encode()).hexdigest() for p, m in members.items()}
    return paths, sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), *below[p], ends[p]) for p, m in members.items())


def digest(r):
    return r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]


@pytest.fixture(scope="module")
def hard(spark, tmp_path_factory):
    path, rows = str(tmp_path_factory.mktemp("trie")), hard_rows()
    spark.createDataFrame(rows, SCHEMA).repartition(7).write.parquet(f"{path}/conversations.parquet")
    return path, rows


def test_trie_equals_plain_dictionaries(spark, hard):
    path, rows = hard
    _, want = plain_trie(rows)
    assert sorted(map(digest, op11_conversation_trie(spark, path).collect()), key=str) == sorted(want, key=str)


def test_rebuilt_turns_are_the_nodes_texts(spark, hard):
    path, rows = hard
    paths, _ = plain_trie(rows)
    got = {}
    for r in prefix_trie.rebuilt_turns(spark.read.parquet(f"{path}/conversations.parquet")).orderBy("conv_id", "depth").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert got == {c: list(p) for c, p in paths.items() if p}


def test_trie_of_the_tables(spark):
    rows = duckdb.sql("select conv_id, turn, role, text from '/root/testdata/sf0.01/conversations.parquet'").fetchall()
    _, want = plain_trie(rows)
    assert sorted(map(digest, op11_conversation_trie(spark, "/root/testdata/sf0.01").collect()), key=str) == sorted(want, key=str)


def test_no_conversations(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie.conversation_trie(spark.createDataFrame([(None, 1, "a", "b", "k", 1)], SCHEMA)).count() == 0


def test_families_that_interleave_are_refused(spark):
    rows = [(c, 0, "user", "x", "k", 1) for c in range(6)]
    with pytest.raises(Exception, match="ranges of ids"):
        prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA), base=lambda c: c % 2).count()
