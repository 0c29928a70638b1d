"""The prefix trie against brute force and its SQL twin."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from conftest import DATA

from clientele.llm import sql
from clientele.llm.prefix_trie import bands, conversation_trie
from clientele.llm.queries import op11_prefix_trie
from clientele.llm.slots import Slots

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, digest string, depth int, parent string"
SHOWN = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)


def brute(rows, family=20, heads=4):
    turns = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            said = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns[c].append((turn is not None, turn or 0, said, role, text))
    for c in turns:
        turns[c] = [t[3:] for t in sorted(turns[c])]
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (abs(c) % family) * (1 if c >= 0 else -1)
        path = tuple(turns.get(base, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    out = []
    for path, own in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaf = lambda p: not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)
        saved = sum((len(members[p]) - 1) * (len(WORD.findall(p[-1][1])) if p else 0) for p in below)
        text = ",".join(map(str, sorted(ends[path])))
        out.append((min(own), len(path), min(members[path[:-1]]) if path else None, len(own), len(kids),
                    sum(map(leaf, below)), saved, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select(SHOWN).collect()), key=repr)


def test_messy_rows(spark):
    rows = [
        (0, 1, "user", "a b c"), (0, 0, None, "hello  there"), (0, None, "system", None), (0, 2, "user", "tail"),
        (20, 0, "user", "x"), (21, 0, "user", "x"), (21, 1, "user", "y z"), (22, 0, "user", "x"), (22, 0, "user", "x"),
        (-5, 0, "user", "x"), (-25, 0, "user", "x"), (None, 0, "user", "lost"), (3, 0, "user", "only"), (7, 0, "", ""),
        (45, 0, "user", "p"), (45, 1, "user", "q"), (45, 1, "user", "r"), (46, 0, "user", "p"), (47, 0, "user", "w " * 5000),
    ]
    assert found(conversation_trie(frame(spark, rows), 20, 4)) == brute(rows)
    assert found(conversation_trie(frame(spark, rows))) == brute(rows, 1, 1)


def test_random_tries_with_small_shards(spark):
    rng = random.Random(4)
    rows = [
        (c, t, "user" if t % 2 else "assistant", f"turn {rng.randrange(1 if t < 2 else 3)}")
        for c in range(150)
        for t in range(rng.randrange(1, 8))
    ]
    expected = brute(rows)
    for most in (1, 7, 1000):
        assert found(conversation_trie(frame(spark, rows), 20, 4, shard_nodes=most)) == expected


def test_a_long_shared_conversation_needs_few_rounds(spark):
    rows = [(c, t, "user", f"w{t}") for c in (1, 2) for t in range(3000)] + [(2, 3000, "user", "more")]
    trie = conversation_trie(frame(spark, rows))
    top = trie.filter("depth = 0").first()
    assert (top["n_convs"], top["n_leaves"], top["saved_tokens"]) == (2, 1, 3000)
    assert trie.count() == 3002


def test_a_hot_first_turn_is_split(spark):
    rows = [(c, t, "user", "same" if t == 0 else f"own {c}") for c in range(9000) for t in range(2)]
    trie = conversation_trie(frame(spark, rows))
    assert trie.filter("depth = 2 and parent_conv_id = 0 and n_convs = 1").count() == 9000
    first = trie.filter("depth = 1").first()
    assert (first["n_children"], first["n_leaves"], first["saved_tokens"]) == (9000, 9000, 8999)


def test_nothing(spark):
    assert conversation_trie(frame(spark, [])).count() == 0
    assert conversation_trie(frame(spark, [(None, 0, "user", "x")])).count() == 0


def test_bands_hold_every_depth_once():
    assert bands({0: 1, 1: 5, 2: 200, 3: 30, 4: 20}, 50) == [(3, 4, 1), (2, 2, 4), (0, 1, 1)]
    assert bands({}, 50) == []


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, size=(5000, 2)).astype(np.uint64)
    slots = Slots(keys)
    assert sorted(slots.find(keys).tolist()) == list(range(5000))
    assert (slots.find(keys + np.uint64(1)) == -1).all()
    assert Slots(keys[:0]).find(keys[:3]).tolist() == [-1, -1, -1]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equals_sql(spark, sf):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/{sf}/conversations.parquet'")
    result = connection.execute(sql.prefix_trie())
    names = [c[0] for c in result.description]
    expected = sorted((tuple(r[names.index(c)] for c in SHOWN) for r in result.fetchall()), key=repr)
    df = op11_prefix_trie(spark, f"{DATA}/{sf}")
    assert sorted(df.columns) == sorted(names)
    assert found(df) == expected
