"""Suffix sorting against sorted(), substring dedup against brute force."""

import collections
import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import DATA

from clientele.llm import suffix_dedup
from clientele.llm.queries import op12_suffix_dedup
from clientele.llm.suffix_dedup import repeated_spans
from clientele.llm.suffix_sort import repeated, sort_suffixes

SCHEMA = "doc_id long, text string, lang string, seg string, sha int, first int, n_bytes int"


def frame(spark, pairs):
    return spark.createDataFrame([(i, t, None, "x", 0, 1, 2) for i, t in pairs], SCHEMA).repartition(3)


def brute(pairs, length):
    texts = [(i, (t or "").encode()) for i, t in pairs]
    seen = collections.Counter(t[j : j + length] for _, t in texts for j in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, np.int64)
        for j in range(len(t) - length + 1):
            if seen[t[j : j + length]] > 1:
                gone[j] += 1
                gone[j + length] -= 1
        gone = np.cumsum(gone)[: len(t)] > 0
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0]))))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((-1 if i is None else i, len(t), edges.reshape(-1, 2).tolist(), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(df):
    return sorted(
        (-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], [[s["start"], s["stop"]] for s in r["spans"]], r["kept_sha256"])
        for r in df.collect()
    )


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgé", k=rng.randrange(2, 9))) for _ in range(n))


@pytest.mark.parametrize("shallow", [0, 8, 32, 200])
@pytest.mark.parametrize("text", ["random", "banana", "runs", "copies"])
def test_suffixes_are_sorted(text, shallow):
    rng = random.Random(3)
    raw = {
        "random": bytes(rng.choices(b"ab", k=3000)),
        "banana": b"banana" * 400,
        "runs": b"\0" * 900 + b"\xff" * 900 + b"\0" * 500,
        "copies": (bytes(rng.choices(range(256), k=300)) * 9),
    }[text]
    length = 60
    starts = np.array(rng.sample(range(len(raw) - length + 1), 1500))
    order, same = sort_suffixes(np.frombuffer(raw, np.uint8), starts, length, shallow)
    mine = [raw[s : s + length] for s in starts[order].tolist()]
    assert mine == sorted(mine) and sorted(order.tolist()) == list(range(1500))
    assert same.tolist() == [i > 0 and mine[i] == mine[i - 1] for i in range(1500)]
    counts = collections.Counter(mine)
    assert repeated(np.frombuffer(raw, np.uint8), starts, length, shallow).tolist() == [
        counts[raw[s : s + length]] > 1 for s in starts.tolist()
    ]


def test_lengths_that_are_no_whole_words():
    raw = b"abcdefghijk" * 20
    for length in (1, 3, 11, 13):
        starts = np.arange(len(raw) - length + 1)
        order, _ = sort_suffixes(np.frombuffer(raw, np.uint8), starts, length)
        mine = [raw[s : s + length] for s in starts[order].tolist()]
        assert mine == sorted(mine)


def cases():
    rng = random.Random(5)
    shared, other = words(rng, 120), words(rng, 90)
    pairs = [(i, words(rng, rng.randrange(0, 60)) + shared[i : i + 450] + words(rng, 40)) for i in range(30)]
    pairs += [(100 + i, other + words(rng, 10) + other[:400]) for i in range(3)]
    pairs += [(200, other), (200, other), (200, words(rng, 90)), (None, shared), (None, None), (201, None), (202, "")]
    pairs += [(203, "a" * 399), (204, "a" * 400), (205, "a" * 400), (206, "b" * 5000), (207, "ab" * 900), (208, "é" * 300)]
    pairs += [(209, words(rng, 200)), (209, words(rng, 3) + shared), (210, shared[:401]), (211, shared[:400] + "?")]
    return pairs


def test_messy_texts(spark):
    pairs = cases()
    assert found(repeated_spans(frame(spark, pairs))) == brute(pairs, 400)


def test_a_key_too_large_for_a_shard(spark):
    pairs = cases()
    assert found(repeated_spans(frame(spark, pairs), shard_bytes=2_000)) == brute(pairs, 400)


def test_small_strings_and_many_shards(spark):
    rng = random.Random(6)
    pairs = [(i, "".join(rng.choices("ab", k=rng.randrange(0, 300)))) for i in range(60)]
    assert found(repeated_spans(frame(spark, pairs), length=16, seed=4, shard_bytes=3_000)) == brute(pairs, 16)


def test_long_texts_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 1_000)
    rng = random.Random(7)
    long = words(rng, 2_000)
    data, offsets = np.frombuffer(long.encode(), np.uint8), np.array([0, len(long.encode())])
    pieces = list(suffix_dedup._blocks(data, offsets, 400))
    assert len(pieces) > 5
    firsts = [s + f + j for p, b, _, s in pieces for f, n in zip(*suffix_dedup.runs(p, b, 400, 64)[:2]) for j in range(n)]
    assert sorted(firsts) == list(range(len(data) - 399))
    pairs = [(1, long), (2, words(rng, 5) + long[5_000:7_000] + words(rng, 5)), (3, long[100:4_000])]
    assert found(repeated_spans(frame(spark, pairs))) == brute(pairs, 400)


def test_no_documents(spark):
    assert repeated_spans(frame(spark, [])).count() == 0


def test_whole_table(spark):
    rows = pq.read_table(f"{DATA}/sf0.001/documents.parquet").to_pylist()
    expected = brute([(r["doc_id"], r["text"]) for r in rows], 400)
    got = op12_suffix_dedup(spark, f"{DATA}/sf0.001").collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == [
        (i, n, sum(b - a for a, b in spans), len(spans), kept) for i, n, spans, kept in expected
    ]
    assert sum(r["n_removed"] > 0 for r in got) > 5
