"""Multiprobe search against brute force, and the order of probes."""

import itertools

import numpy as np
import pytest

from clientele.llm.multiprobe import Hasher, nearest, probe_order

SCHEMA = "vec_id long, embedding array<float>, label int, bucket long, vid int, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 0, 0, 0.0) for i, v in rows], SCHEMA).repartition(3)


def exact(rows, k, every):
    usable = {i: np.array(v, np.float32).astype(np.float64) for i, v in rows}
    out = {}
    for q in usable:
        if q % every == 0:
            found = sorted(((-float((usable[q] * v).sum()), i) for i, v in usable.items() if i != q))[:k]
            out[q] = [(i, -s) for s, i in found]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("places", [1, 2, 3, 4])
def test_probes_come_by_rising_cost_and_none_twice(places):
    fraction = np.random.default_rng(places).random(places)

    def cost(shift):
        return sum(f**2 if s < 0 else (1 - f) ** 2 if s > 0 else 0 for f, s in zip(fraction, shift))

    every = sorted(itertools.product((-1, 0, 1), repeat=places), key=cost)
    found = probe_order(fraction, 1000)
    assert len(set(found)) == len(found) == len(every)
    assert np.allclose([cost(s) for s in found], [cost(s) for s in every])
    assert probe_order(fraction, 2) == found[:2]


def test_the_lift_turns_products_into_distances():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 8)) * rng.random((50, 1))
    hasher = Hasher(8, float(np.linalg.norm(x, axis=1).max()), 2, 3, 1.0, 1)
    assert hasher.places(x, True).shape == (50, 2, 3)
    longest = np.argmax(np.linalg.norm(x, axis=1))
    assert np.allclose(hasher.places(x, True)[longest], hasher.places(x, False)[longest])


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 16)) * 0.35
    x *= rng.uniform(0.5, 1.5, (1500, 1))
    rows = [(i, v) for i, v in enumerate(x)]
    want = exact(rows, 10, 20)
    found = answers(nearest(frame(spark, rows), "vec_id % 20 = 0", k=10, block=300, query_block=20))
    assert found.keys() == want.keys()
    share = [len({i for i, _ in found[q]} & {i for i, _ in want[q]}) / 10 for q in want]
    assert np.mean(share) >= 0.9
    scores = {(q, i): s for q in want for i, s in want[q]}
    assert all(s == scores[q, i] for q in found for i, s in found[q] if (q, i) in scores)
    assert all(a[1] >= b[1] for q in found for a, b in zip(found[q], found[q][1:]))


def test_a_hot_vector_ties_by_id_and_few_candidates_are_all_found(spark):
    hot = [1.0, 0.0, 0.5]
    rows = [(i, hot) for i in range(1, 200)] + [(0, hot), (200, [0.9, 0.1, 0.5]), (220, [-1.0, -1.0, 0.0])]
    found = answers(nearest(frame(spark, rows), block=50))
    assert [i for i, _ in found[0]] == list(range(1, 21))
    assert [i for i, _ in found[40]] == list(range(20))[:20]
    assert [i for i, _ in found[200]] == list(range(20))
    few = [(i, np.random.default_rng(i).normal(size=5)) for i in range(15)]
    assert {q: [i for i, _ in a] for q, a in answers(nearest(frame(spark, few))).items()} == {
        q: [i for i, _ in a] for q, a in exact(few, 20, 20).items()
    }


def test_vectors_that_cannot_be_compared_take_no_part(spark):
    good = [(i, [1.0 + i, 2.0]) for i in range(4)]
    bad = [(20, None), (40, []), (60, [0.0, 0.0]), (80, [None, 1.0]), (100, [float("nan"), 1.0]), (120, [float("inf"), 1.0]), (None, [1.0, 1.0]), (140, [1.0, 2.0, 3.0])]
    found = answers(nearest(frame(spark, good + bad + good[:1])))
    assert {q: [i for i, _ in a] for q, a in found.items()} == {0: [3, 2, 1]}
    assert nearest(frame(spark, [])).collect() == []
    assert nearest(frame(spark, bad[:3])).collect() == []
    assert nearest(frame(spark, [(0, [1.0, 2.0])])).collect() == []
