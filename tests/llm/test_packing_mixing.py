"""Packing by exact round trip, mixing against the definition, pipeline stages."""

import collections
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from clientele.llm.cutting_stock import plan, relaxed
from clientele.llm.mixing import mix, mixed_documents
from clientele.llm.packing import pack, sequences
from clientele.llm.queries import tokenizer
from clientele.llm.tokens import Encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, salt int, target int, copies int, class int"
LONG = " ".join(f"word{i % 89}, Straße-{i % 7}" for i in range(9000))
TEXTS = [
    "a b c", None, "", " \n", LONG, LONG, "it's don't I'LL", "«été» ÉTÉ ÿ × 3.14 x2", "<|endoftext|> a <|ENDOFTEXT|>",
    "한국 😀 x 　y", "\x01 a\x01b", "a-b_c/d|e<f>g", "é é", "ab" * 3000,
]


def docs_of(spark, rows):
    """(doc_id, text, source) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, None, s, 0, 0, 0, 0, 0, 0) for i, t, s in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def definition():
    return tokenizer()


def test_ids_equal_the_whole_tokenizer(definition):
    whole, own = Tokenizer.from_str(definition), Encoder(definition)
    for _ in range(2):
        for first, ids, bounds in own.rows(pa.array(TEXTS)):
            for k in range(len(bounds) - 1):
                text = TEXTS[first + k] or ""
                assert ids[bounds[k] : bounds[k + 1]].tolist() == whole.encode(text, add_special_tokens=False).ids


def test_encoding_many_texts_takes_little_memory(definition):
    rng = np.random.default_rng(4)
    texts = pa.array([" ".join(f"word{i} and" for i in rng.integers(0, 3000, 300)) for _ in range(1200)])
    one_by_one = [ids.tolist() for i in range(0, 1200, 100) for _, ids, _ in Encoder(definition).rows(texts.slice(i, 1))]
    tracemalloc.start()
    own = Encoder(definition)
    found = [ids[a:b] for _, ids, bounds in own.rows(texts) for a, b in zip(bounds[:-1], bounds[1:])]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert texts.nbytes > 3 << 20 and peak < 64 << 20
    assert len(found) == 1200 and [x.tolist() for x in found[::100]] == one_by_one


@pytest.mark.parametrize(("length", "grain"), [(4096, 8), (256, 8), (64, 1)])
def test_pieces_round_trip(spark, definition, length, grain):
    rows = [(i if i != 3 else None, t, "s") for i, t in enumerate(TEXTS)] + [(1, "again", "s"), (0, "a b c", "s")]
    found = pack(docs_of(spark, rows), definition, length, grain, with_ids=True)
    pieces = found.collect()
    whole = Tokenizer.from_str(definition)
    want = collections.Counter(
        (i, tuple([*whole.encode(t or "", add_special_tokens=False).ids, 2])) for i, t, _ in rows
    )
    got, parts = collections.Counter(), sorted(pieces, key=lambda r: (r["doc_id"] or -1, r["doc_tokens"], r["start"]))
    for r in parts:
        assert r["length"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    # Documents of one doc_id and size are told apart by their ids.
    for (i, ids), n in want.items():
        for start in range(0, len(ids), length):
            piece = ids[start : start + length]
            own = [r for r in pieces if (r["doc_id"], r["start"], tuple(r["ids"])) == (i, start, piece) and r["doc_tokens"] == len(ids)]
            assert len(own) >= n
            got[i, start, piece, len(ids)] = len(own)
    assert sum(got.values()) == len(pieces)
    by_sequence = collections.defaultdict(list)
    for r in pieces:
        by_sequence[r["sequence_id"]].append(r)
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
        assert sum(r["length"] for r in own) <= length
    made = {r["sequence_id"]: r["ids"] for r in sequences(found).collect()}
    assert made == {k: [x for r in own for x in r["ids"]] for k, own in by_sequence.items()}


def test_packing_no_rows(spark, definition):
    assert pack(docs_of(spark, []), definition).collect() == []


def test_a_linear_program_with_a_known_optimum():
    # Pairs of 6 and 4, and threes of 3 with a rest of 1, fill 10 without waste.
    patterns, times = relaxed(np.array([1, 3, 4, 6]), np.array([20.0, 60.0, 50.0, 50.0]), 10, gap=0)
    assert times.sum() == pytest.approx(70)
    assert (patterns @ np.array([1, 3, 4, 6]) <= 10).all()


@pytest.mark.parametrize("seed", range(4))
def test_plans_hold_every_item_once_with_little_waste(seed):
    rng = np.random.default_rng(seed)
    sizes = np.unique(rng.integers(1, 512, 200))
    counts = rng.integers(1, 400, len(sizes))
    found = plan(sizes, counts, 512)
    assert (sum(p * n for p, n in found) == counts).all()
    assert all(p @ sizes <= 512 for p, _ in found)
    # The linear program's value bounds every plan from below; rounding costs less than one sequence a class.
    least = relaxed(sizes, counts.astype(float), 512)[1].sum()
    assert least - 1e-6 <= sum(n for _, n in found) * (1 + 1e-3) and sum(n for _, n in found) <= least + len(sizes)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def mixture(spark, rows, **options):
    found = mix(docs_of(spark, rows), **options).collect()
    assert len(found) == len(rows)
    return found


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Share by weight, cap, share the excess again, until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        shares = sum(weight[s] for s in order if s not in capped)
        target = {s: most * sizes[s] if s in capped else rest * weight[s] / shares for s in order}
        over = {s for s in order if s not in capped and target[s] > most * sizes[s] * (1 + 1e-12)}
        if not over:
            return target
        capped |= over


def test_mixing_meets_the_targets(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(900):
        source = [None, "hot", "a", "Z", "é", "tiny"][min(int(rng.exponential(1.5)), 5)] if i % 3 else "hot"
        rows.append((i, "w " * int(rng.integers(0, 40)), source))
    found = {r["doc_id"]: r for r in mixture(spark, rows)}
    sizes = collections.Counter()
    for i, t, s in rows:
        sizes[s] += len(WORD.findall(t))
    target = brute_targets(sizes)
    taken = collections.Counter()
    for i, t, s in rows:
        r = found[i]
        assert r["size"] == len(WORD.findall(t)) and r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(target[s])
        assert r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 3
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 40 for s in sizes)
    again = {r["doc_id"]: r["taken"] for r in mixture(spark, list(reversed(rows)), salts=3)}
    assert again == {i: r["taken"] for i, r in found.items()}


def test_mixing_odd_rows(spark):
    rows = [(1, None, "s"), (None, "a b", "s"), (2, "x", None), (2, "x", None), (3, "", "none"), (4, LONG, "s")]
    found = mixture(spark, rows)
    assert {r["source_size"] for r in found} == {2 + len(WORD.findall(LONG)), 2, 0}
    assert {(r["target"], r["taken"]) for r in found if r["source_size"] == 0} == {(0.0, 0)}
    assert mix(docs_of(spark, [])).collect() == []
    docs = docs_of(spark, rows)
    repeated = mixed_documents(docs)
    assert repeated.schema == docs.schema
    assert repeated.count() == sum(r["copies"] for r in found)
    assert mixed_documents(docs_of(spark, [])).collect() == []


def test_the_pipeline_lists_its_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "mixing", "packing"]


def test_every_stage_works_on_what_the_one_before_kept(spark, tmp_path):
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(i, f"{base} {'x' * (i % 7 + 1)} d{i} e{i} f{i} g{i} h{i} k{i} l{i} m{i}", f"s{i % 3}") for i in range(30)]
    rows += [(100, rows[0][1], "s0"), (101, rows[1][1] + " zz", "s1"), (102, None, "s0"), (103, "", None), (104, LONG, "s2"), (None, "u v", "s1")]
    docs = docs_of(spark, rows)
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = collections.Counter(r["doc_id"] for r in docs.collect())
    assert 0 not in kept["exact_dedup"] and 100 in kept["exact_dedup"]
    assert 1 in kept["ngram_join"] and 101 not in kept["ngram_join"] and None in kept["ngram_join"]
    assert set(kept["mixing"]) <= set(kept["ngram_join"])
    pieces = corpus_pipeline.run(spark, folder).collect()
    whole = collections.Counter(r["doc_id"] for r in pieces if r["start"] == 0)
    assert whole == kept["mixing"]


def test_the_pipeline_of_no_documents(spark, tmp_path):
    folder = str(tmp_path)
    docs_of(spark, []).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []
