"""Exact, near and span duplicates against brute force."""

import collections
import hashlib
import random
import re
import tracemalloc
import types

import numpy as np
import pyarrow as pa
import pytest

from clientele.llm import golomb, jobs, ngram_join, span_dedup
from clientele.llm.components import components
from clientele.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from clientele.llm.ngram_join import band_keys, drop_near_duplicates, near_duplicates, parts, size_bands
from clientele.llm.signature_tree import links, needed
from clientele.llm.span_dedup import cuts_after, dedup_spans
from clientele.llm.textops import word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sha string, keep_id long, `set` int"


def frame(spark, pairs):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, None, None, 1, "x", -1, 0) for i, t in pairs], SCHEMA).repartition(3)


LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
MESSY = [
    (1, "a b c"), (2, "a b c"), (2, "a b c"), (3, None), (4, ""), (5, "A b c"), (None, "a b c"), (None, "only null"),
    (6, "a  b c"), (7, LONG), (8, LONG), (9, LONG + " end"), (10, " \t\n"), (11, "é ü"), (12, "é ü"), (13, "x"),
]


def shingle_sets(rows, size):
    out = []
    for i, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        whole = [tuple(w)] if w else []
        out.append((i, frozenset(tuple(w[j : j + size]) for j in range(len(w) - size + 1)) if len(w) >= size else frozenset(whole)))
    return out


def brute_components(rows, size, num, den):
    sets = shingle_sets(rows, size)
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(sets):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted((doc if doc is not None else -1, len(s), least.get(find(i), -1)) for i, (doc, s) in enumerate(sets))


def near_rows(df):
    null = lambda x: -1 if x is None else x
    return sorted((null(r["doc_id"]), r["n_shingles"], null(r["component_id"])) for r in df.collect())


def variants(seed, families=12, copies=8):
    """Families of texts that differ in a few words, with similarities around the thresholds."""
    rng = random.Random(seed)
    rows, doc = [], 0
    for f in range(families):
        base = [f"f{f}w{rng.randrange(400)}" for _ in range(rng.choice([3, 12, 30, 120, 400]))]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
            rows.append((doc, " ".join(own[rng.randrange(0, 2) :])))
            doc += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_golomb_codes_round_trip(n):
    values = np.unique(np.random.default_rng(n).integers(0, 1 << 30, n))
    k = golomb.divisor_bits(30, len(values))
    assert (golomb.decode(golomb.encode(values, k), len(values), k) == values).all()
    flags = values % 2 == 0
    assert (golomb.unpack(golomb.pack(flags), len(flags)) == flags).all()


@pytest.mark.parametrize("options", [{}, {"chunk_rows": 2, "owner_rows": 3, "slack_bits": 1}])
def test_exact_duplicates_of_messy_rows(spark, options):
    found = exact_duplicates(frame(spark, MESSY), **options).collect()
    groups = collections.defaultdict(list)
    for i, t in MESSY:
        groups[t or ""].append(i)
    assert len(found) == len(MESSY)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in found:
        ids = by_hash[r["text_sha256"]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
    assert sum(r["kept"] for r in found) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in found if r["kept"])


def test_dropping_exact_duplicates_keeps_rows_whole(spark):
    docs = frame(spark, MESSY)
    kept = drop_exact_duplicates(docs)
    assert kept.schema == docs.schema
    texts = [r["text"] or "" for r in kept.collect()]
    assert sorted(texts) == sorted({t or "" for _, t in MESSY})


def test_dropping_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "x", 1, 2, True), (2, "x", 3, 4, False), (2, "y", 5, 6, True)], "doc_id long, text string, a int, b int, stays boolean")
    for drop in (drop_exact_duplicates, drop_near_duplicates):
        assert drop(docs).schema == docs.schema
    assert sorted(map(tuple, drop_exact_duplicates(docs).collect())) == [(2, "x", 3, 4, False), (2, "y", 5, 6, True)]


def test_owners_of_wide_fingerprints():
    """Fingerprints of 46 bits and 2^18 owners, whose product passes 64 bits."""
    import pyarrow as pa

    from clientele.llm.exact_dedup import _answer, _sender

    shas = [hashlib.sha256(str(i % 900).encode()).digest() for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array(shas, pa.binary())], ["doc_id", "sha"])
    packets = [p for b in _packets(_sender(46, 18, 10_000), batch) for p in b.to_pylist()]
    assert all(0 <= p["owner"] < 1 << 18 for p in packets)
    owned = {}
    for p in packets:
        owned.setdefault(p["owner"], []).append(p)
    flagged = 0
    for own in owned.values():
        for answer, p in zip(_answer(pa.Table.from_pylist(own)).to_pylist(), own):
            flagged += int(golomb.unpack(answer["dup"], p["n"]).sum())
    assert flagged == 100


def _packets(run, batch):
    from unittest import mock

    from clientele.llm import exact_dedup

    with mock.patch.object(exact_dedup.TaskContext, "get") as get:
        get.return_value.partitionId.return_value = 0
        return list(run([batch]))


def test_exact_duplicates_of_a_hot_text(spark):
    rows = [(i, "hot" if i % 3 else f"t{i // 2}") for i in range(600)]
    found = {r["doc_id"]: r for r in exact_duplicates(frame(spark, rows), chunk_rows=50, owner_rows=20).collect()}
    assert found[1]["keep_id"] == 599 and found[1]["group_size"] == 400 and found[599]["kept"]
    assert sum(r["kept"] for r in found.values()) == len({t for _, t in rows})


@pytest.mark.parametrize("operator", [exact_duplicates, near_duplicates, dedup_spans, drop_exact_duplicates, drop_near_duplicates])
def test_empty_tables(spark, operator):
    assert operator(frame(spark, [])).collect() == []


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(5, 5)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert found == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)}
    # A hub's links dealt over many tasks.
    again = components(spark.createDataFrame(edges, "u long, v long"), links_a_task=3)
    assert dict(map(tuple, again.collect())) == found


def test_a_group_of_many_copies_is_dealt_over_tasks(spark):
    rows = MESSY + [(100 + i, "a copy that many rows hold") for i in range(50)] + [(120, "a copy that many rows hold"), (None, None)]
    alike = [sorted(map(repr, exact_duplicates(frame(spark, rows), copies_a_task=n).collect())) for n in (2, 10**6)]
    assert alike[0] == alike[1]
    assert sum("group_size=52" in r for r in alike[0]) == 0 and sum("group_size=51" in r for r in alike[0]) == 51


@pytest.mark.parametrize(("num", "den"), [(9, 10), (4, 5)])
def test_linked_sizes_lie_in_neighbouring_bands_and_differ_in_fewer_tokens_than_parts(num, den):
    starts = size_bands(num, den, 5000)
    cuts, spare = parts(starts, num, den)
    band = lambda n: int(np.searchsorted(starts, n, side="right")) - 1
    for a in range(1, 1500):
        for b in {a, -(-a * num // den), a * den // num}:
            if min(a, b) * den >= num * max(a, b):
                assert abs(band(a) - band(b)) <= 1
                at = max(band(a), band(b))
                differ = a + b - 2 * needed(a, b, num, den)
                assert differ == 0 or differ < cuts[at] - spare[at]


@pytest.mark.parametrize(("num", "den"), [(9, 10), (4, 5)])
def test_sets_that_differ_little_share_a_key(num, den):
    rng = np.random.default_rng(1)
    starts = size_bands(num, den, 1 << 20)
    cuts, spare = parts(starts, num, den)
    for n in (10, 13, 20, 40, 300):
        for _ in range(60):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            gone = max(0, (n - needed(n, n, num, den)))
            b = np.sort(np.concatenate((rng.permutation(a)[gone:], rng.integers(0, 1 << 63, gone, dtype=np.uint64))))
            band = np.searchsorted(starts, [len(a), len(b)], side="right") - 1
            layout = np.array([band.max()] * 2)
            keys, whose, _ = band_keys(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), layout, cuts, spare)
            assert set(keys[whose == 0]) & set(keys[whose == 1]) or set(a) == set(b)


@pytest.mark.parametrize("across", [False, True])
def test_tree_join_connects_what_pairs_connect(across):
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 1 << 63, rng.integers(20, 200), dtype=np.uint64)
        for _ in range(12):
            own = base.copy()
            own[rng.integers(0, len(own), rng.integers(0, 1 + len(own) // 12))] = rng.integers(0, 1 << 63, dtype=np.uint64)
            sets.append(np.unique(own))
    order = rng.permutation(len(sets))
    sets = [sets[i] for i in order]
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    side = rng.integers(0, 2, len(sets)) if across else None
    found = links(np.concatenate(sets), bounds, np.arange(len(sets)), side, 9, 10)

    def classes(pairs):
        label = list(range(len(sets)))
        for a, b in pairs:
            old, new = label[a], label[b]
            label = [new if x == old else x for x in label]
        seen = {}
        return [seen.setdefault(x, i) for i, x in enumerate(label)]

    every = [
        (i, j)
        for i in range(len(sets))
        for j in range(i)
        if (side is None or side[i] != side[j])
        and 10 * len(np.intersect1d(sets[i], sets[j])) >= 9 * len(np.union1d(sets[i], sets[j]))
    ]
    assert classes(found) == classes(every) and set(map(frozenset, found)) <= set(map(frozenset, every))


def test_one_large_set_among_small_ones_takes_little_memory():
    rng = np.random.default_rng(5)
    large = np.sort(rng.integers(0, 1 << 63, 4000, dtype=np.uint64))
    sets = [large, large[8:], *np.sort(rng.integers(0, 1 << 63, (10_000, 8), dtype=np.uint64), axis=1)]
    sets.append(sets[-1])
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    tokens = np.concatenate(sets)
    tracemalloc.start()
    found = links(tokens, bounds, np.arange(len(sets)), None, 9, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {frozenset(x) for x in found} == {frozenset((0, 1)), frozenset((10_001, 10_002))}
    assert peak < 80 << 20


def test_the_first_pass_takes_little_memory_and_sends_small_batches():
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 5000, 400)) for _ in range(1500)]
    texts += texts[:100]

    def rows_of(first, last):
        own = texts[first:last]
        return pa.RecordBatch.from_arrays(
            [pa.array(range(first, last), pa.int64()), pa.array([False] * len(own)), pa.array(own)], ["name", "nameless", "text"]
        )

    run = ngram_join._first_pass(5, 4, 5, ngram_join.CHUNK_TOKENS)
    alone = {tuple(r.values()) for i in range(0, 1600, 40) for b in run([rows_of(i, i + 1)]) for r in b.to_pylist()}
    whole = rows_of(0, 1600)
    tracemalloc.start()
    sent, largest = [], 0
    for b in run([whole]):
        sent.append(b)
        largest = max(largest, b.num_rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert whole.nbytes > 3 << 20 and peak < 40 << 20 and largest <= ngram_join.SEND_ROWS
    rows = [tuple(r.values()) for b in sent for r in b.to_pylist()]
    assert alone <= {(ngram_join.KEY, *r[1:]) if r[0] == ngram_join.MIDDLE else r for r in rows}
    # Of equal sets in a chunk one sends keys; a key that several sets hold leaves with its least and greatest.
    keys = collections.defaultdict(list)
    for kind, key, name, _ in rows:
        if kind in (ngram_join.KEY, ngram_join.MIDDLE):
            keys[key].append((kind, name))
    for held in keys.values():
        names = sorted(name for _, name in held)
        assert len(set(names)) == len(names)
        assert sorted(name for kind, name in held if kind == ngram_join.KEY) == sorted({names[0], names[-1]})


def test_near_duplicates_of_messy_rows(spark):
    assert near_rows(near_duplicates(frame(spark, MESSY))) == brute_components(MESSY, 3, 9, 10)


def test_rows_without_an_id_carry_links(spark):
    """Two documents that are linked only through rows without a doc_id."""
    words = [f"w{i}" for i in range(60)]
    between = " ".join(words)
    rows = [(1, " ".join(words[3:])), (None, between), (3, " ".join(words[:-3])), (None, between + " x"), (4, "apart from them")]
    expected = brute_components(rows, 3, 9, 10)
    assert near_rows(near_duplicates(frame(spark, rows))) == expected
    assert (3, 55, 1) in expected


def test_near_copies_are_told_by_id_and_text(spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(1, long), (2, long + " end"), (2, "a clean text that shares its id"), (None, long + " last"), (None, "only"), (3, None)]
    kept = drop_near_duplicates(frame(spark, rows), shingle=5, num=4, den=5)
    assert sorted(((r["doc_id"] or 0, r["text"]) for r in kept.collect()), key=repr) == sorted(
        [(1, long), (2, "a clean text that shares its id"), (0, "only"), (3, None)], key=repr
    )


@pytest.mark.parametrize(
    ("shingle", "num", "den", "options"),
    [(3, 9, 10, {}), (5, 4, 5, {"copies_a_task": 2}), (3, 9, 10, {"chunk_tokens": 500, "block_tokens": 300}), (5, 4, 5, {"block_tokens": 200})],
)
def test_near_duplicates_equal_brute_force(spark, shingle, num, den, options):
    rows = variants(shingle)
    found = near_duplicates(frame(spark, rows), shingle, num, den, **options)
    assert near_rows(found) == brute_components(rows, shingle, num, den)


def test_one_row_of_each_near_group_stays(spark):
    rows = variants(9)
    docs = frame(spark, rows)
    kept = drop_near_duplicates(docs, shingle=5, num=4, den=5)
    assert kept.schema == docs.schema
    want = {c for _, _, c in brute_components(rows, 5, 4, 5)}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)


def sentence_texts(text):
    """The text's sentences by a plain loop over its words."""
    out, at = [], 0
    found = list(WORD.finditer(text))
    for i, m in enumerate(found):
        gap = text[m.end() : found[i + 1].start()] if i + 1 < len(found) else "\n"
        if m[0][-1] in ".!?,;:" or cuts(m[0]) or "\n" in gap or "\r" in gap:
            out.append([w[0] for w in found[at : i + 1]])
            at = i + 1
    return out


def cuts(word):
    raw = np.frombuffer(word.encode(), np.uint8)
    return bool(cuts_after(word_hashes(raw, np.array([0]), np.array([len(raw)])))[0])


def brute_spans(rows, least, words):
    places = collections.defaultdict(set)
    for doc, text in rows:
        parts_ = sentence_texts(text or "")
        for i in range(len(parts_)):
            total, j = 0, i
            while j < len(parts_) and (j - i < least or total < words):
                total, j = total + len(parts_[j]), j + 1
            if j - i >= least and total >= words:
                places[tuple(map(tuple, parts_[i:j]))].add((doc, i, j))
            total, j = 0, i + 1
            while j > 0 and (i + 1 - j < least or total < words):
                total, j = total + len(parts_[j - 1]), j - 1
            if i + 1 - j >= least and total >= words:
                places[tuple(map(tuple, parts_[j : i + 1]))].add((doc, j, i + 1))
    gone = collections.defaultdict(set)
    for found in places.values():
        for doc, i, j in sorted(found)[1:]:
            gone[doc] |= set(range(i, j))
    out = {}
    for doc, text in rows:
        kept = [w for k, s in enumerate(sentence_texts(text or "")) if k not in gone[doc] for w in s]
        out[doc] = (len(gone[doc]), kept)
    return out


def test_spans_equal_brute_force(spark):
    rng = random.Random(4)
    passages = [
        " ".join(f"p{p}w{rng.randrange(99)}" + rng.choice(["", "", ".", ",", ".\n"]) for _ in range(70)) + "." for p in range(5)
    ]
    rows = []
    for doc in range(40):
        own = [" ".join(f"d{doc}w{rng.randrange(999)}" + rng.choice(["", "", "."]) for _ in range(40)) + "." for _ in range(3)]
        for _ in range(rng.randrange(0, 3)):
            own.insert(rng.randrange(len(own) + 1), rng.choice(passages))
        rows.append((doc, " ".join(own)))
    found = {r["doc_id"]: r for r in dedup_spans(frame(spark, rows)).collect()}
    want = brute_spans(rows, 3, 30)
    assert sum(n > 0 for n, _ in want.values()) > 5
    for doc, text in rows:
        assert found[doc]["n_removed"] == want[doc][0]
        assert WORD.findall(found[doc]["text"]) == want[doc][1]
        assert found[doc]["changed"] or found[doc]["text"] == text


def test_spans_of_messy_rows(spark):
    found = dedup_spans(frame(spark, MESSY)).collect()
    assert len(found) == len(MESSY)
    assert {r["text"] for r in found if r["doc_id"] in (1, 3, 4, 10)} == {"a b c", None, "", " \t\n"}
    assert not any(r["changed"] for r in found if r["doc_id"] is None)


def test_passages_of_fifty_words_are_caught_wherever_sentences_end(spark):
    rng = random.Random(7)
    own = lambda n: [f"u{rng.getrandbits(60)}" for _ in range(n)]
    passages = [own(52 + i % 40) for i in range(120)]
    rows = [(i, " ".join(own(3) + p + own(5))) for i, p in enumerate(passages)]
    rows += [(200 + i, " ".join(own(20) + p) + "\t" + " ".join(own(9))) for i, p in enumerate(passages)]
    rows += [(500 + i, " ".join(own(20) + p[:25] + own(20))) for i, p in enumerate(passages)]
    found = {r["doc_id"]: r for r in dedup_spans(frame(spark, rows)).collect()}
    assert not any(found[doc]["changed"] for doc, _ in rows if doc < 200 or doc >= 500)
    caught = [found[200 + i]["changed"] for i in range(120)]
    assert sum(caught) >= 114
    for i, p in enumerate(passages):
        before, left = WORD.findall(rows[120 + i][1]), WORD.findall(found[200 + i]["text"])
        assert [w for w in before if w not in p] == [w for w in left if w not in p]


def test_spans_of_rows_that_share_a_doc_id(spark):
    rng = random.Random(8)
    own = lambda n: " ".join(f"u{rng.getrandbits(60)}" for _ in range(n))
    passage, clean = own(90), own(120)
    rows = [(1, passage), (2, f"{own(9)} {passage}"), (2, clean), (2, clean), (3, f"{passage} {own(4)}")]
    found = dedup_spans(frame(spark, rows)).collect()
    assert [r["text"] for r in found if not r["changed"]].count(clean) == 2
    assert sorted(r["doc_id"] for r in found if r["changed"]) == [2, 3]


def test_only_runs_that_may_repeat_leave_the_second_pass():
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdef", k=5)) for _ in range(200)) for _ in range(4)]
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, 4], "text_id": [5, 6, 7, 8], "text": texts})
    hashes = np.concatenate([b.column("run").to_numpy() for b in span_dedup._run_rows(3, 30)([batch])])
    bitmap = np.zeros(1 << (jobs.BITMAP_BITS - 6), np.uint64)
    bit = int(hashes[7]) & ((1 << jobs.BITMAP_BITS) - 1)
    bitmap[bit >> 6] = np.uint64(1) << np.uint64(bit & 63)
    left = list(span_dedup._run_rows(3, 30, types.SimpleNamespace(value=bitmap))([batch]))
    assert len(hashes) > 100 and sum(b.num_rows for b in left) < 5
    assert hashes[7] in [h for b in left for h in b.column("run").to_pylist()]
