"""Classifiers: held-out rule, learning on a small table, odd rows; token totals against a recount."""

import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from clientele.llm import quality, token_counts, toxicity
from clientele.llm.labelled import held_out, training_sample

DOCS = "doc_id long, text string, lang string, source string, score double, predicted int, label int, size int, id int"
LABELS = "doc_id long, quality int, toxic int, size int"
BAD = ["grumbleskunk", "wortzelpest", "skunkpestling"]


def corpus(n=400, seed=0):
    """Texts of made-up words; every fourth one has bad words, every fifth one is noise."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdeinorst"), rng.integers(2, 9))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        own = list(rng.choice(words, rng.integers(20, 120)))
        toxic, good = i % 4 == 0, i % 5 != 0
        if toxic:
            for at in rng.integers(0, len(own), 1 + len(own) // 20):
                own[at] = str(rng.choice(BAD))
        if not good:
            own = [w + rng.choice(["%%%", "&&&", "$$$"]) for w in own]
        rows.append((i, " ".join(own)))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, None, 0.0, 0, 0, 0, 0) for i, t in rows], DOCS).repartition(3)


def labels_of(spark, labels):
    return spark.createDataFrame([(*row, 0) for row in labels], LABELS)


ODD = [(1000, None), (1001, ""), (1002, " \n"), (None, "abc def"), (1003, "x " * 50_000), (1003, "x " * 50_000), (1004, "é ü ñ 漢字 😀")]


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_scores_learn_and_take_odd_rows(spark, module, label):
    rows, labels = corpus()
    docs, marks = docs_of(spark, rows + ODD), labels_of(spark, labels + [(1002, None, None), (3, 0, 0), (3, 1, 1)])
    model = module.fit(docs, marks)
    found = module.score(docs, model).collect()
    assert len(found) == len(rows) + len(ODD)
    wanted = {i: (t if label == "toxic" else q) for i, q, t in labels}
    apart = [r for r in found if r["held_out"] and r["doc_id"] in wanted]
    right = [(r["score"] >= 0.5) == wanted[r["doc_id"]] for r in apart]
    assert len(apart) > 40 and np.mean(right) > 0.85
    assert all(0 <= r["score"] <= 1 for r in found)
    assert all(r["predicted"] == (r["score"] >= module.THRESHOLD) for r in found)
    assert {r["held_out"] for r in found if r["doc_id"] is None} == {False}
    for r in found:
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    twins = [r["score"] for r in found if r["doc_id"] == 1003]
    assert len(twins) == 2 and twins[0] == twins[1]
    again = module.score(docs.repartition(7), module.fit(docs.repartition(5), marks)).collect()
    # Running sums over a slice of rows round in the last digit by the place of a row in it.
    ordered = [sorted((r["doc_id"] or -1, r["score"]) for r in rows_) for rows_ in (again, found)]
    assert np.allclose(ordered[0], ordered[1], rtol=1e-9)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_scores_without_rows_or_labels(spark, module):
    rows, labels = corpus(20)
    empty = labels_of(spark, [])
    scores = {r["score"] for r in module.score(docs_of(spark, rows), module.fit(docs_of(spark, rows), empty)).collect()}
    assert len(scores) == 1 and 0 <= scores.pop() <= 1
    assert module.score(docs_of(spark, []), module.fit(docs_of(spark, []), empty)).collect() == []


def test_unseen_misspellings_share_the_score_of_the_word():
    rows, labels = corpus(300)
    model = toxicity.train(pa.chunked_array([[t for _, t in rows]]), [t for _, _, t in labels])
    plain, misspelt = toxicity.log_odds(pa.array(["bansi grumbleskunk", "bansi grumbleskunkk"]), *model)
    clean = toxicity.log_odds(pa.array(["bansi toredi", "", None]), *model)
    assert misspelt > clean.max() and plain > clean.max() and clean[1] == clean[2]


def test_scores_of_slices_equal_scores_of_single_texts():
    scores = np.random.default_rng(1).normal(size=1 << 10).astype(np.float32)
    texts = ["a b", "", None, "Idiot!", "x", "ä ö", "  ", "word " * 5000, "q"]
    together = toxicity.log_odds(pa.array(texts), scores, 0.25)
    alone = [toxicity.log_odds(pa.array([t], pa.string()), scores, 0.25)[0] for t in texts]
    assert np.allclose(together, alone)


def test_the_training_sample_is_bounded_and_keeps_the_fold_out(spark):
    rows, labels = corpus(300)
    docs, marks = docs_of(spark, rows), labels_of(spark, labels)
    sample = training_sample(docs, marks, "toxic", (30, 10), (10**6, 10**6)).collect()
    texts, wanted = [r["text"] for r in sample], [r["label"] for r in sample]
    assert wanted.count(0) == 30 and wanted.count(1) == 10
    apart = {r["doc_id"] for r in docs.filter(held_out(docs["doc_id"])).collect()}
    by_text = {t: i for i, t in rows}
    assert not apart & {by_text[t] for t in texts}
    assert training_sample(docs, marks, "toxic", (30, 10), (1, 1)).count() == 2


def test_toxic_rows_go_and_the_rest_keeps_its_columns(spark):
    rows, labels = corpus()
    docs = docs_of(spark, rows + ODD)
    model = toxicity.fit(docs, labels_of(spark, labels))
    kept = toxicity.drop_toxic(docs, model)
    clean = [r["doc_id"] for r in toxicity.score(docs, model).collect() if not r["predicted"]]
    assert kept.schema == docs.schema
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(i or -1 for i in clean)


COUNTED = [(1, "a b", "en", "s"), (2, "a, b", "en", None), (3, None, None, "s"), (4, "", "en", "s"), (4, "", "en", "s")]
VERSIONS = ["words-1", "words-2"]


def counts(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return token_counts.counted(docs.withColumn("version", docs["lang"]), VERSIONS)


def totals(ledger):
    return sorted(map(str, map(tuple, ledger.totals().collect())))


def test_deltas_add_up_to_a_recount(spark, tmp_path):
    ledger = token_counts.Ledger(spark, str(tmp_path / "log"))
    assert totals(ledger) == []
    assert ledger.commit("a", token_counts.inserts(counts(spark, COUNTED)))
    assert not ledger.commit("a", token_counts.inserts(counts(spark, COUNTED)))
    after = [(1, "a b c d", "de", "s")]
    ledger.commit("b", token_counts.revisions(counts(spark, COUNTED[:1]), counts(spark, after)))
    ledger.compact("c")
    ledger.compact("c")
    ledger.commit("d", token_counts.deletes(counts(spark, COUNTED[1:2])))
    assert not ledger.commit("b", token_counts.inserts(counts(spark, COUNTED)))
    rest = token_counts.rollup(token_counts.inserts(counts(spark, after + COUNTED[2:])))
    assert totals(ledger) == sorted(map(str, map(tuple, rest.collect())))
    assert ledger.committed() == ["a", "b", "d"]


def test_a_commit_cut_short_does_not_count_and_can_be_sent_again(spark, tmp_path):
    ledger = token_counts.Ledger(spark, str(tmp_path / "log"))
    deltas = token_counts.inserts(counts(spark, COUNTED))
    ledger.commit("a", deltas)
    want = totals(ledger)
    (tmp_path / "log" / "batch=a" / "_SUCCESS").unlink()
    assert totals(ledger) == []
    assert ledger.commit("a", deltas) and totals(ledger) == want
    with pytest.raises(ValueError):
        ledger.commit("../a", deltas)


def test_token_counts_of_no_rows(spark, tmp_path):
    ledger = token_counts.Ledger(spark, str(tmp_path / "log"))
    ledger.commit("none", token_counts.inserts(counts(spark, COUNTED).limit(0)))
    assert totals(ledger) == []


def test_a_document_too_long_for_the_sample_is_passed_over(spark):
    rows = [(i, "x" * 100) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    taken = lambda rows, most: sorted(
        (r["h"], r["id"], r["label"])
        for r in training_sample(spark.createDataFrame(rows, "doc_id long, text string"), labels, "toxic", (20, 20), (most, most)).collect()
    )
    plain = taken(rows, 10_000)
    assert [sum(label == v for _, _, label in plain) for v in (0, 1)] == [20, 20]
    for place in (0, 7):
        long = {[i for _, i, label in plain if label == v][place] for v in (0, 1)}
        for size in (2_450, 9_500):
            found = taken([(i, "x" * size if i in long else t) for i, t in rows], 2_500)
            assert [sum(label == v for _, _, label in found) for v in (0, 1)] == [20, 20]
            assert not long & {i for _, i, _ in found}
    assert len(taken(rows, 50)) == 2


def test_toxicity_trains_on_the_bytes_it_had_before_the_driver_was_short_of_memory():
    assert toxicity.CLASS_BYTES == (20_000_000, 10_000_000)


def test_token_counts_tell_documents_by_id_and_text(spark, tmp_path):
    """The query on a table where ids and texts repeat: copies go, everything else counts."""
    from clientele.llm.queries import op6_token_counts

    docs = [(1, "x x"), (5, "x x"), (1, "other text here"), (None, "lonely text"), (None, None), (7, ""), (8, "low $$ one"), (8, "low two")]
    spark.createDataFrame([(i, t, "en", "s") for i, t in docs], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(8, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    found = {r["version"]: (r["documents"], r["tokens"]) for r in op6_token_counts(spark, str(tmp_path)).collect()}
    assert found["words-1"] == (6, 2 + 3 + 2 + 0 + 2 + 2)
    import duckdb

    from clientele.llm import sql

    connection = duckdb.connect()
    for name in ("documents", "labels"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    result = connection.execute(sql.token_counts())
    names = [c[0] for c in result.description]
    assert {r[names.index("version")]: (r[names.index("documents")], r[names.index("tokens")]) for r in result.fetchall()} == found


def test_scoring_many_texts_takes_little_memory():
    rng = np.random.default_rng(3)
    texts = pa.array([" ".join(f"w{i}" for i in rng.integers(0, 5000, 400)) for _ in range(1500)])
    scores = rng.normal(size=toxicity.BUCKETS).astype(np.float32)
    one_by_one = np.concatenate([toxicity.log_odds(texts.slice(i, 1), scores, 0.1) for i in range(0, 1500, 100)])
    tracemalloc.start()
    odds = toxicity.log_odds(texts, scores, 0.1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert texts.nbytes > 3 << 20 and peak < 16 << 20
    assert np.allclose(odds[::100], one_by_one, atol=1e-9)
