"""The forest as data against the model, kept models, and results that expire."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

import clientele as cl
from clientele.functions import fixed_values as fv
from clientele.sources import star

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def scored(spark):
    """(frame, model, saved) of the small shop."""
    summary = cl.stage(cl.customer_summary(star.customers(spark, DATA), star.orders(spark, DATA)))
    frame = cl.stage(cl.rfm(summary, "1998-08-03", staged=True))
    return frame, cl.fit_churn(frame)


@pytest.fixture(scope="module")
def saved(spark, scored, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("models"))
    assert cl.save_churn(scored[1], spark, path, "1998-08-03", table_version=4) == 1
    return cl.SavedChurn(spark, path)


def test_nodes_score_every_row_as_the_model(scored, saved):
    frame, model = scored
    expected = cl.apply_churn(frame, model).customers.select("customer_id", "churn_risk_pct")
    got = cl.score_by_nodes(frame, saved.nodes())
    assert rows(got, "customer_id", "churn_risk_pct") == rows(expected)
    assert rows(saved.apply(frame).customers, "customer_id", "churn_risk_pct") == rows(expected)
    assert "Python" not in got._jdf.queryExecution().toString()


def test_nodes_weigh_features_as_the_model(scored, saved):
    theirs = dict(rows(cl.apply_churn(*scored).importances))
    mine = dict(rows(cl.node_importances(saved.nodes())))
    assert mine.keys() == theirs.keys()
    assert all(mine[f] == pytest.approx(theirs[f], abs=1e-12) for f in mine)


def test_node_table_is_a_forest(saved):
    nodes = {(r["tree"], r["node"]): r for r in saved.nodes().collect()}
    assert len({t for t, _ in nodes}) == fv.FOREST_TREES
    for (tree, _), r in nodes.items():
        if r["feature"] is None:
            assert r["left"] is r["right"] is r["threshold"] is r["gain"] is None
        else:
            left, right = nodes[tree, r["left"]], nodes[tree, r["right"]]
            assert left["stayed"] + right["stayed"] == r["stayed"] and left["churned"] + right["churned"] == r["churned"]


def test_one_leaf_and_no_trees(spark):
    schema = "tree int, node int, left int, right int, feature string, threshold double, gain double, rows bigint, stayed double, churned double"
    leaf = spark.createDataFrame([(0, 0, None, None, None, None, None, 4, 1.0, 3.0)], schema)
    frame = spark.createDataFrame([(1,)], "customer_id int")
    assert cl.score_by_nodes(frame, leaf).first()["churn_risk_pct"] == 75.0
    assert {r["importance"] for r in cl.node_importances(leaf).collect()} == {0.0}
    assert cl.score_by_nodes(frame, leaf.limit(0)).first()["churn_risk_pct"] == 0.0


def test_a_model_is_refused_for_anything_else(spark, scored, saved):
    frame, _ = scored
    saved.check(frame, "1998-08-03", 4, after_days=fv.CHURN_AFTER_DAYS)
    wrong = [
        (frame.drop("tenure_days"), {}, "tenure_days: missing"),
        (frame.withColumn("frequency", F.col("frequency").cast("string")), {}, "frequency: string"),
        (frame, {"snapshot": "1998-08-04"}, "snapshot"),
        (frame, {"table_version": 5}, "table version"),
        (frame, {"after_days": 91}, "after_days"),
    ]
    for df, given, said in wrong:
        with pytest.raises(cl.ModelMismatch, match=said):
            saved.apply(df, **given)


def test_a_model_of_other_features_is_refused(scored, saved, monkeypatch):
    monkeypatch.setitem(saved.manifest, "features", [*fv.CHURN_FEATURES[1:], fv.CHURN_FEATURES[0]])
    with pytest.raises(cl.ModelMismatch, match="features"):
        saved.apply(scored[0])


def test_a_model_of_no_rows(spark, scored, tmp_path):
    cl.save_churn(cl.fit_churn(scored[0].limit(0)), spark, str(tmp_path), "1998-08-03")
    empty = cl.SavedChurn(spark, str(tmp_path))
    assert empty.model() is None and empty.nodes().count() == 0
    assert {r["churn_risk_pct"] for r in empty.apply(scored[0]).customers.collect()} == {0.0}
    with pytest.raises(FileNotFoundError):
        cl.SavedChurn(spark, str(tmp_path), 2)


class Clock:
    now = 1_000.0

    def __call__(self):
        return self.now


def jobs_of(spark, call):
    """How many jobs ``call`` starts."""
    group = f"count-{id(call)}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        result = call()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return result, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_a_second_load_runs_no_job(spark, shop, tmp_path):
    clock = Clock()
    catalogue = cl.Catalogue(spark, str(tmp_path), clock=clock)
    first, many = jobs_of(spark, lambda: cl.load_dashboard(*shop, catalogue, "7"))
    clock.now += 599
    second, none = jobs_of(spark, lambda: cl.load_dashboard(*shop, cl.Catalogue(spark, str(tmp_path), clock=clock), "7"))
    assert many > 0 and none == 0
    plain = cl.load_dashboard(*shop)
    for a, b, c in zip(first, second, plain):
        assert rows(a) == rows(b) == rows(c)
    _, anew = jobs_of(spark, lambda: cl.load_dashboard(*shop, catalogue, "8"))
    clock.now += 1
    _, expired = jobs_of(spark, lambda: cl.load_dashboard(*shop, catalogue, "7"))
    assert anew > 0 and expired > 0


def test_expired_folders_are_removed(spark, tmp_path):
    clock = Clock()
    catalogue = cl.Catalogue(spark, str(tmp_path), keep=10, clock=clock)
    one = catalogue.get("a", "1", lambda: spark.range(3).toDF("n"))
    clock.now += 11
    two = catalogue.get("a", "1", lambda: spark.range(4).toDF("n"))
    assert (one.count(), two.count()) == (3, 4)
    assert catalogue.expire() == [] and len(catalogue.expire(grace=0)) == 1
    assert two.count() == 4
    assert sum(p.name.startswith("result-") for p in tmp_path.iterdir()) == 1
    clock.now += 11
    assert len(catalogue.expire(grace=0)) == 1 and catalogue.expire(grace=0) == []
    assert catalogue.get("a", "1", lambda: spark.range(5).toDF("n")).count() == 5


def test_two_builders_share_one_result(spark, tmp_path):
    mine, other = cl.Catalogue(spark, str(tmp_path)), cl.Catalogue(spark, str(tmp_path))

    def build():
        # While this one builds, another has committed.
        other.get("a", "1", lambda: spark.range(2).toDF("n"))
        return spark.range(9).toDF("n")

    assert mine.get("a", "1", build).count() == 2
    assert sum(p.name.startswith("result-") for p in tmp_path.iterdir()) == 1
    with pytest.raises(ValueError):
        mine.get("a/b", "1", build)
