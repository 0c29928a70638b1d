import pytest
from conftest import DATA, rows
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

import __spark_entry__ as driver
import clientele as cl
from clientele.functions import fixed_values as fv

FRAME = (
    "customer_id int, recency_days int, frequency bigint, monetary double, avg_order_value double, "
    "returned_orders bigint, tenure_days int, is_churned_target int"
)


def one_class(spark, label):
    data = [(i, i, i % 4, i * 2.0, 2.0, i % 3, 30 + i, label) for i in range(40)]
    return cl.score_churn(spark.createDataFrame(data, FRAME))


@pytest.mark.parametrize(("label", "pct", "tier"), [(0, 0.0, "Low Risk"), (1, 100.0, "High Churn Risk")])
def test_one_class_only(spark, label, pct, tier):
    got = one_class(spark, label)
    assert set(rows(got.customers, "churn_risk_pct", "churn_risk_level")) == {(pct, tier)}
    assert {r["importance"] for r in got.importances.collect()} == {0.0}


def test_no_customers(spark):
    got = cl.score_churn(spark.createDataFrame([], FRAME))
    assert got.customers.collect() == []
    assert got.customers.columns[-2:] == ["churn_risk_pct", "churn_risk_level"]
    assert got.importances.count() == 6


@pytest.fixture(scope="module")
def frame(spark):
    return cl.stage(cl.rfm(driver._summary(spark, f"{DATA}/sf0.01")))


@pytest.fixture(scope="module")
def churn(frame):
    return cl.score_churn(frame)


def test_percentages_follow_the_label(churn):
    scored = churn.customers
    low, high, n = scored.agg(F.min("churn_risk_pct"), F.max("churn_risk_pct"), F.count("*")).first()
    assert n == 1500
    assert 0 <= low < 35 and 70 <= high <= 100
    labelled = scored.select("churn_risk_pct", F.col("is_churned_target").cast("double").alias("label"))
    auc = BinaryClassificationEvaluator(rawPredictionCol="churn_risk_pct").evaluate(labelled)
    assert auc >= 0.95


def test_tiers_match_the_percentages(churn):
    pct = F.col("churn_risk_pct")
    tier = F.when(pct < 35, fv.LOW_RISK).when(pct < 70, fv.MODERATE_RISK).otherwise(fv.HIGH_RISK)
    assert churn.customers.where(tier != F.col("churn_risk_level")).count() == 0


def test_importances(churn):
    found = churn.importances.collect()
    assert [r["importance"] for r in found] == sorted(r["importance"] for r in found)
    assert sum(r["importance"] for r in found) == pytest.approx(1.0)
    assert found[-1]["feature"] == "recency_days"
    assert {r["feature"] for r in found} == set(fv.CHURN_FEATURES)


def test_refit_of_another_layout_is_identical(frame, churn):
    again = cl.score_churn(frame.repartition(3))
    assert rows(again.importances) == rows(churn.importances)
    assert rows(again.customers, "customer_id", "churn_risk_pct") == rows(
        churn.customers, "customer_id", "churn_risk_pct"
    )


def test_model_scores_other_frames_and_is_saved(churn, frame, tmp_path):
    path = str(tmp_path / "model")
    churn.model.write().save(path)
    again = type(churn.model).load(path).transform(frame)
    assert again.where("prediction = 1").count() > 0


def test_dashboard(shop):
    board = cl.load_dashboard(*shop)
    assert board.customers.count() == 5
    assert board.monthly.count() == 2
    assert board.orders.count() == 7
    assert board.importances.count() == 6
    assert cl.risk_report(board.customers).count() == 5
