import pytest
from pyspark.sql import functions as F

from clientele.functions.money import as_dollars, as_percent, exact_sum


def test_amounts_below_a_cent_add_up(spark):
    df = spark.createDataFrame([(0.004,)] * 3, "amount double")
    assert df.selectExpr(exact_sum("amount")).first()[0] == 0.012


def test_sums_do_not_depend_on_partitions(spark):
    df = spark.range(20_000).selectExpr("id % 977 * 0.123457 - 31.7 AS amount")
    sums = {df.repartition(n).selectExpr(exact_sum("amount")).first()[0] for n in (1, 3, 7)}
    assert len(sums) == 1
    assert sums.pop() == pytest.approx(sum(round(i % 977 * 0.123457 - 31.7, 6) for i in range(20_000)), abs=1e-6)


@pytest.mark.parametrize("value", [12.25, 12.35, 0.125, 2.675, 1234567.885, 0.0, 99.95, 70.05, 1e6, 0.005, 0.045, 3.145, 999.995, 0.05])
def test_numbers_are_shown_as_python_shows_them(spark, value):
    row = spark.range(1).select(F.expr(as_dollars(f"{value!r}D")), F.expr(as_percent(f"{value!r}D"))).first()
    assert tuple(row) == (f"${value:,.2f}", f"{value:.1f}%")
