import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import clientele as cl

# Bucket sizes of equal-width rank cuts.
SIZES = {
    1: (1, 0, 0, 0),
    2: (1, 0, 0, 1),
    3: (1, 1, 0, 1),
    4: (1, 1, 1, 1),
    5: (2, 1, 1, 1),
    6: (2, 1, 1, 2),
    7: (2, 2, 1, 2),
    8: (2, 2, 2, 2),
    9: (3, 2, 2, 2),
    10: (3, 2, 2, 3),
    11: (3, 3, 2, 3),
    350: (88, 87, 87, 88),
}


def scored(df, measures, **limits):
    cuts = cl.quartile_cuts(df, measures, "id", **limits)
    return df.select(
        "id", *[F.expr(cl.quartile_score(text, "id", cuts[m])).alias(m) for m, text in measures.items()]
    )


@pytest.mark.parametrize("n", SIZES)
def test_bucket_sizes(spark, n):
    got = scored(spark.range(n), {"s": "id"}).toPandas()["s"].value_counts()
    assert tuple(int(got.get(k, 0)) for k in (1, 2, 3, 4)) == SIZES[n]


def test_no_rows(spark):
    assert cl.quartile_cuts(spark.range(0), {"s": "id"}, "id") == {"s": []}


def frame(spark, n, seed):
    """Tied, heavily tied and almost unique measures, in no order."""
    rng = np.random.default_rng(seed)
    return pd.DataFrame(
        {
            "id": rng.permutation(n) * 3,
            "tied": np.where(rng.random(n) < 0.6, 5, rng.integers(0, 12, n)),
            "days": rng.integers(0, 400, n),
            "spent": np.round(rng.random(n) * 1000, 2),
        }
    )


def expected(pdf):
    ranked = pdf.sort_values("id").reset_index(drop=True)
    out = ranked[["id"]].copy()
    for name, ascending in (("tied", True), ("days", False), ("spent", True)):
        rank = ranked[name].rank(method="first", ascending=ascending)
        out[f"{name}_rank"] = rank.astype(int)
        out[name] = pd.qcut(rank, q=4, labels=[1, 2, 3, 4]).astype(int)
    return out


MEASURES = {"tied": "tied", "days": "-days", "spent": "spent"}


@pytest.mark.parametrize("n", [7, 350, 4001])
@pytest.mark.parametrize("rows_per_task", [1_000_000, 300])
def test_scores_match_pandas(spark, n, rows_per_task):
    pdf = frame(spark, n, seed=n)
    df = spark.createDataFrame(pdf).repartition(5)
    got = scored(df, MEASURES, rows_per_task=rows_per_task, sample_rows=400)
    got = got.toPandas().sort_values("id").reset_index(drop=True)
    want = expected(pdf)
    for name in MEASURES:
        assert (got[name] == want[name]).all(), name


def test_narrowing_takes_several_rounds_and_string_keys(spark):
    n = 20_000
    key = F.format_string("k%07d", (F.col("id") * 7919) % n)
    df = spark.range(n).select(key.alias("id"), F.lit(1).alias("same"))
    cuts = cl.quartile_cuts(df, {"s": "same"}, "id", rows_per_task=50, sample_rows=1000)
    assert [key for _, key in cuts["s"]] == [f"k{(n - 1) * k // 4:07d}" for k in (1, 2, 3)]


def test_tiny_samples_only_cost_rounds(spark):
    df = spark.range(5000)
    cuts = cl.quartile_cuts(df, {"s": "id"}, "id", rows_per_task=400, sample_rows=60)
    assert cuts["s"] == [((4999 * k // 4) * 1.0, 4999 * k // 4) for k in (1, 2, 3)]


def test_a_key_that_fills_many_tasks_is_every_cut(spark):
    df = spark.range(1000).select(F.lit(1).alias("id"))
    few, many = (cl.quartile_cuts(df, {"s": "id"}, "id", rows_per_task=n) for n in (100, 1_000_000))
    assert few == many == {"s": [(1.0, 1)] * 3}


@pytest.mark.parametrize("n", [1, 7, 4001])
@pytest.mark.parametrize("merge_partitions", ["true", "false"])
def test_global_ranks_match_pandas(spark, n, merge_partitions):
    pdf = frame(spark, n, seed=n)
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, merge_partitions)
    try:
        ranks = cl.global_ranks(spark.createDataFrame(pdf).repartition(5), MEASURES, "id")
        got = ranks.toPandas().sort_values("id").reset_index(drop=True)
    finally:
        spark.conf.set(setting, before)
    for name, ascending in (("tied", True), ("days", False), ("spent", True)):
        want = pdf.sort_values("id").reset_index(drop=True)[name].rank(method="first", ascending=ascending)
        assert (got[name] == want).all(), name


def test_tie_order(spark):
    df = spark.createDataFrame(list(enumerate([5, 3, 5, 1, 3])), "id int, v int")
    ranks = cl.global_ranks(df, {"up": "v", "down": "-v"}, "id").orderBy("id").collect()
    assert [r["up"] for r in ranks] == [4, 2, 5, 1, 3]
    assert [r["down"] for r in ranks] == [1, 3, 2, 5, 4]


KEYS = {
    "date": "date_add(date '2020-01-01', cast(id as int))",
    "decimal": "cast(id as decimal(20, 3)) / 8",
    "string": "format_string('k%06d', id)",
    "binary": "cast(format_string('k%06d', id) as binary)",
    "double": "id / 7D",
    "timestamp": "timestamp_seconds(id * 60)",
}


@pytest.mark.parametrize("kind", KEYS)
def test_any_ordered_key_gives_the_same_scores_at_any_size(spark, kind):
    df = spark.range(900).selectExpr(f"{KEYS[kind]} AS id", "id % 5 AS five", "id AS place")
    one, many = (scored_with(df, {"five": "five"}, rows_per_task=n) for n in (1_000_000, 120))
    assert one == many
    assert len({s for _, s in one}) == 4


def scored_with(df, measures, **limits):
    cuts = cl.quartile_cuts(df, measures, "id", sample_rows=200, **limits)
    columns = [F.expr(cl.quartile_score(text, "id", cuts[m])).alias(m) for m, text in measures.items()]
    return sorted(tuple(r) for r in df.select("place", *columns).collect())


def test_repeated_keys_give_the_same_scores_at_any_size(spark):
    df = spark.range(1200).selectExpr("id % 3 AS id", "1 AS same", "id AS place")
    assert scored_with(df, {"s": "same"}, rows_per_task=1_000_000) == scored_with(df, {"s": "same"}, rows_per_task=100)


def test_samples_without_bounds_are_drawn_again(spark):
    df = spark.range(5000)
    cuts = cl.quartile_cuts(df, {"s": "id"}, "id", rows_per_task=400, sample_rows=15)
    assert cuts["s"] == [((4999 * k // 4) * 1.0, 4999 * k // 4) for k in (1, 2, 3)]
