from conftest import rows
from pyspark.sql import functions as F

import clientele as cl


def skewed(spark, n=3000):
    """A third of the rows belong to key 7, the rest to 100 keys."""
    i = F.col("id")
    return spark.range(n).select(i.alias("row"), F.when(i % 3 == 0, 7).otherwise(i % 100).alias("key"))


def test_hot_keys_are_found_and_cut_to_size(spark):
    hot = cl.hot_keys(skewed(spark), "key", rows_per_task=200, shown=200)
    held = skewed(spark).where("key = 7").count()
    assert rows(hot) == [(7, -(-held // 200))]


def test_small_tables_have_no_hot_keys(spark):
    assert cl.hot_keys(skewed(spark), "key") is None
    assert cl.hot_keys(spark.range(5000).withColumnRenamed("id", "key"), "key", rows_per_task=100) is None


def test_hot_keys_from_a_sample(spark):
    hot = cl.hot_keys(skewed(spark, 60_000), "key", rows_per_task=1000, shown=100)
    ((key, pieces),) = rows(hot)
    assert key == 7
    assert 15 <= pieces <= 27


def test_split_join_gives_the_plain_join(spark):
    fact = skewed(spark)
    dim = spark.range(0, 100, 2).select(F.col("id").alias("key"), (F.col("id") * 10).alias("tag"))
    dim = dim.union(spark.createDataFrame([(7, 70)], "key bigint, tag bigint"))
    hot = cl.hot_keys(fact, "key", rows_per_task=200, shown=200)
    split = cl.join_to_unique(fact, dim, "key", "row", hot)
    plain = cl.join_to_unique(fact, dim, "key", "row", None)
    assert split.columns == plain.columns
    assert rows(split) == rows(plain)
    assert split.where("key = 7").count() == fact.where("key = 7").count()


def test_hot_rows_spread_over_tasks(spark):
    fact = skewed(spark, 30_000)
    dim = spark.range(100).withColumnRenamed("id", "key")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {name: spark.conf.get(name) for name in conf}
    try:
        for name, value in conf.items():
            spark.conf.set(name, value)
        hot = cl.hot_keys(fact, "key", rows_per_task=200, shown=200)

        def largest_task(df):
            return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]

        split = largest_task(cl.join_to_unique(fact, dim, "key", "row", hot))
        plain = largest_task(cl.join_to_unique(fact, dim, "key", "row", None))
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert plain > 10_000
    assert split < 6_000


def test_a_key_of_a_small_share_is_split_when_it_is_too_large_for_a_task(spark):
    i = F.col("id")
    many = spark.range(200_000).select(i.alias("row"), F.when(i < 150, -1).otherwise(i).alias("key"))
    assert rows(cl.hot_keys(many, "key", rows_per_task=20)) == [(-1, 8)]


def test_more_hot_keys_than_may_be_broadcast_are_split_all_the_same(spark):
    fact = skewed(spark)
    few, many = (cl.hot_keys(fact, "key", rows_per_task=10, most_keys=n) for n in (10**6, 50))
    assert many.count() > 50 and rows(many) == rows(few)
    hints = ["ResolvedHint" in df._jdf.queryExecution().analyzed().toString() for df in (few, many)]
    assert hints == [True, False]
    dim = fact.select("key").distinct().selectExpr("key", "key * 2 AS twice")
    joined = cl.join_to_unique(fact, dim, "key", "row", many)
    assert rows(joined, "row", "key", "twice") == rows(fact.join(dim, "key"), "row", "key", "twice")
