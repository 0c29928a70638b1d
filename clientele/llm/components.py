"""Connected components of a link table, by alternating star rounds (large star, small star)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.operators.joins import ROWS_PER_TASK, hot_keys, join_to_unique

from .jobs import stage


def _star(edges: DataFrame, large: bool, links_a_task: int) -> DataFrame:
    """One star round. A node's least neighbour comes from a pre-aggregated sum, not from its list.

    In a large star a node may have links without bound; those of a hub are dealt over tasks.
    """
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if large:
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        up = both.filter("v > u")
        out = join_to_unique(up, least, "u", "v", hot_keys(up, "u", links_a_task)).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = both.filter("v < u")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, links_a_task: int = ROWS_PER_TASK) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v); the component is its least node.

    Null nodes and links of a node with itself are left out. Each round is written to the
    shared folder; the rounds are about the logarithm of the longest chain.
    """
    low, high = F.least("u", "v"), F.greatest("u", "v")
    now = edges.filter("u <> v").select(high.alias("u"), low.alias("v")).distinct()
    now, before = stage(now, "links"), None
    while True:
        state = now.agg(F.count("*").alias("n"), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))").alias("s")).first()
        if state == before:
            break
        before = state
        now = stage(_star(_star(now, True, links_a_task), False, links_a_task), "links")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
