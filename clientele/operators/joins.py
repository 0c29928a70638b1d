"""A join of a fact table to one row per key that survives a hot key, and a filter of rows by a bitmap of keys."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage

# A key is hot when it holds more rows than one task should take.
ROWS_PER_TASK = 2_000_000
# Rows of a barely hot key that the sample shows on average: enough not to miss it.
SHOWN = 40
# A longer list of hot keys is not broadcast but joined as the planner sees fit.
MOST_KEYS = 1_000_000
# Begins the names of the columns that a filter adds.
HIDDEN = "__llm_"
FILTER_BITS = 24


def hot_keys(
    df: DataFrame,
    key: str,
    rows_per_task: int = ROWS_PER_TASK,
    shown: int = SHOWN,
    most_keys: int = MOST_KEYS,
) -> DataFrame | None:
    """(key, pieces) for the hot keys of ``df``, or None when there are none.

    Counts come from a sample of one column, ``shown`` rows for each task's worth. A
    misjudged key costs speed, never rows. At most total / rows_per_task keys can be hot; up to
    ``most_keys`` of them are marked for broadcasting. Runs jobs: a count and a sample scan.
    """
    total = df.count()
    if total <= rows_per_task:
        return None
    fraction = min(1.0, shown / rows_per_task)
    keys = df.select(key).where(f"{key} IS NOT NULL")
    if fraction < 1.0:
        keys = keys.sample(fraction, seed=1)
    # A little below the limit, as the sample may show fewer rows than it should.
    least = rows_per_task * fraction * (0.75 if fraction < 1.0 else 1.0)
    pieces = f"cast(greatest(2, ceil(n / {rows_per_task * fraction!r}D)) as int) AS pieces"
    found = keys.groupBy(key).agg(F.expr("count(*) AS n")).where(f"n > {least!r}D").selectExpr(key, pieces)
    found = stage(found, "hot-keys")
    n = found.count()
    if n == 0:
        return None
    return F.broadcast(found) if n <= most_keys else found


def join_to_unique(
    fact: DataFrame, dim: DataFrame, key: str, spread: str, hot: DataFrame | None
) -> DataFrame:
    """Inner join of ``fact`` to ``dim``, whose ``key`` is unique.

    The rows of a hot key are spread over as many tasks as it has pieces, by a hash
    of column ``spread``, and its one ``dim`` row is repeated for each piece. ``hot_keys``
    marks a list of bounded length for broadcasting; a longer one meets both sides by a shuffle.
    """
    if hot is None:
        return fact.join(dim, key)
    # A hash, unlike a random number, gives a retried task the same answer.
    piece = F.expr(f"cast(coalesce(pmod(xxhash64({spread}), pieces), 0) as int)")
    cut = fact.join(hot, key, "left").withColumn("piece", piece).drop("pieces")
    copies = F.expr("explode(sequence(0, coalesce(pieces, 1) - 1))")
    repeated = dim.join(hot, key, "left").withColumn("piece", copies).drop("pieces")
    return cut.join(repeated, [key, "piece"]).drop("piece")


def member_filter(keys: DataFrame, key: str) -> DataFrame:
    """At most ``2**(FILTER_BITS - 6)`` rows that say which key hashes occur.

    A bitmap of a fixed size, so it may be broadcast whatever the size of ``keys``;
    with more keys it only lets more rows pass.
    """
    h = F.expr(f"xxhash64(`{key}`) & {(1 << FILTER_BITS) - 1}L")
    return (
        keys.select(h.alias("h"))
        .groupBy(F.shiftright("h", 6).alias(HIDDEN + "word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias(HIDDEN + "mask"))
    )


def with_maybe(df: DataFrame, key: str, bitmap: DataFrame) -> DataFrame:
    """``df`` with ``__llm_maybe``: whether its key may be in the bitmap of ``member_filter``."""
    h = f"(xxhash64(`{key}`) & {(1 << FILTER_BITS) - 1}L)"
    word = F.expr(f"shiftright({h}, 6)")
    joined = df.withColumn(HIDDEN + "word", word).join(F.broadcast(bitmap), HIDDEN + "word", "left")
    hit = F.expr(f"coalesce((shiftrightunsigned({HIDDEN}mask, cast({h} & 63 as int)) & 1L) = 1L, false)")
    return joined.withColumn(HIDDEN + "maybe", hit).drop(HIDDEN + "word", HIDDEN + "mask")
