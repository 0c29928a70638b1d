"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash. Per source a histogram of words by hash bucket finds
the bucket in which the budget runs out; that bucket alone is cut into finer buckets,
level by level, until a single hash value is left. The thresholds are nested, so a
larger budget takes a superset. Selection is then a comparison with the threshold:
nothing is sorted but the buckets of one source.

Only DataFrame and SQL expressions.
"""

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import HIDDEN, stage, text_of

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
LEVEL_BITS = 15
LEVELS = 4
WORD = r"[^\x20\x09-\x0D]+"
SALTS = 16


def _hash():
    """60 bits of MD5 over the doc_id and the text, as a non-negative long."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def _targets(sizes: DataFrame, weights: tuple, most: int) -> DataFrame:
    """Each source's target: weight times the level at which all targets add up to the total.

    A source at its cap gives its excess to the others, by weight. Sources fill up in the
    order of cap / weight, so running sums over one row a source find the level.
    """
    cases = ", ".join(str(w) for w in weights)
    ranked = sizes.selectExpr(
        "source",
        "source_size",
        f"cast(element_at(array({cases}), cast((row_number() over (order by source nulls last) - 1)"
        f" % {len(weights)} + 1 as int)) as long) as weight",
        "sum(source_size) over () as total",
        f"source_size * {most}L as cap",
    )
    order = "order by cast(cap as double) / weight, source nulls last"
    run = ranked.selectExpr(
        "*",
        f"coalesce(sum(cap) over ({order} rows between unbounded preceding and 1 preceding), 0L) as cap_before",
        f"sum(weight) over ({order} rows between current row and unbounded following) as weight_left",
        f"row_number() over ({order}) as nth",
    ).selectExpr("*", "cast(cap as double) * weight_left >= cast(total - cap_before as double) * weight as free")
    level = run.selectExpr("*", "min(if(free, nth, null)) over () as at").selectExpr(
        "*",
        "max(if(nth = at, total - cap_before, null)) over () as rest",
        "max(if(nth = at, weight_left, null)) over () as rest_weight",
    )
    return level.selectExpr(
        "source",
        "source_size",
        "case when source_size = 0 then 0D when nth < at then cast(cap as double)"
        " else cast(rest as double) * weight / rest_weight end as target",
    ).selectExpr(
        "*",
        f"case when source_size = 0 then 0L else least(cast(floor(target / source_size) as long), {most}L) end as times",
    )


def _spread(salts: int):
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt")


def _narrow(docs: DataFrame) -> DataFrame:
    sized = docs.select(
        docs["doc_id"].alias("doc_id"),
        docs["source"].alias("source"),
        docs["text"].alias("text"),
        F.regexp_count(text_of(docs), F.lit(WORD)).cast("long").alias("size"),
    )
    return stage(sized.select("doc_id", "source", "size", _hash().alias("h")), "sizes")


def _thresholds(narrow: DataFrame, weights: tuple, most: int, salts: int) -> DataFrame:
    """A row for each source and salt: source_size, target, whole passes (times) and hash threshold."""
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = stage(_targets(sizes, weights, most), "targets")
    salted = narrow.withColumn("salt", F.col("h") % salts).alias("n")
    # The hash prefix in which a source's budget runs out, and the words left to spend there.
    at = plan.filter("source_size > 0").selectExpr(
        "source", "0L as prefix", "target - times * cast(source_size as double) as budget"
    )
    for level in range(1, LEVELS + 1):
        shift = LEVEL_BITS * (LEVELS - level)
        asked = at.select("source", "prefix", "budget", _spread(salts)).alias("a")
        inside = (
            F.col("n.source").eqNullSafe(F.col("a.source"))
            & (F.col("n.salt") == F.col("a.salt"))
            & (F.shiftright("n.h", shift + LEVEL_BITS) == F.col("a.prefix"))
        )
        histogram = (
            salted.join(asked, inside)
            .groupBy(F.col("n.source").alias("source"), F.shiftright("n.h", shift).alias("bucket"))
            .agg(F.sum("n.size").alias("words"), F.max("a.budget").alias("budget"))
        )
        unpaid = histogram.selectExpr(
            "source",
            "bucket",
            "words",
            "budget - (sum(words) over (partition by source order by bucket) - words) as budget",
        ).filter("budget < words")
        first = unpaid.groupBy("source").agg(
            F.min(F.struct("bucket", "budget", "words")).alias("b")
        )
        if level < LEVELS:
            at = first.selectExpr("source", "b.bucket as prefix", "b.budget as budget")
        else:
            at = first.selectExpr("source", "if(2 * b.budget > b.words, b.bucket + 1L, b.bucket) as threshold")
        at = stage(at, f"level{level}")
    same = F.col("p.source").eqNullSafe(F.col("t.source"))
    found = plan.alias("p").join(at.alias("t"), same, "left").select("p.*", "t.threshold", _spread(salts))
    # Written, the planner knows its size: a few rows a source are broadcast, a longer table is not.
    return stage(found, "thresholds")


def _copies(most: int, times: str = "times") -> str:
    # The bound matters to documents without words only: what they take is 0 either way.
    return f"if(source_size = 0, 1L, least({times} + if(h < coalesce(threshold, 0L), 1L, 0L), {most}L))"


def mix(
    docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_REPEATS, salts: int = SALTS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, copies.

    ``size`` counts words (runs without ASCII white space; a null text has none). Sources
    in code-point order, null as a source of its own and last, have the weights in turn;
    targets share the size of all. ``taken`` is ``size`` times ``copies``: as many whole
    passes as the target holds, and one more for documents below the source's hash
    threshold. Rows of equal doc_id and text share a hash: they are taken or left together,
    whichever comes nearer to the target (left when equally near), so a source's taken
    words miss the target by at most half the words of one hash value. A source without
    words has target 0 and one copy of each of its documents. An empty table gives no rows;
    other columns are not read. The result depends on the rows alone. Runs jobs.

    A hot source is summed before each shuffle and joined over ``salts`` pieces.
    """
    narrow = _narrow(docs)
    chosen = _thresholds(narrow, weights, most, salts).alias("c")
    rows = narrow.withColumn("salt", F.col("h") % salts).alias("n")
    same = F.col("n.source").eqNullSafe(F.col("c.source")) & (F.col("n.salt") == F.col("c.salt"))
    return (
        rows.join(chosen, same)
        .selectExpr("n.doc_id", "n.size", "c.source_size", "c.target", f"{_copies(most, 'c.times')} as copies")
        .selectExpr("doc_id", "size", "source_size", "target", "size * copies as taken", "copies")
    )


def mixed_documents(
    docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_REPEATS, salts: int = SALTS
) -> DataFrame:
    """``docs`` as the mix takes them: every row as often as ``mix`` says, all columns as they are."""
    chosen = _thresholds(_narrow(docs), weights, most, salts)
    names = {c: HIDDEN + c for c in chosen.columns}
    chosen = chosen.select(*[F.col(c).alias(n) for c, n in names.items()])
    h = HIDDEN + "h"
    rows = docs.withColumn(h, _hash())
    same = rows["source"].eqNullSafe(chosen[names["source"]]) & (rows[h] % salts == chosen[names["salt"]])
    copies = _copies(most)
    for c, n in [*names.items(), ("h", h)]:
        copies = re.sub(rf"\b{c}\b", n, copies)
    taken = rows.join(chosen, same).withColumn(
        HIDDEN + "copy", F.explode(F.expr(f"array_repeat(1, cast({copies} as int))"))
    )
    return taken.select(*[taken[c] for c in docs.columns])
