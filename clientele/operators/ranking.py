"""Exact unique ranks and quartile scores without sorting a table in one task.

A row's place is decided by (value, key), so ties never share a rank and a value
held by most rows still splits into even parts. Rows that repeat a (value, key) get the
same score. Keys may be of any type that has an order. Measures are SQL expressions
and are compared as DOUBLE.
"""

import datetime
import decimal
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stage

QUARTILES = 4
ROWS_PER_TASK = 1_000_000
SAMPLE_ROWS = 20_000
# Bounds lie this many standard errors around the sampled place of a rank.
SAMPLE_MARGIN = 5

Cut = tuple[float, object]


def quartile_score(measure: str, key: str, cuts: Sequence[Cut]) -> str:
    """SQL for 1 plus the number of ``cuts`` that (measure, key) lies beyond."""
    value = f"cast({measure} as double)"
    return " + ".join(["1", *[f"CASE WHEN {_after(value, key, cut)} THEN 1 ELSE 0 END" for cut in cuts]])


def quartile_cuts(
    df: DataFrame,
    measures: Mapping[str, str],
    key: str,
    buckets: int = QUARTILES,
    rows_per_task: int = ROWS_PER_TASK,
    sample_rows: int = SAMPLE_ROWS,
) -> dict[str, list[Cut]]:
    """The (value, key) pairs that end each bucket but the last, per measure.

    Of n rows, bucket k ends at rank 1 + floor((n - 1) k / buckets): equal-width
    cuts of the ranks 1..n, closed on the right. Only these rows are looked for.
    Samples narrow the range that holds each until it fits one task, exact counts
    keep track of what lies below, and a window over what is left reads the rows
    off. No pass but that last one shuffles rows of ``df``, which is read several
    times and should be a staged frame.
    """
    n = df.count()
    if n == 0:
        return {name: [] for name in measures}
    rows = df.selectExpr(f"{key} AS key", *[f"cast({text} as double) AS {name}" for name, text in measures.items()])
    wanted = [1 + (n - 1) * k // buckets for k in range(1, buckets)]
    ranges = [_Range(name, None, None, 0, n, tuple(sorted(set(wanted)))) for name in measures]
    seed, found = 0, {}
    while wide := [r for r in ranges if r.rows > rows_per_task]:
        seed += len(wide)
        narrowed = _narrow(rows, wide, sample_rows, seed)
        if max(r.rows for r in narrowed) >= max(r.rows for r in wide):
            # Either a pair is repeated that often, or the sample gave no bounds.
            narrowed = _without_repeated(rows, narrowed, found)
            sample_rows *= 2
        ranges = [r for r in ranges if r.rows <= rows_per_task] + narrowed
    found |= _read_off(rows, ranges) if ranges else {}
    return {name: [found[name, rank] for rank in wanted] for name in measures}


def global_ranks(df: DataFrame, measures: Mapping[str, str], key: str) -> DataFrame:
    """(key, one BIGINT rank per measure): 1 for the smallest (value, key).

    All measures share one range-partitioned sort. A row's place inside its sorted
    partition plus the sizes of the partitions before it make its rank.
    """
    pairs = ", ".join(
        f"struct({i} AS measure, cast({text} as double) AS value)" for i, text in enumerate(measures.values())
    )
    placed = (
        df.selectExpr(key, f"inline(array({pairs}))")
        .orderBy("measure", "value", key)
        # The partition number in the high bits, the place inside it in the low 33.
        .selectExpr(key, "measure", "monotonically_increasing_id() AS place")
        .selectExpr("*", "shiftright(place, 33) AS part")
    )
    placed = stage(placed, "ranks")
    # One row per sort partition and measure, hence the broadcast.
    parts = (
        placed.groupBy("measure", "part")
        .agg(F.expr("min(place) AS first"), F.expr("count(*) AS rows"))
        .selectExpr(
            "measure", "part", "first", "sum(rows) OVER (PARTITION BY measure ORDER BY part) - rows AS before"
        )
    )
    ranked = placed.join(F.broadcast(parts), ["measure", "part"])
    rank = "before + place - first + 1"
    return ranked.groupBy(key).agg(
        *[F.expr(f"max(CASE WHEN measure = {i} THEN {rank} END) AS {name}") for i, name in enumerate(measures)]
    )


@dataclass(frozen=True)
class _Range:
    """The rows of a measure beyond ``low`` and up to ``high``, and the ranks sought there."""

    measure: str
    low: Cut | None
    high: Cut | None
    below: int
    rows: int
    ranks: tuple[int, ...]

    def holds(self) -> str:
        inside = ["true"]
        if self.low is not None:
            inside.append(_after(self.measure, "key", self.low))
        if self.high is not None:
            inside.append("NOT " + _after(self.measure, "key", self.high))
        return " AND ".join(inside)


def _after(value: str, key: str, cut: Cut) -> str:
    cut_value = f"({cut[0]!r}D)"
    return f"({value} > {cut_value} OR ({value} = {cut_value} AND {key} > {_literal(cut[1])}))"


def _literal(key) -> str:
    """A key read from a row, as SQL of its own type."""
    if isinstance(key, bool):
        return str(key).lower()
    if isinstance(key, int):
        return f"({key}L)"
    if isinstance(key, float):
        return f"double('{key!r}')"
    if isinstance(key, decimal.Decimal):
        return f"({key:f}BD)"
    if isinstance(key, datetime.datetime):
        return f"{'timestamp' if key.tzinfo else 'timestamp_ntz'} '{key.isoformat(' ')}'"
    if isinstance(key, datetime.date):
        return f"date '{key.isoformat()}'"
    # Text goes through its bytes, which need no quoting.
    if isinstance(key, str):
        return f"cast(X'{key.encode().hex()}' as string)"
    if isinstance(key, (bytes, bytearray)):
        return f"X'{bytes(key).hex()}'"
    raise TypeError(f"cannot rank by a key of type {type(key).__name__}")


def _members(rows: DataFrame, ranges: list[_Range], chosen: Sequence[str] | None = None) -> DataFrame:
    """(range, value, key) for each row and each range it lies in and is ``chosen`` for; one pass."""
    chosen = chosen or ["true"] * len(ranges)
    hits = ", ".join(
        f"CASE WHEN {also} AND {r.holds()} THEN struct({i} AS range, {r.measure} AS value, key) END"
        for i, (r, also) in enumerate(zip(ranges, chosen))
    )
    return rows.selectExpr(f"inline(array_compact(array({hits})))")


def _without_repeated(rows: DataFrame, ranges: list[_Range], found: dict) -> list[_Range]:
    """The ranges that hold more than one (value, key); the ranks of the others go to ``found``."""
    ends = [
        f"{end}(CASE WHEN {r.holds()} THEN struct({r.measure} AS value, key) END) AS {end}{i}"
        for i, r in enumerate(ranges)
        for end in ("min", "max")
    ]
    row, left = rows.selectExpr(*ends).first(), []
    for i, r in enumerate(ranges):
        if row[f"min{i}"] == row[f"max{i}"]:
            found |= {(r.measure, rank): tuple(row[f"min{i}"]) for rank in r.ranks}
        else:
            left.append(r)
    return left


def _narrow(rows: DataFrame, ranges: list[_Range], sample_rows: int, seed: int) -> list[_Range]:
    bounds = _sampled_bounds(rows, ranges, sample_rows, seed)
    upto = [
        f"count_if({r.holds()} AND NOT {_after(r.measure, 'key', cut)})"
        for r, cuts in zip(ranges, bounds)
        for cut in cuts
    ]
    counts = iter(rows.selectExpr(*upto).first() if upto else ())
    narrowed = []
    for r, cuts in zip(ranges, bounds):
        edges = [(r.low, r.below), *[(cut, r.below + next(counts)) for cut in cuts], (r.high, r.below + r.rows)]
        for (low, before), (high, through) in zip(edges, edges[1:]):
            ranks = tuple(rank for rank in r.ranks if before < rank <= through)
            if ranks:
                narrowed.append(_Range(r.measure, low, high, before, through - before, ranks))
    return narrowed


def _sampled_bounds(rows: DataFrame, ranges: list[_Range], sample_rows: int, seed: int) -> list[list[Cut]]:
    """Pairs on either side of each sought rank, in order, from a bounded sample."""
    chance = [f"rand({seed + i}) < {sample_rows / r.rows!r}D" for i, r in enumerate(ranges)]
    drawn: list[list[Cut]] = [[] for _ in ranges]
    for row in _members(rows, ranges, chance).collect():
        drawn[row["range"]].append((row["value"], row["key"]))
    return [_around(sorted(sample), r) for sample, r in zip(drawn, ranges)]


def _around(sample: list[Cut], r: _Range) -> list[Cut]:
    size = len(sample)
    places = set()
    for rank in r.ranks:
        share = (rank - r.below) / r.rows
        margin = 1 + math.ceil(SAMPLE_MARGIN * math.sqrt(size * share * (1 - share)))
        place = int(share * size)
        places |= {p for p in (place - margin, place + margin) if 0 <= p < size}
    return [sample[p] for p in sorted(places)]


def _read_off(rows: DataFrame, ranges: list[_Range]) -> dict[tuple[str, int], Cut]:
    place = F.row_number().over(Window.partitionBy("range").orderBy("value", "key"))
    sought = " OR ".join(
        f"(range = {i} AND place IN ({', '.join(str(rank - r.below) for rank in r.ranks)}))"
        for i, r in enumerate(ranges)
    )
    found = _members(rows, ranges).withColumn("place", place).where(sought).collect()
    return {
        (ranges[row["range"]].measure, ranges[row["range"]].below + row["place"]): (row["value"], row["key"])
        for row in found
    }
