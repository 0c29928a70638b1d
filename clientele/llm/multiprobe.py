"""Approximate nearest neighbours by multiprobe p-stable hashing, reranked exactly.

Equal vectors are searched once. A vector of norm r is lifted by one component,
sqrt(R^2 - r^2) with R the largest norm, so that the largest inner product is the smallest
distance. Each of several tables hashes a vector to ``hashes`` integers
floor((a . x + b) / width) with a normal (2-stable) a. A query visits, table by table, its own
bucket and the buckets whose numbers differ by one in some places, in the order of the
estimated success: the sum of its squared distances to the borders crossed. Candidates of
all tables are merged and compared by their exact inner product.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import stage

TABLES = 3
HASHES = 4
WIDTH = 1.5
PROBES = 40
NEAREST = 20
# Vectors of a bin. A query brings an answer from each bin that it visits, so bins should be few.
BLOCK = 65_536
QUERY_BLOCK = 20_000
SEED = 11
# Kept beyond the answer before the exact comparison, which may order near ties anew.
MARGIN = 8


class Hasher:
    """The random tables; the same for the same dimension, scale and seed."""

    def __init__(self, dimension: int, radius: float, tables: int, hashes: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.radius, self.shape = radius, (tables, hashes)
        self.a = rng.normal(size=(dimension + 1, tables * hashes))
        self.width = width * radius
        self.b = rng.uniform(0, self.width, tables * hashes)

    def places(self, vectors: np.ndarray, lifted: bool) -> np.ndarray:
        """(rows, tables, hashes): positions in units of the width; a query is not lifted but scaled to R."""
        norm = np.linalg.norm(vectors, axis=1)
        if lifted:
            extra = np.sqrt(np.maximum(self.radius**2 - norm**2, 0))
        else:
            vectors, extra = vectors * (self.radius / norm)[:, None], np.zeros(len(vectors))
        at = (vectors @ self.a[:-1] + extra[:, None] * self.a[-1] + self.b) / self.width
        return at.reshape(len(vectors), *self.shape)


def probe_order(fraction: np.ndarray, most: int) -> list[tuple[int, ...]]:
    """Shifts (-1, 0, 1 in each place) by rising estimated cost, the own bucket first."""
    moves = sorted(
        [(float(f) ** 2, i, -1) for i, f in enumerate(fraction)]
        + [(float(1 - f) ** 2, i, 1) for i, f in enumerate(fraction)]
    )
    out, heap = [(0,) * len(fraction)], [(moves[0][0], (0,))]
    while heap and len(out) < most:
        cost, chosen = heapq.heappop(heap)
        shift = [0] * len(fraction)
        for c in chosen:
            shift[moves[c][1]] += moves[c][2]
        if len({moves[c][1] for c in chosen}) == len(chosen):
            out.append(tuple(shift))
        last = chosen[-1]
        if last + 1 < len(moves):
            step = moves[last + 1][0]
            heapq.heappush(heap, (cost - moves[last][0] + step, (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (cost + step, (*chosen, last + 1)))
    return out


def _names(numbers: np.ndarray, table: int) -> np.ndarray:
    """One long for each row of hash numbers of a table."""
    out = np.full(len(numbers), table + 1, np.int64)
    for column in numbers.T:
        out = out * np.int64(1_000_003) + column.astype(np.int64)
    return out


def _matrix(column, dimension: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def _buckets(hasher: Hasher, dimension: int):
    def run(batches):
        for batch in batches:
            numbers = np.floor(hasher.places(_matrix(batch.column("vec"), dimension), True)).astype(np.int64)
            for t in range(hasher.shape[0]):
                names = pa.array(_names(numbers[:, t], t))
                table = pa.array(np.full(batch.num_rows, t, np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("vid"), table, names], ["vid", "t", "bucket"])

    return run


def _probes(hasher: Hasher, dimension: int, most: int):
    def run(batches):
        for batch in batches:
            at = hasher.places(_matrix(batch.column("vec"), dimension), False)
            numbers = np.floor(at).astype(np.int64)
            vids, rows, buckets = batch.column("vid"), [], []
            for i in range(batch.num_rows):
                for t in range(hasher.shape[0]):
                    shifts = np.array(probe_order(at[i, t] - numbers[i, t], most), np.int64)
                    buckets.append(_names(numbers[i, t] + shifts, t))
                    rows.append(np.full(len(shifts), i))
            yield pa.RecordBatch.from_arrays(
                [vids.take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(buckets))], ["vid", "bucket"]
            )

    return run


FOUND = "qid long, vid long, score double"


def _search(dimension: int, keep: int):
    """Of one bin: the best candidates of each query over the buckets that it probes there."""

    none = pa.table({c: pa.array([], t) for c, t in (("qid", pa.int64()), ("vid", pa.int64()), ("score", pa.float64()))})

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return none
        left, right = left.sort_by([("bucket", "ascending"), ("vid", "ascending")]), right.sort_by("bucket")
        bucket, vid, x = left["bucket"].to_numpy(), left["vid"].to_numpy(), _matrix(left["vec"], dimension)
        probed, qid = right["bucket"].to_numpy(), right["vid"].to_numpy()
        queries, first, position = np.unique(qid, return_index=True, return_inverse=True)
        q = _matrix(right["vec"].take(pa.array(first)), dimension)
        found_q, found_v, found_s = [], [], []
        for name in np.unique(probed):
            a, b = np.searchsorted(bucket, [name, name + 1])
            if a == b:
                continue
            rows = np.unique(position[np.searchsorted(probed, name) : np.searchsorted(probed, name, side="right")])
            for lo in range(0, len(rows), 512):
                own = rows[lo : lo + 512]
                score, at = q[own] @ x[a:b].T, np.broadcast_to(np.arange(a, b), (len(own), b - a))
                if b - a > keep:
                    at = np.argpartition(-score, keep - 1, axis=1)[:, :keep] + a
                    score = np.take_along_axis(score, at - a, axis=1)
                found_q.append(np.repeat(own, at.shape[1]))
                found_v.append(at.ravel())
                found_s.append(score.ravel())
        if not found_q:
            return none
        who, at, score = np.concatenate(found_q), np.concatenate(found_v), np.concatenate(found_s)
        # A candidate may come from two tables of this bin.
        _, once = np.unique(who * np.int64(len(x)) + np.searchsorted(np.unique(vid), vid)[at], return_index=True)
        who, at, score = who[once], at[once], score[once]
        order = np.lexsort((vid[at], -score, who))
        who, at = who[order], at[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        who, at = who[rank < keep], at[rank < keep]
        # The exact score comes from the vectors in one fixed order of sums, so equal vectors tie.
        return pa.table({"qid": queries[who], "vid": vid[at], "score": (q[who] * x[at]).sum(axis=1)})

    return run


def _valid(vectors: DataFrame, column: str) -> DataFrame:
    """Vectors that can be compared, as double arrays, with their squared norm."""
    bad = "x is null or isnan(x) or abs(x) = double('infinity')"
    return (
        vectors.select(
            F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vec")
        )
        .filter("vec_id is not null and size(vec) > 0")
        .filter(f"not exists(vec, x -> {bad})")
        .withColumn("square", F.expr("aggregate(vec, 0D, (s, x) -> s + x * x)"))
        .filter("square > 0")
    )


def _bins(candidates: DataFrame, probes: DataFrame, distinct: DataFrame, block: int, splits: int) -> tuple:
    """Buckets dealt to bins of about ``block`` vectors; a larger bucket is cut into several."""
    sizes = candidates.groupBy("bucket").agg(F.count("*").alias("n"))
    sizes = stage(sizes.selectExpr("bucket", f"cast(ceil(n / {block}D) as long) as salts", "n"), "buckets")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    bins = max(1, -(-total // block))
    dealt = (
        probes.join(sizes.select("bucket", "salts"), "bucket")
        .withColumn("salt", F.explode(F.expr("sequence(0L, salts - 1)")))
        .selectExpr("vid", "bucket", f"pmod(xxhash64(bucket, salt), {bins}L) as bin")
        .distinct()
        .withColumn("split", F.expr(f"cast(pmod(xxhash64(vid), {splits}) as int)"))
    )
    dealt = stage(dealt, "visits")
    # A candidate goes only to the splits of queries that visit its bucket.
    asked = dealt.select("bin", "bucket", "split").distinct()
    left = (
        candidates.join(sizes.select("bucket", "salts"), "bucket")
        .withColumn("bin", F.expr(f"pmod(xxhash64(bucket, pmod(xxhash64(vid), salts)), {bins}L)"))
        .join(asked, ["bin", "bucket"])
        .join(distinct.select("vid", "vec"), "vid")
        .select("bin", "split", "bucket", "vid", "vec")
    )
    right = dealt.join(distinct.select("vid", "vec"), "vid").select("bin", "split", "bucket", "vid", "vec")
    # Both sides may come from one frame; new names of the columns keep them apart.
    right = right.toDF(*right.columns)
    return left, right


def nearest(
    vectors: DataFrame,
    queries: str = "vec_id % 20 = 0",
    column: str = "embedding",
    k: int = NEAREST,
    tables: int = TABLES,
    hashes: int = HASHES,
    width: float = WIDTH,
    probes: int = PROBES,
    block: int = BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each query row, its own row apart.

    ``queries`` is a condition on vec_id; candidates are all rows. Nearness is the inner
    product of the original vectors in double precision, ties go to the smaller vec_id.
    A row with a null vec_id, or a vector that is null, empty, zero, holds null or
    non-finite components, or has another length than most (the longer of equally
    frequent lengths), takes no part. Rows that repeat a vec_id with the same vector count
    once. A query that finds fewer than ``k`` is searched again in all buckets, so it
    gets all candidates where there are fewer. No valid query gives no rows. Runs jobs.

    ``width`` is in units of the largest norm; ``probes`` buckets are visited in each
    table. A bucket of more than ``block`` vectors is cut, and a bin is met by at most about
    ``query_block`` queries at a time.
    """
    usable = stage(_valid(vectors, column), "vectors")
    length = usable.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if length is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dimension = length["n"]
    usable = usable.filter(F.size("vec") == dimension)
    radius = float(np.sqrt(usable.agg(F.max("square")).first()[0]))
    hasher = Hasher(dimension, radius, tables, hashes, width, SEED)

    # Equal vectors once, under their least id, with the k + 1 least ids: more can't be in an answer.
    named = usable.select("vec_id", "vec", F.expr("xxhash64(vec)").alias("h")).distinct()
    least = named.groupBy("h", "vec").agg(F.min("vec_id").alias("vid"))
    distinct = stage(least.select("vid", "vec"), "distinct")
    numbered = named.selectExpr("vec_id", "h", "vec", "row_number() over (partition by h, vec order by vec_id) as nth")
    ids = numbered.filter(F.col("nth") <= k + 1).join(least, ["h", "vec"]).select("vid", "vec_id")
    asking = named.filter(queries).join(least, ["h", "vec"]).select(F.col("vid").alias("qid"), F.col("vec_id").alias("query_id"))
    ids, asking = stage(ids, "ids"), stage(asking, "queries")

    asked = distinct.join(asking.select(F.col("qid").alias("vid")).distinct(), "vid")
    splits = max(1, -(-asked.count() // query_block))
    candidates = stage(distinct.mapInArrow(_buckets(hasher, dimension), "vid long, t int, bucket long"), "hashes")
    visits = asked.mapInArrow(_probes(hasher, dimension, probes), "vid long, bucket long")
    keep = k + 1 + MARGIN

    def found(visits: DataFrame, candidates: DataFrame) -> DataFrame:
        left, right = _bins(candidates.select("vid", "bucket"), visits, distinct, block, splits)
        pairs = (
            left.groupBy("bin", "split").cogroup(right.groupBy("bin", "split")).applyInArrow(_search(dimension, keep), FOUND)
        )
        best = pairs.groupBy("qid", "vid").agg(F.max("score").alias("score"))
        ranked = best.selectExpr("*", "row_number() over (partition by qid order by score desc, vid) as nth")
        hits = ranked.filter(F.col("nth") <= k + 1).join(ids, "vid").select("qid", "vec_id", "score")
        ranked = hits.selectExpr("*", "row_number() over (partition by qid order by score desc, vec_id) as nth")
        return ranked.filter(F.col("nth") <= k + 1).select("qid", "vec_id", "score")

    first = stage(found(visits, candidates), "found")
    few = first.groupBy("qid").agg(F.count("*").alias("n")).filter(F.col("n") <= k)
    some = asked.select(F.col("vid").alias("qid")).join(first.select("qid").distinct(), "qid", "left_anti")
    short = stage(few.select("qid").union(some), "short")
    one_table = candidates.filter("t = 0")
    if short.first() is not None:
        every = short.select(F.col("qid").alias("vid"), F.lit(0).alias("t")).join(
            one_table.select("t", "bucket").distinct(), "t"
        )
        again = found(every.select("vid", "bucket"), one_table)
        first = first.join(short, "qid", "left_anti").union(again)
    answers = first.join(asking, "qid").filter("vec_id <> query_id")
    return answers.selectExpr(
        "query_id",
        "cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank",
        "vec_id",
        "score",
    ).filter(F.col("rank") <= k)
