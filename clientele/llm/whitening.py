"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Entries become whole numbers, floor(64 c) + 1000000, so that sums and the mean are exact.
Let A hold the distinct vectors less their mean. The alternating products A v and A'u build
A V = U B with B upper bidiagonal. A pass over the rows takes a block straight from u = A w to
its share of A'u, so a left vector, as long as the table, never exists outside of a task: it
is kept as the short vector w with u = A w, and U'(A x) is (A'U)'x. Left and right vectors are
both orthogonalised anew against all earlier ones, twice. The SVD of the small B gives the
components V Q and the deviations.
"""

import decimal
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import stage

COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000
# Entries that are larger have no exact whole number and count as non-finite.
MOST_ENTRY = 2.0**52
SEED = 13
LOW_BITS = 24
# Deviations under this share of the largest belong to directions without any spread.
FLAT = 1e-9
# Products below this share of the matrix are rounding: the space reached so far is closed.
ROUNDING = 1e-13

RESULT = (
    "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
)
PART = "i int, value double"


def _integers(column: pa.Array) -> np.ndarray:
    """Rows of floor(64 c), the whole numbers less their offset."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(flat.reshape(len(column), -1) * SCALE).astype(np.int64)


def _packed(batches):
    """Each vector in the fewest bytes an entry that hold it, which is one form for equal vectors."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _integers(batch.column("vec"))
        most = np.abs(x).max(axis=1)
        kinds = np.searchsorted([1 << 7, 1 << 15, 1 << 31], most, side="right")
        found = set()
        for kind in np.unique(kinds):
            rows = np.ascontiguousarray(x[kinds == kind].astype(f"<i{1 << kind}"))
            size = rows.shape[1] << int(kind)
            data = rows.tobytes()
            found |= {data[i : i + size] for i in range(0, len(data), size)}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.binary())], ["x"])


def _unpacked(column: pa.Array, dimension: int) -> np.ndarray:
    """The vectors of a packed column, as int64 rows; their order is not kept."""
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data, sizes = np.frombuffer(column.buffers()[2], np.uint8), np.diff(bounds)
    out = []
    for size in np.unique(sizes):
        at = bounds[:-1][sizes == size]
        if len(at) == len(sizes):
            rows = data[bounds[0] : bounds[-1]]
        else:
            rows = data[at[:, None] + np.arange(size)]
        out.append(rows.ravel().view(f"<i{int(size) // dimension}").reshape(-1, dimension).astype(np.int64))
    return np.concatenate(out) if out else np.zeros((0, dimension), np.int64)


def _moments(dimension: int):
    """Per task the number of vectors (i = -1) and each entry's sum in a high and a low part."""

    def run(batches):
        n, high, low = 0, np.zeros(dimension, np.int64), np.zeros(dimension, np.int64)
        for batch in batches:
            x = _unpacked(batch.column("x"), dimension)
            n += len(x)
            high += (x >> LOW_BITS).sum(axis=0)
            low += (x & ((1 << LOW_BITS) - 1)).sum(axis=0)
        index = pa.array(np.arange(-1, dimension), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [index, pa.array(np.append(n, high)), pa.array(np.append(0, low))], ["i", "high", "low"]
        )

    return run


def _centred(x: np.ndarray, whole: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Rows less the mean, which is given as its whole number and the rest below one."""
    return (x - whole) - part


def _pass(dimension: int, whole: np.ndarray, part: np.ndarray, product):
    """Sum over all blocks of what ``product`` makes of a block's centred rows, one number a row."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                one = product(_centred(_unpacked(batch.column("x"), dimension), whole, part))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["i", "value"]
            )

    return run


def _summed(fit: DataFrame, function) -> np.ndarray:
    """The sums of a pass; Spark adds up what its tasks give, so the driver sees one row a number."""
    rows = fit.mapInArrow(function, PART).groupBy("i").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r["i"]] = r["value"]
    return out


def _there_and_back(w: np.ndarray):
    """Of a block: its share of A'u and of u'u, where u = A w."""

    def product(a: np.ndarray) -> np.ndarray:
        u = a @ w
        return np.append(u @ a, u @ u)

    return product


def _orthogonal(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for b in basis:
            v = v - (b @ v) * b
    return v


def bidiagonalise(multiply, dimension: int, scale: float, wanted: int, steps: int, tolerance: float):
    """(components as columns, singular values) of the matrix behind ``multiply``, largest first.

    ``multiply(w)`` gives (A'u, u'u) for u = A w; ``scale`` is A's Frobenius norm. After
    ``dimension`` steps the result is whole. With a ``tolerance`` the steps end earlier, once the
    residuals of the ``wanted`` largest are below that share of the largest value.
    """
    rng = np.random.default_rng(SEED)
    nothing = ROUNDING * scale

    def unit(v: np.ndarray) -> np.ndarray:
        # Dividing by a small norm brings back what rounding left along the others.
        v = _orthogonal(v / np.linalg.norm(v), right)
        return v / np.linalg.norm(v)

    def fresh() -> np.ndarray:
        return unit(_orthogonal(rng.normal(size=dimension), right))

    right, left, images, diagonal, beside = [], [], [], [], []
    v = fresh()
    for step in range(steps):
        right.append(v)
        w = v
        for _ in range(2):
            # u less its part along the earlier left vectors, whose images under A' are known.
            w = w - sum((z @ w) * l for l, z in zip(left, images)) if left else w
        image, square = multiply(w)
        alpha = math.sqrt(max(square, 0.0))
        if alpha <= nothing:
            # Along v the rows only repeat what earlier left vectors hold.
            diagonal.append(0.0)
            left.append(np.zeros(dimension))
            images.append(np.zeros(dimension))
            rest = np.zeros(dimension)
        else:
            diagonal.append(alpha)
            left.append(w / alpha)
            images.append(image / alpha)
            rest = _orthogonal(images[-1] - alpha * v, right)
        if step + 1 == steps:
            break
        beta = float(np.linalg.norm(rest))
        if tolerance and len(diagonal) >= wanted:
            p, s, _ = np.linalg.svd(np.diag(diagonal) + np.diag(beside, 1))
            if (beta * np.abs(p[-1, :wanted]) <= tolerance * s[0]).all():
                break
        # A space that the products don't leave is whole; the next starts anywhere outside of it.
        beside.append(0.0 if beta <= nothing else beta)
        v = fresh() if beta <= nothing else unit(rest)
    k = len(diagonal)
    _, values, q = np.linalg.svd(np.diag(diagonal) + np.diag(beside[: k - 1], 1))
    return np.column_stack(right[:k]) @ q.T, values


def _whitened(n: int, whole: np.ndarray, part: np.ndarray, rest: np.ndarray, axes: np.ndarray, explained, error: float):
    """All rows of the result: each vector once a component."""
    k = axes.shape[1]

    def run(batches):
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            x = _integers(batch.column("vec"))
            y = _centred(x, whole, part) @ axes
            away = x - whole
            # n x - S is n (x - whole) - rest, and its squares are summed exactly.
            bound = (float(np.abs(away).max()) + 1.0) * n
            if bound * bound * x.shape[1] < 2.0**62:
                exact = pa.array(((away * n - rest) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
            else:
                exact = _decimals(((away.astype(object) * n - rest.astype(object)) ** 2).sum(axis=1))
            again = pa.array(np.repeat(np.arange(rows), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(again),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, n, np.int64)),
                    exact.take(again),
                    pa.array(y.ravel()),
                    pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def _decimals(values) -> pa.Array:
    """Whole numbers as decimals of 38 digits; larger ones, which small entries never give, are null."""
    return pa.array([decimal.Decimal(int(v)) if v < 10**38 else None for v in values], pa.decimal128(38, 0))


def whiten(
    vectors: DataFrame,
    column: str = "embedding",
    components: int = COMPONENTS,
    steps: int | None = None,
    tolerance: float = 0.0,
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each usable row and component.

    A row takes no part when its vector is null, empty, holds null or non-finite entries, or
    entries of 2^52 / 64 and more, or has another length than most (the longer of equally
    frequent lengths). Equal vectors count once in the fit and are all returned, as are rows
    with a null vec_id and repeated rows. ``deviation`` is exact. Directions without spread have
    no component, so there are as many as the rank allows, and none (no rows) for fewer than two
    different vectors or an empty table. Other columns are not read. Runs jobs: a pass over the
    distinct vectors for each of ``steps`` (default: the dimension, which makes the result whole;
    for very wide vectors, a ``tolerance`` of about 1e-14 ends them when the components asked for
    have settled, where eigenvalues do not coincide).

    The driver holds three numbers an entry and step; tasks hold a batch of vectors.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], RESULT)
    usable = (
        vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors[column].cast("array<double>").alias("vec"))
        .filter("size(vec) > 0")
        .filter(f"forall(vec, e -> e is not null and abs(e) < {MOST_ENTRY / SCALE!r}D)")
    )
    length = usable.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return empty
    dimension = length["d"]
    usable = usable.filter(F.size("vec") == dimension)
    fit = stage(usable.select("vec").mapInArrow(_packed, "x binary").distinct(), "fit")

    sums = {
        r["i"]: (r["high"] << LOW_BITS) + r["low"]
        for r in fit.mapInArrow(_moments(dimension), "i int, high long, low long")
        .groupBy("i")
        .agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
        .collect()
    }
    n = sums.pop(-1) >> LOW_BITS
    whole = np.array([sums[j] // n for j in range(dimension)], np.int64)
    rest = np.array([sums[j] % n for j in range(dimension)], np.int64)
    part = rest / n
    total = float(_summed(fit, _pass(dimension, whole, part, lambda a: np.array([(a * a).sum()])))[0])
    if total == 0.0:
        return empty

    def multiply(w: np.ndarray):
        both = _summed(fit, _pass(dimension, whole, part, _there_and_back(w)))
        return both[:-1], both[-1]

    wanted = min(components, dimension)
    axes, values = bidiagonalise(
        multiply, dimension, math.sqrt(total), wanted, min(steps or dimension, dimension), tolerance
    )
    wanted = min(wanted, int((values > FLAT * values[0]).sum()))
    axes, eigenvalues = axes[:, :wanted], values[:wanted] ** 2 / n
    # Either sign would do; the largest entry decides, so that reruns agree.
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(wanted)])
    explained = eigenvalues / (total / n)
    axes = axes / np.sqrt(eigenvalues)

    def products(a: np.ndarray) -> np.ndarray:
        y = a @ axes
        return np.concatenate([(y.T @ y).ravel(), y.sum(axis=0)])

    checked = _summed(fit, _pass(dimension, whole, part, products)) / n
    mean = checked[wanted * wanted :]
    spread = checked[: wanted * wanted].reshape(wanted, wanted) - np.outer(mean, mean)
    error = float(np.abs(spread - np.eye(wanted)).max())
    return usable.mapInArrow(_whitened(n, whole, part, rest, axes, explained, error), RESULT)
