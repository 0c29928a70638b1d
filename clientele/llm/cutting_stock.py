"""Cutting stock by column generation: how to fill sequences from a histogram of lengths.

Works on counts by length class only, at most ``capacity`` classes, so its size does not
depend on the number of documents.
"""

import numpy as np

GAP = 5e-4


def _best_pattern(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The filling of one sequence with the highest price: an unbounded knapsack by dynamic programming."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1, np.int64)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        n = fits[room]
        if n:
            worth = best[room - sizes[:n]] + prices[:n]
            i = int(np.argmax(worth))
            if worth[i] > best[room] + 1e-12:
                best[room], pick[room] = worth[i], i
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if pick[room] < 0:
            room -= 1
        else:
            pattern[pick[room]] += 1
            room -= int(sizes[pick[room]])
    return float(best[capacity]), pattern


def relaxed(sizes: np.ndarray, counts: np.ndarray, capacity: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, how often): a linear program over patterns, its columns priced by the knapsack.

    Simplex on the basis inverse. Ends when no column improves or when the dual bound
    proves the value to be within ``gap`` of the optimum.
    """
    m = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(basis))
    value = inverse @ counts
    best_bound = 0.0
    for step in range(50 * m + 50):
        if step % 100 == 99:
            inverse = np.linalg.inv(basis)
            value = np.maximum(inverse @ counts, 0)
        # A column of -1 stands for a slot left empty: it costs nothing.
        costs = (basis.max(axis=0) > 0).astype(float)
        prices = costs @ inverse
        worst = int(np.argmin(prices))
        if prices[worst] < -1e-9:
            column, cost = np.zeros(m), 0.0
            column[worst] = -1
        else:
            worth, pattern = _best_pattern(sizes, np.maximum(prices, 0), capacity)
            total = float(costs @ value)
            best_bound = max(best_bound, float(prices @ counts) / max(worth, 1.0))
            if worth <= 1 + 1e-7 or total <= best_bound * (1 + gap):
                break
            column, cost = pattern.astype(float), 1.0
        direction = inverse @ column
        up = direction > 1e-9
        if not up.any():
            break
        ratio = np.full(m, np.inf)
        ratio[up] = value[up] / direction[up]
        leave = int(np.argmin(ratio))
        value = np.maximum(value - ratio[leave] * direction, 0)
        value[leave] = ratio[leave]
        basis[:, leave] = column
        row = inverse[leave] / direction[leave]
        inverse -= np.outer(direction, row)
        inverse[leave] = row
    real = basis.max(axis=0) > 0
    return basis[:, real].T.astype(np.int64), value[real]


def plan(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns with whole multiplicities that hold every item: the program's, rounded down, then the rest.

    The rest is less than one sequence for each pattern; the largest classes that still fit go first.
    """
    sizes, left = np.asarray(sizes, np.int64), np.asarray(counts, np.int64).copy()
    out = []
    if not len(sizes):
        return out
    patterns, times = relaxed(sizes, left.astype(float), capacity)
    for pattern, often in zip(patterns, np.floor(times + 1e-9).astype(np.int64)):
        held = pattern > 0
        # Where the program leaves slots empty, a pattern is used only as long as it can be filled.
        often = int(min(often, (left[held] // pattern[held]).min()))
        if often > 0:
            out.append((pattern, often))
            left -= pattern * often
    while left.any():
        pattern, room = np.zeros(len(sizes), np.int64), capacity
        for i in range(len(sizes) - 1, -1, -1):
            take = min(int(left[i]), room // int(sizes[i]))
            pattern[i], room = take, room - take * int(sizes[i])
        held = pattern > 0
        often = int((left[held] // pattern[held]).min())
        out.append((pattern, often))
        left -= pattern * often
    return out
