"""Deep-shallow sorting of suffixes in numpy, as far as a fixed length.

To the shallow depth suffixes are sorted by multikey quicksort, a word of eight bytes for
a character: groups that agree so far are sorted by their next word, lone suffixes drop out.
What still agrees then has long common prefixes and goes to blind tries: a suffix chosen
from each group is the trie's path, every other one is compared with it once and leaves the
path where the two part, below the byte that it has there. Suffixes that leave at the same
place below the same byte form the group of the next trie.
"""

import numpy as np

SHALLOW = 32


def words(data: np.ndarray, beyond: int) -> np.ndarray:
    """The eight bytes from every position as one number that compares like them; zeros follow the end."""
    out = np.zeros(len(data) + beyond, np.uint64)
    for j in range(8):
        part = data[j:].astype(np.uint64)
        part <<= np.uint64(56 - 8 * j)
        out[: len(part)] |= part
    return out


def _common(word: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, length: int) -> np.ndarray:
    """How many bytes each pair of suffixes has in common, ``known`` of them given, at most ``length``."""
    lcp, live = known.copy(), np.arange(len(a))
    while len(live):
        x = word[a[live] + lcp[live]] ^ word[b[live] + lcp[live]]
        apart = x != 0
        ended, x = live[apart], x[apart]
        lcp[ended] += sum((x < np.uint64(1 << (64 - 8 * j))).astype(np.int64) for j in range(1, 8))
        live = live[~apart]
        lcp[live] += 8
        live = live[lcp[live] < length]
    return np.minimum(lcp, length)


def _split(group: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group numbers anew where any key changes, which of the sorted rows share theirs with another)."""
    change = group[1:] != group[:-1]
    for key in keys:
        change |= key[1:] != key[:-1]
    number = np.concatenate(([0], np.cumsum(change)))
    return number, (np.bincount(number) > 1)[number]


def sort_suffixes(
    data: np.ndarray, starts: np.ndarray, length: int, shallow: int = SHALLOW
) -> tuple[np.ndarray, np.ndarray]:
    """(order, same): ``starts[order]`` by the ``length`` bytes from each; whether one equals the one before.

    Every suffix must have ``length`` bytes. Equal ones stand together in any order.
    """
    n = len(starts)
    order, same = np.arange(n), np.zeros(n, bool)
    if n < 2:
        return order, same
    word = words(data, length + 8)
    place, group = np.arange(n), np.zeros(n, np.int64)
    depth = 0
    while depth < min(shallow, length) and len(place):
        key = word[starts[order[place]] + depth]
        if length - depth < 8:
            key >>= np.uint64(8 * (8 - length + depth))
        turn = np.lexsort((key, group)) if depth else np.argsort(key, kind="quicksort")
        order[place] = order[place][turn]
        group, kept = _split(group[turn], key[turn])
        place, group = place[kept], group[kept]
        depth += 8
    known = np.full(len(place), min(depth, length), np.int64)
    padded = np.concatenate([data, np.zeros(1, np.uint8)])
    while len(place):
        own = starts[order[place]]
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        sizes = np.diff(np.append(first, len(place)))
        path = np.repeat(own[first + sizes // 2], sizes)
        lcp = _common(word, own, path, known, length)
        byte = np.where(lcp < length, padded[own + np.minimum(lcp, length - 1)], 0).astype(np.int64)
        there = np.where(lcp < length, padded[path + np.minimum(lcp, length - 1)], 0).astype(np.int64)
        side = np.where(lcp < length, np.sign(byte - there), 0)
        # What leaves the path early lies further from it, on both sides.
        away = -side * lcp
        turn = np.lexsort((byte, away, side, group))
        order[place] = order[place][turn]
        side, lcp = side[turn], lcp[turn]
        number, kept = _split(group[turn], side, away[turn], byte[turn])
        equal = (side == 0) & np.concatenate(([False], number[1:] == number[:-1]))
        same[place[equal]] = True
        kept &= side != 0
        place, group, known = place[kept], number[kept], lcp[kept] + 1
    return order, same


def repeated(data: np.ndarray, starts: np.ndarray, length: int, shallow: int = SHALLOW) -> np.ndarray:
    """Whether the ``length`` bytes from each start are those from another start, too."""
    order, same = sort_suffixes(data, starts, length, shallow)
    out = np.zeros(len(starts), bool)
    out[order[same]] = True
    out[order[:-1][same[1:]]] = True
    return out
