"""Token ids of many texts by a public tokenizer file, each distinct piece of text encoded once.

Lower-cased runs of letters and runs of ASCII punctuation are pre-tokens of their own in
the word tokenizer, so they are looked up (or encoded by its BPE model alone); any other
word goes through the whole tokenizer. White space separates words and has no ids.
"""

import numpy as np
import pyarrow as pa

from .textops import buffers, slices, word_hashes, words

LETTERS, MARKS, OTHER = 1, 2, 3
# Units remembered by a task process, and the ids a remembered unit may have.
CACHE_BITS = 18
CACHE_IDS = 10
# Texts encoded at a time, as each byte takes about a hundred in arrays.
SLICE_BYTES = 1 << 17


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    out[65:91] = out[97:123] = LETTERS
    # ASCII punctuation, without the apostrophe (contractions) and the signs of special tokens.
    for sign in '!"#$%&()*+,-./:;=?@[\\]^_`{}~':
        out[ord(sign)] = MARKS
    return out


_CLASSES = _classes()


def _byte_letters() -> dict[int, str]:
    """The printable letter by which byte-level BPE writes each byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes, starts, ends, rows, whether a unit needs the whole tokenizer)."""
    starts, ends, rows = words(data, offsets)
    kind = _CLASSES[data]
    folded = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    # Two-byte Latin letters, U+00C0 to U+00FF but for the multiplication and division signs.
    lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, np.int64)
    tail = data[lead + 1]
    lead = lead[(tail >= 0x80) & (tail <= 0xBF) & (tail != 0x97) & (tail != 0xB7)]
    tail = data[lead + 1]
    kind[lead] = kind[lead + 1] = LETTERS
    folded[lead + 1] = np.where(tail <= 0x9E, tail + 32, tail)
    odd = np.concatenate(([0], np.cumsum(kind == OTHER)))
    hard = odd[ends] > odd[starts]
    lengths = ends - starts
    within = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
    hard_at = np.repeat(hard, lengths)
    kind[within[hard_at]] = OTHER
    folded[within[hard_at]] = data[within[hard_at]]
    new = np.ones(len(within), bool)
    if len(within):
        new[1:] = kind[within[1:]] != kind[within[:-1]]
        new[np.cumsum(lengths)[:-1]] = True
    at = np.flatnonzero(new)
    word = np.repeat(np.arange(len(starts)), lengths)[at]
    unit_starts = within[at]
    unit_ends = np.append(at[1:], len(within)) - at + unit_starts
    return folded, unit_starts, unit_ends, rows[word], hard[word]


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class Encoder:
    """Ids by one tokenizer. A table of fixed size, addressed by hash, remembers recent units."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(definition)
        self.model = self.whole.model
        self.keys = np.zeros(1 << CACHE_BITS, np.uint64)
        most = max(self.whole.get_vocab().values(), default=0)
        self.ids = np.zeros((1 << CACHE_BITS, CACHE_IDS), np.uint16 if most < 1 << 16 else np.uint32)
        self.sizes = np.zeros(1 << CACHE_BITS, np.uint8)

    def _unit(self, text: str, hard: bool) -> list[int]:
        if hard:
            return self.whole.encode(text, add_special_tokens=False).ids
        spelled = text if text.isascii() else "".join(_BYTE_LETTERS[b] for b in text.encode())
        return [t.id for t in self.model.tokenize(spelled)]

    def slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of each row."""
        folded, starts, ends, rows, hard = units(data, offsets)
        h = word_hashes(folded, starts, ends) | np.uint64(1)  # 0 marks an empty place
        at = (h >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        hit = np.flatnonzero(self.keys[at] == h)
        miss = np.flatnonzero(self.keys[at] != h)
        sizes = np.empty(len(h), np.int64)
        sizes[hit] = self.sizes[at[hit]]
        known = self.ids[at[hit]][np.arange(CACHE_IDS) < sizes[hit][:, None]]

        distinct, first, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
        raw, first = folded.tobytes(), miss[first]
        found = [
            self._unit(raw[a:b].decode(), whole)
            for a, b, whole in zip(starts[first].tolist(), ends[first].tolist(), hard[first].tolist())
        ]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(lengths.sum()))
        begin = np.cumsum(lengths) - lengths
        sizes[miss] = lengths[inverse]

        short = np.flatnonzero(lengths <= CACHE_IDS)
        place = (distinct[short] >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        place, pick = np.unique(place, return_index=True)
        short = short[pick]
        self.keys[place], self.sizes[place] = distinct[short], lengths[short]
        column = np.arange(CACHE_IDS)
        self.ids[place] = np.append(flat, np.zeros(CACHE_IDS, np.uint32))[begin[short][:, None] + column]

        start = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.uint32)
        out[_runs(start[hit], sizes[hit])] = known
        out[_runs(start[miss], sizes[miss])] = flat[_runs(begin[inverse], sizes[miss])]
        tokens = np.bincount(rows, sizes, minlength=len(offsets) - 1).astype(np.int64)
        return out, np.concatenate(([0], np.cumsum(tokens)))

    def rows(self, texts: pa.Array):
        """(first row, ids, bounds) of runs of rows of a string column; null counts as empty."""
        data, offsets = buffers(texts)
        for i, j in slices(offsets, SLICE_BYTES):
            yield i, *self.slice(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


_ENCODERS: dict[int, Encoder] = {}


def encoder(definition: str) -> Encoder:
    """The task process's encoder of a tokenizer, kept between tasks."""
    key = hash(definition)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(definition)
    return _ENCODERS[key]
