"""Substring dedup by suffix sorting: bytes inside any string of a given length that occurs twice.

Sorting the suffixes of all texts in one array can't be dealt to tasks, so they are first
dealt by content: the key of a string of ``length`` bytes is the least hash of the seeds (of
``SEED_BYTES`` bytes) in it. Equal strings have equal keys, and neighbouring strings mostly
share one, so a text falls into runs of strings with one key. Keys that occur once are done
with. The rest of the runs, as segments of text, meet by key in shards of bounded size,
and each shard sorts its suffixes deep and shallow.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import hash_bitmap, may_hold, stage, text_of
from .suffix_sort import repeated
from .textops import _ODD, _PLAIN, _Powers, buffers, slices

LENGTH = 400
SEED_BYTES = 64
# Strings of a run, so that a segment is bounded whatever a text repeats.
RUN = 2_048
# Texts read, and segments sorted, at a time: arrays of eight bytes a byte then stay in the processor's cache.
BLOCK_BYTES = 1 << 16
SORT_BYTES = 1 << 17
# Segment bytes that one shard sorts. A key that holds more is dealt by string instead.
SHARD_BYTES = 8 << 20
OUT_BYTES = 4 << 20

FOUND = "sha binary, first int, n int, key long, again boolean, seg binary, bytes binary"
VERDICT = "seg binary, low array<int>, high array<int>"
RANGES = pa.list_(pa.int32())


def _seeds(data: np.ndarray, seed: int) -> np.ndarray:
    """A hash of the ``seed`` bytes from each position, as differences of running sums."""
    up, down = _Powers.get(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_PLAIN[data] * up, out=sums[1:])
    h = (sums[seed:] - sums[:-seed]) * down[: len(data) - seed + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(_ODD)
    return h


def _least(h: np.ndarray, span: int) -> np.ndarray:
    """The least of each ``span`` neighbours."""
    done = 1
    while done * 2 <= span:
        h = np.minimum(h[:-done], h[done:])
        done *= 2
    rest = span - done
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def runs(data: np.ndarray, offsets: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """(first position, strings, key, again) of the runs of one slice of texts; ``offsets`` begin at 0.

    ``again``: the run holds its least seed in two places, one of them the first seed of a string
    that the run goes on after. Only then can strings of one run be equal: the text between
    them is periodic, so the first of these seeds in the first of them is passed on the way.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(bool)
    seeds = _seeds(data, seed)
    key = _least(seeds, length - seed + 1)
    inside = np.zeros(len(data) + 1, np.int64)
    long = np.diff(offsets) >= length
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(inside)[: len(key)] > 0)
    if not len(at):
        return none, none, none, none.astype(bool)
    key = key[at]
    passed = (seeds[at] == key).astype(np.int64)
    key = key.view(np.int64)
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)))
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(at)))
    if n.max() > RUN:
        head = np.concatenate([np.arange(a, a + m, RUN) for a, m in zip(head.tolist(), n.tolist())])
        n = np.diff(np.append(head, len(at)))
    again = np.add.reduceat(passed, head) - passed[head + n - 1] > 0
    return at[head], n, key[head], again


def _blocks(data: np.ndarray, offsets: np.ndarray, length: int):
    """(data, offsets, first row, position of the data in its text) of slices; a long text comes in overlapping blocks."""
    for a, b in slices(offsets, 2 * BLOCK_BYTES):
        lo, hi = offsets[a], offsets[b]
        if hi - lo <= 2 * BLOCK_BYTES:
            yield data[lo:hi], offsets[a : b + 1] - lo, a, 0
            continue
        # Such a slice is one text. Each string of it begins in exactly one block.
        for at in range(lo, max(hi - length + 1, lo + 1), BLOCK_BYTES):
            end = min(at + BLOCK_BYTES + length - 1, hi)
            yield data[at:end], np.array([0, end - at]), a, at - lo


def _keys(length: int, seed: int):
    """(key, n): the keys of a block of texts, once each, n = 2 where strings may repeat in the block."""

    def task(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for part, bounds, _, _ in _blocks(data, offsets, length):
                _, _, key, again = runs(part, bounds, length, seed)
                key, place = np.unique(key, return_inverse=True)
                n = np.minimum(np.bincount(place, 1.0 + again, len(key)), 2).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    return task


def _segments(length: int, seed: int, bitmap):
    """The runs whose key may occur twice; equal segments of a block carry their bytes once."""

    def task(batches):
        words = bitmap.value
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            shas = batch.column("sha").to_pylist()
            for part, bounds, row, skipped in _blocks(data, offsets, length):
                first, n, key, again = runs(part, bounds, length, seed)
                hit = may_hold(words, key)
                first, n, key, again = first[hit], n[hit], key[hit], again[hit]
                text = np.searchsorted(bounds, first, side="right") - 1
                inner = first - bounds[text] + skipped
                raw, seen, held, out = part.tobytes(), set(), 0, []
                columns = (first, n, key, again, text, inner)
                for f, size, k, twice, t, i in zip(*[c.tolist() for c in columns]):
                    own = raw[f : f + size + length - 1]
                    seg = hashlib.blake2b(own, digest_size=16).digest()
                    out.append((shas[row + t], i, size, k, twice, seg, None if seg in seen else own))
                    held += 0 if seg in seen else len(own)
                    seen.add(seg)
                    if held > OUT_BYTES:
                        yield _found(out)
                        out, held = [], 0
                if out:
                    yield _found(out)

    return task


def _found(rows: list) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
    names = ["sha", "first", "n", "key", "again", "seg", "bytes"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _sorted(length: int):
    """Of one shard: the strings that occur in another place as well, of each segment that itself does not."""

    def strings(parts: list[bytes], many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(segment, position in it) of the strings found twice."""
        size = np.array([len(p) for p in parts], np.int64)
        count = size - length + 1
        owner = np.repeat(np.arange(len(parts)), count)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        data = np.frombuffer(b"".join(parts), np.uint8)
        twice = repeated(data, (np.cumsum(size) - size)[owner] + inner, length) & ~many[owner]
        return owner[twice], inner[twice]

    def shard(table: pa.Table) -> pa.Table:
        # Equal strings have one key, so segments are sorted some keys at a time.
        table = table.sort_by("key")
        parts, many = table.column("bytes").to_pylist(), table.column("n").to_numpy() > 1
        key, ends = table.column("key").to_numpy(), np.cumsum([len(p) for p in parts])
        last = np.flatnonzero(np.append(key[1:] != key[:-1], True))
        full = np.flatnonzero(np.diff(ends[last] // SORT_BYTES, prepend=0, append=ends[-1] // SORT_BYTES + 1)[1:])
        owner, inner, start = [], [], 0
        for stop in (last[full] + 1).tolist():
            who, at = strings(parts[start:stop], many[start:stop])
            owner.append(who + start)
            inner.append(at)
            start = stop
        owner, inner = np.concatenate(owner), np.concatenate(inner)
        if not len(owner):
            return _verdicts([], [], [])
        new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (inner[1:] != inner[:-1] + 1)))
        low, high = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(owner)) - 1
        mine = owner[low]
        cut = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
        segs = table.column("seg").take(pa.array(mine[cut])).to_pylist()
        return _verdicts(segs, np.split(inner[low], cut[1:]), np.split(inner[high], cut[1:]))

    return shard


def _verdicts(segs, low, high) -> pa.Table:
    return pa.table({"seg": pa.array(segs, pa.binary()), "low": pa.array(low, RANGES), "high": pa.array(high, RANGES)})


def _strings(length: int):
    """Of the segments of a key that is too large for one shard: each string's fingerprint."""

    def task(batches):
        for batch in batches:
            for seg, own in zip(batch.column("seg").to_pylist(), batch.column("bytes").to_pylist()):
                n = len(own) - length + 1
                prints = [hashlib.blake2b(own[i : i + length], digest_size=16).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([seg] * n, pa.binary()), pa.array(np.arange(n, dtype=np.int32)), pa.array(prints, pa.binary())],
                    ["seg", "place", "string"],
                )

    return task


def _cut(length: int):
    """The removed ranges of a text, joined, and the hash of what is left."""
    pairs = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def task(batches):
        for batch in batches:
            spans, kept = [], []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
                raw, out, at, left = text.encode(), [], 0, hashlib.sha256()
                for r in sorted((r["low"], r["high"] + length) for r in ranges):
                    if out and r[0] <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], r[1])
                    else:
                        out.append(list(r))
                for start, stop in out:
                    left.update(raw[at:start])
                    at = stop
                left.update(raw[at:])
                spans.append([{"start": a, "stop": b} for a, b in out])
                kept.append(left.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("sha"), pa.array(spans, pairs), pa.array(kept)], ["sha", "spans", "kept_sha256"]
            )

    return task


def repeated_spans(
    docs: DataFrame, length: int = LENGTH, seed: int = SEED_BYTES, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, spans, kept_sha256.

    ``spans`` lists the ranges of bytes (start, stop) covered by a string of ``length`` bytes that
    also starts anywhere else, in any text or in the same one, overlapping or not; all its places
    go, the first as well. ``kept_sha256`` is that of the bytes left. Texts are UTF-8 bytes, null
    counts as empty and a text of fewer bytes keeps them. Repeated rows are texts of their own,
    so equal texts of ``length`` bytes go whole, whatever their doc_ids. A very long text is
    read in blocks, which changes no result. Other columns are not read; an empty table gives no
    rows. Runs jobs.

    ``shard_bytes`` bounds what a task sorts. The segments of a key that holds more are compared by
    the 128-bit fingerprints of their strings, dealt by fingerprint. The driver sees a bitmap of a
    fixed size.
    """
    spark = docs.sparkSession
    text = text_of(docs)
    named = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("sha")
    )
    sized = F.octet_length("text").cast("long")
    texts = named.filter(sized >= length).select("sha", "text")
    keys = texts.mapInArrow(_keys(length, seed), "key long, n int").groupBy("key").agg(F.sum("n").alias("n"))
    keys = stage(keys.filter("n > 1").select("key"), "keys")
    bitmap = spark.sparkContext.broadcast(hash_bitmap(keys, "key"))
    found = stage(texts.mapInArrow(_segments(length, seed, bitmap), FOUND), "segments")

    segments = found.groupBy("seg", "key", "again").agg(F.count("*").alias("n"), F.first("bytes", ignorenulls=True).alias("bytes"))
    segments = stage(segments, "distinct-segments")
    by_key = segments.groupBy("key").agg(
        F.sum(F.octet_length("bytes")).alias("size"), F.sum("n").alias("n"), (F.bool_or("again") | (F.count("*") > 1)).alias("sort")
    )
    by_key = stage(by_key.filter("n > 1 or sort"), "key-sizes")
    size = by_key.filter(f"sort and size <= {shard_bytes}").agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-2 * size // shard_bytes))
    compared = segments.join(by_key.filter("sort").select("key", "size"), "key")
    shard = F.expr(f"pmod(xxhash64(key), {shards})")
    sorted_ = (
        compared.filter(F.col("size") <= shard_bytes)
        .select("seg", "key", "n", "bytes", shard.alias("shard"))
        .groupBy("shard")
        .applyInArrow(_sorted(length), VERDICT)
    )
    # All strings of a segment that repeats do.
    whole = F.expr(f"octet_length(bytes) - {length}")
    alike = segments.filter("n > 1").select("seg", F.array(F.lit(0)).alias("low"), F.array(whole).alias("high"))
    strings = stage(
        compared.filter(F.col("size") > shard_bytes).select("seg", "bytes").mapInArrow(
            _strings(length), "seg binary, place int, string binary"
        ),
        "strings",
    )
    twice = strings.groupBy("string").agg(F.count("*").alias("m")).filter("m > 1").select("string")
    dealt = strings.join(twice, "string").groupBy("seg").agg(F.collect_list("place").alias("low"))
    verdicts = stage(sorted_.union(alike).union(dealt.select("seg", "low", F.col("low").alias("high"))), "verdicts")

    empty = F.sha2(F.lit(""), 256)
    rows = named.select("doc_id", "sha", sized.alias("n_bytes"))
    copies = rows.filter(F.col("n_bytes") >= length).groupBy("sha", "n_bytes").agg(F.count("*").alias("n"))
    copies = stage(copies.filter("n > 1").select("sha", "n_bytes"), "copies")
    ranges = F.expr(
        "inline(transform(arrays_zip(low, high), r -> named_struct('low', first + r.low, 'high', first + r.high)))"
    )
    places = found.select("sha", "first", "seg").distinct().join(verdicts, "seg").select("sha", ranges)
    covers = places.groupBy("sha").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    covers = stage(covers.join(copies, "sha", "left_anti"), "covers")
    spans = "array<struct<start:int,stop:int>>"
    cut = texts.join(covers, "sha").mapInArrow(_cut(length), f"sha binary, spans {spans}, kept_sha256 string")
    gone = copies.select(
        "sha",
        F.expr("array(named_struct('start', 0, 'stop', cast(n_bytes as int)))").alias("spans"),
        empty.alias("kept_sha256"),
    )
    results = stage(cut.union(gone), "cut")
    return rows.join(results, "sha", "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("spans", F.expr(f"cast(array() as {spans})")).alias("spans"),
        F.coalesce("kept_sha256", F.lower(F.hex("sha"))).alias("kept_sha256"),
    )
