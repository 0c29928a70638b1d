"""Passages that repeat across documents, found by hashing sliding runs of sentences.

A sentence ends at ``. ! ?``, or for long ones' sake at ``, ; :``, before white space, at a
line break, and after every word whose own hash asks for it (one of ``CUT``): so long
sentences are cut at the same words wherever a passage stands, and text around it spoils
only its first and last piece. Every sentence starts a run and ends one: the fewest
sentences, at least ``sentences``, that hold at least ``words`` words. Runs are joined
globally by hash, the first place of each stays, and the sentences of all its later
places are removed.

The join first finds the hashes that occur more than once, from hashes alone; only runs
with one of those send their places, which a second hash tells apart.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import HIDDEN, hash_bitmap, may_hold, member_filter, stage, with_maybe
from .textops import buffers, mix, slices, word_hashes, words

SENTENCES = 3
WORDS = 30
CUT = 4
ENDS = b".!?,;:"
# Texts read at a time: arrays of eight bytes a byte then stay in the processor's cache.
SLICE_BYTES = 1 << 17


def cuts_after(hashes: np.ndarray) -> np.ndarray:
    """Which words end a sentence whatever follows, from the words' hashes."""
    return mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(CUT) == 0


def sentence_spans(
    data: np.ndarray, offsets: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end byte, row, words, hash) of each sentence.

    The hash covers the sentence's words, not the white space between them. A sentence's
    bytes go from its first word to the end of its last.
    """
    starts, ends, rows = words(data, offsets)
    n = len(starts)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64)
    stop = np.isin(data[ends - 1], np.frombuffer(ENDS, np.uint8))
    # A line break between this word and the next.
    breaks = np.concatenate(([0], np.cumsum((data == 10) | (data == 13))))
    following = np.append(starts[1:], len(data))
    stop |= breaks[following] > breaks[ends]
    stop |= np.append(rows[1:] != rows[:-1], True)
    h = word_hashes(data, starts, ends)
    stop |= cuts_after(h)
    last = np.flatnonzero(stop)
    first = np.concatenate(([0], last[:-1] + 1))
    place = np.arange(n) - np.repeat(first, last - first + 1)
    h = mix(h + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)))
    return starts[first], ends[last], rows[first], last - first + 1, running[last + 1] - running[first]


def runs(rows: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, least: int, words_least: int):
    """(first sentence, end sentence, hash) of the runs that sentences start or end within their text."""
    n = len(rows)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, none
    total = np.concatenate(([0], np.cumsum(sizes)))
    here = np.arange(n)
    end = np.maximum(np.searchsorted(total, total[:-1] + words_least, side="left"), here + least)
    begin = np.minimum(np.searchsorted(total, total[1:] - words_least, side="right") - 1, here + 1 - least)
    ahead = end <= np.searchsorted(rows, rows, side="right")
    back = begin >= np.searchsorted(rows, rows)
    # A span that one sentence starts and another ends is one run.
    both = np.concatenate((here[ahead] * (n + 1) + end[ahead], begin[back] * (n + 1) + here[back] + 1))
    begin, end = np.divmod(np.unique(both), n + 1)
    return begin, end, run_hashes(begin, end, hashes, 0x9FB21C651E98DF25)


def run_hashes(begin: np.ndarray, end: np.ndarray, hashes: np.ndarray, factor: int) -> np.ndarray:
    """Order matters within a run: hashes scrambled one after the other from the run's start."""
    out, sizes = np.zeros(len(begin), np.uint64), end - begin
    for j in range(int(sizes.max(initial=0))):
        live = np.flatnonzero(sizes > j)
        out[live] = mix(out[live] * np.uint64(factor) + hashes[begin[live] + j])
    return out.view(np.int64)


def second_hashes(begin: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return run_hashes(begin, end, mix(hashes ^ np.uint64(0xD1B54A32D192ED03)), 0x9E3779B97F4A7C15)


def _run_rows(least: int, words_least: int, bitmap=None):
    """Runs of texts: their hashes alone, or with their places those whose hash is in the bitmap."""

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in slices(offsets, SLICE_BYTES):
                _, _, rows, sizes, hashes = sentence_spans(
                    data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                )
                begin, end, h = runs(rows, sizes, hashes, least, words_least)
                if bitmap is None:
                    yield pa.RecordBatch.from_arrays([pa.array(h)], ["run"])
                    continue
                hit = np.flatnonzero(may_hold(bitmap.value, h))
                if not len(hit):
                    continue
                begin, end, h = begin[hit], end[hit], h[hit]
                first = np.searchsorted(rows, rows[begin])
                whose = pa.array(rows[begin])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h),
                        pa.array(second_hashes(begin, end, hashes)),
                        batch.column("doc_id").slice(i, j - i).take(whose),
                        batch.column("text_id").slice(i, j - i).take(whose),
                        pa.array((begin - first).astype(np.int32)),
                        pa.array((end - first).astype(np.int32)),
                    ],
                    ["run", "again", "doc_id", "text_id", "first", "stop"],
                )

    return run


def _cut(schema: pa.DataType):
    """Texts without the sentences of their spans."""

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            spans = batch.column("spans").to_pylist()
            texts, removed = [], []
            for i, j in slices(offsets, SLICE_BYTES):
                own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, _, of, _, _ = sentence_spans(own, at)
                raw = own.tobytes()
                for k in range(i, j):
                    a, b = np.searchsorted(of, [k - i, k - i + 1])
                    kept = np.ones(b - a, bool)
                    for span in spans[k]:
                        kept[span["first"] : span["stop"]] = False
                    # A sentence goes with the white space after it.
                    edges = np.append(starts[a:b], at[k - i + 1])
                    turns = np.flatnonzero(np.diff(np.concatenate(([False], kept, [False])).astype(np.int8)))
                    parts = [raw[int(at[k - i]) : int(edges[0])]]
                    parts += [raw[int(edges[x]) : int(edges[y])] for x, y in zip(turns[::2], turns[1::2])]
                    texts.append(b"".join(parts).decode())
                    removed.append(int((~kept).sum()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(texts, pa.string()),
                    pa.array(removed, pa.int32()),
                    pa.array(spans, schema),
                ],
                ["doc_id", "text", "n_removed", "spans"],
            )

    return run


def dedup_spans(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, text, n_removed, spans, changed.

    ``spans`` lists the (first, stop) sentence ranges that repeat an earlier place, in the
    document or in one of a smaller doc_id; ``text`` is the text without their sentences,
    n_removed the number of these. Texts of fewer than ``sentences`` sentences or ``words``
    words have no run; null stays null. Very long texts are read whole. Of
    repeated places the one of the smallest doc_id and position stays. Documents are told
    by doc_id and text: rows that repeat both count as one document and are cut alike, rows
    that share a doc_id only are documents of their own. A row with a null doc_id
    can't be addressed: it is neither a first place nor cut. An empty table gives no rows;
    other columns are not read. Runs jobs.
    """
    text = docs["text"]
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_id"), text.alias("text"))
    known = narrow.filter("doc_id is not null and text is not null")
    hashes = known.select("text").mapInArrow(_run_rows(sentences, words), "run long")
    repeated = stage(hashes.groupBy("run").agg(F.count("*").alias("n")).filter("n > 1").select("run"), "repeated")
    bitmap = docs.sparkSession.sparkContext.broadcast(hash_bitmap(repeated, "run"))
    places = known.mapInArrow(
        _run_rows(sentences, words, bitmap), "run long, again long, doc_id long, text_id long, first int, stop int"
    )
    held = stage(places.join(repeated, "run"), "places")
    place = F.struct("doc_id", "text_id", "first")
    # A run that a third of all documents hold is one row per task here.
    firsts = held.groupBy("run", "again").agg(F.min(place).alias("low"), F.max(place).alias("high")).filter("low <> high")
    later = held.join(firsts.select("run", "again", "low"), ["run", "again"]).filter(place != F.col("low"))
    spans = F.sort_array(F.collect_set(F.struct("first", "stop"))).alias("spans")
    gone = stage(later.groupBy("doc_id", "text_id").agg(spans), "spans")
    marked = with_maybe(narrow, "text_id", member_filter(gone, "text_id"))
    several = marked.filter(HIDDEN + "maybe").join(gone, ["doc_id", "text_id"], "left")
    found = F.col("spans").isNotNull() & F.col("text").isNotNull()
    empty = "array<struct<first:int,stop:int>>"
    arrow = pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32())]))
    changed = several.filter(found).select("doc_id", "text", "spans").mapInArrow(
        _cut(arrow), f"doc_id long, text string, n_removed int, spans {empty}"
    )
    same = [
        part.select("doc_id", "text", F.lit(0).alias("n_removed"), F.expr(f"cast(array() as {empty})").alias("spans"))
        for part in (marked.filter(~F.col(HIDDEN + "maybe")), several.filter(~found))
    ]
    return changed.unionByName(same[0]).unionByName(same[1]).withColumn("changed", F.col("n_removed") > 0)
