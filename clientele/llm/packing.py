"""Packing documents into token sequences by cutting-stock column generation.

A document longer than a sequence is cut into full sequences and a rest. Only the
histogram of the rests by length class reaches the driver; it solves a linear program
over patterns there, rounds it, and hands back a table of patterns. Every rest is ranked
in its class (task by task, with the sums of the tasks before it) and looks up its
sequence and slot by that rank. Offsets are running sums inside one sequence.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cutting_stock import plan
from .jobs import stage, text_of
from .tokens import encoder

LENGTH = 4096
GRAIN = 8
END_ID = 2

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, chunk int, class int, place long"


def _cutter(definition, end_id: int, length: int, grain: int, with_ids: bool):
    def run(batches):
        encode = encoder(definition.value)
        classes = -(-length // grain) + 1
        chunk, seen = TaskContext.get().partitionId(), np.zeros(classes, np.int64)
        for batch in batches:
            ids = batch.column("doc_id")
            for first, tokens, bounds in encode.rows(batch.column("text")):
                n = len(bounds) - 1
                sizes = np.diff(bounds) + 1
                whole, rest = sizes // length, sizes % length
                pieces = whole + (rest > 0)
                row = np.repeat(np.arange(n), pieces)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = nth * length
                size = np.minimum(length, sizes[row] - start)
                kind = np.where(size == length, 0, -(-size // grain)).astype(np.int32)
                order = np.argsort(kind, kind="stable")
                ranked = kind[order]
                change = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
                group = np.diff(np.append(change, len(ranked)))
                place = np.empty(len(row), np.int64)
                place[order] = seen[ranked] + np.arange(len(row)) - np.repeat(change, group)
                seen += np.bincount(kind, minlength=classes)
                # Every document's ids and its end id, one after the other.
                ended = np.insert(tokens, bounds[1:], np.uint32(end_id)).astype("<u4")
                at = bounds[:-1][row] + row + start
                raw = memoryview(ended.tobytes())
                crc = [zlib.crc32(raw[a * 4 : (a + s) * 4]) for a, s in zip(at.tolist(), size.tolist())]
                columns = [
                    ids.slice(first, n).take(pa.array(row)),
                    pa.array(start),
                    pa.array(size),
                    pa.array(crc, pa.int64()),
                    pa.array(sizes[row]),
                    pa.array(np.full(len(row), chunk, np.int32)),
                    pa.array(kind),
                    pa.array(place),
                ]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "chunk", "class", "place"]
                if with_ids:
                    cuts = np.concatenate(([0], np.cumsum(size)))
                    own = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ended.astype(np.int32)))
                    columns, names = [*columns, own], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _seater(patterns: list, classes: list[int], first_full: int, columns: list[str]):
    """Sequence and slot of a piece from its class and rank; the pattern table is bounded by the classes."""
    tables = {}
    for i, c in enumerate(classes):
        begin, rank, base, slot = [], 0, 0, []
        for pattern, often in patterns:
            if pattern[i]:
                begin.append((rank, base, often, int(pattern[:i].sum())))
                rank += int(pattern[i]) * often
            base += often
        tables[c] = np.array(begin, np.int64).reshape(-1, 4)

    def run(batches):
        for batch in batches:
            kind, rank = batch.column("class").to_numpy(), batch.column("rank").to_numpy()
            sequence, slot = np.empty(len(kind), np.int64), np.zeros(len(kind), np.int64)
            for c in np.unique(kind):
                own = np.flatnonzero(kind == c)
                if c == 0:
                    sequence[own] = first_full + rank[own]
                    continue
                table = tables[c]
                use = table[np.searchsorted(table[:, 0], rank[own], side="right") - 1]
                within = rank[own] - use[:, 0]
                sequence[own] = use[:, 1] + within % use[:, 2]
                slot[own] = use[:, 3] + within // use[:, 2]
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(slot)], [*columns, "sequence_id", "slot"])

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    length: int = LENGTH,
    grain: int = GRAIN,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    ``tokenizer`` is the definition (JSON) of a public tokenizer. A document is its ids
    without special ones, then ``end_id``, so a null or empty text is one token long.
    Pieces of a sequence lie one after the other from offset 0 and never exceed
    ``length``. Only documents longer than that are cut. Rests are planned by their length
    in steps of ``grain``, so padding is about half a step for each piece, plus at most
    one part-filled sequence a pattern. Repeated rows are packed each; a doc_id may be
    null; other columns are not read; an empty table gives no rows. Runs jobs.

    The length histogram on the driver has at most ``length / grain`` rows.
    """
    spark = docs.sparkSession
    definition = spark.sparkContext.broadcast(tokenizer)  # of the tokenizer's own, fixed size
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    schema = PIECE + (", ids array<int>" if with_ids else "")
    pieces = stage(narrow.mapInArrow(_cutter(definition, end_id, length, grain, with_ids), schema), "pieces")
    counted = pieces.groupBy("chunk", "class").agg(F.count("*").alias("n"))
    before = counted.selectExpr(
        "chunk", "class", "sum(n) over (partition by class order by chunk) - n as before"
    )
    histogram = {r["class"]: r["n"] for r in pieces.groupBy("class").agg(F.count("*").alias("n")).collect()}
    classes = sorted(c for c in histogram if c)
    patterns = plan(np.array(classes), np.array([histogram[c] for c in classes]), length // grain)
    first_full = sum(often for _, often in patterns)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + (["ids"] if with_ids else [])
    ranked = pieces.join(before, ["chunk", "class"]).select(
        *columns, "class", (F.col("place") + F.col("before")).alias("rank")
    )
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name in columns]
    seated = ranked.mapInArrow(
        _seater(patterns, classes, first_full, columns), ", ".join(kept) + ", sequence_id long, slot long"
    )
    offset = "coalesce(sum(length) over (partition by sequence_id order by slot rows between unbounded preceding and 1 preceding), 0L)"
    return seated.selectExpr(
        *columns[:5], "sequence_id", f"{offset} as offset", *(["ids"] if with_ids else [])
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids) from ``pack(..., with_ids=True)``: each at most one sequence long."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
