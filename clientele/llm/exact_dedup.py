"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Each task sorts the fingerprints of its rows, cuts them by owner (a range of the
fingerprint space) and sends every owner one Golomb-coded packet. The owner answers
each packet with a bitmap of the fingerprints seen more than once. Rows behind a set
bit are suspects; only their texts are shuffled and compared byte by byte. All others
are unique: fingerprints come from the text's SHA-256, so equal texts always collide.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.operators.joins import ROWS_PER_TASK, hot_keys, join_to_unique

from .golomb import decode, divisor_bits, encode, pack, unpack
from .jobs import HIDDEN, member_filter, partitions, stage, text_of, with_maybe

CHUNK_ROWS = 500_000
OWNER_ROWS = 2_000_000
SLACK_BITS = 10

PACKETS = "chunk long, owner int, n int, k int, code binary, many binary, counts binary, doc_ids array<long>, shas binary"
ANSWERS = "chunk long, owner int, dup binary"
ENTRIES = "doc_id long, sha binary, row long, suspect boolean"


def _sender(width: int, owner_bits: int, chunk_rows: int):
    def packets(chunk: int, ids: list, shas: list):
        ids = pa.chunked_array(ids).combine_chunks()
        raw = np.frombuffer(b"".join(shas), np.uint8).reshape(-1, 32)
        prints = raw[:, :8].copy().view(">u8").ravel() >> np.uint64(64 - width)
        order = np.argsort(prints, kind="stable")
        prints, raw = prints[order].astype(np.int64), raw[order]
        first = np.flatnonzero(np.concatenate(([True], prints[1:] != prints[:-1])))
        distinct, counts = prints[first], np.diff(np.append(first, len(prints)))
        owner = distinct >> (width - owner_bits)
        cuts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1], [True])))
        rows = np.append(first, len(prints))
        for a, b in zip(cuts[:-1], cuts[1:]):
            low = int(owner[a]) << (width - owner_bits)
            k = divisor_bits(width, int(max(b - a, 1)) << owner_bits)
            lo, hi = rows[a], rows[b]
            yield {
                "chunk": chunk,
                "owner": int(owner[a]),
                "n": int(b - a),
                "k": k,
                "code": encode(distinct[a:b] - low, k),
                "many": pack(counts[a:b] > 1),
                "counts": counts[a:b].astype(np.int32).tobytes(),
                "doc_ids": ids.take(pa.array(order[lo:hi])).to_pylist(),
                "shas": raw[lo:hi].tobytes(),
            }

    def run(batches):
        chunk, ids, shas, held = TaskContext.get().partitionId() << 20, [], [], 0
        for batch in batches:
            ids.append(batch.column("doc_id"))
            shas.append(b"".join(batch.column("sha").to_pylist()))
            held += batch.num_rows
            if held >= chunk_rows:
                yield from _batches(packets(chunk, ids, shas))
                chunk, ids, shas, held = chunk + 1, [], [], 0
        if held:
            yield from _batches(packets(chunk, ids, shas))

    def _batches(rows, most=256):
        schema = pa.schema(
            [
                ("chunk", pa.int64()),
                ("owner", pa.int32()),
                ("n", pa.int32()),
                ("k", pa.int32()),
                ("code", pa.binary()),
                ("many", pa.binary()),
                ("counts", pa.binary()),
                ("doc_ids", pa.list_(pa.int64())),
                ("shas", pa.binary()),
            ]
        )
        held = []
        for row in rows:
            held.append(row)
            if len(held) == most:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return run


def _answer(table: pa.Table) -> pa.Table:
    """One owner: which fingerprints of each packet occur more than once over all packets."""
    sizes = table.column("n").to_pylist()
    codes, divisors = table.column("code").to_pylist(), table.column("k").to_pylist()
    values = [decode(code, n, k) for code, n, k in zip(codes, sizes, divisors)]
    local = [unpack(many, n) for many, n in zip(table.column("many").to_pylist(), sizes)]
    _, inverse, counts = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    repeated = counts > 1
    np.logical_or.at(repeated, inverse, np.concatenate(local))
    flags, ends = repeated[inverse], np.cumsum(sizes)
    dup = [pack(flags[end - n : end]) for end, n in zip(ends, sizes)]
    return pa.table(
        {"chunk": table.column("chunk"), "owner": table.column("owner"), "dup": pa.array(dup, pa.binary())}
    )


def _entries(batches):
    """Rows of a packet with the bit that its owner sent back."""
    for batch in batches:
        for p in batch.to_pylist():
            counts = np.frombuffer(p["counts"], np.int32)
            flags = np.repeat(unpack(p["dup"], p["n"]), counts)
            m = len(flags)
            shas = pa.Array.from_buffers(pa.binary(32), m, [None, pa.py_buffer(p["shas"])]).cast(pa.binary())
            # Unique within a text: its rows of one chunk all lie in one packet.
            rows = (np.int64(p["chunk"]) << np.int64(20)) + np.arange(m)
            yield pa.RecordBatch.from_arrays(
                [pa.array(p["doc_ids"], pa.int64()), shas, pa.array(rows), pa.array(flags)],
                ["doc_id", "sha", "row", "suspect"],
            )


def exact_duplicates(
    docs: DataFrame,
    chunk_rows: int = CHUNK_ROWS,
    owner_rows: int = OWNER_ROWS,
    slack_bits: int = SLACK_BITS,
    copies_a_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text counts as empty, so null and
    empty texts form one group. The largest doc_id of a group stays, a null doc_id
    only where no other is there. Of repeated rows with that doc_id exactly one has
    ``kept``. An empty table gives no rows; other columns are not read. Runs jobs.

    Fingerprints have ``log2(rows) + slack_bits`` bits. Fewer bits make more false
    suspects, never a missed duplicate. ``owner_rows`` bounds what an owner decodes
    and ``chunk_rows`` what a sender holds; a group of more than ``copies_a_task`` rows is dealt over tasks.
    """
    rows = docs.count()
    width = min(60, max(16, int(np.ceil(np.log2(rows + 2))) + slack_bits))
    # An owner takes the fingerprints of one prefix, so there are a power of two of them.
    owners = max(partitions(docs), -(-rows // owner_rows))
    owner_bits = min((owners - 1).bit_length(), width - 8)
    narrow = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), F.unhex(F.sha2(text_of(docs), 256)).alias("sha")
    )
    packets = stage(narrow.mapInArrow(_sender(width, owner_bits, chunk_rows), PACKETS), "packets")
    answers = (
        packets.select("chunk", "owner", "n", "k", "code", "many").groupBy("owner").applyInArrow(_answer, ANSWERS)
    )
    back = packets.select("chunk", "owner", "n", "counts", "doc_ids", "shas").join(answers, ["chunk", "owner"])
    entries = stage(back.mapInArrow(_entries, ENTRIES), "entries")

    suspects = entries.filter("suspect")
    asked = with_maybe(
        docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")),
        "doc_id",
        member_filter(suspects, "doc_id"),
    ).filter(HIDDEN + "maybe")
    # Grouping by the text itself compares bytes; copies collapse before the shuffle.
    texts = (
        asked.groupBy("text")
        .agg(F.count("*").alias("size"))
        .select(F.unhex(F.sha2("text", 256)).alias("sha"), "size")
        .groupBy("sha")
        .agg(F.sum("size").alias("group_size"), F.count("*").alias("texts"))
    )
    keepers = suspects.groupBy("sha").agg(F.max(F.struct("doc_id", "row")).alias("keeper"))
    groups = keepers.join(texts, "sha").select(
        "sha",
        "keeper",
        F.when(F.col("texts") == 1, F.col("group_size"))
        .otherwise(F.raise_error(F.lit("two texts share a SHA-256")))
        .alias("group_size"),
    )
    # A text with more copies than a task should take is met by as many copies of its group's row.
    found = join_to_unique(suspects, groups, "sha", "row", hot_keys(suspects, "sha", copies_a_task)).select(
        "doc_id",
        F.col("keeper.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keeper.row")).alias("kept"),
        "sha",
    )
    alone = entries.filter(~F.col("suspect")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True), "sha"
    )
    return found.union(alone).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")
    )


def drop_exact_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that ``exact_duplicates`` drops, all columns as they are.

    Rows whose doc_id is not near a repeated text pass without a shuffle. Where rows
    repeat with the same doc_id and text, one of them stays.
    """
    found = stage(exact_duplicates(docs, **options).filter("group_size > 1"), "copies")
    key, sha = HIDDEN + "id", HIDDEN + "sha"
    named = docs.withColumn(key, docs["doc_id"].cast("long"))
    marked = with_maybe(named, key, member_filter(found, "doc_id"))
    sure = marked.filter(~F.col(HIDDEN + "maybe")).drop(key, HIDDEN + "maybe")
    asked = marked.filter(HIDDEN + "maybe").withColumn(sha, F.sha2(text_of(docs), 256))
    own, text, stays, nth = (HIDDEN + c for c in ("own", "text", "stays", "nth"))
    kept = found.groupBy(F.col("doc_id").alias(own), F.col("text_sha256").alias(text)).agg(F.max("kept").alias(stays))
    joined = asked.join(kept, (F.col(key).eqNullSafe(F.col(own))) & (F.col(sha) == F.col(text)), "left")
    in_group = F.col(stays).isNotNull()
    ranked = joined.filter(F.coalesce(stays, F.lit(True))).withColumn(
        nth, F.expr(f"row_number() over (partition by `{key}`, `{sha}` order by xxhash64(`{sha}`))")
    )
    rest = ranked.filter(~in_group | (F.col(nth) == 1)).select(*[ranked[c] for c in docs.columns])
    return sure.select(*docs.columns).unionByName(rest)
