"""The trie of conversation prefixes over minimal-perfect-hash node tables.

A node is a sequence of turns, named by a chained 128-bit digest. Rows of turns are
sorted by conversation and streamed, so that no conversation is held in memory; equal
prefixes collapse inside tasks before they are shuffled. Nodes that several conversations
share are dealt by digest to shards, each of a bounded number of nodes. A shard gives its
digests the slots of a minimal perfect hash, scatters its counts into flat arrays, and adds
them up through the array of parent slots, deepest first. Sums for parents of another
shard travel as one row for each parent to the next band of depths. A node of a single
conversation is the top of a plain chain and needs no sum.
"""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import stage
from .slots import Slots, digests

SHARD_NODES = 65_536
# Parents with more children than this many rows, or this share of all nodes, are split.
HOT_CHILDREN, HOT_SHARE = 4_096, 1e-5
ROOT = bytes(16)
CHUNK_IDS = 4_096
OUT_ROWS = 16_384

PREFIX = "conv_id long, depth int, digest binary, parent binary, words long, ended int"


def _turns(conversations: DataFrame, family: int) -> DataFrame:
    """Each turn as a digest and a number of words, its text left behind, in the order of the stream."""
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    named = conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"),
        conversations["turn"].alias("turn"),
        # The length of the role keeps (role, text) apart from any other split of the same bytes.
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("said"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    ).filter("conv_id is not null")
    kin = named.withColumn("base", F.expr(f"conv_id - conv_id % {family}"))
    return kin.repartition("base").sortWithinPartitions(
        "base", F.expr("conv_id <> base"), "conv_id", F.asc_nulls_first("turn"), "said"
    )


def _prefixes(heads: int):
    """All prefixes of the rebuilt conversations, each with its parent, from the sorted turns."""

    def run(batches):
        rows, base, conv, head, out = [], None, None, [], []
        take = own = depth = 0
        digest = ROOT

        def add(said, words):
            nonlocal depth, digest
            parent, depth = digest, depth + 1
            digest = hashlib.blake2b(parent + said, digest_size=16).digest()
            rows.append([conv, depth, digest, parent, words, 0])

        def flush(most):
            if len(rows) > most:
                # The last row may still turn out to be an end.
                done, rows[:] = rows[:-1], rows[-1:]
                out.append(_batch(done))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("base", "conv_id", "said", "words")]
            for b, c, said, words in zip(*columns):
                if b != base:
                    base, head = b, []
                if c != conv:
                    if rows:
                        rows[-1][5] = 1
                    flush(OUT_ROWS)
                    conv, own, depth, digest = c, 0, 0, ROOT
                    take = zlib.crc32(str(c).encode()) % heads
                    rows.append([conv, 0, ROOT, None, 0, 0])
                    if c != base:
                        for turn in head[:take]:
                            add(*turn)
                if c == base:
                    if len(head) < heads:
                        head.append((said, words))
                    add(said, words)
                elif own >= take:
                    add(said, words)
                own += 1
                flush(OUT_ROWS)
            yield from out
            out.clear()
        if rows:
            rows[-1][5] = 1
            yield _batch(rows)

    return run


def _batch(rows: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int32())
    names = ("conv_id", "depth", "digest", "parent", "words", "ended")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], list(names))


SUMS = "digest binary, upward boolean, n_leaves long, saved_tokens long"


def _accumulate(nodes: pa.Table, messages: pa.Table) -> pa.Table:
    """One shard of a band: its nodes' sums, and what they add to parents that lie outside."""
    keys = digests(nodes.column("digest"))
    slots = Slots(keys)
    slot, n = slots.find(keys), len(keys)

    def scattered(name, kind=np.int64):
        flat = np.zeros(n, kind)
        flat[slot] = nodes.column(name).to_numpy()
        return flat

    depth, leaves = scattered("depth"), scattered("leaves")
    saved = (scattered("n_convs") - 1) * scattered("words")
    above = np.zeros((n, 2), np.uint64)
    # The root's parent is null and gets no sum.
    parents = nodes.column("parent").to_pylist()
    above[slot] = np.frombuffer(b"".join(p or ROOT for p in parents), "<u8").reshape(-1, 2)
    parent = slots.find(above)
    parent[depth == 0] = -1
    if messages.num_rows:
        to = slots.find(digests(messages.column("digest")))
        np.add.at(leaves, to, messages.column("n_leaves").to_numpy())
        np.add.at(saved, to, messages.column("saved_tokens").to_numpy())
    order = np.argsort(-depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, cuts):
        inside = level[parent[level] >= 0]
        np.add.at(leaves, parent[inside], leaves[inside])
        np.add.at(saved, parent[inside], saved[inside])
    outside = np.flatnonzero((parent < 0) & (depth > 0))
    names, group = np.unique(above[outside], axis=0, return_inverse=True)
    up = np.zeros((2, len(names)), np.int64)
    np.add.at(up[0], group.ravel(), leaves[outside])
    np.add.at(up[1], group.ravel(), saved[outside])
    every = np.concatenate([slots.keys, names]).astype("<u8").tobytes()
    return pa.table(
        {
            "digest": pa.array([every[i : i + 16] for i in range(0, len(every), 16)], pa.binary()),
            "upward": pa.array(np.arange(n + len(names)) >= n),
            "n_leaves": pa.array(np.concatenate([leaves, up[0]])),
            "saved_tokens": pa.array(np.concatenate([saved, up[1]])),
        }
    )


def bands(nodes_by_depth: dict[int, int], most: int) -> list[tuple[int, int, int]]:
    """(first depth, last depth, shards), deepest first; several depths share a shard while they fit."""
    out = []
    for depth in sorted(nodes_by_depth, reverse=True):
        n = nodes_by_depth[depth]
        if out and out[-1][2] + n <= most:
            out[-1] = (depth, out[-1][1], out[-1][2] + n)
        else:
            out.append((depth, depth, n))
    return [(first, last, -(-n // most)) for first, last, n in out]


def _ends(ended: DataFrame) -> DataFrame:
    """(digest, ends_sha256): the hash of the ids that end at a node, in their order.

    Ids are sorted over all tasks and joined to texts of a bounded length there, so a
    node where most conversations end reaches its hash as few rows, one after the other.
    """

    def texts(batches):
        last, ids = None, []
        rows = []
        for batch in batches:
            for digest, conv in zip(batch.column("digest").to_pylist(), batch.column("conv_id").to_pylist()):
                if digest != last or len(ids) == CHUNK_IDS:
                    if ids:
                        rows.append((last, ids[0], ",".join(map(str, ids))))
                    last, ids = digest, []
                ids.append(conv)
            yield _columns(rows)
            rows = []
        if ids:
            yield _columns([(last, ids[0], ",".join(map(str, ids)))])

    def _columns(rows):
        kinds = {"digest": pa.binary(), "first": pa.int64(), "ids": pa.string()}
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], list(kinds)
        )

    def hashes(batches):
        last, state = None, None
        for batch in batches:
            rows = []
            for digest, ids in zip(batch.column("digest").to_pylist(), batch.column("ids").to_pylist()):
                if digest == last:
                    state.update(b",")
                else:
                    if state:
                        rows.append((last, state.hexdigest()))
                    last, state = digest, hashlib.sha256()
                state.update(ids.encode())
            yield _hashed(rows)
        if state:
            yield _hashed([(last, state.hexdigest())])

    def _hashed(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())],
            ["digest", "ends_sha256"],
        )

    joined = (
        ended.repartitionByRange("digest", "conv_id")
        .sortWithinPartitions("digest", "conv_id")
        .mapInArrow(texts, "digest binary, first long, ids string")
    )
    ordered = joined.repartition("digest").sortWithinPartitions("digest", "first")
    return ordered.mapInArrow(hashes, "digest binary, ends_sha256 string")


def conversation_trie(
    conversations: DataFrame, family: int = 1, heads: int = 1, shard_nodes: int = SHARD_NODES
) -> DataFrame:
    """One row per distinct prefix: digest, depth, words, conv_id, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, n_ends, ends_sha256.

    Turns go by ``turn`` (null first), those of one turn by the SHA-256 of role and text; null
    roles and texts are empty; a row that repeats is a turn of its own; a row without a conv_id
    belongs to no conversation. Conversation c begins with the first h turns of c - c % ``family``
    (signed remainder; fewer or none where it has fewer or is absent), h = crc32(decimal c) %
    ``heads``, instead of its own first h; by default that is the conversation as it is.
    A node's conv_id is its smallest member, ``saved_tokens`` the words that its subtree need not
    repeat. Texts and conversations of any length stream through; an empty table gives no rows;
    other columns are not read. Runs jobs.

    The driver sees one row for each depth that two conversations share.
    """
    prefixes = stage(_turns(conversations, family).mapInArrow(_prefixes(heads), PREFIX), "prefixes")
    nodes = prefixes.groupBy("depth", "digest", "parent", "words").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum("ended").alias("n_ends")
    )
    nodes = stage(nodes, "nodes")
    total = nodes.count()

    # Children are counted for each parent inside tasks first, as most nodes may hang from one.
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("digest")).agg(
        F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("chains")
    )
    shared = nodes.filter("n_convs > 1")
    depths = {r["depth"]: r["n"] for r in shared.groupBy("depth").agg(F.count("*").alias("n")).collect()}
    plan = bands(depths, shard_nodes)
    band = F.lit(-1)
    for i, (first, last, _) in enumerate(plan):
        band = F.when(F.col("depth").between(first, last), i).otherwise(band)
    leaves = F.when(F.col("n_children").isNull(), F.lit(1)).otherwise(F.col("chains")).cast("long")
    shared = shared.join(children, "digest", "left").select(
        "digest", "parent", "depth", "words", "conv_id", "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        leaves.alias("leaves"), band.alias("band"),
    )
    shared = stage(shared, "shared")

    session = conversations.sparkSession
    none = session.createDataFrame([], SUMS)
    messages, sums = none, none
    for i, (_, _, shards) in enumerate(plan):
        shard = F.expr(f"pmod(xxhash64(digest), {shards})")
        own = shared.filter(F.col("band") == i).select("digest", "parent", "depth", "words", "n_convs", "leaves")
        both = own.groupBy(shard.alias("shard")).cogroup(
            messages.groupBy(shard.alias("shard"))
        )
        done = stage(both.applyInArrow(_accumulate, SUMS), "sums")
        messages = done.filter("upward")
        sums = sums.union(done.filter("NOT upward"))

    # At most 1 / HOT_SHARE parents have that share of all nodes for children.
    least = max(HOT_CHILDREN, int(total * HOT_SHARE))
    pieces = F.expr(f"cast(ceil(n_children / {least}D) as int)")
    hot = shared.filter(F.col("n_children") > least).select(F.col("digest").alias("parent"), pieces.alias("pieces"))
    copies = F.expr(f"explode(sequence(0, greatest(1, cast(ceil(n_children / {least}D) as int)) - 1)) as piece")
    above = shared.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"), copies)
    piece = F.expr("cast(coalesce(pmod(xxhash64(digest), pieces), 0) as int)")
    placed = nodes.join(F.broadcast(hot), "parent", "left").withColumn("piece", piece).join(
        above, ["parent", "piece"], "left"
    )
    known = shared.select("digest", "n_children").join(sums.drop("upward"), "digest")
    found = placed.join(known, "digest", "left").join(_ends(prefixes.filter("ended = 1").select("digest", "conv_id")), "digest", "left")
    # Without a row in ``known`` the node has one member, whose conversation ends here or goes on.
    return found.select(
        "digest",
        "depth",
        "words",
        "conv_id",
        # A parent that is not shared has the same single member.
        F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.coalesce("n_children", 1 - F.col("n_ends")).alias("n_children"),
        F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"),
        "n_ends",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
