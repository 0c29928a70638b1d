"""Links between documents whose word-shingle sets have a high Jaccard similarity.

1. Each text becomes a set of 64-bit shingle hashes; equal sets collapse to one.
2. Candidates, without loss: linked sets of sizes in one or two neighbouring size bands
   differ in at most K tokens, so when the hash space is cut into more than K ranges,
   they agree in one of them. Each set sends a key for each range and band pair. There are
   spare ranges, so linked sets share several keys: a set that shares fewer with all
   others together is no candidate and its keys go. Sets that still share a key belong to
   one candidate cluster.
3. Each cluster that exceeds a block is cut by size band into blocks of bounded tokens, and a
   signature tree is built over a block. The tree is joined with itself, later with the trees of the
   cluster's other blocks whose sizes can match, dropping node pairs by their largest
   possible overlap. What remains is compared token by token.
4. Links that connect are enough: pairs already connected are not looked at again.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.operators.joins import ROWS_PER_TASK, hot_keys, join_to_unique

from .components import components
from .jobs import HIDDEN, member_filter, partitions, stage, text_of, with_maybe
from .signature_tree import links
from .textops import buffers, mix, shingles, slices

SHINGLE = 3
NUM, DEN = 9, 10
CHUNK_TOKENS = 4_000_000
BLOCK_TOKENS = 2_000_000
# Texts cut into shingles at a time, as each byte takes about sixty in arrays, and rows sent at a time.
SLICE_BYTES = 1 << 17
SEND_ROWS = 1 << 16

DOC, KEY, MIDDLE, NAMELESS, NEED = 0, 1, 2, 3, 4


def size_bands(num: int, den: int, most: int) -> np.ndarray:
    """Least sizes of the bands: a set can only be linked into its own or a neighbouring band."""
    starts = [1]
    while starts[-1] <= most:
        starts.append(starts[-1] * den // num + 1)
    return np.array(starts, np.int64)


def parts(starts: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(ranges to cut the hash space into, spare ones) by band; no ranges where only equal sets are linked.

    A linked pair of the band and the one below differs in at most K tokens, so of
    K + 1 + spare ranges it agrees in 1 + spare. Ranges without tokens say nothing: they
    get no key, unless a set has more of them than are spare. If two sets agree only
    in empty ranges, both have that many and send their keys.
    """
    ends = np.concatenate((starts[1:] - 1, [starts[-1] * den // num])).astype(float)
    least = np.concatenate((starts[:1], starts[:-1])).astype(float)
    # Of sets of sizes a and b, at most (a + b) (den - num) / (den + num) tokens are in one only.
    differ = np.floor(2 * ends * (den - num) / (den + num) + 1e-9)
    spare = np.zeros(len(ends))
    for _ in range(20):
        cuts = differ + 1 + spare
        empty = cuts * np.exp(-least / cuts)
        spare = np.ceil(empty + 3 * np.sqrt(empty))
    cuts = np.where(differ > 0, differ + 1 + spare, 0)
    return cuts.astype(np.int64), spare.astype(np.int64)


def band_keys(
    tokens: np.ndarray, bounds: np.ndarray, band: np.ndarray, cuts: np.ndarray, spare: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, set positions, need): a key for each range of a set's hash space, in the layout of ``band``.

    The lowest bit of a key is that of its layout. ``need`` tells of each set how many of its keys
    any linked set of the layout shares at least.
    """
    n = len(bounds) - 1
    count = cuts[band]
    base = np.concatenate(([0], np.cumsum(count)))
    own = np.repeat(count > 0, np.diff(bounds))
    tokens, owner = tokens[own], np.repeat(np.arange(n), np.diff(bounds))[own]
    part = ((tokens >> np.uint64(32)) * count[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    held = np.bincount(base[owner] + part, minlength=int(base[-1]))
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(tokens), dtype=np.uint64)))
    ends = np.cumsum(held)
    total = running[ends] - running[ends - held]
    whose = np.repeat(np.arange(n), count)
    place = (np.arange(len(whose)) - base[whose]).astype(np.uint64)
    layout = mix(band.astype(np.uint64) + np.uint64(1))[whose]
    keys = mix(total + mix(place + layout) + held.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    empties = np.bincount(whose[held == 0], minlength=n)
    told = (held > 0) | (empties > spare[band])[whose]
    keys = keys & ~np.uint64(1) | (band & 1).astype(np.uint64)[whose]
    return keys[told], whose[told], 1 + spare[band] - empties


def _set_ids(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    raw = tokens.astype("<u8").tobytes()
    out = np.empty(len(bounds) - 1, np.int64)
    for i in range(len(out)):
        digest = hashlib.blake2b(raw[bounds[i] * 8 : bounds[i + 1] * 8], digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little", signed=True)
    return out


def _first_pass(shingle: int, num: int, den: int, chunk_tokens: int):
    starts = size_bands(num, den, 1 << 40)
    cuts, spare = parts(starts, num, den)

    def rows(kind, x, y, n):
        m = len(x)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.broadcast_to(np.int8(kind), m)), x, y, n], ["kind", "x", "y", "n"]
        )

    def merge(held):
        """Of a chunk: each key with its least and its greatest set, which show that it is shared, and apart the sets between."""
        keys, sets = np.concatenate([k for k, _ in held]), np.concatenate([s for _, s in held])
        held.clear()
        ends = np.zeros(len(keys), bool)
        # A sixteenth of the hash space at a time, so that what is sorted stays small.
        part = (keys >> np.uint64(60)).astype(np.uint8)
        for own in (np.flatnonzero(part == p) for p in range(16)):
            order = own[np.lexsort((sets[own], keys[own]))]
            new = np.concatenate(([True], keys[order[1:]] != keys[order[:-1]]))[: len(order)]
            ends[order] = new | np.append(new[1:], True)[: len(order)]
        # Set by set, as they came: repeated set ids compress well, in the file and in the shuffle.
        for kind, own in ((KEY, ends), (MIDDLE, ~ends)):
            own = np.flatnonzero(own)
            for at in (own[a : a + SEND_ROWS] for a in range(0, len(own), SEND_ROWS)):
                yield rows(kind, pa.array(keys[at].view(np.int64)), pa.array(sets[at]), pa.nulls(len(at), pa.int32()))

    def run(batches):
        held, seen, tokens_held = [], set(), 0
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            ids = batch.column("name")
            kinds = np.where(batch.column("nameless").to_numpy(zero_copy_only=False), NAMELESS, DOC).astype(np.int8)
            for i, j in slices(offsets, SLICE_BYTES):
                tokens, bounds, _ = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle)
                sizes, names = np.diff(bounds), _set_ids(tokens, bounds)
                yield rows(
                    kinds[i:j],
                    ids.slice(i, j - i),
                    pa.array(names, mask=sizes == 0),
                    pa.array(sizes.astype(np.int32)),
                )
                fresh = [k for k in np.flatnonzero(sizes) if int(names[k]) not in seen]
                fresh = list({int(names[k]): k for k in reversed(fresh)}.values())[::-1]
                if not fresh:
                    continue
                seen.update(int(names[k]) for k in fresh)
                own = np.concatenate([tokens[bounds[k] : bounds[k + 1]] for k in fresh])
                own_bounds = np.concatenate(([0], np.cumsum(sizes[fresh])))
                band = np.searchsorted(starts, sizes[fresh], side="right") - 1
                for layout in (band, band + 1):
                    keys, whose, need = band_keys(own, own_bounds, layout, cuts, spare)
                    held.append((keys, names[fresh][whose]))
                    yield rows(NEED, pa.array(names[fresh]), pa.array(need), pa.array((layout & 1).astype(np.int32)))
                    tokens_held += len(keys)
                if tokens_held * 5 >= chunk_tokens:
                    yield from merge(held)
                    held, seen, tokens_held = [], set(), 0
        if held:
            yield from merge(held)

    return run


def _joiner(shingle: int, num: int, den: int, across: bool):
    """Join each cluster block (or pair of blocks) of a bin; tables hold whole bins.

    Texts travel instead of tokens, as they compress better. A row whose text is not of
    its set (a doc_id with two texts) and rows that repeat are left out.
    """
    place = "pair" if across else "block"

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("cluster", place, "set")])
        cluster, block = table.column("cluster").to_numpy(), table.column(place).to_numpy()
        names, labels = table.column("set").to_numpy(), table.column("label").to_numpy()
        side = table.column("side").to_numpy() if across else None
        change = np.flatnonzero(np.concatenate(([True], (np.diff(cluster) != 0) | (np.diff(block) != 0), [True])))
        u, v = [], []
        for a, b in zip(change[:-1], change[1:]):
            data, offsets = buffers(table.column("text").slice(a, b - a))
            cells, rows = [], []
            for i, j in slices(offsets, SLICE_BYTES):
                tokens, bounds, _ = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle)
                own = np.flatnonzero(_set_ids(tokens, bounds) == names[a + i : a + j])
                rows.append(own + a + i)
                cells += [tokens[bounds[k] : bounds[k + 1]] for k in own]
            rows = np.concatenate(rows)
            once = np.flatnonzero(np.concatenate(([True], names[rows][1:] != names[rows][:-1]))[: len(rows)])
            rows, cells = rows[once], [cells[k] for k in once]
            if len(rows) < 2:
                continue
            bounds = np.concatenate(([0], np.cumsum([len(c) for c in cells])))
            sides = None if side is None else side[rows]
            for i, j in links(np.concatenate(cells), bounds, labels[rows], sides, num, den):
                u.append(int(names[rows[i]]))
                v.append(int(names[rows[j]]))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _ends(held: DataFrame) -> DataFrame:
    """(key, low, high) of the keys that several sets hold: their least and greatest set."""
    return held.groupBy("key").agg(F.min("set").alias("low"), F.max("set").alias("high")).filter("low <> high")


def _agreeing(held: DataFrame, need: DataFrame) -> DataFrame:
    """(key, set) rows of the sets that share as many keys of a layout as a linked set would.

    Nothing linked is lost: both sets of a linked pair hold that many keys in common, which no step takes
    from them. Keys that no second set holds any more are left out.
    """
    layout = F.expr("cast(key & 1 as int)").alias("layout")
    counts = held.groupBy("set", layout).agg(F.count("*").alias("n"))
    able = stage(counts.join(need, ["set", "layout"]).filter("n >= need").select("set", "layout"), "able")
    maybe = with_maybe(held, "set", member_filter(able, "set")).filter(HIDDEN + "maybe").select("key", "set", layout)
    kept = stage(maybe.join(able, ["set", "layout"]).select("key", "set"), "kept")
    return stage(kept.join(_ends(kept).select("key"), "key").select("key", "set"), "agreeing")


def near_duplicates(
    docs: DataFrame,
    shingle: int = SHINGLE,
    num: int = NUM,
    den: int = DEN,
    chunk_tokens: int = CHUNK_TOKENS,
    block_tokens: int = BLOCK_TOKENS,
    copies_a_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    A set holds the distinct ``shingle``-word shingles of a text, A-Z lower-cased, words
    cut at ASCII white space; with fewer words, the whole sequence as one. Documents are
    linked when ``den * |A and B| >= num * |A or B|``. ``component_id`` is the smallest
    doc_id that links reach, its own included. Null and blank texts have an empty set and
    no link. A row with a null doc_id links like any other; where no row of a component has a
    doc_id its component_id is null. Very long texts are cut into shingles whole.
    Repeated rows give repeated result rows; other columns are not read; an empty table
    gives no rows. Sets are told apart by 64-bit hashes of their tokens. A set of more than
    ``copies_a_task`` rows is dealt over tasks. Runs jobs.
    """
    spark = docs.sparkSession
    # A row without an id is found again by a hash of its text; what is loaded is held against its set anyway.
    own, text = docs["doc_id"].cast("long"), text_of(docs)
    texts = docs.select(F.coalesce(own, F.xxhash64(text)).alias("name"), own.isNull().alias("nameless"), text.alias("text"))
    first = stage(
        texts.mapInArrow(_first_pass(shingle, num, den, chunk_tokens), "kind byte, x long, y long, n int"), "sets"
    )
    rows = first.filter(F.col("kind").isin(DOC, NAMELESS)).select(
        F.col("x").alias("name"),
        F.when(F.col("kind") == DOC, F.col("x")).alias("doc_id"),
        F.col("y").alias("set"),
        F.col("n").alias("n_shingles"),
    )
    keyed = first.filter(F.col("kind") == KEY).select(F.col("x").alias("key"), F.col("y").alias("set"))
    # A chunk sends a key at most twice, so the rows of a key are at most twice the chunks.
    least, most = (f"{f}(`set`) over (partition by key)" for f in ("min", "max"))
    shared = keyed.selectExpr("key", "`set`", f"{least} as low", f"{most} as high").filter("low <> high")
    middle = first.filter(F.col("kind") == MIDDLE).select(F.col("x").alias("key"), F.col("y").alias("set"))
    held = stage(shared.select("key", "set").union(middle), "shared")
    need = first.filter(F.col("kind") == NEED).groupBy(F.col("x").alias("set"), F.col("n").alias("layout"))
    need = need.agg(F.max("y").alias("need"))
    held = _agreeing(held, need)
    candidates = held.join(_ends(held), "key").select(F.col("set").alias("u"), F.col("low").alias("v"))
    clusters = stage(components(candidates), "clusters")

    # One document of each candidate set brings its text; the band bounds its block.
    one = rows.filter("set is not null").groupBy("set").agg(F.min("name").alias("name"), F.max("n_shingles").alias("n"))
    members = one.join(clusters, one["set"] == clusters["node"]).select("set", "name", "n", F.col("component").alias("cluster"))
    step = float(np.log(den / num))
    members = stage(members.withColumn("band", F.floor(F.log("n") / step).cast("int")), "candidates")
    room = (
        members.groupBy("cluster", "band")
        .agg(F.sum("n").alias("tokens"))
        .withColumn("whole", F.expr("sum(tokens) over (partition by cluster)"))
        .withColumn("blocks", F.ceil(F.col("tokens") / F.lit(float(block_tokens))).cast("long"))
    )
    placed = (
        members.join(room, ["cluster", "band"])
        .withColumn("slot", F.expr("pmod(xxhash64(`set`), blocks)"))
        .withColumn("block", F.expr(f"if(whole <= {block_tokens}, -1L, band * 4294967296L + slot)"))
        .select("set", "name", "cluster", "n", "band", "block")
    )
    asked = with_maybe(texts, "name", member_filter(members, "name")).filter(HIDDEN + "maybe")
    loaded = stage(placed.join(asked.select("name", "text"), "name").drop("name"), "members")
    volume = loaded.agg(F.sum("n")).first()[0] or 0
    bins = max(partitions(docs), -(-volume // block_tokens))
    inside = loaded.select(
        "cluster",
        "block",
        "set",
        F.col("set").alias("label"),
        "text",
        F.expr(f"pmod(xxhash64(cluster, block), {bins}L)").alias("bin"),
    )
    inner = stage(inside.groupBy("bin").applyInArrow(_joiner(shingle, num, den, False), "u long, v long"), "inner")

    # Blocks of one cluster whose sizes can match and that are not connected as a whole.
    labels = stage(components(inner), "inner-components")
    labelled = loaded.join(labels, loaded["set"] == labels["node"], "left").withColumn(
        "label", F.coalesce("component", "set")
    )
    blocks = stage(
        labelled.groupBy("cluster", "block").agg(
            F.min("label").alias("low"),
            F.max("label").alias("high"),
            F.min("n").alias("least"),
            F.max("n").alias("most"),
        ),
        "blocks",
    )
    a, b = blocks.alias("a"), blocks.alias("b")
    pairs = a.join(
        b,
        (F.col("a.cluster") == F.col("b.cluster"))
        & (F.col("a.block") < F.col("b.block"))
        & (F.col("a.most") * den >= F.col("b.least") * num)
        & (F.col("b.most") * den >= F.col("a.least") * num)
        & (F.least("a.low", "b.low") < F.greatest("a.high", "b.high")),
    ).select(
        F.col("a.cluster").alias("cluster"),
        F.expr("xxhash64(a.block, b.block)").alias("pair"),
        F.expr("inline(array(struct(a.block as block, 0 as side), struct(b.block as block, 1 as side)))"),
    )
    crossing = (
        labelled.select("cluster", "block", "set", "label", "text")
        .join(pairs, ["cluster", "block"])
        .withColumn("bin", F.expr("xxhash64(cluster, pair)"))
        .select("cluster", "pair", "side", "set", "label", "text", "bin")
    )
    outer = crossing.groupBy("bin").applyInArrow(_joiner(shingle, num, den, True), "u long, v long")
    joined = components(inner.union(outer))

    named = rows.filter("set is not null").groupBy("set").agg(F.min("doc_id").alias("least"))
    classes = named.join(joined, named["set"] == joined["node"], "left").select(
        "set", "least", F.coalesce("component", "set").alias("component")
    )
    names = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    lookup = classes.join(names, "component").select("set", "component_id")
    full = rows.filter("set is not null")
    full = join_to_unique(full, lookup, "set", "name", hot_keys(full, "set", copies_a_task))
    full = full.select("doc_id", "n_shingles", "component_id")
    return full.union(
        rows.filter("set is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    ).withColumn("n_shingles", F.col("n_shingles").cast("long"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each component of ``near_duplicates``, all columns as they are.

    The smallest doc_id stays, one of several texts with it; a null doc_id only where no other is
    there. A row is told by its doc_id and text, so of two rows that share a doc_id only the near copy
    goes, and rows that repeat both stay or go together.
    """
    row, own, first = (HIDDEN + c for c in ("row", "own", "first"))
    named = docs.withColumn(own, docs["doc_id"].cast("long")).withColumn(row, F.xxhash64(docs["doc_id"].cast("long"), text_of(docs)))
    found = near_duplicates(named.select(F.col(row).alias("doc_id"), "text"), **options)
    found = stage(found.filter("component_id is not null").select(F.col("doc_id").alias(row), "component_id").distinct(), "near-rows")
    several = found.filter(F.col(row) != F.col("component_id")).select("component_id").distinct()
    rank = F.struct(F.col(own).isNull(), F.col(own), F.col(row))
    placed = found.join(several, "component_id", "left_semi").join(named.select(row, own).distinct(), row)
    keepers = placed.groupBy("component_id").agg(F.min(rank).alias(first))
    gone = stage(placed.join(keepers, "component_id").filter(rank != F.col(first)).select(row, own), "near-copies")
    gone = gone.toDF(HIDDEN + "gone_row", HIDDEN + "gone_own")
    marked = with_maybe(named, row, member_filter(gone, HIDDEN + "gone_row"))
    sure = marked.filter(~F.col(HIDDEN + "maybe")).select(*docs.columns)
    same = (F.col(row) == F.col(HIDDEN + "gone_row")) & F.col(own).eqNullSafe(F.col(HIDDEN + "gone_own"))
    asked = marked.filter(HIDDEN + "maybe").join(gone, same, "left_anti")
    return sure.unionByName(asked.select(*docs.columns))
