"""A bounded sample of labelled documents for training, and the held-out rule."""

import pickle

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5
EMPTY = pa.schema([("id", pa.int64()), ("label", pa.int32()), ("h", pa.int64()), ("text", pa.string())])


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text is divisible by FOLDS."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _fitting(known: DataFrame, value: int, rows: int, room: int) -> list[tuple]:
    """(doc_id, label, h) of one class, read by at most ``rows`` candidates at a time."""
    found, least, longest, after = [], room // 100, room // 10, None
    while len(found) < rows and (room > least or not found):
        fits = known.filter(F.col("size") <= min(room, longest))
        if after:
            fits = fits.filter((F.col("h") > after[0]) | ((F.col("h") == after[0]) & (F.col("doc_id") > after[1])))
        most = rows - len(found)
        read = fits.orderBy("h", "doc_id").limit(most).collect()
        for row in read:
            if row["size"] <= room and (room > least or not found):
                room -= row["size"]
                found.append((row["doc_id"], value, row["h"]))
        if len(read) < most:
            break
        after = (read[-1]["h"], read[-1]["doc_id"])
    if not found and rows:
        found = [(r["doc_id"], value, r["h"]) for r in known.orderBy("size", "h", "doc_id").limit(1).collect()]
    return found


def training_sample(
    docs: DataFrame, labels: DataFrame, label: str, class_rows: tuple[int, int], class_bytes: tuple[int, int]
) -> DataFrame | None:
    """(text, label, h, id) of at most ``class_rows`` rows and ``class_bytes`` bytes of class 0 and class 1.

    Rows come in order of a hash of the doc_id, so the sample is the same in any
    partitioning. Texts are whole. Labels other than 0 and 1 and documents with both
    labels are left out. A document that does not fit into the bytes left, or takes over a
    tenth of all bytes of its class, is passed over and the next ones are tried, until the rows or all but a hundredth of the bytes are
    used; the last hundredth would only draw short texts. Where no document of a class
    fits, its smallest is taken whatever its size. None where no row is labelled. ``h`` and ``id`` give the order.
    """
    marks = (
        labels.filter(F.col(label).isin(0, 1))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min(label).cast("int").alias("low"), F.max(label).cast("int").alias("high"))
        .filter("low = high")
        .select("doc_id", F.col("low").alias("label"))
    )
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), F.octet_length(F.coalesce(docs["text"], F.lit(""))).alias("size")
    )
    known = rows.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("size").alias("size"))
    known = known.join(marks, "doc_id").select("doc_id", "label", "size", F.xxhash64("doc_id").alias("h"))
    chosen = []
    for value in (0, 1):
        chosen += _fitting(known.filter(F.col("label") == value), value, class_rows[value], class_bytes[value])
    if not chosen:
        return None
    # At most the sum of class_rows ids: a proven bound for the broadcast.
    ids = docs.sparkSession.createDataFrame(chosen, "id long, label int, h long")
    texts = docs.select(docs["doc_id"].cast("long").alias("id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    return texts.join(F.broadcast(ids), "id").groupBy("id", "label", "h").agg(F.min("text").alias("text"))


def train_in_task(sample: DataFrame | None, function):
    """``function(texts, labels)`` over a whole training sample, run in one task.

    The sample is bounded, so one task can hold it, and the driver's memory is spared. The
    result travels as one pickled row. Without a sample the function gets no rows here.
    """
    if sample is None:
        return function(pa.chunked_array([pa.array([], pa.string())]), [])

    def run(batches):
        held = list(batches)
        table = pa.Table.from_batches(held) if held else EMPTY.empty_table()
        table = table.sort_by([("h", "ascending"), ("id", "ascending")])
        model = function(table.column("text"), table.column("label").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    rows = sample.select("id", "label", "h", "text").coalesce(1).mapInArrow(run, "model binary")
    return pickle.loads(rows.first()["model"])
