"""What the operators share as Spark jobs: staging, sizing, safe columns and bounded filters."""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.operators.joins import HIDDEN, member_filter, with_maybe  # noqa: F401
from clientele.sources.staging import new_folder

BITMAP_BITS = 25


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder (``spark.checkpoint.dir``) and read it back."""
    spark = df.sparkSession
    path = new_folder(spark, f"llm-{name}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_of(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"], F.lit(""))


def hash_bitmap(keys: DataFrame, key: str) -> np.ndarray:
    """Which of the hashes in ``key`` occur, in a fixed number of bits; more keys only let more rows pass."""
    h = F.expr(f"`{key}` & {(1 << BITMAP_BITS) - 1}L")
    words = (
        keys.select(h.alias("h"))
        .groupBy(F.shiftright("h", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("mask"))
        .toArrow()
    )
    out = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
    return out


def may_hold(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which ``hashes`` may be in the bitmap of ``hash_bitmap``."""
    bit = hashes & ((1 << BITMAP_BITS) - 1)
    return (bitmap[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1
