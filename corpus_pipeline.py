"""From raw documents to packed training sequences: five stages, each an operator of clientele.llm.

A stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept.
All but the last return the columns of documents. Between stages the documents are
written as Parquet into the shared folder and read again, so a lost executor costs a
re-read and no stage repeats another's work.
"""

from pyspark.sql import DataFrame, SparkSession

from clientele.llm import toxicity
from clientele.llm.exact_dedup import drop_exact_duplicates
from clientele.llm.jobs import stage
from clientele.llm.mixing import mixed_documents
from clientele.llm.ngram_join import drop_near_duplicates
from clientele.llm.packing import pack
from clientele.llm.queries import tokenizer

# Near duplicates: five-word shingles, similarity of 0.8 or more.
NEAR = {"shingle": 5, "num": 4, "den": 5}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id."""
    return drop_near_duplicates(docs, **NEAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source weights ask for, repeats as rows of their own."""
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in the sequences; a repeated document is packed each time."""
    return pack(docs, tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# A trained classifier and a tokenizer have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
