"""The driver's queries of this package: each operator over its whole table, and the SQL twins."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.operators.joins import hot_keys, join_to_unique
from clientele.sources.staging import new_folder

from . import quality, sql, token_counts, toxicity
from .exact_dedup import exact_duplicates
from .html_wrapper import main_text
from .jobs import HIDDEN, member_filter, stage, with_maybe
from .mixing import mix
from .multiprobe import nearest
from .ngram_join import near_duplicates
from .packing import pack
from .prefix_trie import conversation_trie
from .span_dedup import dedup_spans
from .suffix_dedup import repeated_spans
from .whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    """The definition of a public tokenizer, read on the driver and shipped to the tasks."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), tokenizer())


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).drop("copies")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op5_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four commits: a load, its copies deleted, low-quality texts revised, the load sent again.

    Copies are all but the largest doc_id of an equal text. A document marked low in
    quality is revised by dropping runs of symbols.
    """
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    versions = list(token_counts.VERSIONS)
    low = labels.filter("quality = 0").select("doc_id").distinct()
    revised_text = F.regexp_replace("text", sql.SYMBOLS, "")

    # A document is told by its id and its text, as either may repeat.
    named = docs.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    keys = ("doc_id", "sha")
    loaded = stage(token_counts.counted(named, versions, keys), "counts")
    prints = stage(named.select(*keys), "prints")
    keepers = prints.groupBy("sha").agg(F.max("doc_id").alias("keep_id"))
    copies = join_to_unique(prints, keepers, "sha", "doc_id", hot_keys(prints, "sha")).filter("not doc_id <=> keep_id").select(F.col("doc_id").alias("gone_id"), F.col("sha").alias("gone_sha"))
    gone = stage(copies.distinct(), "copies")

    def split(counts: DataFrame, how: str) -> DataFrame:
        return counts.join(gone, F.expr("doc_id <=> gone_id and sha = gone_sha"), how)

    # Only counts are joined; texts that can't be among the revised ones are not even counted.
    maybe = with_maybe(named, "doc_id", member_filter(low, "doc_id")).filter(HIDDEN + "maybe")
    recounted = stage(token_counts.counted(maybe.withColumn("text", revised_text), versions, keys), "recounts")
    after = split(recounted.join(low, "doc_id", "left_semi"), "left_anti")
    before = split(loaded.join(low, "doc_id", "left_semi"), "left_anti")

    ledger = token_counts.Ledger(spark, new_folder(spark, "llm-ledger"))
    ledger.commit("load", token_counts.inserts(loaded))
    ledger.commit("copies", token_counts.deletes(split(loaded, "left_semi")))
    ledger.compact("first")
    ledger.commit("symbols", token_counts.revisions(before, after))
    ledger.commit("load", token_counts.inserts(loaded))
    return ledger.totals()


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op8_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"))


def op9_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_spans(_table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    trie = conversation_trie(_table(spark, sf_dir, "conversations"), family=20, heads=4)
    return trie.select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        "ends_sha256",
    )


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        F.expr("aggregate(spans, 0L, (n, s) -> n + s.stop - s.start)").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        "kept_sha256",
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(_table(spark, sf_dir, "embeddings"))
    # A long holds the exact sum up to tables of about 10^8 vectors; beyond, it is null here.
    return found.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_packing, op3_mixing, op4_exact_dedup, op5_html_wrapper, op6_token_counts, op7_toxicity, op8_multiprobe, op9_span_dedup, op10_ngram_join, op11_prefix_trie, op12_suffix_dedup, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": sql.mixing(), "op4_exact_dedup": sql.exact_dedup(), "op6_token_counts": sql.token_counts(), "op11_prefix_trie": sql.prefix_trie()}
