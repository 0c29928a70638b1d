"""Token totals by source, language and tokenizer version, kept up to date by signed deltas.

A change says what a document counted before and counts now; it becomes rows of -1 and +1
documents and tokens, summed by group before anything is shuffled. A commit writes the
sums of one batch as one folder of an append-only log under the batch's name, so a batch
that is sent again, after a failure or by mistake, changes nothing. Totals are sums over
the log and its last compaction.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .jobs import HIDDEN, text_of

GROUP = ["source", "lang", "version"]
SUMS = ["documents", "tokens"]
SCHEMA = "source string, lang string, version string, documents long, tokens long"

# Tokenizers that SQL can state. A version is part of the group, so a revision of a rule is a new name.
VERSIONS = {
    "words-1": r"[^\x20\x09-\x0D]+",
    "words-2": r"[A-Za-z0-9\x{80}-\x{10FFFF}]+|[^A-Za-z0-9\x20\x09-\x0D\x{80}-\x{10FFFF}]",
}


def counter(version: str) -> Column:
    """Tokens of column ``text`` by a named version; null and empty texts have none."""
    return F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(VERSIONS[version])).cast("long")


def counted(docs: DataFrame, versions: list[str], keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(``keys``, source, lang, version, tokens): one row per row of ``docs`` and version.

    Null and empty texts have no tokens and count as documents; null sources and languages are groups of their own; rows
    that repeat count each. ``keys`` are carried along to tell documents apart; other columns are not read.
    """
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), counter(v).alias("tokens")) for v in versions]))
    rows = docs.select(
        *[docs[k].alias(HIDDEN + k) for k in keys], docs["source"].alias("source"), docs["lang"].alias("lang"), text_of(docs).alias("text")
    )
    names = [F.col(HIDDEN + k).alias(k) for k in keys]
    return rows.select(*names, "source", "lang", each.alias("c")).select(*keys, "source", "lang", "c.*")


def inserts(counts: DataFrame) -> DataFrame:
    """Deltas of documents that are new."""
    return _signed(counts, 1)


def deletes(counts: DataFrame) -> DataFrame:
    """Deltas of documents that go; ``counts`` is what they counted."""
    return _signed(counts, -1)


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Deltas of documents whose text, source or language changed, or that are counted anew."""
    return deletes(before).unionByName(inserts(after))


def _signed(counts: DataFrame, sign: int) -> DataFrame:
    return counts.select(*GROUP, F.lit(sign).cast("long").alias("documents"), (F.col("tokens") * sign).alias("tokens"))


def rollup(deltas: DataFrame) -> DataFrame:
    """Sums by group; null source and language are groups of their own. Groups whose sums are all 0 go."""
    sums = deltas.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in SUMS])
    return sums.filter(" or ".join(f"{c} <> 0" for c in SUMS))


class Ledger:
    """A log of committed batches in a shared folder; one writer at a time.

    ``commit`` writes the folder ``batch=<name>``. It counts once Spark's ``_SUCCESS``
    marker is there, written last, so a commit cut short is not seen and can be sent
    again. ``compact`` writes the totals so far and the names they cover; they count only
    when both are complete, and the batches they cover are then left out of the sums.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _complete(self, kind: str) -> list[str]:
        path, files = self._path("")
        names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        names = [n for n in names if n.startswith(f"{kind}=") and files.exists(self._path(f"{n}/_SUCCESS")[0])]
        return sorted(n.partition("=")[2] for n in names)

    def _covered(self) -> tuple[str | None, set[str]]:
        """The compaction that covers most batches, and their names."""
        best, names = None, set()
        for name in self._complete("totals"):
            rows = self.spark.read.schema("name string").parquet(f"{self.folder}/covers={name}").collect()
            if best is None or len(rows) >= len(names):
                best, names = name, {r["name"] for r in rows}
        return best, names

    def committed(self) -> list[str]:
        """Names of all batches that count."""
        return sorted({*self._complete("batch"), *self._covered()[1]})

    def commit(self, name: str, deltas: DataFrame) -> bool:
        """Add a batch of deltas; False, and no work, if a batch of that name is committed."""
        _checked(name)
        if name in self.committed():
            return False
        rollup(deltas).select(*GROUP, *SUMS).write.mode("overwrite").parquet(f"{self.folder}/batch={name}")
        return True

    def compact(self, name: str) -> None:
        """Write the totals of all batches so far, so that later sums read them instead."""
        _checked(name)
        if name in self._complete("totals"):
            return
        names = [(n,) for n in self.committed()]
        covers = self.spark.createDataFrame(names, "name string")
        covers.write.mode("overwrite").parquet(f"{self.folder}/covers={name}")
        self.totals().write.mode("overwrite").parquet(f"{self.folder}/totals={name}")

    def totals(self) -> DataFrame:
        """source, lang, version, documents, tokens over all batches; no batch gives no rows."""
        best, covered = self._covered()
        paths = [f"{self.folder}/batch={n}" for n in self._complete("batch") if n not in covered]
        if best is not None:
            paths.append(f"{self.folder}/totals={best}")
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        parts = [self.spark.read.schema(SCHEMA).parquet(p) for p in paths]
        return rollup(reduce(DataFrame.unionByName, parts))


def _checked(name: str) -> None:
    if not name or not all(c.isascii() and (c.isalnum() or c in "-_") for c in name):
        raise ValueError(f"a batch name has ASCII letters, digits, - and _ only: {name!r}")
