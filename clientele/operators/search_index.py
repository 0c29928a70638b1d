"""Customer search by an index of trigrams: the same rows as a full scan, most of them never read.

The index has a row for each three letters or digits that stand next to each other in a customer's
name, email or id, folded as the search folds case. From a pattern the runs of plain letters are taken
that every match must contain; only customers that hold all trigrams of one of them can match, and
the pattern itself decides among these. A pattern without such a run is searched by a scan.
"""

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import SEARCHED, search_customers

GRAM = 3
# A trigram that more than this share of the customers hold rules out too little to be read.
COMMON = 0.1
# Letters and digits whose case folds alike in the index and in the pattern.
_PLAIN = re.compile(r"[A-Za-z0-9@_#]", re.ASCII)
# Of folded text, from each position; a lookahead, as grams overlap.
_PLAIN_GRAM = f"(?=([a-z0-9@_#]{{{GRAM}}}))"


def search_index(customers: DataFrame, key: str = "customer_id") -> DataFrame:
    """(gram, key), sorted by gram inside its files, so that a search reads the parts with its grams."""
    # A customer is a few dozen grams: a table of few splits is dealt to all tasks before it grows by them.
    names = list(dict.fromkeys([key, *SEARCHED]))
    dealt = customers.select(*names).repartition(int(customers.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    # One pass of a pattern over the folded text: substrings at each position would fold it again for each.
    folded = F.concat_ws("\n", *[_folded(name) for name in dict.fromkeys(SEARCHED)])
    grams = F.array_distinct(F.regexp_extract_all(folded, F.lit(_PLAIN_GRAM), F.lit(1)))
    return dealt.select(F.explode(grams).alias("gram"), F.col(key).alias(key))


def store_index(index: DataFrame, path: str) -> None:
    """Write the index dealt by ranges of grams; a gram that many customers hold is spread over tasks."""
    index.repartitionByRange("gram", index.columns[1]).sortWithinPartitions("gram").write.parquet(path)


def gram_sizes(index: DataFrame) -> DataFrame:
    """(gram, customers): at most 40^3 rows, whatever the number of customers."""
    return index.groupBy("gram").agg(F.count("*").alias("customers"))


def indexed_search(customers: DataFrame, index: DataFrame, term: str, sizes: DataFrame, key: str = "customer_id") -> DataFrame:
    """``search_customers(customers, term)`` by ``index``, which was made of the same customers; ``sizes`` by
    ``gram_sizes``. Runs a small job over ``sizes``."""
    wanted = required_grams(term)
    held = {}
    if wanted:
        every = sorted({g for grams in wanted for g in grams})
        held = {r["gram"]: r["customers"] for r in sizes.where(F.col("gram").isin(every)).collect()}
        most = COMMON * (sizes.agg(F.max("customers")).first()[0] or 0)
        # The rarest grams of a branch suffice; a gram that nobody holds rules the branch out.
        wanted = [sorted(grams, key=lambda g: held.get(g, 0))[:GRAM] for grams in wanted]
        if any(held.get(grams[0], 0) > most for grams in wanted):
            wanted = None
    if wanted is None:
        return search_customers(customers, term)
    branches = [grams for grams in wanted if grams[0] in held]
    found = index.where(F.lit(False)).select(key)
    for grams in branches:
        rows = index.where(F.col("gram").isin(grams)).groupBy(key).agg(F.count("*").alias("n"))
        found = found.union(rows.where(F.col("n") == len(set(grams))).select(key))
    return search_customers(customers.join(found.distinct(), key, "left_semi"), term)


def required_grams(term: str) -> list[set[str]] | None:
    """For each alternative of a pattern the trigrams that each of its matches contains; None if one has none.

    Only what is certain counts: letters and digits outside of groups and classes that no quantifier
    makes optional, in patterns that set no flags.
    """
    if re.search(r"\(\?[A-Za-z-]", term):
        return None
    out = []
    for branch in _alternatives(term):
        grams = {run[i : i + GRAM] for run in _runs(branch) for i in range(len(run) - GRAM + 1)}
        if not grams:
            return None
        out.append(grams)
    return out


def _tokens(term: str):
    """(text, plain): the pattern in pieces; a group, a class and an escape are one piece each."""
    i = 0
    while i < len(term):
        start, c = i, term[i]
        if c == "\\":
            i += 2
            if term[start : i] == "\\Q":
                i = term.find("\\E", i)
                i = len(term) if i < 0 else i + 2
            elif term[start : i] in ("\\p", "\\P", "\\x", "\\N", "\\k", "\\u", "\\c", "\\0", "\\o"):
                # What belongs to such an escape differs; nothing after it is counted on.
                i = len(term)
        elif c == "[" and term[i + 1 : i + 3].lstrip("^").startswith("]"):
            # A bracket in first place is one of the class.
            i = len(term)
        elif c in "([":
            i = _closing(term, i)
        elif c == "{":
            i = term.find("}", i) + 1 or len(term)
        else:
            i += 1
        yield term[start:i], bool(_PLAIN.fullmatch(term[start:i]))


def _closing(term: str, i: int) -> int:
    """The end of the group or class that begins at ``i``."""
    opened = []
    while i < len(term):
        c = term[i]
        if c == "\\":
            # Quoted text may hold brackets: nothing after it is counted on.
            if term[i : i + 2] == "\\Q":
                return len(term)
            i += 1
        elif c in "([" and not (opened and opened[-1] == "[" and c == "("):
            opened.append(c)
        elif opened and c == (")" if opened[-1] == "(" else "]"):
            opened.pop()
            if not opened:
                return i + 1
        i += 1
    return len(term)


def _alternatives(term: str) -> list[list[tuple[str, bool]]]:
    out = [[]]
    for token in _tokens(term):
        if token[0] == "|":
            out.append([])
        else:
            out[-1].append(token)
    return out


def _runs(tokens: list[tuple[str, bool]]) -> list[str]:
    """Runs of plain characters that stand next to each other in every match, in lower case."""
    runs, now = [], ""
    for i, (text, plain) in enumerate(tokens):
        after = tokens[i + 1][0][0] if i + 1 < len(tokens) else ""
        if plain and after not in ("?", "*", "{", "+"):
            now += text.lower()
            continue
        if plain and after == "+":
            # Once at least: it ends this run and may begin the next one.
            runs.append(now + text.lower())
            now = ""
            continue
        runs.append(now)
        now = ""
    return [*runs, now]


def _folded(name: str):
    # Beside A to Z the search takes four letters for plain ones: the long s, the dotless and the dotted i, and the
    # Kelvin sign. Lower case leaves the first two and turns the third into an i and a dot.
    text = F.coalesce(F.col(name).cast("string"), F.lit(""))
    return F.translate(F.lower(text), "\u017f\u0131\u212a\u0307", "sik")
