"""The trigram search against the full scan."""

import pytest
from conftest import rows

import clientele as cl
from clientele.operators.search_index import required_grams

NAMES = ["Ann Lee", "ANNA LEIGH", "Bob Ray", "İstanbul Ak", "ıstanbul", "ſtraße", "Kelvin King", "aXbXc", None, "", "ab", "a.b*c(d)", "Foo+Bar", "émile", "annnnex"]
TERMS = [
    "ann", "ANN|bob", "lee$", "^ann\\s+le", "an+e", "ann?", "ann*a", "(ann|bob) ?le", "[a-c]nn", "istanbul", "kin", "str", "king",
    "a\\.b", "\\Qa.b*c(d)\\E", "foo\\+bar", "x(?=b)bx", "(?x)a n n", "a{2}nn", "nn{3}", "\\x61nn", "é?mile", "mile", "nothing here", "cust|ann", "",
    "ann|", "ann|(lee)", "[]abc]nna", "[^]x]nna", "[(]ann", "\u212aelvin", "[[a]b]nna", "e\\d*x", "user1\\d", "@example", "customer_1",
]


@pytest.fixture(scope="module")
def people(spark):
    data = [(f"customer_{i}", n, f"user{i}@example.com" if n else None) for i, n in enumerate(NAMES)]
    return cl.stage(spark.createDataFrame(data, "customer_id string, name string, email string"))


@pytest.fixture(scope="module")
def index(people, tmp_path_factory, spark):
    path = str(tmp_path_factory.mktemp("index") / "grams")
    cl.store_index(cl.search_index(people), path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("term", TERMS)
def test_same_rows_as_a_scan(people, index, term):
    found = cl.indexed_search(people, index, term, cl.gram_sizes(index))
    assert rows(found, "customer_id") == rows(cl.search_customers(people, term), "customer_id")


def test_malformed_patterns_are_refused(people, index):
    for term in ("ann(", "[ann", "*ann"):
        with pytest.raises(ValueError):
            cl.indexed_search(people, index, term, cl.gram_sizes(index))


def test_required_grams():
    assert required_grams("anna") == [{"ann", "nna"}]
    assert required_grams("ann|bob") == [{"ann"}, {"bob"}]
    assert required_grams("ann|b") is None
    assert required_grams("ab?cdef") == [{"cde", "def"}]
    assert required_grams("abc+def") == [{"abc", "def"}]
    assert required_grams("(abc)?") is None
    assert required_grams("abc(?i)def") is None
    assert required_grams("(?x)a b|abc d") is None
    assert required_grams("abc(?:x)def") == [{"abc", "def"}]
    assert required_grams("") is None


def test_only_the_parts_with_the_grams_are_read(people, index):
    text = cl.indexed_search(people, index, "bob", cl.gram_sizes(index))._jdf.queryExecution().toString()
    assert "left_semi" in text.lower() or "LeftSemi" in text
    assert "In(gram, [bob])" in text or "EqualTo(gram,bob)" in text


def test_customers_are_dealt_before_they_become_grams(people, spark):
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert cl.search_index(people.coalesce(1)).rdd.getNumPartitions() == wanted > 1


def test_the_index_holds_each_plain_gram_once(spark):
    people = spark.createDataFrame([("c1", "Ab-cdEK", "abab"), ("c1", None, "ab"), (None, "xyz", "")], "customer_id string, name string, email string")
    found = sorted(((r["gram"], r["customer_id"]) for r in cl.search_index(people).collect()), key=repr)
    assert found == sorted([("cde", "c1"), ("dek", "c1"), ("aba", "c1"), ("bab", "c1"), ("xyz", None)], key=repr)
