"""Numbered commits that one writer takes, and loads that race."""

import threading

import pytest
from conftest import rows

import clientele as cl
from clientele.sources import commits, storage


def test_a_number_is_taken_once(spark, tmp_path):
    root = str(tmp_path / "log")
    assert commits.numbers(spark, root, "v") == []
    commits.publish(spark, root, "v", 1, {"who": "ü"})
    with pytest.raises(commits.Taken):
        commits.publish(spark, root, "v", 1, {"who": "b"})
    commits.publish(spark, root, "v", 10, {"who": "c"})
    assert commits.numbers(spark, root, "v") == [1, 10]
    assert commits.read(spark, root, "v", 1) == {"who": "ü"}
    # No drafts are left behind.
    assert sorted(p.name for p in (tmp_path / "log").iterdir()) == ["v=1", "v=10"]


def test_many_writers_get_numbers_of_their_own(spark, tmp_path):
    root, won, lost = str(tmp_path / "log"), [], []

    def write(who):
        for number in range(1, 4):
            try:
                commits.publish(spark, root, "v", number, {"who": who})
                won.append((number, who))
            except commits.Taken:
                lost.append((number, who))

    threads = [threading.Thread(target=write, args=(i,)) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(n for n, _ in won) == [1, 2, 3] and len(lost) == 15
    assert {(n, commits.read(spark, root, "v", n)["who"]) for n in (1, 2, 3)} == set(won)


def _meanwhile(monkeypatch, other):
    """Let ``other`` run once between the moment a load has written its rows and its manifest."""
    publish, done = commits.publish, []

    def late(spark, root, kind, number, entry):
        if not done:
            done.append(1)
            other()
        return publish(spark, root, kind, number, entry)

    monkeypatch.setattr(storage.commits, "publish", late)


def test_two_forced_loads_keep_both(shop, spark, tmp_path, monkeypatch):
    customers, orders = shop
    path = str(tmp_path / "shop")
    _meanwhile(monkeypatch, lambda: cl.load_tables(customers, orders.limit(1), path, force=True))
    assert cl.load_tables(customers, orders.limit(3), path, force=True) == 2
    assert cl.read_tables(spark, path, 1)[1].count() == 1
    assert cl.read_tables(spark, path, 2)[1].count() == cl.read_tables(spark, path)[1].count() == 3


def test_of_two_first_loads_one_wins(shop, spark, tmp_path, monkeypatch):
    customers, orders = shop
    path = tmp_path / "shop"
    _meanwhile(monkeypatch, lambda: cl.load_tables(customers, orders.limit(1), str(path)))
    assert cl.load_tables(customers, orders, str(path)) is None
    assert cl.read_tables(spark, str(path))[1].count() == 1
    # The loser took its folders away.
    assert sum(p.name.startswith("orders-") for p in path.iterdir()) == 1


def test_a_load_that_is_not_there(spark, shop, tmp_path):
    path = str(tmp_path / "shop")
    cl.load_tables(*shop, path)
    with pytest.raises(FileNotFoundError):
        cl.read_tables(spark, path, 7)
    assert rows(cl.read_quarantine(spark, path)) == []
