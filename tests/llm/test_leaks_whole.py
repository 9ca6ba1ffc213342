"""Leaks with their parts in another order, and documents shorter than an item, against brute force."""

import random
from collections import Counter

import pytest

from barweave.llm import decontaminate


def words(n, seed):
    rng = random.Random(seed)
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def best(text, item):
    n = min(5, len(item))
    grams = lambda x: Counter(tuple(x[j : j + n]) for j in range(len(x) - n + 1))
    b, size = grams(item), min(len(item), len(text))
    return max(sum((grams(text[s : s + size]) & b).values()) / sum((grams(text[s : s + size]) | b).values()) for s in range(len(text) - size + 1))


def compare(spark, rows, items):
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")
    want = {(i, k): s for i, t in rows for k, m in items if (s := best(t, m)) >= 0.8}
    assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.leaks(docs, bench).collect()} == pytest.approx(want)
    return set(want)


def test_swapped_halves(spark):
    item, long = words(57, 1), words(150, 2)
    rows = [(0, words(30, 3) + item[29:] + item[:29] + words(30, 4)), (1, item[29:] + item[:29]), (2, words(40, 5) + long[90:] + long[40:90] + long[:40] + words(3, 6)), (3, words(300, 7)), (4, words(20, 8) + item[29:] + words(9, 9) + item[:29] + words(20, 10))]
    assert compare(spark, rows, [(0, item), (1, long)]) == {(0, 0), (1, 0), (2, 1)}


def test_documents_shorter_than_the_item(spark):
    item = words(40, 1)
    rows = [(0, item[:37]), (1, item[2:]), (2, item[:30]), (3, item[:4]), (4, ["x"]), (5, item[20:] + item[:18])]
    assert compare(spark, rows, [(0, item), (1, words(6, 2))]) == {(0, 0), (1, 0)}


def test_many_items_of_one_size(spark, monkeypatch):
    """Windows meet the items that made them start, not all of their size; long documents are cut in stretches."""
    items = [(i, words(30, 100 + i)) for i in range(120)]
    rows = [(i, words(60, 500 + i) + items[i % 120][1] + words(30, 900 + i)) for i in range(40)]
    rows += [(100, [w for i in range(0, 120, 7) for w in items[i][1] + words(11, 40 + i)]), (101, items[3][1][:25] + items[4][1][5:]), (102, words(50, 3))]
    met = []

    def counted(probe, index, f=decontaminate.found_near):
        met.append((probe.select("doc_id", "start").distinct().count(), probe.join(index, ["item_id", "m", "block", "value"]).count()))
        return f(probe, index)

    monkeypatch.setattr(decontaminate, "found_near", counted)
    monkeypatch.setattr(decontaminate, "STRETCH", 100)
    assert len(compare(spark, rows, items)) > 50
    windows, pairs = met[0]
    assert 0 < pairs < 0.1 * windows * len(items)


def test_items_under_one_id(spark):
    docs = spark.createDataFrame([(0, " ".join(words(20, 1) + words(9, 5))), (1, " ".join(words(35, 2))), (2, " ".join(words(20, 3)))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(words(20, 1))), (7, " ".join(words(35, 2))), (7, " ".join(words(20, 3)))], "item_id long, text string")
    got = decontaminate.leaks(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"], r["similarity"], r["first_word"]) for r in got} == {(0, 7, 1.0, 0), (1, 7, 1.0, 0), (2, 7, 1.0, 0)}
