"""Components in contraction rounds, and classes that gain links later."""

from __future__ import annotations

import random
import time

import pytest

from bomwerk.llm import near_dups, rounds


def plain(edges):
    up = {}

    def top(n):
        while up.setdefault(n, n) != n:
            n = up[n]
        return n

    for a, b in edges:
        low, high = sorted((top(a), top(b)))
        up[high] = low
    return {n: top(n) for n in up}


def graph(seed):
    rng = random.Random(seed)
    chain = [(n, n + 1) for n in range(1000, 1200)]
    star = [(5000, n) for n in range(5001, 5300)]
    loose = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    return chain + star + loose + [(5001, 5000), (7, 7), (-3, 8)]


@pytest.mark.parametrize("short", [1 << 17, 40, 0])
def test_components(spark, short):
    edges = graph(1)
    rows = spark.createDataFrame(edges, "node long, other long").repartition(3)
    found = rounds.components(rows, short).collect()
    want = {n: r for n, r in plain([e for e in edges if e[0] != e[1]]).items()}
    assert len(found) == len(want) and {r.node: r.root for r in found} == want
    assert rounds.components(rows.limit(0), short).collect() == []


def test_links_added_later(spark):
    first, later = graph(1)[:-100], [(1000, 5000), (20_000, 20_001), (20_001, 5000), (-9, 30_000)]
    frame = lambda edges: spark.createDataFrame(edges, "node long, other long")
    found = rounds.joined(rounds.components(frame(first)), frame(later)).collect()
    want = plain([e for e in first if e[0] != e[1]] + later)
    assert {r.node: r.root for r in found} == want and len(found) == len(want)


def test_an_id_with_several_texts_joins_their_classes(spark):
    a, b, c = (" ".join(f"{side}{n}" for n in range(40)) for side in "abc")
    rows = [(3, a), (5, a), (5, b), (5, c), (9, b), (11, c), (12, a + " x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.class_id for r in near_dups.classes(docs).collect()} == {3}
    assert [r.doc_id for r in near_dups.deduplicated(docs).collect()] == [3]


def test_many_in_doubt_that_are_all_refused(spark):
    """2,000 texts of which any two are similar by 0.73 to 0.77: two edit the same place at most twice."""
    base = [f"w{n}" for n in range(8 * 13 * 5 + 4)]
    texts = []
    for n in range(2000):
        words = list(base)
        for i in range(8):  # a polynomial of second degree modulo 13
            words[4 + 5 * (13 * i + (n // 169 * i * i + n // 13 % 13 * i + n % 13) % 13)] = f"e{n}x{i}"
        texts.append((n, " ".join(words)))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(8)
    started = time.time()
    assert near_dups.classes(docs).where("class_id <> doc_id").isEmpty()
    assert time.time() - started < 180  # a minute on a machine with nothing else to do
