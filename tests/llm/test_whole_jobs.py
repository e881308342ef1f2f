"""Inputs on which a shortened job loses rows that the whole job finds."""

from __future__ import annotations

import numpy as np
import pytest

from bomwerk.llm import decontaminate, langid, near_dups


def families(spark, seeds, copies):
    """Two groups of edited copies a seed, and their ids: only the first texts of the two groups are similar, by 0.817 to at most 0.796."""
    texts = []
    for seed in seeds:
        rng = np.random.default_rng(seed)
        base = [f"w{seed}x{k}" for k in rng.permutation(400)]
        other = list(base)
        cuts = [20 + 45 * k for k in range(8)]
        for k in cuts:
            other[k] = f"o{seed}x{k}"
        for side, words in enumerate((base, other)):
            for copy in range(copies):
                edited = list(words)
                # the first is edited where the two groups differ anyway
                at = cuts[side] if copy == 0 else 22 + 45 * int(rng.integers(8)) + int(rng.integers(5, 35))
                edited[at] = f"e{seed}x{side}x{copy}"
                texts.append(" ".join(edited))
    want = {n: n // (2 * copies) * 2 * copies for n in range(len(texts))}
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), want


def test_refused_links_leave_the_others_of_a_block(spark):
    docs, want = families(spark, [0, 1, 2, 10], 8)
    assert {r.doc_id: r.class_id for r in near_dups.classes(docs).collect()} == want


def test_a_similar_pair_behind_many_others_in_doubt(spark):
    docs, want = families(spark, [0, 2], 150)
    assert {r.doc_id: r.class_id for r in near_dups.classes(docs).collect()} == want


def test_long_texts_keep_their_margin():
    rng = np.random.default_rng(1)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    words = {lang: ["".join(rng.choice(letters, 7)) for _ in range(3000)] for lang in ("aa", "bb")}
    text = {lang: " ".join(rng.choice(some, 15_000)) for lang, some in words.items()}
    judge = langid._judge({lang: some.encode()[: langid.DICTIONARY_BYTES] for lang, some in text.items()})
    short, long = (judge(" ".join(rng.choice(words["bb"], n))) for n in (3000, 1_500_000))
    assert short[::2] == long[::2] == ("bb", False)
    assert abs(short[1] - long[1]) < 0.1


def leaks(spark, item, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = decontaminate.contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    return sorted((r.doc_id, r.reparameterised) for r in found)


def test_items_of_mostly_placeholders(spark):
    item = "What is 12 + 7 - 3 + 9?"
    assert leaks(spark, item, f"Some words. {item} More words.", "Some words. What is 5 + 4 - 1 + 2? More words.", None) == [(0, False)]


def test_one_changed_value_leaves_the_other_windows(spark):
    item = "A farmer sells 12 boxes of ripe pears at the old market and then he drives home again to fetch another 12 boxes for his neighbour in town."
    changed = item.replace("another 12", "another 15")
    assert leaks(spark, item, item, f"Some words. {changed} More words.", "Some words, and 12 boxes, and 15 boxes.") == [(0, False), (1, False)]


def test_short_items_are_whole_texts(spark):
    items = spark.createDataFrame([(1, "Paris"), (2, "Yes, no!"), (3, "..."), (4, None), (5, "paris"), (6, "one two three four")], "item_id long, text string")
    docs = [(1, " PARIS. "), (2, "in Paris"), (3, "yes no"), (4, "no yes"), (5, ""), (6, None), (7, "one two three four"), (None, "Paris")]
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert sorted((r.doc_id, r.item_id, r.coverage) for r in found) == [(1, 1, 1.0), (1, 5, 1.0), (3, 2, 1.0), (7, 6, 1.0)]


def test_filter_of_window_hashes(spark):
    values = [0, -1, 1, 2**63 - 1, -(2**63), 12345678901234567, -98765432109876543]
    mask = decontaminate._filter(spark.createDataFrame([(values[:4],), (values[4:],), (values[:2],)], "windows array<long>"))
    places = {(v % 2**64) >> (64 - decontaminate.BITS) for v in values}
    assert all(mask[p >> 3] >> (p & 7) & 1 for p in places)
    assert int(np.unpackbits(mask).sum()) == len(places)
    assert not decontaminate._filter(spark.createDataFrame([], "windows array<long>")).any()


def test_template_windows_equal_a_plain_join(spark):
    """Which items a document holds word for word or with values exchanged, window by window."""
    rng = np.random.default_rng(7)
    words = [f"w{n}" for n in range(40)]
    items = [(n, " ".join(rng.choice(words, 14)) + f" costs {n + 3} dollars") for n in range(30)]
    docs = []
    for n in range(60):
        item = items[n % 30][1].split()
        if n % 4 == 1:
            item = [str(900 + n) if w.isdigit() else w for w in item]  # other figures
        if n % 4 == 2:
            item[6] = "elsewhere"  # breaks the windows around
        if n % 4 == 3:
            item = item[:9]
        docs.append((n, "before " + " ".join(item) + " after and so on"))

    def canonical(text):
        out = []
        for word in text.split():
            out.append(("N", word) if word.isdigit() else ("U", word) if word == "dollars" and out and out[-1][0] == "N" else (word, None))
        return out

    want = set()
    for d, text in docs:
        theirs = canonical(text)
        for i, item in items:
            ours, held, total = canonical(item), 0, 0
            for at in range(len(ours) - decontaminate.WIDTH + 1):
                mine = [kind for kind, _ in ours[at : at + decontaminate.WIDTH]]
                total += 1
                held += any([kind for kind, _ in theirs[k : k + decontaminate.WIDTH]] == mine for k in range(len(theirs)))
            if held / total >= decontaminate.COVERAGE:
                want.add((d, i))
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.reparameterised for r in found.collect()}
    assert set(got) == want and {d for d, _ in want} >= {n for n in range(60) if n % 4 < 2}
    assert all(got[d, i] == (d % 4 == 1) for d, i in got if d % 30 == i)
