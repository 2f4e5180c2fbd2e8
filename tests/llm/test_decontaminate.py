import random

import numpy as np
from conftest import DOCUMENTS, prose
from pyspark.sql import functions as F

from homeledger.llm import decontaminate as d


def plain_tiles(test, doc, least):
    """Greedy string tiling by its definition: mark the longest common unmarked runs, again and again."""
    a, b, found = [False] * len(test), [False] * len(doc), []
    while True:
        best, where = least - 1, []
        for i in range(len(test)):
            for j in range(len(doc)):
                n = 0
                while (i + n < len(test) and j + n < len(doc) and test[i + n] == doc[j + n]
                       and not a[i + n] and not b[j + n]):
                    n += 1
                if n > best:
                    best, where = n, [(i, j)]
                elif n == best and n >= least:
                    where.append((i, j))
        if best < least or not where:
            return found
        for i, j in where:
            if not any(a[i : i + best]) and not any(b[j : j + best]):
                a[i : i + best] = b[j : j + best] = [True] * best
                found.append((i, j, best))


def test_tiles_equal_the_definition():
    rng = random.Random(1)
    for trial in range(60):
        letters = rng.choice([2, 3, 6, 30])
        test = np.array([rng.randrange(letters) for _ in range(rng.randrange(1, 30))])
        doc = np.array([rng.randrange(letters) for _ in range(rng.randrange(1, 60))])
        if trial % 2:
            cut = rng.randrange(len(test))
            doc = np.r_[doc[:10], test[cut:], doc[10:], test[:cut]]
        for least in (2, 5):
            got = d.tiles(test, doc, np.arange(len(doc)), least)
            want = plain_tiles(test.tolist(), doc.tolist(), least)
            # A search length's finds are marked before shorter ones, so lengths and coverage agree
            # up to the choice between overlapping runs of nearly equal length.
            assert sum(n for *_, n in got) >= 0.8 * sum(n for *_, n in want)
            assert max((n for *_, n in got), default=0) == max((n for *_, n in want), default=0)
            for i, j, n in got:
                assert (test[i : i + n] == doc[j : j + n]).all() and n >= least


def test_runs_do_not_cross_gaps():
    words = np.arange(10)
    at = np.array([0, 1, 2, 3, 4, 9, 10, 11, 12, 13])
    assert sorted(d.tiles(words, words, at, 5)) == [(0, 0, 5), (5, 5, 5)]


def items_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_planted_passages(spark):
    rng = random.Random(5)
    items = [prose(rng, 40) for _ in range(12)]
    words = [t.split() for t in items]
    reordered = " ".join(words[2][20:] + words[2][10:20] + words[2][:10])
    edited = " ".join(w if i % 12 else "zzz" for i, w in enumerate(words[3]))
    rows = [
        (1, f"{prose(rng, 100)} {items[0]} {prose(rng, 50)}"),
        (2, items[1].upper().replace(" ", ",\n")),
        (3, f"{prose(rng, 30)} {reordered}"),
        (4, f"{edited} {prose(rng, 30)}"),
        (5, prose(rng, 3000)),
        (6, " ".join(words[4][:10]) + " " + prose(rng, 90)),
        (7, f"{items[5]} {items[5]} {items[6]}"),
        (None, items[7]),
        (8, None), (9, ""), (10, items[8]), (10, items[8]),
    ]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], DOCUMENTS)
    bench = items_of(spark, [*items, None, "", "too short", items[0]])
    got = {(r.doc_id, r.item_id) for r in d.contaminated(docs, bench.filter("item_id < 15")).collect()}
    assert got == {(1, 0), (2, 1), (3, 2), (4, 3), (7, 5), (7, 6), (None, 7), (10, 8)}
    kept = [r.doc_id for r in d.decontaminate(docs, bench).collect()]
    assert sorted(kept) == [5, 6, 8, 9]
    # A saturated filter only costs work.
    small = d.contaminated(docs, bench.filter("item_id < 15"), filter_bits=64)
    assert {(r.doc_id, r.item_id) for r in small.collect()} == got


def test_items_that_repeat_themselves(spark):
    """Copies whose distinct seeds are fewer than a tenth of the item's words."""
    rng = random.Random(9)
    items = ["a b c d e " * 12, "row one two three four five\n" * 30, prose(rng, 20) + " x y" * 60, prose(rng, 40)]
    docs = [(i, f"{prose(rng, 30)} {t} {prose(rng, 30)}", "en", "s", 0) for i, t in enumerate(items)]
    docs.append((9, "a b c d e f " + prose(rng, 50), "en", "s", 0))
    found = d.contaminated(spark.createDataFrame(docs, DOCUMENTS), items_of(spark, items)).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(i, i) for i in range(4)]
    assert all(r.coverage == 1 for r in found)


def test_short_items_and_unspaced_scripts(spark):
    rng = random.Random(10)
    items = ["quick zebra", "seven green old gates", "solitaire", "日本の首都は東京です", "ประเทศไทยมีเมืองหลวง"]
    docs = [(i, f"{prose(rng, 30)} {t} {prose(rng, 30)}", "en", "s", 0) for i, t in enumerate(items)]
    docs += [(7, "前文日本の首都は東京です。後文", "ja", "s", 0), (8, "zebra quick gates old green seven 東京の首都", "en", "s", 0)]
    found = d.contaminated(spark.createDataFrame(docs, DOCUMENTS), items_of(spark, items)).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (7, 3)]


def test_phrase_shared_by_all_items(spark):
    """Equal to tiling every pair, also where most seeds are common to many items."""
    rng = random.Random(12)
    phrase = "which of the following statements is not true of the"
    items = [f"{phrase} {prose(rng, 12)}" for _ in range(25)] + [phrase]
    docs = [(i, f"{prose(rng, 20)} {phrase} {prose(rng, 30)}", "en", "s", 0) for i in range(20)]
    docs += [(100 + i, f"{prose(rng, 20)} {' '.join(t.split()[k:])} {prose(rng, 9)}", "en", "s", 0)
             for i, t in enumerate(items[:-1]) for k in (rng.randrange(15),)]
    got = {(r.doc_id, r.item_id) for r in d.contaminated(spark.createDataFrame(docs, DOCUMENTS), items_of(spark, items)).collect()}
    want = set()
    for doc_id, text, *_ in docs:
        words = d.word_hashes(text)
        for item, t in enumerate(items):
            test = d.word_hashes(t)
            if sum(n for *_, n in d.tiles(test, words, np.arange(len(words)))) >= d.COVERAGE * len(test):
                want.add((doc_id, item))
    assert got == want and len(want) > 30


def test_edges(spark, edge, empty):
    bench = items_of(spark, ["1 1 1 1 1 1", "same line same line same line other", "nothing of the kind is in here"])
    bench = bench.select("*", F.lit(1).alias("key"), F.lit(1).alias("words"))
    got = {(r.doc_id, r.item_id) for r in d.contaminated(edge, bench).collect()}
    assert got == {(13, 0), (14, 1)}
    kept = d.decontaminate(edge, bench)
    assert kept.columns == edge.columns and kept.count() == edge.count() - 2
    assert d.contaminated(empty, bench).count() == 0 and d.decontaminate(empty, bench).count() == 0
    assert d.contaminated(edge, bench.limit(0)).count() == 0
    assert d.decontaminate(edge, bench.limit(0)).count() == edge.count()
