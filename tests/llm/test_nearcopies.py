import random

import corpus_pipeline
from conftest import DOCUMENTS, prose

from homeledger.llm import nearcopies


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def greedy(rows):
    """Ids that stay: those similar to no earlier one that stays."""
    kept = []
    for i, text in sorted(rows):
        found = shingles(text)
        if all(jaccard(found, other) < 0.8 for _, other in kept):
            kept.append((i, found))
    return [i for i, _ in kept]


def family(rng, size, words, edits):
    base = prose(rng, words).split()
    for _ in range(size):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(words)] = f"edit{rng.randrange(10**6)}"
        yield " ".join(copy)


def test_equals_the_greedy_loop_over_exact_similarity(spark):
    rng = random.Random(11)
    texts = [t for words, edits in ((60, 3), (200, 8), (200, 12), (400, 20), (3, 1)) for t in family(rng, 30, words, edits)]
    texts += [prose(rng, 150) for _ in range(20)] + [None, "", " ", "a b", "A  b", "b a"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want = greedy(rows)
    pairs = [(a, b) for a, x in rows for b, y in rows if a < b and 0.8 <= jaccard(shingles(x), shingles(y)) < 1]
    assert len(pairs) > 200 and 40 < len(want) < 150
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCUMENTS).repartition(4)
    assert sorted(r.doc_id for r in nearcopies.drop_near_copies(df).collect()) == want


def test_pipeline_drops_copies_that_fingerprints_keep_apart(spark):
    rng = random.Random(12)
    rows = [(i, t) for i, t in enumerate(t for _ in range(20) for t in family(rng, 2, 200, 6))]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCUMENTS)
    for name, stage in corpus_pipeline.STAGES:
        if name.startswith("near_"):
            df = stage(spark, df, "")
    left = df.collect()
    found = [shingles(r.text) for r in left]
    assert all(jaccard(a, b) < 0.8 for k, a in enumerate(found) for b in found[:k])
    assert len(left) >= 20


def test_edges(edge, empty):
    got = nearcopies.drop_near_copies(edge)
    assert got.columns == edge.columns
    ids = [r.doc_id for r in got.collect()]
    assert ids.count(7) == 1 and 8 not in ids and 9 not in ids and 3 in ids and 4 not in ids
    assert nearcopies.drop_near_copies(empty).count() == 0


def test_copies_of_dropped_test_items_and_of_personal_data(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names.index("decontamination") < names.index("near_copies") == names.index("packing") - 1
    rng = random.Random(14)
    body = prose(rng, 30)
    rows = [(i, f"Write to a{i}@example.com about {body}", "en", "s", 0) for i in range(4)]
    df = spark.createDataFrame(rows, DOCUMENTS)
    for name, stage in corpus_pipeline.STAGES:
        if name in ("personal_data", "near_copies"):
            df = stage(spark, df, "")
    assert [r.doc_id for r in df.collect()] == [0]


def test_a_large_group_is_compared_in_few_bands(spark):
    rng = random.Random(15)
    rows = list(enumerate(family(rng, 100, 200, 1)))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCUMENTS).repartition(4)
    made = []
    close = nearcopies._close

    def counted(asks, members):
        joined = asks.select("band", asks.rank.alias("p")).join(members, "band").filter("p < rank")
        made.append(joined.count())
        return close(asks, members)

    nearcopies._close = counted
    try:
        assert sorted(r.doc_id for r in nearcopies.drop_near_copies(df).collect()) == greedy(rows)
    finally:
        nearcopies._close = close
    assert sum(made) < 12 * len(rows)
