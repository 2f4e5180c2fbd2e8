import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use themselves.
CLASHING = ["key", "_key", "row", "_row", "fp", "root", "component_id", "score", "lang_pred", "ids", "spans", "codes",
            "host", "line", "w", "x", "y", "low", "norm", "shard", "slot", "index", "part", "item", "label"]


def prose(rng, words):
    pool = ["alpha", "bravo", "cedar", "delta", "ember", "fjord", "grove", "heron", "inlet", "joker", "kayak", "lemon"]
    return " ".join(rng.choice(pool) + str(rng.randrange(50)) for _ in range(words))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty, blank and long texts, ties, copies and repeated rows."""
    rng = random.Random(3)
    long = prose(rng, 30_000)
    copy = prose(rng, 120)
    near = copy.replace(" ", "  ", 1)
    texts = [None, "", "   \n\t", "word", "Word", "one two three", "ÀÉ ß İ K ſ", copy, copy, near, long, "!" * 70_000,
             "a" * 50_000, "1 " * 20_000, "same line\nsame line\nsame line\nother", prose(rng, 60), "\x00\x1f  x"]
    rows = [(i, t, "en", f"s{i % 3}", 1) for i, t in enumerate(texts)]
    rows += [(None, copy, None, None, None), (None, None, None, None, None), (7, copy, "en", "s1", 1)]
    rows += [(100 + i, prose(rng, 40 + i), None if i % 4 == 0 else "en", None if i % 5 == 0 else "s1", None) for i in range(20)]
    return rows


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    """The edge rows, with extra columns of clashing names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(edge_rows, DOCUMENTS).repartition(3, "text")
    return df.select("*", *[F.lit(None).cast("string").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)
