import random
from collections import Counter

import brute
import numpy as np
import pytest
from conftest import DOCUMENTS, prose

from homeledger.llm import simhash
from homeledger.llm.components import components


def test_fingerprint():
    texts = [None, "", " \t\n", "One", "a b c", "A b C d", "a b c d e f g", "x " * 50, "É é z b\x0bc d e\x1cf"]
    for text in texts:
        assert simhash.fingerprint(text.encode() if text else None) == brute.fingerprint(text)


def test_near_duplicates_on_edges(edge, edge_rows):
    prints = [brute.fingerprint(t) for _, t, *_ in edge_rows]
    ids = [10**9 if i is None else i for i, *_ in edge_rows]
    want = Counter((i, f, c) for (i, *_), f, c in zip(edge_rows, prints, brute.components(ids, prints, 4)))
    rows = simhash.near_duplicates(edge).collect()
    assert Counter((r.doc_id, r.fp % (1 << 64), 10**9 if r.component_id is None else r.component_id) for r in rows) == want


def test_deduplicate_keeps_one_row_of_each_group(edge, edge_rows):
    prints = [brute.fingerprint(t) for _, t, *_ in edge_rows]
    groups = brute.components(list(range(len(prints))), prints, 4)
    kept = simhash.deduplicate(edge)
    assert kept.columns == edge.columns
    rows = kept.collect()
    assert len(rows) == len(set(groups))
    smallest = {}
    for (doc_id, *_), g in zip(edge_rows, groups):
        if doc_id is not None:
            smallest[g] = min(smallest.get(g, doc_id), doc_id)
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(smallest.values())


def test_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.deduplicate(empty).count() == 0


@pytest.fixture(scope="module")
def dense():
    """Fingerprints around a few centres, in chains, and at random."""
    rng = random.Random(8)
    out = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(120):
            f = centre
            for _ in range(rng.randrange(7)):
                f ^= 1 << rng.randrange(64)
            out.add(f)
    f = rng.getrandbits(64)
    for i in range(40):
        f ^= 15 << (i % 16 * 4)
        out.add(f)
    return sorted(out)


@pytest.mark.parametrize("slice_size", [simhash.SLICE, 7])
def test_links_lose_no_pair(spark, dense, slice_size):
    signed = np.array(dense, dtype=np.uint64).view(np.int64).tolist()
    fps = spark.createDataFrame([(f,) for f in signed], "fp long")
    edges = simhash.links(fps, slice_size=slice_size)
    assert edges.count() < 15 * len(dense)
    roots = {r.node: r.root for r in components(edges, "test").collect()}
    got = [roots.get(f, f) for f in signed]
    assert got == brute.components(signed, dense, 4)


def test_forest_search_equals_scan(dense):
    fps = np.array(dense * 2, dtype=np.uint64)
    shards = np.repeat([0, 1], len(dense))
    forest = simhash.Forest(fps, shards)
    got = {(int(a), int(b)) for x, y in forest.search(np.arange(len(fps)), 4) for a, b in zip(x, y)}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    near &= shards[:, None] == shards[None, :]
    np.fill_diagonal(near, False)
    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(near))))


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 100)]
    edges += [(rng.randrange(5000, 5400), rng.randrange(5000, 5400)) for _ in range(200)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    df = spark.createDataFrame([e if i % 2 else e[::-1] for i, e in enumerate(edges)], "a long, b long")
    got = {r.node: r.root for r in components(df, "test").collect()}
    assert got == {x: find(x) for x in parent}
    assert components(df.limit(0), "test").count() == 0


def test_groups_of_copies(spark):
    rng = random.Random(6)
    rows, n = [], 0
    for size in (1, 2, 3, 300):
        base = prose(rng, 400)
        for k in range(size):
            words = base.split()
            if k % 3 == 1:
                words[rng.randrange(400)] = "changed"
            rows.append((n, " ".join(words), "en", "s", 0))
            n += 1
    prints = [brute.fingerprint(r[1]) for r in rows]
    want = dict(zip(range(n), brute.components(list(range(n)), prints, 4)))
    df = spark.createDataFrame(rows, DOCUMENTS).repartition(5)
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()} == want
