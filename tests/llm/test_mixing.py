import random
import re

import duckdb
import pytest
from conftest import DOCUMENTS

from homeledger.llm import mixing
from homeledger.llm.queries import ORACLE, QUERIES


def targets(sizes, weights=(3, 1, 2), share=1.5, epochs=2):
    """Resharing as the contract words it; ``sizes`` by source name, None last."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    left, open_ = share * sum(sizes.values()), set(names)
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        above = {s for s in open_ if target[s] > epochs * sizes[s]}
        left = sum(target[s] - epochs * sizes[s] for s in above)
        for s in above:
            target[s] = float(epochs * sizes[s])
        open_ -= above
    return target


def check(rows):
    sizes, taken = {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], abs=1e-6)
    for s in sizes:
        assert abs(taken[s] - want[s]) < 1 + 1e-6
    # Within a source the documents lie one after the other in the mix's order.
    for s in sizes:
        at = 0
        for r in sorted((r for r in rows if r.source == s), key=lambda r: (r.start, r.size)):
            assert r.start == at
            at += r.size


@pytest.mark.parametrize("case", ["skewed", "capped", "one", "nothing"])
def test_mix(spark, case):
    rng = random.Random(case)
    sources = {"skewed": ["a"] * 30 + ["b", "é", "z", None, ""], "capped": ["a", "b", "c", "d", None],
               "one": ["only"], "nothing": ["a", None]}[case]
    rows = []
    for i in range(300 if case != "nothing" else 4):
        source = rng.choice(sources)
        many = {"nothing": 0, "capped": 400 if source == "b" else 3}.get(case, 40)
        rows.append((i, rng.choice([" ", "\n\t"]).join(["w"] * rng.randint(0, many)), "en", source, None))
    df = spark.createDataFrame(rows, DOCUMENTS)
    found = mixing.mix(df).collect()
    assert sorted((r.doc_id, r.size, r.source) for r in found) == [
        (i, len(re.findall(r"[^\x20\x09-\x0D]+", t)), s) for i, t, _, s, _ in rows]
    check(found)
    again = mixing.mix(df.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    if case == "skewed":  # another seed, another choice
        other = mixing.mix(df, seed=99).collect()
        assert {r.doc_id: r.taken for r in other} != {r.doc_id: r.taken for r in found}
        check(other)


def test_edges(spark, edge, empty):
    assert mixing.mix(empty).count() == 0
    found = mixing.mix(edge).collect()
    assert len(found) == edge.count()
    check(found)


def test_general_weights(spark):
    rows = [(i, "w " * 10, None, "ab"[i % 2], None) for i in range(100)]
    found = mixing.mix(spark.createDataFrame(rows, DOCUMENTS), weights=(9, 1), share=1.0, epochs=3).collect()
    taken = {s: sum(r.taken for r in found if r.source == s) for s in "ab"}
    assert taken == {"a": 900, "b": 100}


def test_twin(spark, edge, scratch):
    edge.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{scratch}/documents.parquet")
    got = QUERIES["op12_mix_sources"](spark, scratch)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{scratch}/documents.parquet/*.parquet'")
    want = con.execute(ORACLE["op12_mix_sources"])
    columns = [c[0] for c in want.description]
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in got.select(*columns).collect())
