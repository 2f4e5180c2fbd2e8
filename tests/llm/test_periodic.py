import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from conftest import DOCUMENTS

from homeledger.llm import periodic
from homeledger.llm.queries import QUERIES


def brute(words):
    """Every lag, word by word; a stretch found at a smaller lag has that period."""
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > s and i + q - s >= max(24, 3 * q):
                found.setdefault((s, i + q), q)
            i += i == s
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def made(rng):
    text = []
    size, kinds = rng.randrange(260), rng.choice([1, 2, 3, 6, 40])
    while len(text) < size:
        how = rng.random()
        if how < 0.5:
            block = [b"w%d" % rng.randrange(kinds) for _ in range(rng.randrange(1, 25))]
            text += (block * 9)[: rng.randrange(1, 130)]
        elif how < 0.7 and text:
            at = rng.randrange(len(text))
            text += text[at : at + rng.randrange(1, 60)] * rng.randrange(1, 4)
        else:
            text += [b"w%d" % rng.randrange(kinds) for _ in range(rng.randrange(1, 30))]
    return text


def test_runs_equal_brute_force(monkeypatch):
    rng = random.Random(5)
    texts = [made(rng) for _ in range(600)]
    want = [brute(t) for t in texts]
    assert sum(map(len, want)) > 400
    got = []
    while len(got) < len(texts):
        monkeypatch.setattr(periodic, "PIECE", rng.choice([7, 100, 1 << 20]))
        got += periodic.find_runs(texts[len(got) : len(got) + rng.randrange(1, 9)])
    assert got == want


def test_long_uniform_text_is_one_run():
    assert periodic.find_runs([[b"a"] * 60_000, [], [b"a"] * 23, [b"a"] * 24]) == [[(0, 60_000, 1)], [], [], [(0, 24, 1)]]


def test_rare_words_split():
    import numpy as np

    words = np.array([1] * 24 + [2] + [1] * 23 + [3] + [4, 5] * 12)
    assert periodic.split_rare(words, np.zeros(len(words), int)).tolist() == [*range(24), *range(49, 73)]


def contract(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in runs)]
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()), sha(b" ".join(kept)), n,
    )


@pytest.mark.parametrize("rows", ["edge", "made"])
def test_query(spark, edge, edge_rows, rows, scratch):
    if rows == "edge":
        df = edge
        given = [(r[0], r[1]) for r in edge_rows if len(r[1] or "") < 20_000]  # brute force is too slow for longer
    else:
        rng = random.Random(6)
        given = [(i, b" ".join(made(rng)).decode()) for i in range(400)]
        df = spark.createDataFrame([(*r, None, None, None) for r in given], DOCUMENTS)
    df.write.parquet(f"{scratch}/documents.parquet")
    out = QUERIES["op11_periodic_runs"](spark, scratch)
    assert out.columns[:8] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
                               "collapsed_sha256"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == df.count()
    key = lambda r: tuple(str(v) for v in r)
    want = [contract(*r) for r in given]
    short = {r[0] for r in given}
    if rows == "edge":
        got = [r for r in got if r[0] in short and r[-1] < 5000]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_operator_output_and_empty_table(spark, edge, empty):
    assert periodic.periodic_runs(empty).count() == 0
    text = "x y " * 20 + "end of it"
    row = periodic.periodic_runs(spark.createDataFrame([(1, text, "", "", 1)], DOCUMENTS)).first()
    assert row.collapsed == "x y end of it" and row.n_words == 43
    assert [tuple(r) for r in row.runs] == [(0, 40, 2)] == [tuple(row.strongest)]
