import random
from collections import Counter

import brute
from conftest import DOCUMENTS, prose

from homeledger.llm import linerules


def test_counts_on_edges(edge, edge_rows, empty):
    rows = linerules.quality_rules(edge).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert got == Counter((doc_id, *brute.counts(text)) for doc_id, text, *_ in edge_rows)
    assert linerules.quality_rules(empty).count() == 0


def test_counts_on_random_texts(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab \n\t#|é\x0b") for _ in range(rng.randrange(80))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCUMENTS)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
           for r in linerules.quality_rules(df).collect()}
    assert got == {i: brute.counts(t) for i, t in enumerate(texts)}


def test_common_lines_per_host(spark):
    rng = random.Random(9)
    banner = "Subscribe to our   newsletter and follow us"
    rows = []
    for i in range(60):
        host = "busy" if i < 40 else None
        own = prose(rng, 30)
        text = f"{banner}\n{own}" if i % 2 else "\n".join([banner.upper(), "one two three four five"])
        rows.append((i, text, "en", host, 0))
    df = spark.createDataFrame(rows, DOCUMENTS)
    got = {r.doc_id: r for r in linerules.quality_rules(df, max_host_docs=15, min_left=0.2).collect()}
    hosts = {h: [r for r in rows if r[3] == h] for h in ("busy", None)}
    for h, docs in hosts.items():
        lines = Counter()
        normal = lambda x: " ".join(x.lower().split())
        for r in docs:
            lines.update({normal(x) for x in r[1].split("\n")})
        for r in docs:
            gone = sum(len(x.split()) for x in r[1].split("\n") if lines[normal(x)] > 15)
            words = len(r[1].split())
            assert got[r[0]].common_words == gone
            assert got[r[0]].kept == (words >= 10 and words - gone >= 0.2 * words)
    assert any(not r.kept for r in got.values()) and any(r.kept for r in got.values())


def test_a_document_counts_once(spark):
    rows = [(1, "x y\n" * 50, "en", "s", 0), (2, "x y", "en", "s", 0)]
    counts = linerules.text_counts(spark.createDataFrame(rows, DOCUMENTS))
    assert linerules.common_lines(counts, 1).count() == 1 and linerules.common_lines(counts, 2).count() == 0


def test_common_lines_are_taken_out_of_the_texts(spark):
    rng = random.Random(11)
    banner = "Read  our TERMS today"
    texts = [f"{prose(rng, 12)}\n\n{banner if i % 2 else banner.lower()}\n {prose(rng, 5)}\n{banner}" for i in range(30)]
    rows = [(i, t, "en", "s" if i < 20 else None, 0) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[4], "en", "s", 0), (99, None, "en", "s", 0)]
    got = linerules.quality_rules(spark.createDataFrame(rows, DOCUMENTS), max_host_docs=15).collect()
    want = Counter()
    for doc_id, text, _, host, _ in rows:
        lines = (text or "").split("\n")
        clean = "\n".join(x for x in lines if x.lower().split() != banner.lower().split()) if host and text else None
        want[doc_id, clean, 8 if clean is not None else 0] += 1
    assert Counter((r.doc_id, r.clean, r.common_words) for r in got) == want
