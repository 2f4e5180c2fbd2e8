import sys

import brute

import __spark_entry__
import corpus_pipeline
from homeledger.llm import decontaminate, language, packing, simhash, tokens
from homeledger.llm.text import documents

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = documents(spark, DATA)
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == columns
        before, after = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.text for r in out.collect()}
        kept[name] = (before, after)
        docs = spark.createDataFrame(out.collect(), out.schema)
    before, after = kept["language"]
    assert all(language.LETTER.search(t) for t in after.values()) and len(after) > 0.95 * len(before)
    before, after = kept["near_duplicates"]
    groups = brute.components(list(before), [brute.fingerprint(t) for t in before.values()], simhash.RADIUS)
    assert set(after) == set(groups) and all(after[i] == before[i] for i in after)
    before, after = kept["decontamination"]
    items = [decontaminate.word_hashes(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]

    def leaked(text):
        words = decontaminate.word_hashes(text)
        at = range(len(words))
        import numpy as np

        cover = [sum(n for *_, n in decontaminate.tiles(i, words, np.array(at))) / len(i) for i in items]
        return max(cover) >= decontaminate.COVERAGE

    assert set(after) == {i for i, t in before.items() if not leaked(t)}
    before, after = kept["personal_data"]
    assert set(after) == set(before)
    for i, text in after.items():
        assert sum(brute.base_spans(text)[0][:2]) == 0
        if not brute.base_spans(before[i])[2]:
            assert "[EMAIL]" not in text and "[CARD]" not in text


def test_run_packs_what_is_left(spark):
    rows = corpus_pipeline.run(spark, DATA).collect()
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
        assert r.length <= packing.SEQUENCE
    assert all(total[r.doc_id] == r.doc_tokens for r in rows)
    assert len(total) > 100


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert tokens.EOS == 1 and "homeledger.llm" in sys.modules


def test_stages_on_edges(spark, edge, empty):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0, name
        out = stage(spark, edge, DATA)
        if name == "packing":
            assert out.count() >= edge.count()
        else:
            assert out.columns == edge.columns and 0 < out.count() <= edge.count(), name
