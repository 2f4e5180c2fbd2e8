import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from homeledger.llm import lengths, packing, shards, tokens


def plain_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder.encode_special_tokens = True
    return np.array(encoder.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")


@pytest.fixture(scope="module")
def edge_ids(edge_rows):
    return [(doc_id, plain_ids(text)) for doc_id, text, *_ in edge_rows]


def test_ids_that_do_not_fit_raise(spark, edge, scratch):
    with pytest.raises(ValueError, match="u1"):
        shards.write_shards(edge, f"{scratch}/s", dtype="<u1")


def test_ids_are_those_of_the_tokenizer(edge_rows):
    for _, text, *_ in edge_rows:
        assert (tokens.document_ids(text) == plain_ids(text)).all()
    odd = "it's <|endoftext|> 123  \n\n x y 漢字 🙂\r\n"
    assert (tokens.document_ids(odd) == plain_ids(odd)).all()


@pytest.mark.parametrize("block", [1, 5000, 1 << 20])
def test_packing_holds_each_id_once(edge, edge_ids, block):
    rows = packing.pack(edge, sequence=256, block_tokens=block).collect()
    pieces, filled = {}, {}
    for r in rows:
        assert len(r.ids) == 4 * r.length > 0
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.ids))
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in filled.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256 and (at & (at - 1)) == 0  # no padding at all
    want = {}
    for doc_id, ids in edge_ids:
        want.setdefault((doc_id, len(ids)), []).append(ids.tobytes())
    assert want.keys() == pieces.keys()
    for key, texts in want.items():
        # Copies of one id and length share a key; their pieces then add up to all of them.
        assert sum(len(p) for _, p in pieces[key]) == sum(map(len, texts))
        if len(texts) == 1:
            assert b"".join(p for _, p in sorted(pieces[key])) == texts[0]


def test_packing_balances_cost():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 300, 400)  # several documents fit in a sequence
    placed = packing.assign(sizes, 1024, 1 / 512)
    cost, filled = {}, {}
    for _, _, length, number, _ in placed:
        cost[number] = cost.get(number, 0) + length + length * length / 512
        filled[number] = filled.get(number, 0) + length
    full = [cost[n] for n in cost if filled[n] == 1024]
    # In the order given, one sequence after another, the spread is far larger.
    naive, left = [0.0], 1024
    for size in sizes.tolist():
        while size:
            length = min(size, left)
            naive[-1] += length + length * length / 512
            size, left = size - length, left - length
            if not left:
                naive.append(0.0)
                left = 1024
    assert np.std(full) < 0.5 * np.std(naive[:-1])
    assert sum(filled.values()) == sizes.sum()


def test_packing_empty_table(empty):
    assert packing.pack(empty).count() == 0


def test_length_table(edge, edge_ids):
    n = np.array([len(ids) for _, ids in edge_ids])
    table = lengths.length_table(lengths.histogram(lengths.encoded_lengths(edge)))
    rows = {r.n_tokens: r for r in table.collect()}
    assert sorted(rows) == sorted(set(n.tolist()))
    for k, r in rows.items():
        assert (r.docs, r.docs_at_most, r.docs_longer) == ((n == k).sum(), (n <= k).sum(), (n > k).sum())
        assert (r.tokens_at_most, r.tokens_longer) == (n[n <= k].sum(), n[n > k].sum())
        assert r.truncated_tokens == np.minimum(n, k).sum()
        assert r.lost_tokens == n.sum() - np.minimum(n, k).sum()
        assert r.quantile == pytest.approx((n <= k).mean())
    limits = [0, 1, 2, 77, 2048, 10**7]
    got = {r.context_limit: (r.docs_cut, r.tokens_kept) for r in lengths.truncated_totals(table, limits).collect()}
    assert got == {k: ((n > k).sum(), np.minimum(n, k).sum()) for k in limits}
    shares = {r.share: r.n_tokens for r in lengths.length_quantile(table, [0.1, 0.5, 1.0]).collect()}
    assert shares == {s: np.quantile(n, s, method="inverted_cdf") for s in (0.1, 0.5, 1.0)}


def test_length_table_empty(empty):
    table = lengths.length_table(lengths.histogram(lengths.encoded_lengths(empty)))
    assert table.count() == 0
    assert lengths.truncated_totals(table, [5]).collect()[0].tokens_kept == 0


@pytest.mark.parametrize("count", [1, 2, 3, 4, 5, 16, 17, 1000, 4097])
def test_permutation_is_a_bijection(count):
    index = np.arange(count)
    slots = shards.permute(index, count, key=9)
    assert sorted(slots.tolist()) == index.tolist()
    if count > 100:
        assert (slots != shards.permute(index, count, key=10)).mean() > 0.9
        assert np.abs(np.corrcoef(index, slots)[0, 1]) < 0.1


def test_shards_round_trip(spark, edge, edge_ids, scratch):
    shards.write_shards(edge, f"{scratch}/order", key=5, sequence=128, shard_slots=64)
    rows = shards.read_shards(spark, f"{scratch}/order").orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(len(rows)))
    assert sorted(r["index"] for r in rows) == list(range(len(rows)))
    assert all(len(r.ids) == 256 and r.shard == r.slot // 64 and r.byte_offset == r.slot % 64 * 256 for r in rows)
    assert sum(r.n_tokens for r in rows) == sum(len(ids) for _, ids in edge_ids)
    # Back in index order, the unpadded ids are the documents again.
    stream = b"".join(r.ids[: 2 * r.n_tokens] for r in sorted(rows, key=lambda r: r["index"]))
    ids = np.frombuffer(stream, "<u2")
    ends = np.flatnonzero(ids == 1)
    got = sorted(zlib.crc32(x.astype("<u4").tobytes()) for x in np.split(ids, ends + 1)[:-1])
    assert got == sorted(zlib.crc32(ids.tobytes()) for _, ids in edge_ids)
    # Resumed in the middle of a shard.
    later = shards.read_shards(spark, f"{scratch}/order", first_slot=100)
    assert [r.slot for r in later.orderBy("slot").collect()] == list(range(100, len(rows)))
    # Each shard is one file, in order.
    files = spark.read.parquet(f"{scratch}/order/shards").select("shard", F.input_file_name().alias("f")).distinct()
    assert files.count() == files.select("shard").distinct().count() == -(-len(rows) // 64)


def test_shards_empty(spark, empty, scratch):
    shards.write_shards(empty, f"{scratch}/none")
    assert shards.read_shards(spark, f"{scratch}/none").count() == 0


def test_assign_random_sizes():
    rng = random.Random(2)
    for _ in range(30):
        sizes = np.array([rng.choice([1, 2, 63, 64, 65, 128, rng.randrange(1, 400)]) for _ in range(rng.randrange(1, 60))])
        got = {}
        for doc, start, length, *_ in packing.assign(sizes, 64, 0.1):
            got.setdefault(doc, []).append((start, length))
        for doc, spans in got.items():
            at = 0
            for start, length in sorted(spans):
                assert start == at
                at += length
            assert at == sizes[doc]
