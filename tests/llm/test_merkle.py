import hashlib
import random
import re
import zlib

from conftest import DOCUMENTS

from homeledger.llm import merkle
from homeledger.llm.queries import QUERIES


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i : i + 8]) for i in range(0, len(below), 8)])
    return levels


def way_up(levels, at):
    for nodes in levels[:-1]:
        first = at - at % 8
        yield nodes[first:at], nodes[at + 1 : first + 8]
        at //= 8


def brute(rows):
    """doc_id, leaf, subroot, root, proof, folded root, verified, number of siblings."""
    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        own = leaf((doc_id, source, lang, n_chars, text))
        later = own
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and text is not None:
            lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            later = leaf((doc_id, source, lang, n_chars, lower))
        groups.setdefault(lang, []).append((doc_id, own, later))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = [tree([r[1] for r in groups[g]]) for g in names]
    top = tree([t[-1][0] for t in trees])
    for place, g in enumerate(names):
        for at, (doc_id, own, later) in enumerate(groups[g]):
            steps = [*way_up(trees[place], at), *way_up(top, place)]
            value = later
            for left, right in steps:
                value = h(*left, value, *right)
            others = [s for left, right in steps for s in (*left, *right)]
            root = top[-1][0]
            yield doc_id, own, trees[place][-1][0], root, h(*others), value, value == root, len(others)


def compare(spark, df, rows, scratch):
    df.write.parquet(f"{scratch}/documents.parquet")
    got = QUERIES["op13_merkle_manifest"](spark, scratch).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)
    return got


def test_query_on_edges(spark, edge, edge_rows, scratch):
    compare(spark, edge, edge_rows, scratch)


def test_query_over_several_arrays(spark, scratch):
    """Groups of one, of more than a slot array, of ids far apart and negative, in no order."""
    rng = random.Random(8)
    ids = [*range(9000), *(rng.randrange(-(1 << 62), 1 << 62) for _ in range(800)), 7, 7, 8999]
    rows = [(i, f"Text {k}", "en" if k < 9400 else f"l{k % 12}", "s", k) for k, i in enumerate(ids)]
    rows += [(1, "A", "one", None, 1), (None, "x", "en", None, None), (None, "x", "en", None, None)]
    rng.shuffle(rows)
    got = compare(spark, spark.createDataFrame(rows, DOCUMENTS).repartition(6), rows, scratch)
    assert {r.root for r in got} == {got[0].root}
    assert 0.6 < sum(r.verified for r in got) / len(got) < 0.7


def test_single_leaf_and_empty(spark, empty, scratch):
    assert merkle.manifest(empty).count() == 0
    row = merkle.manifest(spark.createDataFrame([(5, "x", "en", "s", 1)], DOCUMENTS)).first()
    assert row.leaf == row.subroot == row.root == row.folded_root == leaf((5, "s", "en", 1, "x"))
    assert row.proof_sha256 == h() and row.verified and row.n_siblings == 0


def test_other_fields_and_group(spark):
    rows = [(i, f"t{i}", "en", f"s{i % 2}", 1) for i in range(30)]
    found = merkle.manifest(spark.createDataFrame(rows, DOCUMENTS), ("doc_id", "text"), "source").collect()
    want = {i: leaf((i, t)) for i, t, *_ in rows}
    assert {r.doc_id: r.leaf for r in found} == want and len({r.subroot for r in found}) == 2
