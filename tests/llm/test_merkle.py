"""Merkle manifest against a plain recomputation of every tree and every proof."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from chromaloom.llm import merkle, queries
from tests.oracle import compare, connect

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree int, idx int, root string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def tree_of(leaves):
    """All levels of a tree, bottom first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def climb(value, i, levels):
    proof = []
    for level in levels[:-1]:
        other = level[i ^ 1] if (i ^ 1) < len(level) else None
        proof += [other] if other is not None else []
        value = h(*((other or "", value) if i & 1 else (value, other or "")))
        i //= 2
    return value, proof


def plain(rows):
    def leaf(r, add=0):
        doc_id, source, lang, n_chars, text = r[:5]
        values = [doc_id, source, lang, None if n_chars is None else n_chars + add, text]
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, placed = [], []
    for lang in langs:
        own = sorted(((r[0] is not None, r[0] or 0, leaf(r), r) for r in rows if r[2] == lang), key=lambda t: t[:3])
        placed.append([t[3] for t in own])
        trees.append(tree_of([t[2] for t in own]))
    top = tree_of([t[-1][0] for t in trees]) if trees else []
    out = []
    for k, members in enumerate(placed):
        for i, r in enumerate(members):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            sub, first = climb(leaf(r, 1 if hit else 0), i, trees[k])
            whole, second = climb(sub, k, top)
            out.append((r[0], leaf(r), trees[k][-1][0], top[-1][0], h(*first, *second), whole, whole == top[-1][0]))
    return sorted(out, key=str)


def got(spark, rows, bits):
    df = spark.createDataFrame([tuple(r[:5]) + ("x", 1, 2, "y") for r in rows], SCHEMA).repartition(5)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    m = merkle.manifest(df, tampered, bits=bits)
    out = m.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256), "folded_root", "verified").collect()
    return sorted((tuple(r) for r in out), key=str)


ODD = [(None, None, None, None, None), (None, "s", None, 3, ""), (5, "é", "", 1, "漢"), (5, "é", "", 1, "漢"), (5, "a", "", 2**63 - 1, "x"), (42, None, "zz", None, "y" * 200_000)]


@pytest.mark.parametrize("bits,n", [(1, 13), (2, 37), (10, 37), (2, 0), (1, 1)])
def test_blocks_of_every_height(spark, bits, n):
    rows = [(i * 3 % 101, "s", ["en", "de", "fr", "en", "en"][i % 5], i, f"text {i}") for i in range(n)] + (ODD if n > 1 else [])
    assert got(spark, rows, bits) == plain(rows)


def test_many_languages(spark):
    rows = [(i, "s", f"l{i % 23}" if i % 23 else None, i, "t") for i in range(60)]
    assert got(spark, rows, 1) == plain(rows)


def test_versions_share_untouched_nodes():
    leaves = [h(str(i)) for i in range(100)]
    t = merkle.PersistentTree(leaves)
    before, root = len(t.digests), t.root
    new = t.replaced(42, h("x"))
    assert len(t.digests) - before == t.levels + 1          # the leaf and its ancestors only
    assert t.root == root and t.digests[root] == tree_of(leaves)[-1][0]
    assert t.digests[new] == tree_of([*leaves[:42], h("x"), *leaves[43:]])[-1][0]
    old, copied = t.path(42), t.path(42, new)
    for a, b, level in zip(old[:-1], copied[:-1], reversed(range(t.levels))):
        side = t.left if 42 >> level & 1 else t.right
        assert side[a] == side[b]                            # the other child is the same node
    again = t.replaced(7, h("y"))
    assert t.digests[again] == tree_of([*leaves[:7], h("y"), *leaves[8:]])[-1][0]


def test_sql(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    assert compare(spark, connect(d), d, queries.QUERIES["op12_merkle_manifest"], queries.SQL["op12_merkle_manifest"])[0] is None
