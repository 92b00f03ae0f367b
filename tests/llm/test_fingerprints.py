"""Fingerprints against brute force on sets of pieces."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from chromaloom.llm import fingerprints as fp


def piece_set(text):
    return {p.strip(" ") for p in re.split(r"\n|(?<=[.!?])[ \t\r\f\x0B]+", text)} - {""}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    order = sorted({(i, t or "") for i, t in rows}, reverse=True)
    out = {}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        new = t[:len(t) - half] + after[:half]
        out[i] = (len(t), hashlib.sha256(new.encode()).hexdigest(), jaccard(piece_set(t), piece_set(new)), jaccard(piece_set(t), piece_set(after)))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, h int, n string").repartition(3)
    got = fp.edited_fingerprints(df).collect()
    want = brute(rows)
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    for r in got:
        n, sha, edited, after = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert r.near_edited == pytest.approx(edited) and r.near_next == pytest.approx(after)
    return got


def test_brute_force(spark):
    body = [f"Sentence {k} of a text. " for k in range(300)]
    rows = [(5, "".join(body)), (4, "".join(body[:299]) + "Another end."), (3, "".join(body[100:])), (9, None), (11, ""), (20, "One line only"),
            (21, "é𝄞漢 x. Y!\nZ? w"), (30, "".join(body)), (31, "\n\n \n"), (40, "a.\nb.\na.\n" * 40 + "c")]
    got = {r.doc_id: r for r in check(spark, rows)}
    assert got[5].fingerprint == got[30].fingerprint and got[9].fingerprint == got[11].fingerprint
    assert got[5].fingerprint != got[4].fingerprint


def test_repeats_single_and_empty(spark):
    assert len(check(spark, [(1, "A b. C d.")])) == 1
    got = check(spark, [(1, "A b. C d."), (1, "A b. C d."), (2, "A b. Q d.")])
    assert len(got) == 3
    assert fp.edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_null_id(spark):
    df = spark.createDataFrame([(None, "A b. C d."), (3, "X y.")], "doc_id long, text string")
    got = {r.doc_id: r.edited_sha256 for r in fp.edited_fingerprints(df).collect()}
    assert got[3] == hashlib.sha256(b"X A ").hexdigest() or len(got) == 2


def test_peeling_needs_a_larger_sketch(spark):
    """More differing digests than the base sketch holds are found by the retries."""
    a, b = list(range(1000)), list(range(700, 1500))
    pairs = spark.createDataFrame([(1, a, b), (2, a, a), (3, [], []), (4, [7], [])], "id long, a array<int>, b array<int>")
    got = {r.id: r.near for r in fp.likeness(pairs, ["id"], ["id"]).collect()}
    assert got == {1: pytest.approx(300 / 1500), 4: 0.0}      # equal sets have no row


def test_retry_after_a_failure(spark, monkeypatch):
    monkeypatch.setattr(fp, "ROOM", 0.3)
    pairs = spark.createDataFrame([(1, list(range(500)), list(range(250, 800)))], "id long, a array<int>, b array<int>")
    assert fp.likeness(pairs, ["id"], ["id"]).first().near == pytest.approx(250 / 800)


def test_cells_subtract(spark):
    rows = spark.createDataFrame([(1, 5, 1), (1, 6, 1), (1, 5, -1)], "id long, d int, s int")
    left = fp.cells(rows, ["id"], "d", F.col("s"), F.lit(8)).where("n <> 0")
    assert left.count() == 3 and {r.x for r in left.collect()} == {6}
