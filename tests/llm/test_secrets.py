"""Secret scans: planted findings, the forest and odd rows."""

import random

import numpy as np

from chromaloom.llm import secrets
from chromaloom.llm.queries import tokenizer_file

KNOWN = secrets.dictionary(tokenizer_file("piece_bpe_32k.model"))


def planted(seed, n):
    r = random.Random(seed)
    rows, truth = [], {}
    for i in range(n):
        kind = r.randrange(4)
        key = "".join(r.choice("0123456789abcdef") for _ in range(40))
        value = [f'token = "{key}"', f"see /usr/share/doc/part{i}/index.html", f"call {r.randrange(10 ** 15, 10 ** 16)} now", f"mail user{i}@mail.example.com"][kind]
        rows.append((i, f"some words before {value} and after"))
        truth[i] = kind == 0
    return rows, truth


def test_forest_separates_held_out(spark):
    train, _ = planted(1, 400)
    test, truth = planted(2, 200)
    df = lambda rows: spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, start int")
    findings = secrets.labelled(secrets.scan(df(train), KNOWN))
    got = secrets.scan_and_classify(df(test), KNOWN, findings).collect()
    assert {r.doc_id for r in got if r.is_secret} == {i for i, t in truth.items() if t}
    assert all(0 <= r.score <= 1 for r in got)
    text = dict(test)
    assert all(text[r.doc_id][r.start:r.start + r.length].isalnum() for r in got if r.is_secret)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "é𝄞 token = a1b2c3d4e5f6a7b8"), (3, "é𝄞 token = a1b2c3d4e5f6a7b8"), (None, "x" * 30 + "1"), (4, "ab1" * 20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = secrets.scan_and_classify(df, KNOWN).collect()
    assert sorted(str(r.doc_id) for r in got) == ["3", "3", "4", "None"]
    assert {r.start for r in got if r.doc_id == 3} == {11}
    assert secrets.scan_and_classify(df.limit(0), KNOWN).count() == 0


def test_one_label_and_none():
    assert secrets.Forest([]).score(np.zeros((2, secrets.FEATURES))).tolist() == [0.0, 0.0]
    x = np.random.default_rng(0).random((30, secrets.FEATURES))
    tree = secrets._grow(x, np.ones(30), np.random.default_rng(1))
    assert secrets.Forest([tree]).score(x).tolist() == [1.0] * 30


def test_coverage():
    assert secrets.coverage("thereabout", frozenset({"there", "about"})) == 1.0
    assert secrets.coverage("xx9there", frozenset({"there"})) == 5 / 8
