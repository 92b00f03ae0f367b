"""Near-duplicate join against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from chromaloom.llm import jaccard

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_set(text, k):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if x]
    return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, num, den):
    s = {i: word_set(t, k) for i, t in rows}
    root = {i: i for i in s}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    ids = sorted(s)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            u = len(s[a] | s[b])
            if u and den * len(s[a] & s[b]) >= num * u:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (i, len(s[i]), find(i)) for i in s}


def planted(seed, n):
    """A dense group of near copies around the threshold, small sets, copies and odd texts."""
    r = random.Random(seed)
    base = [f"w{r.randrange(500)}" for _ in range(r.choice([60, 150]))]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one "), (5, "a b"), (6, "A  b"), (7, "a b c"), (8, "é\xa0b c d"), (9, "é\xa0b C d")]
    for i in range(10, n):
        w = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 2, 3, 3, 4])):
            w[r.randrange(len(w))] = f"x{r.randrange(40)}"
        rows.append((i * 3, " ".join(w if r.random() < .9 else w[:r.randrange(1, 12)])))
    return rows


@pytest.mark.parametrize("seed,k,num", [(1, 3, 90), (2, 5, 80), (3, 3, 90), (4, 5, 80)])
def test_components_match_brute_force(spark, seed, k, num):
    rows = planted(seed, 160)
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, sid string, component long").repartition(3)
    got = {r.doc_id: (r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(docs, k, num, 100).collect()}
    assert got == brute(rows, k, num, 100)


def test_empty_table_and_repeats(spark):
    schema = "doc_id long, text string"
    assert jaccard.components(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "q")]
    got = sorted((str(r.doc_id), r.component_id) for r in jaccard.components(spark.createDataFrame(rows, schema)).collect())
    assert got == [("1", 1), ("1", 1), ("2", 2), ("None", 1)]


def test_keep_one(spark):
    rows = [(5, "a b c d e f", "s"), (3, "A b c d e f", "s"), (3, "A b c d e f", "s"), (9, None, None), (8, "", "t")]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert kept.columns == ["doc_id", "text", "source"]
    assert sorted(r.doc_id for r in kept.collect()) == [3, 8, 9]


def test_plan_leaves_room():
    for band in range(2, 25):
        for num in (80, 90):
            t, k, e, m = jaccard.band_plan(band, num, 100)
            assert k == t + 1 + e and 1 <= m <= 4


def test_null_and_repeated_ids_are_no_identity(spark):
    say = lambda k: " ".join(f"t{k}w{i}" for i in range(60))
    rows = [(None, say(k), "s") for k in range(4)] + [(None, say(0) + " more", "s"), (7, say(8), "s"), (7, say(9), "s"), (7, say(9), "s")]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    assert len(kept) == 6 and len({r.text for r in kept}) == 6
    assert {r.text.split()[0] for r in kept} == {f"t{k}w0" for k in (0, 1, 2, 3, 8, 9)}


@pytest.mark.parametrize("size", [7, 64, 100_000])
def test_dense_groups_that_are_not_linked_make_no_rows(size):
    """Near copies of one text that share edits, most of them just not linked: 400 sets, in batches of `size` rows."""
    r, num, den = np.random.default_rng(5), 90, 100
    base = jaccard.mix(np.arange(100, dtype=np.uint64))
    members = []
    for i in range(400):
        gone = r.choice(100, 7, replace=False)
        new = jaccard.mix(np.arange(7, dtype=np.uint64) + np.uint64(1000 + (i // 2 if i % 10 == 1 else i) * 7))
        if i % 10 == 1:                                       # as good as the one before it: linked
            gone, new = last
        last = gone, new[:6] if i % 10 == 0 else new
        members.append((set(new.tolist()), set(base[gone].tolist())))
    rows, full = [], set(base.tolist())
    sets = [(full - gone) | new for new, gone in members]
    for i, (h, (new, gone)) in enumerate(zip(sets, members)):
        words = np.zeros(2, np.uint64)
        for x in h:
            words[x >> 6 & 1] ^= np.uint64(1 << (x & 63))
        d = sorted(new) + sorted(gone)
        rows += [(1, np.uint64(g).astype(np.int64).item(), i, i, len(h), len(d), len(d) - at, *words.view(np.int64).tolist()) for at, g in enumerate(d)]
    rows.sort(key=lambda x: x[1])
    names = ["c", "g", "sid", "component", "n", "nd", "tail", "s0", "s1"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[k:k + size])], names) for k in range(0, len(rows), size)]
    got = {tuple(x.values()) for b in jaccard.meetings(num, den)(batches) for x in b.to_pylist()}
    links = {(1, a, b) for a in range(400) for b in range(a + 1, 400) if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])}
    met = {(x[2], y[2]) for x in rows for y in rows if x[1] == y[1] and x[2] < y[2]}
    assert len(links) == 40 and links <= got
    assert len(met) > 20_000 and len(got) < 400                # what the join on a shared shingle made rows of


def family(seed, n, size, edits):
    """n texts of about `size` words with up to `edits` words of a common text exchanged, from few words or unique ones."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10 ** 6)}" for _ in range(size)]
    rows = []
    for i in range(n):
        w = list(base[:r.choice([size, size, size * 9 // 10])])
        for j in range(r.randrange(edits + 1)):
            w[r.randrange(len(w))] = f"x{r.randrange(30)}" if j % 2 else f"u{i}y{j}"
        rows.append((i, " ".join(w)))
    return rows


def test_dense_families_travel_as_sets_and_not_as_pairs(spark, monkeypatch):
    """240 texts around the threshold: tables of pairs and texts sent to a comparison stay in proportion to the sets."""
    rows, kept = family(3, 240, 200, 12), []

    def counted(df, put=jaccard.cut):
        out = put(df)
        if {"a", "b"} <= set(out.columns) and "times" not in out.columns:
            kept.append(("pairs", out.count()))
        return out
    monkeypatch.setattr(jaccard, "cut", counted)
    sent = jaccard.exact_links if hasattr(jaccard, "exact_links") else None
    if sent:
        monkeypatch.setattr(jaccard, "exact_links", lambda r, *a, **b: (kept.append(("texts", r.count())), sent(r, *a, **b))[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(docs, 5, 80, 100).collect()}
    assert got == brute(rows, 5, 80, 100)
    parts = {c for _, _, c in got.values()}
    assert 1 < len(parts) < 200                                           # some are linked, some are not
    assert max(n for _, n in kept) <= 2 * len(rows), kept


def test_hot_buckets_and_clusters_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "UNIT_ROWS", 7)
    monkeypatch.setattr(jaccard, "UNIT_SHINGLES", 900)
    rows = planted(5, 160)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(docs, 3, 90, 100).collect()}
    assert got == brute(rows, 3, 90, 100)


def test_units_hold_every_pair_of_two_components(spark):
    rows = [(1, i, 5) for i in range(40)] + [(1, 100 + i, 200 + i % 6) for i in range(13)] + [(2, i, i) for i in range(25)] + [(3, i, i) for i in range(4)]
    df = spark.createDataFrame(rows, "c long, sid long, component long")
    dealt = jaccard.units(df, "c", jaccard.F.lit(1), 4).collect()
    held = {}
    for r in dealt:
        held.setdefault((r.c, r.u), []).append((r.sid, r.component))
    met = {(c, x[0], y[0]) for (c, _), v in held.items() for x in v for y in v if x[1] != y[1] and x[0] < y[0]}
    assert met == {(x[0], x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[2] != y[2] and x[1] < y[1]}
    assert max(map(len, held.values())) < 40 and len(held) > 3 and len({k for k in held if k[0] == 3}) == 1


def test_folds_of_different_widths_meet(spark):
    """Sets on both sides of the sizes where folds get wider, linked and just not linked."""
    r, rows = random.Random(9), []
    for f, size in enumerate((500, 540, 1010, 1090, 2100)):
        base = [f"f{f}w{j}" for j in range(size)]
        for i in range(12):
            w = base[:size - r.randrange(size // 5)] if i % 2 else base + [f"f{f}z{i}y{j}" for j in range(r.randrange(size // 4))]
            for _ in range(r.randrange(size // 80)):
                w[r.randrange(len(w))] = f"x{r.randrange(99)}"
            rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.doc_id, x.n_shingles, x.component_id) for x in jaccard.components(docs, 5, 80, 100).collect()}
    want = brute(rows, 5, 80, 100)
    assert got == want and len({c for _, _, c in want.values()}) > 5
    assert len({jaccard.fold_words(n) for _, n, _ in want.values()}) >= 4


def test_keep_one_of_repeated_rows_and_a_large_list_of_names(spark, monkeypatch):
    say = lambda k: " ".join(f"t{k}w{i}" for i in range(40))
    rows = [(i % 9 if i % 4 else None, say(i % 5) if i % 7 else None, i) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(3)

    def check():
        got = [tuple(x) for x in jaccard.keep_one(docs).collect()]
        assert sorted(x[2] for x in got if x[1] is None) == sorted(x[2] for x in rows if x[1] is None)
        rest = [x for x in got if x[1] is not None]
        low = {t: min(i for i, u, _ in rows if u == t and i is not None) for t in {x[1] for x in rest}}
        assert len(rest) == 5 and all(x[0] == low[x[1]] and x in rows for x in rest)
    check()
    monkeypatch.setattr(jaccard, "BATCH_IDS", 0)                          # nothing is broadcast
    check()
