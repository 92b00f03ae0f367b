"""Decontamination against brute force over all windows."""

import random
import re
from collections import Counter

from chromaloom.llm import decontam


def words(text):
    return [w for w in re.split(r"[^\w]+|_+", (text or "").lower()) if w]


def grams(w):
    return Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def brute(docs, items, num=80):
    found = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            x = words(item)
            g = grams(x)
            if not g:
                continue
            best = 0.0
            for s in range(max(1, len(w) - 4)):
                h = grams(w[s:s + len(x)])
                common, union = sum((g & h).values()), sum((g | h).values())
                if union and 100 * common >= num * union:
                    best = max(best, common / union)
            if best:
                found[d, i] = best
    return found


def planted(seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}é" for k in range(300)]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(k, say(r.choice([5, 6, 20, 40, 70]))) for k in range(12)] + [(50, say(3)), (51, []), (52, ["rep", "eat"] * 12)]
    docs = []
    for d in range(60):
        w = say(r.randrange(0, 200))
        if d % 2:
            x = list(r.choice(items)[1])
            for _ in range(r.choice([0, 0, 1, 2, 6])):
                if x:
                    x[r.randrange(len(x))] = "changed"
            at = r.randrange(len(w) + 1)
            w = w[:at] + x + w[at:]
        docs.append((d, r.choice([" ", ", ", "\n"]).join(w).upper() if d % 3 else " ".join(w) + "."))
    return docs + [(900, None), (901, ""), (902, "one two")], [(i, " ".join(x)) for i, x in items] + [(60, None)]


def test_matches_brute_force(spark):
    docs, items = planted(4)
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in docs], "doc_id long, text string, m int, sh string").repartition(3)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, h int")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.contaminated(df, bench).collect()}
    want = brute(docs, items)
    assert want and len(want) > 10
    # windows begin or end at a shared shingle, so a better alignment in between may score a little more
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 0.2 for k in want)


def test_repeats_and_empty(spark):
    text = "a b c d e f g h i j"
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "q")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, text), (1, text), (2, text)], "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id, r.start, r.n_words) for r in decontam.contaminated(df, bench).collect())
    assert got == [("1", 1, 0, 10), ("1", 2, 0, 10), ("None", 1, 0, 10), ("None", 2, 0, 10)]
    assert decontam.contaminated(df.limit(0), bench).count() == 0
    assert decontam.contaminated(df, bench.limit(0)).count() == 0
    kept = decontam.keep_clean(df, bench)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [2]


def test_blocks_cover_the_radius(spark):
    """Two fingerprints within the radius always share a block."""
    r = random.Random(1)
    rows = []
    for k in range(300):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), decontam.RADIUS):
            b ^= 1 << bit
        rows.append((k, a - (1 << 63), b - (1 << 63)))
    df = spark.createDataFrame(rows, "k long, a long, b long")
    x, y = df.select("k", decontam.F.inline(decontam.hamming_blocks("a"))), df.select("k", decontam.F.inline(decontam.hamming_blocks("b")))
    assert x.join(y, ["k", "block", "value"]).select("k").distinct().count() == 300


def test_items_cut_at_an_edge_or_edited(spark):
    """Quotations without their first or last tenth, or with one word changed, just above the bound."""
    r = random.Random(7)
    vocabulary = [f"word{k}" for k in range(4000)]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(k, say(r.choice([24, 32, 50, 60]))) for k in range(40)]
    docs, want = [], {}
    for i, x in items:
        first = len(docs)
        most = (len(x) - 4) // 9
        changed = list(x)
        changed[len(x) // 2] = "changed"
        for part in (x[most:], x[:len(x) - most], x[most // 2:len(x) - (most - most // 2)], changed):
            docs.append((len(docs), " ".join(say(80) + part + say(80))))
        docs.append((len(docs), " ".join(say(30) + x[:len(x) - (len(x) - 4) // 5])))
        want |= brute(docs[first:], [(i, " ".join(x))])
    bench = [(i, " ".join(x)) for i, x in items]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.similarity for r in got.collect()}
    assert len(want) >= 4 * len(items)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_clean_rows_of_a_contaminated_id_stay(spark):
    df = spark.createDataFrame([(None, "a b c d e f g h i j"), (None, "quite another text"), (1, "q")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    assert sorted(r.text for r in decontam.keep_clean(df, bench).collect()) == ["q", "quite another text"]
