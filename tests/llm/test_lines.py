"""Line dedup against brute force."""

import random

from chromaloom.llm import lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def edited(r, line, times):
    c = list(line)
    for _ in range(times):
        p = r.randrange(len(c) + 1)
        kind = r.randrange(3)
        if kind == 0:
            c.insert(p, r.choice("abé漢"))
        elif c and kind == 1:
            del c[p % len(c)]
        elif c:
            c[p % len(c)] = r.choice("xyü")
    return "".join(c)


def test_band_matches_plain_distance():
    r = random.Random(5)
    for _ in range(6000):
        a = "".join(r.choice("abc") for _ in range(r.randrange(0, 90)))
        b = edited(r, a, r.randrange(0, 7)) if r.random() < .9 else "".join(r.choice("abc") for _ in range(r.randrange(0, 90)))
        for k in (1, 2, 3):
            assert lines.edit_within(a, b, k) == (distance(a, b) <= k), (a, b, k)


def test_report_matches_brute_force(spark):
    r = random.Random(9)
    base = ["".join(r.choice("abcdefg é") for _ in range(r.choice([5, 15, 16, 17, 18, 40, 200]))) for _ in range(25)]
    docs = [(None, "short\nline of twenty chars"), (1, None), (2, ""), (3, " \n\t\n"), (4, "line  of twenty chars\nline of twenty charz")]
    for i in range(10, 70):
        docs.append((i, "\n".join(edited(r, r.choice(base), r.choice([0, 0, 1, 1, 2, 2, 3, 4])) for _ in range(r.randrange(0, 6)))))
    own = [(d, k, x) for d, t in docs for k, x in enumerate(lines.text_lines(t))]
    texts = sorted({x for _, _, x in own})
    root, links = {x: x for x in texts}, {x: 0 for x in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(texts):
        for b in texts[i + 1:]:
            if min(len(a), len(b)) >= lines.MIN_NEAR and abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2:
                links[a] += 1
                links[b] += 1
                root[find(b)] = find(a)
    first = {}
    for d, k, x in own:
        at = ((d is not None, d or 0), k)
        first[find(x)] = min(first.get(find(x), at), at)
    want = {d: [0, 0, 0, 0] for d, _ in docs}
    for d, k, x in own:
        w = want[d]
        w[0] += 1
        w[1] += first[find(x)] == ((d is not None, d or 0), k)
        w[2] += links[x] > 0
        w[3] += links[x]
    df = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, key string").repartition(4)
    got = {x.doc_id: [x.n_lines, x.n_kept, x.n_near, x.n_links] for x in lines.line_report(df).collect()}
    assert got == want
    assert sum(w[3] for w in want.values()) > 20


def test_no_rows(spark):
    assert lines.line_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_substrings_hash_alike_wherever_they_stand():
    import numpy as np

    text = ["abc漢字 the quick brown fox", "xx abc漢字 the quick brown", "ab"]
    h = lines.Hashes()
    h.read(text)
    assert list(h.starts) == [0, len(text[0]), len(text[0]) + len(text[1])]
    part = "abc漢字 the quick"
    low = np.array([text[k].index(part) for k in (0, 1)]) + h.starts[:2]
    one, two = h.of(low, low + len(part))
    other, = h.of(low[:1] + 1, low[:1] + 1 + len(part))
    assert one == two != other
    alone = lines.Hashes()
    for k, line in enumerate(text):
        alone.read([line])
        assert alone.signatures[0] == h.signatures[k]


def test_a_key_is_compared_whole_on_both_ways():
    import numpy as np
    import pyarrow as pa

    r = random.Random(3)
    rows = []
    for key in range(60):
        for k in range(r.choice([1, 2, 5, 63, 64, 65, 150])):
            rows.append((key, int(r.random() < .6), r.randrange(1, 40), r.getrandbits(64) & 0x0003000F0000000F))
    rows.sort()
    want = {(min(a, b), max(a, b)) for x in range(60) for i, (k, s, a, p) in enumerate(rows) if k == x and s == 0
            for _, _, b, q in [y for y in rows[i + 1:] if y[0] == x] if a != b
            and ((p ^ q) >> 32).bit_count() <= 4 and ((p ^ q) & 0xFFFFFFFF).bit_count() <= 8}
    for size in (7, 100, len(rows)):
        cut = [rows[i:i + size] for i in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array(np.array([y[j] for y in x], np.uint64).view(np.int64)) for j in (0, 1, 2, 3)], ["key", "role", "lid", "sig"]) for x in cut]
        got = {(a, b) for x in lines.candidates(2)(batches) for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist())}
        assert got == want


def test_hashing_of_many_lines_is_quick():
    import time

    import pyarrow as pa
    import xxhash

    r = random.Random(1)
    text = ["\n".join("".join(r.choices("abcdefghij ", k=r.randrange(40, 120))) for _ in range(20)) for _ in range(1000)]
    batch = [pa.RecordBatch.from_pydict({"text": text})]
    t = time.process_time()
    n = sum(b.num_rows for b in lines.emit(2)(batch))
    took, t = time.process_time() - t, time.process_time()
    each = [xxhash.xxh3_64_intdigest(x[lo:hi], seed) for y in text for x in y.split("\n") for seed, lo, hi, _ in lines.probes(len(x), 2)]
    assert n == len(each) and took < time.process_time() - t
