"""Added clicks against the sequential rule."""

import random

from chromaloom.operators import clicks as C

SCHEMA = "key string, reviewer string, y double, x double"


def plain(points, radius=4.0):
    out = []
    for y, x, who in sorted(points, key=lambda p: (p[0], p[1], p[2] or "")):
        for s in out:
            if (s[0] / s[2] - y) ** 2 + (s[1] / s[2] - x) ** 2 <= radius * radius:
                s[0], s[1], s[2] = s[0] + y, s[1] + x, s[2] + 1
                break
        else:
            s = [y, x, 1, set()]
            out.append(s)
        if who is not None:
            s[3].add(who)
    return [(round(s[0] / s[2], 9), round(s[1] / s[2], 9), s[2], sorted(s[3])) for s in out]


def test_random_clicks_equal_the_sequential_rule(spark):
    r = random.Random(4)
    rows = []
    for key, n, size in (("dense", 400, 60), ("sparse", 200, 900), ("line", 60, 0), ("one", 1, 5)):
        for k in range(n):
            y, x = (3.0 * k, 0.0) if key == "line" else (round(r.uniform(-size, size), 1), round(r.uniform(-size, size), 1))
            rows.append((key, r.choice(["a", "b", "c", None]), y, x))
    rows += [("dense", "a", 1.0, 1.0)] * 3
    df = spark.createDataFrame([*rows, (None, "a", 1.0, 1.0), ("dense", "a", None, 1.0)], SCHEMA).repartition(7)
    got = sorted((s.key, round(s.y, 9), round(s.x, 9), s.n_clicks, list(s.reviewers)) for s in C.added_spots(df).collect())
    want = sorted((key, *s) for key in ("dense", "sparse", "line", "one") for s in plain([(y, x, w) for k, w, y, x in rows if k == key]))
    assert got == want
    assert C.added_spots(df.limit(0)).count() == 0


def test_busy_page_is_split_into_groups(spark):
    cells = spark.createDataFrame([("k", y, x) for y, x in [(0, 0), (1, 1), (2, 2), (5, 5), (5, 6), (9, 0)] + [(20, i) for i in range(40)]], "key string, gy long, gx long")
    got = {(r.gy, r.gx): (r.group.gy, r.group.gx) for r in C.cell_groups(cells, ["key"]).collect()}
    assert len(set(got.values())) == 4 and got[2, 2] == (0, 0) and got[5, 6] == (5, 5) and got[20, 39] == (20, 0)
