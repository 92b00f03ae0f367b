import math

import numpy as np
import pandas as pd
import pytest

from chromaloom.operators import chains, cycle_model, detection, multiplicity


def test_quality_model_recovers_its_spread(spark):
    rng = np.random.default_rng(0)
    u, b = rng.normal(size=4000), rng.normal(0.5, 0.5, 10)
    x = rng.random((4000, 10)) < 1 / (1 + np.exp(-(b[None] + u[:, None])))
    pdf = pd.Series(["".join("1" if v else "0" for v in row) for row in x]).value_counts().rename_axis("pattern").reset_index(name="n")
    pat = spark.createDataFrame(pdf).repartition(4).cache()
    m = detection.fit_quality_model(pat, 10)
    assert m.tau == pytest.approx(1.0, abs=0.12) and np.abs(m.b - b).max() < 0.2
    obs = spark.createDataFrame([(i, j, int((x[:, i] & x[:, j]).sum())) for i in range(10) for j in range(i + 1, 10)], "bin_i int, bin_j int, observed long")
    z = detection.cooccurrence_z(obs, pat, m, 10).toPandas().z
    assert z.abs().max() < 4.5 and abs(z.mean()) < 1.0
    d = detection.count_dispersion(pat, m).first()
    assert d["ratio"] == pytest.approx(1.0, abs=0.15) and d["p"] > 0.001


def test_cycle_model_recovers_the_circle(spark):
    rng = np.random.default_rng(1)
    theta = rng.uniform(0, 2 * np.pi, 1500)
    peaks = np.linspace(0, 2 * np.pi, 8, endpoint=False)
    pi = np.exp(1.2 * np.cos(theta[:, None] - peaks[None]))
    pi /= pi.sum(1, keepdims=True)
    x = np.array([rng.multinomial(200, p) for p in pi])
    cells = spark.createDataFrame([(1, k, [float(v) for v in row]) for k, row in enumerate(x)], "fov int, cell long, x array<double>").repartition(4).cache()
    m = cycle_model.fit(cells, [f"g{k}" for k in range(8)], iters=8)
    got = cycle_model.place(cells, m).toPandas().sort_values("cell")
    th = np.radians(got.theta_deg.to_numpy())
    best = min(np.median(np.abs(np.angle(np.exp(1j * (d - np.angle(np.mean(np.exp(1j * d)))))))) for d in (th - theta, th + theta))
    assert best < np.radians(12) and got.R.median() > 0.8
    assert got.radius.median() == pytest.approx(1.0, abs=0.3) and got.ring_level.median() > 0
    share = cycle_model.fisher_share(m)
    assert sum(share.values()) == pytest.approx(1.0)
    assert cycle_model.fit_z(cycle_model.place(cells, m)).toPandas().fit_z.abs().median() < 1.5


def test_count_likelihood_matches_log_gamma():
    m = cycle_model.RingModel(["a", "b"], np.array([0.2, -0.2]), np.array([[0.5, 0.1], [-0.5, 0.0]]), alpha=7.0)
    x = np.array([[3.0, 0.0], [1.0, 5.0]])
    pi = np.exp(m.log_pi())
    want = [[sum(math.lgamma(x[i, g] + 7 * pi[t, g]) - math.lgamma(7 * pi[t, g]) for g in range(2)) for t in range(72)] for i in range(2)]
    assert np.allclose(m.loglik(x), want)
    s = x.sum(1)
    const = [math.lgamma(s[i] + 1) - sum(math.lgamma(v + 1) for v in x[i]) + math.lgamma(7) - math.lgamma(s[i] + 7) for i in range(2)]
    assert np.allclose(m.evidence_const(x), const)


def test_cycle_time_runs_from_birth():
    w = np.ones(72)
    w[:36] = 3
    t = cycle_model.cycle_time(w, birth_deg=90.0)
    assert t[17] == pytest.approx(1.0) and t[18] == pytest.approx(3 / 144) and cycle_model.cycle_time(w, 90.0, "exponential")[40] < t[40]


POINTS = "fov int, cell long, point long, slot int, y_um double, x_um double, z_um double"


def test_planted_chain_is_found_among_clutter(spark):
    rng = np.random.default_rng(2)
    rows, at = [], np.zeros(3)
    for s in range(8):
        at = at + rng.normal(0, 0.08, 3)
        rows.append((1, 1, s, s, *map(float, at)))
    rows += [(1, 1, 100 + k, int(rng.integers(0, 8)), *map(float, rng.uniform(2, 7, 3))) for k in range(6)]
    pts = spark.createDataFrame(rows, POINTS)
    got = chains.best_chains(pts, 8, 50.0).first()
    assert got["chain"] == list(range(8)) and got["weight"] < 0
    two = chains.disjoint_chains(pts, 8, 50.0).orderBy("rank").collect()
    assert two[0]["chain"] == list(range(8)) and not (set(two[1]["chain"]) & set(range(8)) if len(two) > 1 else False)


def test_best_chain_equals_exhaustive_search(spark):
    rng = np.random.default_rng(3)
    rows = [(1, 1, k, int(rng.integers(0, 4)), *map(float, rng.normal(0, 0.3, 3))) for k in range(9)]
    got = chains.best_chains(spark.createDataFrame(rows, POINTS), 4, 50.0).first()
    price = math.log(500.0 / 9)

    def step(a, b):
        sp = (0.0572 * ((b[3] - a[3]) * 50.0) ** 0.267) ** 2
        vxy, vz = sp + 2 * 0.031**2, sp + 2 * 0.076**2
        dy, dx, dz = (b[4 + i] - a[4 + i] for i in range(3))
        return 0.5 * ((dy * dy + dx * dx) / vxy + dz * dz / vz) + math.log(vxy) + 0.5 * math.log(vz) + 1.5 * math.log(2 * math.pi) - price

    def walk(chain, w):
        yield w, chain
        for r in rows:
            if r[3] > chain[-1][3]:
                yield from walk(chain + [r], w + step(chain[-1], r))
    best = min((x for r in rows for x in walk([r], 0.0)), key=lambda t: t[0])
    assert got["weight"] == pytest.approx(best[0]) and got["chain"] == [r[2] for r in best[1]]


def test_binomial_multiplicity_of_a_clean_cell(spark):
    rows = [(1, 1, s * 10 + k, s, 0.0, 0.0, 0.0) for s in range(12) for k in range(2 if s % 3 else 1)]
    rows += [(1, 2, s, s, 0.0, 0.0, 0.0) for s in range(12)] + [(1, 2, 90 + k, 5, 0.0, 0.0, 0.0) for k in range(3)]
    got = {r["cell"]: r["k"] for r in multiplicity.binomial_multiplicity(multiplicity.bin_counts(spark.createDataFrame(rows, POINTS), 12)).collect()}
    assert got == {1: 2, 2: 1}


def test_repeat_calibration_ignores_wrong_matches(spark):
    rng = np.random.default_rng(4)
    clean = rng.normal(0, [0.03 * 2**0.5, 0.03 * 2**0.5, 0.08 * 2**0.5], (4000, 3))
    wrong = rng.normal(0, 1.5, (800, 3))
    v = spark.createDataFrame(pd.DataFrame(np.vstack([clean, wrong]), columns=["dy", "dx", "dz"])).cache()
    cal = multiplicity.repeat_calibration(v)
    assert cal["sigma_xy"] == pytest.approx(0.03, rel=0.06) and cal["sigma_z"] == pytest.approx(0.08, rel=0.06) and cal["mix"] == pytest.approx(1 / 6, abs=0.02)
    with pytest.raises(ValueError, match="at least 30"):
        multiplicity.repeat_calibration(v.limit(5))


def test_trades_keep_margins_and_find_linked_bins(spark):
    rng = np.random.default_rng(6)
    x = rng.random((3000, 5)) < [0.5, 0.5, 0.3, 0.6, 0.4]
    x[:, 1] = np.where(rng.random(3000) < 0.5, x[:, 0], x[:, 1])
    alleles = spark.createDataFrame([(k,) for k in range(3000)], "allele_id long")
    polymer = spark.createDataFrame([(int(a), int(s)) for a, s in np.argwhere(x)], "allele_id long, slot int")
    got = detection.count_null(alleles, polymer, 5, 60).toPandas().set_index(["bin_i", "bin_j"])
    # rows keep their counts, so the excess of one pair is a deficit spread over the nine others
    others = got.drop((0, 1))
    assert got.loc[(0, 1), "z"] > 20 and others.z.max() < 3 and others.z.min() > -8
    assert (others.observed - others.expected).sum() == pytest.approx(got.loc[(0, 1), "expected"] - got.loc[(0, 1), "observed"])
    assert got.loc[(0, 2), "observed"] == (x[:, 0] & x[:, 2]).sum()


def test_trades_do_not_depend_on_the_number_of_blocks(spark):
    rng = np.random.default_rng(7)
    # two halves of the table differ in efficacy: blocks that kept their own margins would hide it
    x = rng.random((600, 4)) < np.where(np.arange(600)[:, None] < 300, 0.8, 0.2)
    alleles = spark.createDataFrame([(k,) for k in range(600)], "allele_id long")
    polymer = spark.createDataFrame([(int(a), int(s)) for a, s in np.argwhere(x)], "allele_id long, slot int")
    one = detection.count_null(alleles, polymer, 4, 60).toPandas().sort_values(["bin_i", "bin_j"])
    many = detection.count_null(alleles, polymer, 4, 60, block=60).toPandas().sort_values(["bin_i", "bin_j"])
    assert np.allclose(one.expected, many.expected, rtol=0.03) and np.allclose(one.observed, many.observed)
    # a row keeps its count, so the expected pairs over all bins add up to those of the rows
    k = x.sum(1)
    assert one.expected.sum() == pytest.approx((k * (k - 1) / 2).sum()) == many.expected.sum()
    assert ((one.p >= 0) & (one.p <= 1)).all()


def test_a_wide_axis_has_a_count_null(spark):
    rng = np.random.default_rng(8)
    x = rng.random((120, 90)) < 0.3
    alleles = spark.createDataFrame([(k,) for k in range(130)], "allele_id long")       # ten were never traced
    polymer = spark.createDataFrame([(int(a), int(s)) for a, s in np.argwhere(x)], "allele_id long, slot int")
    got = detection.count_null(alleles, polymer, 90, 10, block=50)
    assert got.count() == 90 * 89 // 2 and got.where("expected < 0").count() == 0


def test_count_dispersion_tail(spark):
    rng = np.random.default_rng(9)

    def table(u):
        x = rng.random((4000, 6)) < 1 / (1 + np.exp(-u[:, None]))
        return spark.createDataFrame(pd.Series(["".join("01"[v] for v in row) for row in x.astype(int)]).value_counts().rename_axis("pattern").reset_index(name="n"))

    def p_of(u, tau):
        t = table(u)
        return detection.count_dispersion(t, detection.margin_model(t, 6, tau)).first()
    same, wide = p_of(np.zeros(4000), 1e-4), p_of(rng.normal(0, 1.0, 4000), 1e-4)
    assert 0.001 < same["p"] < 0.999 and same["ratio"] == pytest.approx(1.0, abs=0.1)
    assert wide["p"] < 1e-6 and wide["ratio"] > 1.5
    with pytest.raises(ValueError):
        detection.margin_model(table(np.zeros(4000)).limit(0), 6, 1.0)


def test_fit_gate_names_the_first_reason(spark):
    from pyspark.sql import functions as F

    from chromaloom.operators import polymer

    rows = [(False, 5.0, [], 1.0, 0.01, 0.01, 0.01), (True, 0.5, [], 1.0, 0.01, 0.01, 0.01), (True, 5.0, ["sx"], 1.0, 0.01, 0.01, 0.01),
            (True, 5.0, [], float("nan"), 0.01, 0.01, 0.01), (True, 5.0, [], 0.2, 0.01, 0.01, 0.01), (True, 5.0, [], 0.9, 0.06, 0.01, 0.01), (True, 5.0, [], 0.9, 0.01, 0.01, 0.01)]
    df = spark.createDataFrame(rows, "found boolean, z double, at_bound array<string>, occupancy double, ci_y_um double, ci_x_um double, ci_z_um double")
    reason = polymer.fit_rejection(F.lit(20), z_trim=2, min_occupancy=0.4, max_uncert_xy_nm=100, max_uncert_z_nm=100)
    assert [r[0] for r in df.select(reason).collect()] == [
        "fit failed", "stack end", "at bound (sx)", "occupancy undefined", "occupancy", "lateral uncertainty", None]


def test_arcs_from_time():
    from chromaloom.operators.cellcycle import arcs_from_time

    t = cycle_model.cycle_time(np.ones(72), 30.0)
    arcs = arcs_from_time(t, [("G1", 50), ("S", 25), ("G2/M", 25)], 30.0)
    assert [a["name"] for a in arcs] == ["G1", "S", "G2/M"]
    assert arcs[0]["start_deg"] == 30.0 and arcs[0]["end_deg"] == pytest.approx(210.0) and arcs[1]["end_deg"] == pytest.approx(300.0) and arcs[2]["end_deg"] == 30.0


def test_multiplicity_without_a_fit(spark):
    pts = spark.createDataFrame([(1, 1, s, s, 0.0, 0.0, 0.0) for s in range(9)], POINTS)
    cells = spark.createDataFrame([(1, 1), (1, 2)], "fov int, cell long")
    got = {r["cell"]: (r["k"], r["reason"]) for r in multiplicity.binomial_multiplicity(multiplicity.bin_counts(pts, 9, cells)).collect()}
    assert got == {1: (1, "fitted"), 2: (0, "no spots")}
    few = multiplicity.binomial_multiplicity(multiplicity.bin_counts(pts, 5, cells)).collect()
    assert {(r["k"], r["efficiency"], r["reason"]) for r in few} == {(None, None, "few bins")}


def test_trades_keep_every_margin(spark):
    """Each sample keeps the co-detections an allele can have, whatever the trades moved."""
    rng = np.random.default_rng(12)
    hit = rng.random((300, 6)) < np.linspace(0.1, 0.9, 6)
    alleles = spark.createDataFrame([(a,) for a in range(300)], "allele_id long")
    polymer = spark.createDataFrame([(int(a), int(s)) for a, s in zip(*np.nonzero(hit), strict=True)], "allele_id long, slot int")
    got = detection.count_null(alleles, polymer, 6, 40, block=70).toPandas()
    n = hit.sum(1)
    assert got.expected.sum() == pytest.approx((n * (n - 1) // 2).sum(), abs=1e-6) == pytest.approx(got.observed.sum(), abs=1e-6)
    assert (got.variance > 0).all() and len(got) == 15


def test_masks_and_image_meet_once(spark, monkeypatch):
    """Small masks take one join for median and sums; a large one takes the counted path with the same rows."""
    from chromaloom.operators import celltype, stats

    pixels = spark.createDataFrame([(0, c, y, x) for c in (1, 2) for y in range(3) for x in range(2 * c)], "fov int, cell long, y int, x int")
    image = spark.createDataFrame([(0, ch, y, x, float((y * 7 + x * 5 + ch) % 11 - 2)) for ch in (488, 555) for y in range(4) for x in range(6)], "fov int, channel int, y int, x int, value double")
    one = image.where("channel = 488").drop("channel")
    types = {488: "WT", 555: "KI"}
    small = celltype.mask_sums(pixels, one)
    plan = small._jdf.queryExecution().optimizedPlan().toString()
    rows, typed = small.collect(), celltype.barcode_median(pixels, image, types).collect()
    monkeypatch.setattr(stats, "HOT_GROUP", 3)
    monkeypatch.setattr(stats.has_hot_group, "__defaults__", ("n", 3))
    large = celltype.mask_sums(pixels, one).select(*small.columns).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, large)) and {r.area for r in rows} == {6, 12}
    assert sorted(map(tuple, typed)) == sorted(map(tuple, celltype.barcode_median(pixels, image, types).collect()))
    assert plan.count("Join") == 2                                          # image and background, nothing joined to itself
