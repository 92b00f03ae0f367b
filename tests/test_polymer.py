import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromaloom.operators import anisotropy, ensemble, polymer, readout

CAND = "fov int, cell long, allele_id long, slot int, cand long, y double, x double, z double, amplitude double, quality double"


def test_brightest_candidate_and_missing_slots(spark):
    c = spark.createDataFrame([(1, 1, 5, 0, 1, 0.0, 0.0, 0.0, 100.0, 1.0), (1, 1, 5, 0, 2, 0.0, 9.0, 0.0, 500.0, 1.0), (1, 1, 5, 0, 3, 0.0, 8.0, 0.0, 500.0, 1.0),
                               (1, 1, 5, 2, 1, 0.0, 1.0, 0.0, 50.0, 1.0)], CAND)
    got = {r["slot"]: r for r in polymer.collapse(c).collect()}
    assert set(got) == {0, 2} and got[0]["n_cand"] == 3 and got[0]["cand"] == 2
    assert got[0]["x_um"] == pytest.approx(9 * 0.208)
    dim = polymer.collapse(c, F.struct(-F.col("amplitude"), -F.col("cand"))).where("slot = 0").first()
    assert dim["amp"] == 100.0
    al = spark.createDataFrame([(1, 1, 5), (1, 1, 6)], "fov int, cell long, allele_id long")
    assert {r["allele_id"]: r["n_traced"] for r in polymer.completeness(al, polymer.collapse(c)).collect()} == {5: 2, 6: 0}


def test_distance_between_slots(spark):
    p = spark.createDataFrame([(1, 1, 1, 0, 0.0, 0.0, 0.0), (1, 1, 1, 1, 0.0, 0.208, 0.0)],
                              "fov int, cell long, allele_id long, slot int, y_um double, x_um double, z_um double")
    rows = polymer.distance_maps(p).collect()
    assert len(rows) == 1 and rows[0]["d"] == pytest.approx(0.208)


@pytest.fixture
def constant_maps(spark):
    rows = [(1, 1, a, i, j, v) for a, v in enumerate((1.0, 2.0, 3.0, 100.0)) for i in range(3) for j in range(i + 1, 3)]
    return spark.createDataFrame(rows, "fov int, cell long, allele_id long, bin_i int, bin_j int, d double")


def test_ensemble_rules(constant_maps):
    assert {r["value"] for r in ensemble.ensemble_map(constant_maps, min_n=1).collect()} == {2.5}
    assert {r["value"] for r in ensemble.ensemble_map(constant_maps.where("allele_id < 3"), min_n=1).collect()} == {2.0}
    few = ensemble.ensemble_map(constant_maps.where("allele_id < 2"), min_n=3).collect()
    assert {(r["n"], r["value"]) for r in few} == {(2, None)}
    sub = ensemble.subtraction_map(constant_maps, F.col("allele_id") < 2, F.lit(False), min_n=1).collect()
    assert {r["value"] for r in sub} == {None}


def test_scc_of_a_map_with_itself(spark):
    rng = np.random.default_rng(0)
    m = spark.createDataFrame([(i, j, float(rng.random())) for i in range(9) for j in range(i + 1, 9)], "bin_i int, bin_j int, value double")
    assert ensemble.scc(m, m).first()["scc"] == pytest.approx(1.0)
    assert ensemble.scc(m, m, h=1, n_slots=9).first()["scc"] == pytest.approx(1.0)


def test_box_mean_matches_numpy(spark):
    rng = np.random.default_rng(1)
    full = np.full((6, 6), np.nan)
    rows = []
    for i in range(6):
        for j in range(i + 1, 6):
            if (i, j) != (1, 3):
                full[i, j] = full[j, i] = rng.random()
                rows.append((i, j, float(full[i, j])))
    np.fill_diagonal(full, 0.0)
    up = spark.createDataFrame(rows, "bin_i int, bin_j int, value double")
    got = {(r["i"], r["j"]): r["v"] for r in ensemble.box_mean(ensemble.full_square(up, 6), 1).collect()}
    a = np.array([np.nanmean(full[max(0, i - 1):i + 2], 0) for i in range(6)])
    b = np.array([np.nanmean(a[:, max(0, j - 1):j + 2], 1) for j in range(6)]).T
    assert all(got[i, j] == pytest.approx(b[i, j]) for i in range(6) for j in range(6))


def test_quality_control_keeps_bins_beside_a_hole(spark):
    pts = {0: 0.0, 1: 5.0, 2: 0.1, 4: 9.0}
    p = spark.createDataFrame([(1, 1, 1, s, 0.0, x, 0.0, 10.0) for s, x in pts.items()],
                              "fov int, cell long, allele_id long, slot int, y_um double, x_um double, z_um double, amp double")
    flagged = polymer.bad_bins(p, polymer.distance_maps(p), {"max_jump_um": 1.0}, 6)
    assert {r["slot"] for r in flagged.where("bad").collect()} == {1}
    assert polymer.apply_qc(flagged, 3).count() == 3 and polymer.apply_qc(flagged, 4).count() == 0


def test_isotropic_cloud_has_factor_one(spark):
    rng = np.random.default_rng(2)
    rows = [(1, 1, a, s, *map(float, rng.normal(size=3))) for a in range(400) for s in range(6)]
    p = spark.createDataFrame(rows, "fov int, cell long, allele_id long, slot int, y_um double, x_um double, z_um double")
    s = anisotropy.summary(polymer.xy_and_xyz(p)).first()
    assert s["factor"] == pytest.approx(1.0, abs=0.05) and s["rms_slope"] == pytest.approx(math.sqrt(1.5), abs=0.03)
    swapped = anisotropy.isotropic_surrogate(p, 3).select("allele_id", "slot", "z_um").toPandas()
    assert len(swapped) == 2400 and swapped.z_um.notna().all()
    assert sorted(swapped.z_um.round(9)) == sorted(p.toPandas().x_um.round(9))


def test_deviant_fov_stands_out(spark):
    rng = np.random.default_rng(3)
    rows, al = [], []
    for f in range(3):
        for k in range(40):
            a = f * 100 + k
            al.append((f, 1, a))
            rows += [(f, 1, a, i, j, float(j - i + 1.5 * (f == 2) + rng.normal(0, 0.15))) for i in range(10) for j in range(i + 1, 10)]
    d = spark.createDataFrame(rows, "fov int, cell long, allele_id long, bin_i int, bin_j int, d double")
    alleles = spark.createDataFrame(al, "fov int, cell long, allele_id long")
    inside = ensemble.ring_pairs(alleles, 1, 3, ["fov"]).withColumn("same", F.lit(True))
    cross = ensemble.ring_pairs(alleles, 2, 5).where("fov_a <> fov_b").withColumn("same", F.lit(False))
    pairs = inside.unionByName(cross).select("allele_a", "allele_b", "fov_a", "fov_b", "same")
    msd = ensemble.allele_pair_difference(d, pairs).where("n_shared >= 10").withColumn("msd", F.col("sum_sq") / F.col("n_shared"))
    w = ensemble.welch(msd, "same", "msd").first()
    assert w["t"] < 0 and ensemble.student_two_sided(w["t"], w["df"]) < 1e-6
    assert ensemble.welch(msd.limit(1), "same", "msd").first()["t"] is None


@pytest.mark.parametrize("t, df, p", [(2.0, 10.0, 0.07338803), (0.5, 3.0, 0.651442), (12.0, 40.0, 7.2e-15)])
def test_student_tail(t, df, p):
    assert ensemble.student_two_sided(t, df) == pytest.approx(p, rel=0.02)


def test_readout_axis(spark):
    rec = spark.createDataFrame([("p", "H3", 488, 3, "H"), ("p", "H1", 488, 1, "H"), ("p", "R1", 488, 1, "R"), ("p", "H2", 488, 2, "H"), ("p", "T50", 488, 50, "T")],
                                "panel string, hybe string, channel int, rindex int, dtype string")
    got = {r["hybe"]: r["pindex"] for r in readout.dense_index(rec).collect()}
    assert got == {"H1": 0, "H2": 1, "H3": 2, "R1": -1, "T50": -1}
    axis = readout.axis(readout.declared_index(rec, 1, 5), 5, ["panel"]).orderBy("pindex").collect()
    assert [r["hybe"] for r in axis] == ["H1", "H2", "H3", None, None]
    with pytest.raises(Exception, match="outside the declared range"):
        readout.declared_index(rec, 1, 2).collect()
    assert readout.check_unique(readout.declared_index(rec, 1, 5), ["panel"]).count() == 0
    assert "H1|488|1|H|0" in readout.map_text(readout.declared_index(rec, 1, 5), ["panel"]).first()["text"]
