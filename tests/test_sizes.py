"""Results that must not depend on how many rows there are, and rows that must not vanish."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromaloom.operators import cellcycle, detection, ensemble, polymer, sites, stats


@pytest.mark.parametrize("n_fov", [25, 400, 4000])
def test_ring_pairs_inside_small_groups(spark, n_fov):
    n = 12_000
    alleles = spark.range(n).select((F.col("id") % n_fov).cast("int").alias("fov"), F.col("id").alias("cell"), F.col("id").alias("allele_id"))
    pairs = ensemble.ring_pairs(alleles, 1, group=["fov"])
    assert pairs.where("fov_a <> fov_b").count() == 0
    assert pairs.count() == n - n_fov      # all but the last allele of every FOV


def test_quantiles_skip_nan_on_both_paths(spark, monkeypatch):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, float("nan")), (2, None)], "g int, v double")
    plain = {r.g: (r.n, r.q) for r in stats.group_quantiles(df, ["g"], "v", {"q": 0.5}).collect()}
    monkeypatch.setattr(stats, "HOT_GROUP", 0)
    hot = {r.g: (r.n, r.q) for r in stats.group_quantiles(df, ["g"], "v", {"q": 0.5}).collect()}
    assert plain[1] == hot[1] == (2, 1.5)


def test_cells_without_a_site_have_zero(spark):
    pts = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 0.0, 0), (1, 2, 2, 0.0, 0.0, 0.0, 0), (1, 2, 3, 0.1, 0.0, 0.0, 1), (1, 2, 4, 0.0, 0.1, 0.0, 2)],
                                "fov int, cell long, point long, y_um double, x_um double, z_um double, bin int")
    got = {r.cell: r.k for r in sites.spatial_multiplicity(pts, 12).collect()}
    assert got == {1: 0, 2: 1}


def test_one_row_for_nothing(spark):
    schema = "fov int, cell long, theta_deg double"
    none = spark.createDataFrame([], schema)
    row = cellcycle.phase_agreement(none, none).collect()
    assert len(row) == 1 and row[0].n == 0 and row[0].median_abs_diff_deg is None
    poly = spark.createDataFrame([], "allele_id long, slot int, amp double")
    maps = spark.createDataFrame([], "allele_id long, bin_i int, bin_j int, d double")
    t = polymer.qc_thresholds(poly, maps).collect()
    assert len(t) == 1 and t[0].min_brightness == 0 and math.isinf(t[0].max_brightness) and math.isinf(t[0].max_jump_um)


def test_pairs_never_seen_together_have_a_row(spark):
    patterns = spark.createDataFrame([("110", 40), ("001", 40)], "pattern string, n long")
    observed = spark.createDataFrame([(0, 1, 40)], "bin_i int, bin_j int, observed long")


    model = detection.QualityModel(b=np.zeros(3), tau=0.5, loglik=0.0)
    got = {(r.bin_i, r.bin_j): r for r in detection.cooccurrence_z(observed, patterns, model, 3).collect()}
    assert set(got) == {(0, 1), (0, 2), (1, 2)} and got[0, 2].observed == 0 and got[0, 2].z < 0
