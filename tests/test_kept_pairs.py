"""Distances that several passes read are measured once, and are those of the plain operators."""

import numpy as np
from pyspark.sql import functions as F

from chromaloom.operators import anisotropy, export, frames, polymer


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def positions(spark, holes=True):
    r = np.random.default_rng(4)
    rows = [(1, a % 5, 97 * a, s, *map(float, r.normal(size=3)), float(r.random())) for a in range(60) for s in range(5) if not holes or (a + s) % 4]
    return spark.createDataFrame(rows, "fov int, cell long, allele_id long, slot int, y_um double, x_um double, z_um double, amp double")


def digits(df, *cols):
    return sorted(tuple(None if v is None else round(v, 9) for v in x) for x in df.select(*cols).where(F.col(cols[-1]).isNotNull()).collect())


def test_surrogate_meets_with_the_pairs(spark):
    p = positions(spark)
    pairs, null = anisotropy.pairs_and_surrogate(p, 3)
    assert digits(pairs, "d_xy", "d_xyz") == digits(polymer.xy_and_xyz(p), "d_xy", "d_xyz")
    assert digits(null, "d_xy", "d_xyz") == digits(polymer.xy_and_xyz(anisotropy.isotropic_surrogate(p, 3)), "d_xy", "d_xyz")
    assert null.where("d_xyz is null").count() and pairs.count() == null.count()
    assert not any(x in plan(df) for df in (pairs, null) for x in ("Exchange", "Join"))


def test_thresholds_read_kept_distances(spark):
    p = positions(spark)
    assert "SQRT" not in plan(polymer.qc_thresholds(p, polymer.distance_maps(p)))


def test_pairs_keep_what_they_carry(spark):
    p = positions(spark).withColumn("celltype", F.concat(F.lit("t"), F.col("cell")))
    got = polymer.distance_maps(p, carry=["celltype"])
    assert got.columns == ["fov", "cell", "allele_id", "celltype", "bin_i", "bin_j", "d"]
    assert got.where("celltype <> concat('t', cell)").count() == 0 and got.count() == polymer.distance_maps(p).count()


def test_moves_are_measured_once(spark):
    rows = spark.createDataFrame([("a", 3.0 * k, 4.0 * k, 0.0, 0.0) for k in range(11)] + [("b", None, 1.0, 0.0, 0.0), ("b", 0.0, 2.0, 0.0, 0.0)], "m string, y double, x double, v double, u double")
    s = frames.shift_stats(rows, ("y", "x"), ("v", "u"), ["m"])
    assert sorted(tuple(x) for x in s.collect()) == [("a", 11, 25.0, 45.0, 50.0), ("b", 1, 2.0, 2.0, 2.0)]
    assert "HYPOT" not in plan(s).upper()


def test_cells_meet_their_spots_once(spark):
    spots = spark.createDataFrame([(1, 10, 5, "DNA"), (1, 11, -1, "DNA"), (2, 12, 9, "RNA"), (1, 13, 5, "RNA")], "fov int, uid long, cell long, modality string").selectExpr(
        "*", "'H' AS hybe", "488 AS channel", "1.0D AS raw_y", "2.0D AS raw_x", "3.0D AS raw_z", "4.0D AS brightness", "0.5D AS p_exist", "'accepted' AS z_status")
    layout = spark.createDataFrame([("DNA", "H", "g", "H", 7, 488)], "modality string, hybe string, readout_name string, datatype string, readout_id int, fiducial_channel int")
    cells = spark.createDataFrame([(1, 5, "WT", 3), (2, 5, "KI", 4)], "fov int, cell long, celltype string, area int")
    sheet = cells.select(export.cell_key().alias("cell_key"), "*")
    two = export.combined_rows(export.spot_rows(spots, cells, layout), sheet, [], [], compact=False)
    one = export.combined_sheet(spots, layout, sheet, ["cell_key", "celltype", "area"])
    assert one.columns == two.columns and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert plan(one).count("Join") < plan(two).count("Join")
