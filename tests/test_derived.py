"""Caches, speckles, repeats, targets, key bins and point maps on literal tables."""

import pytest
from pyspark.sql import functions as F

from chromaloom.functions import affine
from chromaloom.operators import frames, readout, repeats, status
from chromaloom.operators import quality_gate as QG
from chromaloom.sources import cache

SRC = "modality string, hybe string, channel int"


def test_cache_is_used_only_for_the_same_cells_and_files(spark, tmp_path):
    rows = spark.createDataFrame([(f, c, "DNA", "H1", 488, 5) for f, cells in ((1, (1, 2)), (2, (1,)), (3, (1, 2, 3)), (4, (1,))) for c in cells], f"fov int, cell long, {SRC}, n int")
    stamps = spark.createDataFrame([(f, "DNA", "H1", 488, 10 + (f == 4), 7) for f in (1, 2, 3, 4)], f"fov int, {SRC}, mtime long, size long")
    cells = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2), (4, 1), (5, 1)], "fov int, cell long")
    now = spark.createDataFrame([(f, "DNA", "H1", 488, 10, 7) for f in (1, 2, 3, 4, 5, 6)], f"fov int, {SRC}, mtime long, size long")
    cache.write_expression(rows, stamps, str(tmp_path / "c"))
    got_rows, got_stamps = cache.read_expression(spark, str(tmp_path / "c"))
    got = {r.fov: (r.covered, r.same_inputs, r.usable) for r in cache.usable_sources(got_rows, got_stamps, cells, now).collect()}
    # same; a cell more; a cell fewer; other files; never cached; a field without cells, never cached
    assert got == {1: (True, True, True), 2: (False, True, False), 3: (False, True, False), 4: (True, False, False), 5: (False, False, False), 6: (True, False, False)}
    assert {r.fov for r in cache.read_expression(spark, str(tmp_path / "c"), [2])[0].collect()} == {2}
    cache.write_expression(rows.where("fov = 2").limit(0).unionByName(rows.where("fov = 1").withColumn("fov", F.lit(9))), stamps.where("fov = 1").withColumn("fov", F.lit(9)), str(tmp_path / "c"))
    assert {r.fov for r in cache.read_expression(spark, str(tmp_path / "c"))[0].collect()} == {1, 2, 3, 4, 9}


def test_speckles_without_images_do_not_read_them(spark, tmp_path):
    df = spark.createDataFrame([(1, c, float(c), b"x" * 10) for c in range(5)] + [(2, 1, 9.0, b"y")], "fov int, cell long, y double, lab binary")
    cache.write_speckles(df, str(tmp_path / "s"))
    some = cache.read_speckles(spark, str(tmp_path / "s"), 1, [1, 3, 8], images=False)
    assert sorted(r.cell for r in some.collect()) == [1, 3] and "lab" not in some.columns
    assert "lab" not in some._jdf.queryExecution().executedPlan().toString()
    assert cache.read_speckles(spark, str(tmp_path / "s"), 2).first().lab == b"y"


def test_repeats_pair_by_readout(spark):
    poly = spark.createDataFrame([(1, 1, 1, s, 0.0, float(x), 0.0) for s, x in ((0, 0), (1, 5), (2, 9), (7, 5.5), (8, 50))], "fov int, cell long, allele_id long, slot int, y_um double, x_um double, z_um double")
    slots = spark.createDataFrame([(0, 11, "H"), (1, 12, "H"), (2, 13, "H"), (7, 12, "R"), (8, 99, "R")], "slot int, readout_id int, datatype string")
    d = sorted((r.readout_id, r.same, r.d) for r in repeats.repeat_distances(poly, slots).collect())
    assert d == [(12, False, 4.0), (12, False, 5.0), (12, True, 0.5)]
    one = repeats.repeat_report(repeats.repeat_distances(poly, slots)).first()
    assert (one.readout_id, one.n, one.median_um, one.n_null, one.null_median_um, one.beats_null) == (12, 1, 0.5, 2, 4.5, True)
    assert repeats.repeat_report(repeats.repeat_distances(poly.limit(0), slots)).count() == 0


def test_expected_targets(spark):
    rounds = spark.createDataFrame([("RNA", "Hyb_1", "GeneA_mRNA", [488, 555, 635], 488), ("RNA", "Rep_1", "Rep_GeneA_mRNA", [635], 488), ("DNA", "Hyb_2", None, [555, 635], 555)],
                                   "modality string, hybe string, readout_name string, channels array<int>, fiducial_channel int")
    got = {tuple(r) for r in status.expected_targets(rounds, ("DNA", "Hyb_2", 635), [("DNA", "Toe_9")], [635, 747], [("RNA", "Hyb_1", 635), ("none", "x", 1)]).collect()}
    assert got == {("RNA", "Hyb_1", 635), ("DNA", "Hyb_2", 635), ("DNA", "Toe_9", 635), ("DNA", "Toe_9", 747)}
    assert status.expected_targets(rounds, channels=[747]).count() == 0
    assert [r.hybe for r in status.expected_targets(rounds, ("DNA", "Hyb_2", 635), chosen=[("DNA", "Hyb_2")]).collect()] == ["Hyb_2"]
    assert status.expected_targets(rounds, ("DNA", "Hyb_2", 635), chosen=[("DNA", "none")]).count() == 0


def test_keys_of_all_parts_get_their_bin(spark):
    parts = [spark.createDataFrame(rows, "fov int, allele_id long, hybe string, channel int") for rows in
             ([(1, 1, "A", 488), (1, 1, "B", None)], [(1, 1, "A", 488), (1, 1, "C", None)], [(1, 1, "Z", None)])]
    slots = spark.createDataFrame([("A", 488, 1, "H", 0), ("B", 635, 2, "H", 1), ("C", 488, 3, "H", 2), ("C", 635, 4, "H", 3)], "hybe string, channel int, rindex int, dtype string, pindex int")
    got = {(r.hybe, r.channel): (r.rindex, r.pindex) for r in readout.bins_of_keys(parts, slots).collect()}
    assert got == {("A", 488): (1, 0), ("B", None): (2, 1)}


def test_points_go_there_and_back(spark):
    m = spark.range(1).select(F.lit(1).alias("fov"), F.lit("DNA").alias("modality"), F.lit("H1").alias("hybe"),
                              affine.make(yy=F.lit(0.9), yx=F.lit(-0.2), yt=F.lit(5.0), xy=F.lit(0.2), xx=F.lit(0.95), xt=F.lit(-3.0)).alias("h_within"))
    p = spark.createDataFrame([(1, "DNA", "H1", 2.0, 7.0)], "fov int, modality string, hybe string, y double, x double")
    there = frames.map_points(p, m).first()
    assert (there.ref_y, there.ref_x) == pytest.approx((0.9 * 2 - 0.2 * 7 + 5, 0.2 * 2 + 0.95 * 7 - 3))
    back = frames.map_points(p.withColumns({"y": F.lit(there.ref_y), "x": F.lit(there.ref_x)}), m, inverse=True).first()
    assert (back.raw_y, back.raw_x) == pytest.approx((2.0, 7.0))
    other = p.withColumn("hybe", F.lit("H9"))
    assert frames.map_points(other, m, strict=False).first().ref_y is None
    with pytest.raises(Exception, match="no alignment matrix"):
        frames.map_points(other, m).collect()


def test_one_quantity_per_set(spark):
    nan = float("nan")
    df = spark.createDataFrame([(None, 0.2), (nan, 0.9), (0.4, nan)], "p_exist double, p double")
    assert QG.gate_quantity(df) == "p_exist" and QG.gate_quantity(df.limit(2)) == "p" and QG.gate_quantity(df.where("false")) is None
    assert QG.gate_quantity(df.select("p")) == "p" and QG.gate_quantity(spark.range(2)) is None
    one = QG.gate_report(df, 0.5).first()
    assert (one.quantity, one.calibrated, one.n_total, one.n_scored, one.n_denied, one.n_kept, one.degenerate) == ("p_exist", True, 3, 1, 1, 0, True)
    bare = QG.gate_report(spark.range(2), 0.5).first()
    assert (bare.quantity, bare.n_scored, bare.n_denied, bare.degenerate) == (None, 0, 0, False)
    assert [r[0] for r in df.select(QG.denied("p", 0.5)).collect()] == [True, False, False]
