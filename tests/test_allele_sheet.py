"""The full allele sheet on literal alleles."""

import pytest

from chromaloom.operators import allele_sheet as S

ALLELES = ("fov int, cell long, allele_id long, modality string, final_polymer array<struct<y: double, x: double, z: double>>, anchor_uid long, "
           "anchor_adj_y double, anchor_adj_x double")
TRACES = "fov int, allele_id long, hybe string, channel int, side string, k int, y double, x double, z double, amplitude double, quality double"
FIDUCIALS = "fov int, allele_id long, hybe string, channel int, fiducial_adj_y double, fiducial_adj_amplitude double"
AXIS = [(0, 15, "Hyb_015", None), (1, 16, "Hyb_016", None), (2, 17, "Hyb_017", None)]
ADJ = [(3, 42, "Hyb_015", None, "adj", 0, 20.0, 900.0, 50.0, 10.0, 0.9), (3, 42, "Hyb_015", None, "adj", 1, 21.0, 901.0, 51.0, 99.0, 0.8)]
RAW = [(3, 42, "Hyb_015", None, "raw", 0, 22.0, 902.0, 52.0, 10.0, 0.9), (3, 42, "Hyb_015", None, "raw", 1, 23.0, 903.0, 53.0, 99.0, 0.8)]


@pytest.fixture(scope="module")
def sheet(spark):
    def make(traces=(*ADJ, *RAW), final=None, modality=None, axis=AXIS, fiducials=((3, 42, "Hyb_015", None, 1.0, 111.0), (3, 42, "Hyb_016", None, None, None)), cell=7):
        alleles = spark.createDataFrame([(3, cell, 42, modality, final, 5, 10.0, 800.0)], ALLELES)
        rows = S.allele_sheet(
            alleles, spark.createDataFrame(list(traces), TRACES), spark.createDataFrame(list(fiducials), FIDUCIALS),
            spark.createDataFrame([(3, 42, "Hyb_017", None, "no fiducial peak")], "fov int, allele_id long, hybe string, channel int, rejected_reason string"),
            spark.createDataFrame(axis, "bin_index int, readout_id int, hybe string, channel int"),
            spark.createDataFrame([("Rep_032", 32, "R", ""), ("Hyb_015", 15, "H", "Gorab")], "hybe string, readout_id int, datatype string, readout_name string"),
            spark.createDataFrame([(3, 7, "WT")], "fov int, cell long, celltype string"), "DNA")
        return sorted(rows.collect(), key=lambda r: (r.bin_index < 0, r.bin_index, r.hybe, r.readout_channel, r.candidate_index))
    return make


def test_long_format(sheet):
    rows = sheet()
    assert [(r.bin_index, r.candidate_index) for r in rows] == [(0, 0), (0, 1), (1, -1), (2, -1)]
    a, b, empty, rejected = rows
    assert (a.readout_adj_y, a.readout_adj_x, a.readout_adj_amplitude) == (20.0, 900.0, 10.0) and (a.readout_raw_y, b.readout_raw_y) == (22.0, 23.0)
    assert [r.is_selected for r in rows] == [False, True, False, False] and a.selection_rule == "computed"
    assert b.final_y == 21.0 and b.final_x_um == pytest.approx(901.0 * 0.208) and b.readout_adj_z_um == pytest.approx(51.0 * 0.2)
    assert rejected.rejected_reason == "no fiducial peak" and rejected.readout_adj_x is None and rejected.final_x is None
    assert a.fiducial_found and a.fiducial_adj_amplitude == 111.0 and not empty.fiducial_found and not rejected.fiducial_found
    assert all(r.anchor_adj_y == 10.0 and r.allele_key == "F003-A42" and r.cell_key == "F003-C7" and r.celltype == "WT" for r in rows)
    assert a.readout_name == "Gorab" and [r.readout_id for r in rows] == [15, 15, 16, 17]
    assert {(r.modality, r.modality_source) for r in rows} == {("DNA", "assumed")}
    assert {(r.modality, r.modality_source) for r in sheet(modality="RNA")} == {("RNA", "provenance")}


def test_stored_positions_win_if_they_cover_the_axis(sheet):
    rows = sheet(final=[(70.0, 700.0, 7.0), (0.0, 0.0, 0.0), None])
    assert rows[0].final_y == 70.0 and rows[0].selection_rule == "stored" and not any(r.is_selected for r in rows)
    short = sheet(final=[(70.0, 700.0, 7.0)])
    assert short[0].selection_rule == "computed" and short[1].is_selected


def test_lists_of_different_length_are_not_paired(sheet):
    rows = sheet(traces=[*ADJ, RAW[0]])
    assert [r.readout_adj_amplitude for r in rows[:2]] == [10.0, 99.0] and [r.readout_raw_x for r in rows[:2]] == [None, None]


def test_rounds_outside_the_axis_keep_their_rows(sheet):
    extra = [(3, 42, "Rep_032", None, "adj", 0, 30.0, 930.0, 60.0, 12.0, 0.5), (3, 42, "Toe_001", 635, "adj", 0, 1.0, 2.0, 3.0, 4.0, 0.5)]
    rows = sheet(traces=[*ADJ, *RAW, *extra])
    qc = [r for r in rows if r.bin_index < 0]
    assert [(r.hybe, r.readout_channel, r.datatype, r.readout_id, r.readout_adj_y) for r in qc] == [("Rep_032", 0, "R", 32, 30.0), ("Toe_001", 635, "", -1, 1.0)]
    assert all(r.final_x is None and not r.is_selected for r in qc) and len(rows) == 6


def test_channel_axis_reads_bare_keys_once(sheet):
    axis = [(0, 15, "Hyb_015", 635), (1, 16, "Hyb_016", 635), (2, 17, "Hyb_017", 635), (3, 18, "", None)]
    rows = sheet(axis=axis)
    assert [(r.bin_index, r.candidate_index, r.readout_channel) for r in rows] == [(0, 0, 635), (0, 1, 635), (1, -1, 635), (2, -1, 635), (3, -1, 0)]
    exact = [(3, 42, "Hyb_015", 635, "adj", 0, 5.0, 6.0, 7.0, 8.0, 0.5)]
    rows = sheet(axis=axis, traces=[*ADJ, *exact])
    assert [r.readout_adj_y for r in rows if r.bin_index == 0] == [5.0] and all(r.bin_index >= 0 for r in rows)
    # a hybe that fills two slots cannot be told by its bare name
    two = [(0, 15, "Hyb_015", 635), (1, 16, "Hyb_015", 555)]
    assert [(r.bin_index, r.candidate_index) for r in sheet(axis=two) if r.hybe == "Hyb_015"] == [(0, -1), (1, -1), (-1, 0), (-1, 1)]


def test_homeless_allele(sheet):
    rows = sheet(cell=-1)
    assert {(r.cell_key, r.celltype) for r in rows} == {("", "")} and len(rows) == 4


def test_the_sheet_is_dealt_by_allele_once(spark):
    """Each table is shuffled once, by allele; the joins before had ten shuffles and more."""
    from chromaloom.plans import load_all
    from chromaloom.plans.registry import QUERIES

    load_all()
    plan = QUERIES["allele_sheet"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    # candidates, their fiducials, alleles and rejections
    assert 1 <= len(shuffles) <= 4 and not any("ENSURE_REQUIREMENTS" in line for line in shuffles), shuffles
