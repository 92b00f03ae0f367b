"""Arc proposers on planted curves."""

import numpy as np
import pytest

from chromaloom.operators import arcs as A
from chromaloom.operators.cycle_model import GRID, RingModel


def table(spark, curve, n=20):
    rows = [(float(10 * b + 10 * (k + 0.5) / n), float(v)) for b, v in enumerate(curve) for k in range(n)]
    return spark.createDataFrame(rows, "theta_deg double, dna double")


def test_dna_boundaries(spark):
    curve = [2.0] * 12 + list(np.linspace(2.0, 4.0, 12)) + [4.0] * 12
    got, levels = A.arcs_from_dna(table(spark, curve), "dna")
    assert [a["name"] for a in got] == ["G1", "S", "G2/M"]
    assert got[1]["start_deg"] == 140.0 and got[2]["start_deg"] == 220.0          # above 2.3, and at 85 % of the way up
    assert levels["ratio"] == pytest.approx(2.0) and got[2]["end_deg"] == got[0]["start_deg"] == 0.0
    # the same circle seen from another birth
    turned, _ = A.arcs_from_dna(table(spark, np.roll(curve, 9)), "dna", birth_deg=90.0)
    assert [a["start_deg"] for a in turned] == [90.0, 230.0, 310.0]


def test_smeared_division_does_not_count_as_a_rise(spark):
    curve = list(np.linspace(3.6, 2.0, 10)) + [2.0] * 6 + list(np.linspace(2.0, 4.0, 10)) + [4.0] * 10
    got, _ = A.arcs_from_dna(table(spark, curve), "dna")
    assert got[1]["start_deg"] >= 160.0


@pytest.mark.parametrize("curve", [[2.0] * 36, [2.0] * 20 + [4.0] + [2.0] * 15])
def test_flat_curve_and_spike_are_refused(spark, curve):
    with pytest.raises(ValueError):
        A.arcs_from_dna(table(spark, curve), "dna")


def test_profile_rises():
    coef = np.zeros((3, 4))
    coef[0, :2] = np.cos(np.radians(90)), np.sin(np.radians(90))                # highest at 90
    coef[1, :2] = np.cos(np.radians(200)), np.sin(np.radians(200))
    model = RingModel(["a", "b", "c"], np.zeros(3), coef)
    got = A.arcs_from_profiles(model, {"a": "S", "b": "G2/M"}, birth_deg=350.0)
    assert [a["start_deg"] for a in got] == [350.0, 5.0, 115.0]
    with pytest.raises(ValueError):
        A.arcs_from_profiles(model, {"a": "S"})


def test_post_division_split():
    w = np.ones(GRID)
    w[:8] = 0.1
    end = A.post_division_end(w / w.sum())
    assert 30.0 <= end <= 40.0
    arcs = A._three(0.0, 150.0, 250.0)
    split = A.with_post_division(arcs, w / w.sum())
    assert [a["name"] for a in split] == ["post-M", "G1", "S", "G2/M"] and split[0]["end_deg"] == split[1]["start_deg"] == end
    flat = np.full(GRID, 1 / GRID)
    assert A.with_post_division(arcs, flat) == arcs
    by_time = A.with_post_division(arcs, flat, share=0.1)
    assert by_time[0]["end_deg"] == pytest.approx(36.0, abs=3.0)
    assert A.with_post_division(arcs, flat, share=0.9) == arcs


def test_density_of_no_cells(spark):
    with pytest.raises(ValueError):
        A.phase_density(spark.createDataFrame([(None,)], "theta_deg double"))
