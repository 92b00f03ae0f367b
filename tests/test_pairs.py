import itertools
import math

import numpy as np
import pandas as pd
import pytest

from chromaloom.operators import distances, pairs, sites


@pytest.fixture
def cloud(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"fov": 1, "cell": np.where(np.arange(400) < 300, 7, rng.integers(8, 20, 400)), "point": np.arange(400),
                        "bin": rng.integers(0, 6, 400)})
    pdf[["y_um", "x_um", "z_um"]] = rng.uniform(-3, 3, (400, 3))
    return pdf, spark.createDataFrame(pdf.astype({"fov": "int32", "cell": "int64"}))


def brute(pdf, radius):
    out = set()
    for _c, g in pdf.groupby("cell"):
        for (_, a), (_, b) in itertools.product(g.iterrows(), g.iterrows()):
            if math.dist(a[["y_um", "x_um", "z_um"]], b[["y_um", "x_um", "z_um"]]) <= radius:
                out.add((int(a.point), int(b.point)))
    return out


def test_hot_cell_is_split_without_losing_pairs(cloud, monkeypatch):
    pdf, df = cloud
    monkeypatch.setattr(pairs, "BLOCK", 40)
    got = distances.pair_distances(df.select("fov", "cell", "point", "y_um", "x_um", "z_um")).toPandas()
    sizes = pdf.groupby("cell").size()
    assert len(got) == (sizes * (sizes - 1) // 2).sum()
    assert not got.duplicated(["point_a", "point_b"]).any()


def test_radius_join_direct_and_by_grid(cloud, monkeypatch):
    pdf, df = cloud
    want = brute(pdf, 1.2)

    def run():
        near = pairs.radius_neighbours(df, ["fov", "cell"], ["y_um", "x_um", "z_um"], 1.2, "point")
        return {(r["point"], r["other"]) for r in near.collect()}

    assert run() == want
    monkeypatch.setattr(pairs, "DENSE", 50)
    monkeypatch.setattr(pairs, "BLOCK", 10)
    assert run() == want


def test_four_spots(spark):
    rows = [(1, 1, "RNA", 0.0, 0.0, 0.0), (1, 1, "RNA", 3.0, 0.0, 4.0), (1, 1, "DNA", 4.0, 0.0, 3.0), (1, 2, "RNA", 0.0, 0.0, 0.0), (1, -1, "DNA", 0.0, 0.0, 0.0)]
    spots = spark.createDataFrame([(f, c, k, m, "Hyb_001", 555, y, x, z, "accepted") for k, (f, c, m, y, x, z) in enumerate(rows)],
                                  "fov int, cell long, uid long, modality string, hybe string, channel int, y_um double, x_um double, z_um double, z_status string")
    rna, dna = (distances.spot_points(spots, (m, "Hyb_001", 555)) for m in ("RNA", "DNA"))
    assert sorted(round(r["d_um"], 9) for r in distances.pair_distances(rna, dna).collect()) == [round(math.sqrt(2), 9), 5.0]
    assert [r["d_um"] for r in distances.pair_distances(rna).collect()] == [5.0]
    one = distances.per_cell(rna, dna).collect()
    assert len(one) == 1 and one[0]["d_um"] == pytest.approx((math.sqrt(2) + 5) / 2)
    none = distances.histogram(distances.pair_distances(rna, dna), 0, 10, 10, gate=spots.where("false").select("fov", "cell"))
    assert none.count() == 0


def test_z_status_follows_the_dimensionality(spark):
    rows = [(1, 1, k, "RNA", "Hyb_001", 555, float(k), 0.0, 0.0, s) for k, s in enumerate(("accepted", "not_fit", "rejected"))]
    spots = spark.createDataFrame(rows, "fov int, cell long, uid long, modality string, hybe string, channel int, y_um double, x_um double, z_um double, z_status string")
    assert distances.spot_points(spots, ("RNA", "Hyb_001", 555), "xyz").count() == 1
    assert distances.spot_points(spots, ("RNA", "Hyb_001", 555), "xy").count() == 2


def test_traced_source_must_name_its_modality():
    with pytest.raises(ValueError, match="traced"):
        distances.points_of(("RNA", "Hyb_001", "traced"), slot_of={"Hyb_001": 0}, traced_modality="DNA")
    with pytest.raises(ValueError, match="not a traced bin"):
        distances.points_of(("DNA", "Hyb_099", "traced"), slot_of={"Hyb_001": 0}, traced_modality="DNA")


def test_two_planted_sites(spark):
    rng = np.random.default_rng(5)
    rows = []
    for site, centre in enumerate(([0, 0, 0], [6, 0, 0])):
        for b in range(12):
            rows.append((1, 1, site * 100 + b, *map(float, rng.normal(centre, 0.2)), b))
    rows.append((1, 1, 999, 20.0, 20.0, 20.0, 3))
    pts = spark.createDataFrame(rows, "fov int, cell long, point long, y_um double, x_um double, z_um double, bin int")
    assert sites.spatial_multiplicity(pts, 12).collect()[0]["k"] == 2
    seeds = sites.seeds(pts, 3, 1.5, 4)
    assert seeds.count() == 2
    near = sites.nearest_site(pts, seeds).toPandas()
    assert near[near.point < 100].site.nunique() == 1 and near[near.point.between(100, 200)].site.nunique() == 1
