"""Cells settled side by side in a task give the rows of the joins and rounds over the table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromaloom.operators import clusters as C
from chromaloom.operators import distances as D
from chromaloom.operators import sites as S

POINTS = "fov int, cell long, point long, slot string, y_um double, x_um double, z_um double"


@pytest.fixture(scope="module")
def points(spark):
    rng, rows = np.random.default_rng(5), []
    for cell in range(16):
        for i in range(int(rng.integers(1, 40))):
            at = rng.choice([0.0, 4.0, 9.0]) + rng.integers(0, 5, 3) / 4     # a coarse grid makes ties
            slot = None if rng.random() < 0.05 else f"Hyb_{int(rng.integers(0, 70)):03d}"
            rows.append((cell % 3, cell, 1000 * cell + i, slot, *map(float, at)))
    rows += [(0, 50, 1, "a", None, 0.0, 0.0), (0, 50, 2, "b", 0.0, 0.0, 0.0), (0, 50, None, "c", 0.0, 0.0, 0.0), (0, 51, 1, "a", None, 0.0, 0.0),
             (0, 52, 1, "a", float("nan"), 0.0, 0.0), (0, 52, 2, "b", float("inf"), 0.0, 0.0)]
    return spark.createDataFrame(rows, POINTS).withColumn("bin", F.col("slot")).cache()


def rows_of(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("limit", [2000, 15])
def test_any_kernel_size_gives_the_same_rows(points, limit):
    """Limit 0 sends every cell through the rounds."""
    named = points.where("point is not null")
    assert rows_of(D.radius_support(named, 1.0, kernel_points=limit)) == rows_of(D.radius_support(named, 1.0, kernel_points=0))
    assert rows_of(S.spatial_multiplicity(points, 7, kernel_points=limit)) == rows_of(S.spatial_multiplicity(points, 7, kernel_points=0))
    assert rows_of(S.seeds(points, 2, 1.0, 3, kernel_points=limit)) == rows_of(S.seeds(points, 2, 1.0, 3, kernel_points=0))


def test_clusters_of_any_kernel_size(points):
    proposed = S.spatial_multiplicity(points, 7)
    assert {r.k for r in proposed.collect()} >= {0, 1, 2, 3}
    want = None
    for limit in (2000, 15):
        labels, centres = C.site_clusters(points, proposed, kernel_points=limit)
        got = rows_of(labels.select("cell", "point", "slot", "y_um", "site")), rows_of(centres.select("cell", "site", "y_um", "x_um", "z_um"))
        want = want or got
        assert got == want and got[0] and got[1]


def test_support_and_picks_start_few_jobs(spark, points):
    """A pass over the table was at least one job; now all picks of all cells are one."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("multiplicity", "all rounds")
    S.spatial_multiplicity(points, 7).collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup("multiplicity")) <= 6
