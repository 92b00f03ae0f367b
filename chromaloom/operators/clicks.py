"""Reviewers' added clicks, grouped into spots by the order-true first-fit rule.

A key's clicks are taken in order of (y, x, reviewer); each joins the first spot whose running
centre it lies within `radius` of, or opens one. A spot's last click is within the radius of its
centre, so a click can only join a spot that has a click within twice the radius: clicks whose
grid cells (side: twice the radius) do not touch never meet. Connected groups of cells are
therefore settled apart from each other, and one busy page spreads over many tasks.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaloom.session import cut

SAME_CLICK_PX = 4.0      # fixed: how far two hands may be apart and still mean one spot


def cell_groups(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, gy, gx, group): connected groups of occupied grid cells, diagonals included.

    Every round takes the smallest label among a cell and its neighbours, then the label of that
    label's cell, so labels travel twice as far each round. A label is the (gy, gx) it started from.
    """
    state = cut(cells.select(*by, "gy", "gx").distinct().withColumn("group", F.struct("gy", "gx")))
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    while True:
        told = state.select(*by, F.explode(steps).alias("s"), "gy", "gx", "group").select(
            *by, (F.col("gy") + F.col("s.a")).alias("gy"), (F.col("gx") + F.col("s.b")).alias("gx"), "group")
        low = told.groupBy(*by, "gy", "gx").agg(F.min("group").alias("low"))
        near = state.join(low, [*by, "gy", "gx"])
        of = state.select(*by, F.col("group").alias("further"), F.col("gy").alias("__y"), F.col("gx").alias("__x"))
        at = [near[k] == of[k] for k in by]
        jumped = near.join(of, [*at, F.col("low.gy") == F.col("__y"), F.col("low.gx") == F.col("__x")]).select(
            *[near[k] for k in by], "gy", "gx", "group", F.least("low", "further").alias("new"))
        new = cut(jumped)
        state = new.select(*by, "gy", "gx", F.col("new").alias("group"))
        if new.where("new <> group").isEmpty():
            return state


def _first_fit(radius: float):
    """Streams clicks sorted by (group, y, x, reviewer); holds the spots of one group at a time."""
    def settle(batches):
        group, spots, index = None, [], {}

        def place(y, x):
            return math.floor(y / radius), math.floor(x / radius)

        def rows():
            made = [(*group[0], s[0] / s[2], s[1] / s[2], s[2], sorted(s[3])) for s in spots]
            return pa.RecordBatch.from_arrays([
                pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64()), pa.array([m[2] for m in made], pa.float64()),
                pa.array([m[3] for m in made], pa.int64()), pa.array([m[4] for m in made], pa.list_(pa.string()))],
                ["key", "y", "x", "n_clicks", "reviewers"])

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("key", "group", "y", "x", "reviewer")]
            for key, g, y, x, who in zip(*cols, strict=True):
                here = (key,), (g["gy"], g["gx"])
                if group != here:
                    if spots:
                        yield rows()
                    group, spots, index = here, [], {}
                a, c = place(y, x)
                near = [i for p in range(a - 1, a + 2) for q in range(c - 1, c + 2) for i in index.get((p, q), ())
                        if (spots[i][0] / spots[i][2] - y) ** 2 + (spots[i][1] / spots[i][2] - x) ** 2 <= radius * radius]
                if near:
                    i = min(near)
                    s = spots[i]
                    index[place(s[0] / s[2], s[1] / s[2])].discard(i)
                    s[0], s[1], s[2] = s[0] + y, s[1] + x, s[2] + 1
                else:
                    i = len(spots)
                    s = [y, x, 1, set()]
                    spots.append(s)
                if who is not None:
                    s[3].add(who)
                index.setdefault(place(s[0] / s[2], s[1] / s[2]), set()).add(i)
        if spots:
            yield rows()
    return settle


def added_spots(clicks: DataFrame, radius: float = SAME_CLICK_PX) -> DataFrame:
    """(key, y, x, n_clicks, reviewers): the spots of clicks(key, reviewer, y, x).

    Rows without key or place are left out; an unnamed reviewer counts as a click, not as a voice.
    Equal clicks are equal in every respect, so their order does not matter.
    """
    side = 2.0 * radius
    named = cut(clicks.where("key is not null and y is not null and x is not null").select(
        F.col("key").cast("string").alias("key"), F.col("reviewer").cast("string").alias("reviewer"), F.col("y").cast("double").alias("y"),
        F.col("x").cast("double").alias("x"), F.floor(F.col("y") / side).alias("gy"), F.floor(F.col("x") / side).alias("gx")))
    groups = cell_groups(named, ["key"])
    tagged = named.join(groups, ["key", "gy", "gx"]).select("key", "group", "y", "x", "reviewer")
    order = [F.col(c).asc_nulls_first() for c in ("key", "group", "y", "x", "reviewer")]
    return tagged.repartition("key", "group").sortWithinPartitions(*order).mapInArrow(
        _first_fit(float(radius)), "key string, y double, x double, n_clicks long, reviewers array<string>")
