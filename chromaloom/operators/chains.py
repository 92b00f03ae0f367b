"""Cheapest chains through a cell's spots, computed slot by slot over the whole table.

The dynamic programme of every cell advances together: one round per slot of the
declared axis, each a join of the slot's points with the chains that end earlier in
the same cell and one min-aggregate. A row carries its own chain (bounded by the
axis), so there is no back-tracking pass and no per-cell Python.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaloom.functions.physics import ChainLaw, chain_variance, clutter_price, log_density
from chromaloom.session import cut

from .pairs import BLOCK, group_pairs
from .stats import has_hot_group

KEYS = ["fov", "cell"]
AXES = ("y_um", "x_um", "z_um")
CLUTTER_VOLUME_UM3 = 500.0


def slot_kb(separation) -> Column:
    """kb between p_slot and slot from a matrix over the axis; NULL where no step leads."""
    rows = [F.array(*[F.lit(None).cast("double") if math.isnan(v) else F.lit(float(v)) for v in row]) for row in separation]
    return F.get(F.get(F.array(*rows), F.col("p_slot")), F.col("slot"))


def step_cost(s_kb: Column, law: ChainLaw) -> Column:
    """-ln N_chain of the step from (p_*) to (y_um, ...)."""
    gaps = [F.col(a) - F.col(f"p_{a}") for a in AXES]
    return -log_density(*gaps, *chain_variance(law, s_kb))


def best_chains(points: DataFrame, n_slots: int, step_kb: float = 0.0, volume_um3: float = CLUTTER_VOLUME_UM3,
                law: ChainLaw = ChainLaw(), separation=None, price: DataFrame | None = None) -> DataFrame:
    """(fov, cell, weight, chain): the cheapest chain of every cell that has one below zero.

    points(fov, cell, point, slot, y_um, x_um, z_um). A chain takes at most one point
    per slot and walks the axis forward; one more point must pay more than its price
    as clutter, ln(V / n), or what `price`(fov, cell, clutter) says. Slots are `step_kb`
    apart, or as the `separation` matrix says. Ties go to the earlier (slot, point).
    """
    s_kb = (F.col("slot") - F.col("p_slot")) * F.lit(float(step_kb)) if separation is None else slot_kb(separation)
    sizes = points.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    hot = has_hot_group(sizes, limit=BLOCK)
    if price is None:
        price = sizes.select(*KEYS, clutter_price(F.lit(float(volume_um3)), "n").alias("clutter"))
    base = cut(points.join(price, KEYS).select(*KEYS, "point", "slot", *AXES, "clutter"))
    lone = [F.lit(0.0).alias("w"), F.array("point").alias("chain")]
    done = [base.where(F.col("slot") == 0).select(*base.columns, *lone)]
    for slot in range(1, n_slots):
        here = base.where(F.col("slot") == slot)
        before = reduce(DataFrame.unionByName, done).select(
            *KEYS, F.col("slot").alias("p_slot"), F.col("point").alias("p_point"), F.col("w").alias("p_w"), F.col("chain").alias("p_chain"),
            *[F.col(a).alias(f"p_{a}") for a in AXES])
        steps = group_pairs(here, before, KEYS, "point", may_be_hot=hot).withColumn(
            "cost", F.col("p_w") + step_cost(s_kb, law) - F.col("clutter"))
        best = steps.where(F.col("cost") < 0).groupBy(*KEYS, "point").agg(
            F.min_by(F.struct("cost", "p_chain"), F.struct("cost", "p_slot", "p_point")).alias("b"))
        # a slot's chains are written once and only read afterwards
        done.append(cut(here.join(best, [*KEYS, "point"], "left").select(
            *base.columns, F.coalesce("b.cost", F.lit(0.0)).alias("w"),
            F.when(F.col("b").isNull(), F.array("point")).otherwise(F.array_append("b.p_chain", F.col("point"))).alias("chain"))))
    ends = reduce(DataFrame.unionByName, done).where(F.col("w") < 0)
    return ends.groupBy(*KEYS).agg(F.min("w").alias("weight"), F.min_by("chain", F.struct("w", "slot", "point")).alias("chain"))


def disjoint_chains(points: DataFrame, n_slots: int, step_kb: float, k: int = 2, **kw) -> DataFrame:
    """Up to k point-disjoint chains per cell, cheapest first (k is the fixed allele cap), all
    under the price of the whole cell. `paths.cell_paths` settles them against each other."""
    remaining, found = points, None
    sizes = points.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    price = cut(sizes.select(*KEYS, clutter_price(F.lit(CLUTTER_VOLUME_UM3), "n").alias("clutter")))
    for rank in range(k):
        chains = best_chains(remaining, n_slots, step_kb, price=price, **kw).withColumn("rank", F.lit(rank))
        found = chains if found is None else found.unionByName(chains)
        if rank + 1 < k:
            used = chains.select(*KEYS, F.explode("chain").alias("point"))
            remaining = cut(remaining.join(used, [*KEYS, "point"], "left_anti"))
    return found
