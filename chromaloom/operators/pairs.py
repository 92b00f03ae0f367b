"""Pairs inside a group, with hot groups split into blocks.

The pair list of a cell is the operator's own result, so nothing is dropped. A
group with more than BLOCK left rows is cut into blocks: its left rows are dealt
over the blocks by hash and its right rows are repeated once per block, so the
work of one group spreads over many tasks. Ordinary groups take the plain join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 20_000


def group_pairs(left: DataFrame, right: DataFrame, keys: list[str], deal_by: str,
                residual: Column | None = None, may_be_hot: bool | None = None) -> DataFrame:
    """Inner equi-join on `keys`; non-key columns of the two sides must differ.

    A count of the left group sizes decides: without a hot group this is one plain
    join. Otherwise only the hot groups are cut into blocks; the rest stays plain.
    `may_be_hot=False` is for callers that have checked the sizes themselves.
    """
    hot = left.groupBy(*keys).count().where(F.col("count") > BLOCK).select(
        *keys, F.ceil(F.col("count") / F.lit(BLOCK)).cast("int").alias("__blocks"))
    if may_be_hot is None:
        may_be_hot = not hot.limit(1).isEmpty()
    if not may_be_hot:
        out = left.join(right, keys)
    else:
        names = hot.select(*keys)
        plain = left.join(names, keys, "left_anti").join(right, keys)
        dealt = left.join(hot, keys).withColumn(
            "__block", F.pmod(F.xxhash64(deal_by), F.col("__blocks")).cast("int")).drop("__blocks")
        repeated = right.join(hot, keys).withColumn(
            "__block", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))).drop("__blocks")
        out = plain.unionByName(dealt.join(repeated, [*keys, "__block"]).drop("__block"))
    return out if residual is None else out.where(residual)


DENSE = 2_000


def radius_neighbours(points: DataFrame, keys: list[str], axes: list[str], radius: float, ident: str) -> DataFrame:
    """Rows (keys, ident, other) of points within `radius` of each other, self included.

    A group of up to DENSE points is compared directly. Denser groups, if a count of
    the group sizes finds any, go through a grid with side `radius`: a probe looks
    into the 3^d grid cells around its own, so the range join stays an equi-join.
    """
    gap = None
    for a in axes:
        term = F.pow(F.col(a) - F.col(f"o_{a}"), F.lit(2.0))
        gap = term if gap is None else gap + term
    near = F.sqrt(gap) <= F.lit(float(radius))
    other = [F.col(ident).alias("other"), *[F.col(a).alias(f"o_{a}") for a in axes]]

    def direct(part: DataFrame) -> DataFrame:
        left = part.select(*keys, ident, *axes)
        return group_pairs(left, part.select(*keys, *other), keys, ident, near, may_be_hot=False).select(*keys, ident, "other")

    sizes = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    dense = sizes.where(F.col("n") > DENSE).select(*keys)
    if dense.limit(1).isEmpty():
        return direct(points)
    sparse = points.join(dense, keys, "left_anti")
    return direct(sparse).unionByName(_by_grid(points.join(dense, keys, "left_semi"), keys, axes, radius, ident, other, near))


def _by_grid(points: DataFrame, keys: list[str], axes: list[str], radius: float, ident: str, other: list[Column],
             near: Column) -> DataFrame:
    grid = [F.floor(F.col(a) / F.lit(float(radius))).cast("long") for a in axes]
    base = points.select(*keys, *other, *[g.alias(f"g{k}") for k, g in enumerate(grid)])
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    probe = points.select(*keys, ident, *axes, *[g.alias(f"h{k}") for k, g in enumerate(grid)])
    for k in range(len(axes)):
        probe = probe.select("*", F.explode(steps).alias(f"s{k}"))
        probe = probe.withColumn(f"g{k}", F.col(f"h{k}") + F.col(f"s{k}")).drop(f"h{k}", f"s{k}")
    cells = [*keys, *[f"g{k}" for k in range(len(axes))]]
    return group_pairs(probe, base, cells, ident, near).select(*keys, ident, "other")
