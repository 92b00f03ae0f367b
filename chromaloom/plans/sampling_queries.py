"""Crop draws: an even budget over rounds and fields, then the prefix of each field's permutation."""

from pyspark.sql import functions as F

from chromaloom.operators import sampling as S
from chromaloom.session import cut
from chromaloom.sources import tables as T

from .registry import query

BUDGET, SEED = 4000, 11


def _order(text: str) -> str:
    return f"CAST('0x' || substr(md5('{SEED}|' || {text}), 1, 15) AS BIGINT)"


def _water(name: str, source: str, by: str, key: str, budget: str) -> str:
    """SQL of the even allocation: sorted capacities give the level, the hash order the remainder."""
    part = f"PARTITION BY {by}" if by else ""
    cols = f"{by}, " if by else ""
    return f"""
{name}_s AS (SELECT *, {budget} AS n, sum(capacity) OVER ({part}) AS total, max(capacity) OVER ({part}) AS top, count(*) OVER ({part}) AS m,
  row_number() OVER ({part} ORDER BY capacity, {key}) AS i, coalesce(sum(capacity) OVER ({part} ORDER BY capacity, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {source}),
{name}_l AS (SELECT *, CASE WHEN total <= n THEN top ELSE max(CASE WHEN before + capacity * (m - i + 1) > n THEN (n - before) // (m - i + 1) END) OVER ({part}) END AS level FROM {name}_s),
{name}_r AS (SELECT *, n - sum(least(capacity, level)) OVER ({part}) AS left_over,
  row_number() OVER (PARTITION BY {cols} capacity > level ORDER BY {_order(f"CAST({key} AS VARCHAR)")}, {key}) AS o FROM {name}_l),
{name} AS (SELECT {cols} {key}, capacity, CAST(least(capacity, level) + CASE WHEN capacity > level AND o <= left_over THEN 1 ELSE 0 END AS BIGINT) AS taken FROM {name}_r)"""


CROPS_SQL = f"""
mem AS MATERIALIZED (SELECT DISTINCT hybe, fov, cell FROM m_spots WHERE cell >= 0),
cf AS MATERIALIZED (SELECT hybe, fov, count(*) AS capacity FROM mem GROUP BY 1, 2),
ch AS MATERIALIZED (SELECT hybe, sum(capacity) AS capacity FROM cf GROUP BY 1),
{_water("ah", "ch", "", "hybe", str(BUDGET))},
cj AS (SELECT cf.*, taken AS share FROM cf JOIN (SELECT hybe, taken FROM ah) USING (hybe)),
{_water("af", "cj", "hybe", "fov", "share")}"""


def crops(spark, d):
    """(members, allotted): the cells a round has in a field, and how many are to be drawn."""
    members = cut(T.spots(spark, d).where("cell >= 0").select("hybe", "fov", "cell").distinct())
    fields = cut(members.groupBy("hybe", "fov").agg(F.count("*").alias("capacity")))
    rounds = fields.groupBy(F.lit(0).alias("run"), "hybe").agg(F.sum("capacity").alias("capacity"))
    budget = spark.createDataFrame([(0, BUDGET)], "run int, n long")
    shares = S.allocate(rounds, budget, ["run"], "hybe", seed=SEED).select("hybe", F.col("taken").alias("n"))
    return members, cut(S.allocate(fields, shares, ["hybe"], "fov", seed=SEED))


@query("crop_allocation", f"WITH {CROPS_SQL} SELECT hybe, fov, capacity, taken FROM af")
def crop_allocation(spark, d):
    return crops(spark, d)[1]


@query("crop_draw", f"""WITH {CROPS_SQL} SELECT hybe, fov, cell, position FROM (
  SELECT *, row_number() OVER (PARTITION BY hybe, fov ORDER BY {_order("hybe || '|' || CAST(fov AS VARCHAR) || '|' || CAST(cell AS VARCHAR)")}, cell) - 1 AS position FROM mem) JOIN af USING (hybe, fov) WHERE position < taken""")
def crop_draw(spark, d):
    members, allotted = crops(spark, d)
    return S.draw(members, allotted, ["hybe", "fov"], "cell", SEED)
