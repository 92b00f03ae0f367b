"""Even allocation of a budget over capacities, and the seeded order in which members are drawn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaloom.session import checked_broadcast, cut

from .stats import ordered_index

LEVELS = 32       # water levels tried per pass


def hash_order(seed: int, *names) -> Column:
    """A number in [0, 2^60) from the seed and the names alone: the same on every machine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def water_levels(capacities: DataFrame, budgets: DataFrame, by: list[str], cap: str = "capacity") -> DataFrame:
    """(by, n, level, left): the highest level at which min(capacity, level) sums to n at most.

    `left` is what remains of n. All groups are searched together: a pass tries LEVELS levels per
    group in one grouped sum (combined before the shuffle), so the passes follow the logarithm of
    the largest capacity, and no group is sorted or gathered.
    """
    rows = capacities.select(*by, F.greatest(F.col(cap).cast("long"), F.lit(0)).alias("__c"))
    whole = rows.groupBy(*by).agg(F.sum("__c").alias("total"), F.max("__c").alias("top"))
    state = cut(whole.join(budgets.select(*by, F.greatest(F.col("n").cast("long"), F.lit(0)).alias("n")), by).select(
        *by, "n", F.when(F.col("total") <= F.col("n"), F.col("top")).otherwise(F.lit(0)).alias("lo"),
        # the level hi is known to be too high, unless lo already takes everything
        F.when(F.col("total") <= F.col("n"), F.col("top") + 1).otherwise(F.col("top")).alias("hi")))
    while not state.where("hi - lo > 1").isEmpty():
        step = F.greatest(F.ceil((F.col("hi") - F.col("lo")) / (LEVELS + 1)), F.lit(1))
        tried = state.withColumn("step", step).select("*", *[F.least(F.col("lo") + F.col("step") * k, F.col("hi")).alias(f"l{k}") for k in range(1, LEVELS + 1)])
        sums = rows.join(checked_broadcast(tried), by).groupBy(*by, "n", "lo", "hi", *[f"l{k}" for k in range(1, LEVELS + 1)]).agg(
            *[F.sum(F.least(F.col("__c"), F.col(f"l{k}"))).alias(f"s{k}") for k in range(1, LEVELS + 1)])
        fits = [F.when(F.col(f"s{k}") <= F.col("n"), F.col(f"l{k}")) for k in range(1, LEVELS + 1)]
        over = [F.when(F.col(f"s{k}") > F.col("n"), F.col(f"l{k}")) for k in range(1, LEVELS + 1)]
        state = cut(sums.select(*by, "n", F.greatest(F.col("lo"), *fits).alias("lo"), F.least(F.col("hi"), *over).alias("hi")))
    filled = rows.join(checked_broadcast(state), by).groupBy(*by, "n", "lo").agg(F.sum(F.least("__c", "lo")).alias("s"))
    return filled.select(*by, "n", F.col("lo").alias("level"), (F.col("n") - F.col("s")).alias("left"))


def allocate(capacities: DataFrame, budgets: DataFrame, by: list[str], key: str, cap: str = "capacity", seed: int = 0) -> DataFrame:
    """capacities plus `taken`: each group's budget spread as evenly as its keys' capacities allow.

    Everybody gets min(capacity, level); what is left, less than one each, goes to keys with room
    in seeded hash order. A budget of the whole capacity or more takes everything.
    """
    levels = cut(water_levels(capacities, budgets, by, cap))
    flat = capacities.select(*by, key, F.col(cap).alias("capacity")).join(checked_broadcast(levels), by)
    room = flat.where(F.col("capacity") > F.col("level")).where(F.col("left") > 0).withColumn("__h", hash_order(seed, key))
    extra = ordered_index(room, ["__h", key], by, "__i").where(F.col("__i") < F.col("left")).select(*by, key, F.lit(1).alias("__x"))
    return flat.join(extra, [*by, key], "left").select(
        *by, key, "capacity", (F.greatest(F.least("capacity", "level"), F.lit(0)) + F.coalesce("__x", F.lit(0))).alias("taken"))


def draw(members: DataFrame, allotted: DataFrame, by: list[str], ident: str, seed: int = 0) -> DataFrame:
    """(by, ident, position): of every group the first `taken` members of its own permutation.

    The permutation is a function of seed and names alone, so a larger budget extends each
    prefix and a new group changes no other.
    """
    named = members.select(*by, ident).withColumn("__h", hash_order(seed, *by, ident))
    placed = ordered_index(named, ["__h", ident], by, "position")
    return placed.join(checked_broadcast(allotted.where("taken > 0").select(*by, "taken")), by).where("position < taken").select(*by, ident, "position")
