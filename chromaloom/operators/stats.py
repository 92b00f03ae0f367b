"""Exact order statistics and positions that never gather a whole group in one task.

`percentile`/`median` keep every distinct value of a group in one aggregation
buffer, and a window keeps a whole partition in one task. Both are fine only for
groups with a known bound. The functions here are for groups that grow with the
data: they bracket the wanted rank with a mergeable sketch and then count exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromaloom.session import checked_broadcast, cut

SKETCH = 10_000          # percentile_approx accuracy: rank error <= n / SKETCH
HOT_GROUP = 1_000_000    # values one task may rank in memory
RUN = 10_000             # equal values written out at a time
POSITION_SPLITS = 1024   # range buckets of the position functions


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"__{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    cond = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return left.join(renamed, cond).drop(*[f"__{k}" for k in keys])


def exact_quantiles(df: DataFrame, keys: list[str], value, probs: dict[str, float],
                    few_groups: bool = False) -> DataFrame:
    """keys, n and one interpolated quantile column per entry of `probs`.

    Pass 1 (map-side combined, bounded state): count, min, max and a bracket
    around every wanted rank. Pass 2: everything below the bracket collapses to
    one counted row before the shuffle, only values inside it are ranked.
    `few_groups` broadcasts the bracket table and is for key sets whose number of
    groups has a bound that does not depend on the data.
    """
    names = list(probs)
    margin = 4.0 / SKETCH
    values = df.select(*keys, F.expr(value).alias("__v") if isinstance(value, str) else value.alias("__v"))
    values = values.where(F.col("__v").isNotNull() & ~F.isnan(F.col("__v").cast("double")))
    lows = [max(probs[k] - margin, 0.0) for k in names]
    highs = [min(probs[k] + margin, 1.0) for k in names]
    sketch = F.percentile_approx("__v", lows + highs, SKETCH)
    brackets = values.groupBy(*keys).agg(
        F.count("__v").alias("n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"),
        sketch.alias("__b"))
    wanted = []
    for k, name in enumerate(names):
        # the margin spans whole ranks only above SKETCH values; smaller groups are ranked whole
        few = F.col("n") <= SKETCH
        lo = F.col("__min") if lows[k] <= 0.0 else F.when(few, F.col("__min")).otherwise(F.col("__b")[k])
        hi = F.col("__max") if highs[k] >= 1.0 else F.when(few, F.col("__max")).otherwise(F.col("__b")[k + len(names)])
        wanted.append(F.struct(F.lit(k).alias("which"), lo.alias("lo"), hi.alias("hi"),
                               (F.lit(float(probs[name])) * (F.col("n") - 1)).alias("pos")))
    if keys:
        targets = brackets.select(*keys, "n", F.explode(F.array(*wanted)).alias("__t"))
        # one narrow row per group and rank; broadcast when bounded by construction or by count
        side = F.broadcast(targets) if few_groups else checked_broadcast(targets)
        bracketed = _null_safe(values, side, keys)
    else:
        # one bracket for all rows: a scalar subquery, not a join
        whole = brackets.select(F.struct("n", F.array(*wanted).alias("t")).alias("b")).scalar()
        bracketed = values.withColumn("__w", whole).select("__v", F.col("__w.n").alias("n"), F.explode("__w.t").alias("__t"))
    inside = (
        bracketed
        .where(F.col("__v") <= F.col("__t.hi"))
        .select(*keys, "n", F.col("__t.which").alias("which"), F.col("__t.pos").alias("pos"),
                F.when(F.col("__v") >= F.col("__t.lo"), F.col("__v")).alias("__v"))
        .groupBy(*keys, "which", "n", "pos", "__v").count()
    )
    upto = F.sum("count").over(
        Window.partitionBy(*keys, "which").orderBy(F.col("__v").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = inside.withColumn("__upto", upto)
    first, last = F.floor("pos"), F.ceil("pos")

    def at(rank: Column) -> Column:
        holds = (F.col("__upto") > rank) & (F.col("__upto") - F.col("count") <= rank)
        return F.max(F.when(holds, F.col("__v")))

    picked = ranked.groupBy(*keys, "which", "n", "pos").agg(at(first).alias("__lo"), at(last).alias("__hi"))
    frac = F.col("pos") - F.floor("pos")
    q = F.col("__lo") + (F.col("__hi") - F.col("__lo")) * frac
    q = F.when(q.isNotNull(), q).otherwise(F.raise_error(F.lit("rank outside its bracket")).cast("double"))
    out = picked.groupBy(*keys, "n").agg(*[
        F.max(F.when(F.col("which") == k, q)).alias(name) for k, name in enumerate(names)])
    return out.select(*keys, "n", *names)


def weighted_quantiles(df: DataFrame, keys: list[str], value: str, weight: str, probs: dict[str, float]) -> DataFrame:
    """exact_quantiles of values that stand for `weight` equal ones each (a whole number).

    Equal values are summed first. Groups with few different values are ranked over running
    counts; with a group above the limit the values are written out and take the counted path.
    """
    kept = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.col(weight) > 0))
    counted = cut(kept.groupBy(*keys, value).agg(F.sum(weight).cast("long").alias("__c")))
    if has_hot_group(counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))):
        # in two steps, so an array stays short
        runs = counted.select(*keys, value, "__c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__c") - 1, F.lit(RUN).cast("long"))).alias("__s"))
        each = runs.select(*keys, value, F.explode(F.array_repeat(F.lit(0), F.least(F.col("__c") - F.col("__s"), F.lit(RUN)).cast("int"))))
        return exact_quantiles(each, keys, value, probs)
    w = Window.partitionBy(*keys)
    ranked = counted.select(*keys, value, "__c", F.sum("__c").over(w).alias("n"), F.sum("__c").over(
        w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("__upto"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("__upto") > rank) & (F.col("__upto") - F.col("__c") <= rank), F.col(value)))

    picked = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = at(F.floor(pos)), at(F.ceil(pos))
        picked.append((lo + (hi - lo) * F.max(pos - F.floor(pos))).alias(name))
    return ranked.groupBy(*keys, "n").agg(*picked).select(*keys, "n", *probs)


def has_hot_group(sizes: DataFrame, n: str = "n", limit: int = HOT_GROUP) -> bool:
    """Size check before the in-memory path is allowed (one cheap aggregate job)."""
    return not sizes.where(F.col(n) > limit).limit(1).isEmpty()


def group_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                    sizes: DataFrame | None = None, bound: DataFrame | None = None) -> DataFrame:
    """Quantiles of many groups that are small by nature (per cell).

    `sizes(keys..., n)` bounds the group sizes; `bound(n)`, where no n is smaller than the groups it
    stands for, spares counting them when it shows that none is hot. With no group above the limit the
    built-in aggregate is used; otherwise the hot groups, and only they, take the
    counted path.
    """
    # NaN is no value, whichever path a group takes; a group without values keeps its row
    df = df.withColumn(value, F.when(~F.isnan(F.col(value).cast("double")), F.col(value)))

    def built_in(part: DataFrame) -> DataFrame:
        return part.groupBy(*keys).agg(
            F.count(value).alias("n"), *[F.percentile(value, F.lit(p)).alias(k) for k, p in probs.items()])

    if bound is not None and not has_hot_group(bound):
        return built_in(df)
    sizes = df.groupBy(*keys).agg(F.count(value).alias("n")) if sizes is None else sizes
    if not has_hot_group(sizes):
        return built_in(df)
    hot = sizes.where(F.col("n") > HOT_GROUP).select(*keys)
    return built_in(df.join(hot, keys, "left_anti")).unionByName(
        exact_quantiles(df.join(hot, keys, "left_semi"), keys, value, probs))


def _range_buckets(df: DataFrame, order: str) -> DataFrame:
    """df plus `__bucket`: range buckets of a numeric column from a bounded list of
    approximate splits (the only thing that reaches the driver)."""
    from pyspark.ml.feature import Bucketizer

    lead = df.withColumn("__lead", F.col(order).cast("double"))
    splits = sorted(set(lead.where("__lead is not null").approxQuantile(
        "__lead", [k / POSITION_SPLITS for k in range(1, POSITION_SPLITS)], 0.5 / POSITION_SPLITS)))
    if not splits:
        return lead.withColumn("__bucket", F.lit(0)).drop("__lead")
    edges = [-float("inf"), *splits, float("inf")]
    return Bucketizer(splits=edges, inputCol="__lead", outputCol="__bucket", handleInvalid="keep").transform(
        lead).drop("__lead").withColumn("__bucket", F.col("__bucket").cast("int"))


def ordered_index(df: DataFrame, order: list[str], keys: list[str] | None = None, name: str = "idx") -> DataFrame:
    """0-based position in the total order of `order` (first column numeric), per `keys`.

    Bucket counts give the offsets, so no window spans more than one range bucket of
    one group.
    """
    keys = keys or []
    df = _range_buckets(df, order[0])
    counts = df.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    # at most POSITION_SPLITS + 1 rows per group
    w = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = counts.select(*keys, "__bucket", (F.sum("__n").over(w) - F.col("__n")).alias("__off"))
    local = F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy(*order))
    placed = df.withColumn("__rn", local).join(offsets, [*keys, "__bucket"], "inner")
    return placed.withColumn(name, F.col("__off") + F.col("__rn") - 1).drop("__bucket", "__rn", "__off")


def running(df: DataFrame, order: str, columns: dict[str, str], descending: bool = False, how: str = "sum") -> DataFrame:
    """Running sums or minima of `columns` {new: column} over the total order of a numeric
    column with distinct values; bucket totals carry over what came before a bucket."""
    fn = {"sum": F.sum, "min": F.min}[how]
    bucketed = _range_buckets(df, order)
    direction = F.desc if descending else F.asc
    totals = bucketed.groupBy("__bucket").agg(*[fn(c).alias(f"__t_{k}") for k, c in columns.items()])
    # at most POSITION_SPLITS + 1 rows
    before = Window.orderBy(direction("__bucket")).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("__bucket", *[fn(f"__t_{k}").over(before).alias(f"__o_{k}") for k in columns])
    local = Window.partitionBy("__bucket").orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = bucketed.join(F.broadcast(carried), "__bucket")
    for k, c in columns.items():
        here, past = fn(c).over(local), F.col(f"__o_{k}")
        out = out.withColumn(k, here + F.coalesce(past, F.lit(0)) if how == "sum" else F.least(here, past))
    return out.drop("__bucket", *[f"__o_{k}" for k in columns])


def running_totals(df: DataFrame, order: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    return running(df, order, sums, descending)
