"""Reviewer verdicts to labels, agreement and score quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromaloom.session import checked_broadcast

from .stats import ordered_index, running_totals

RECORD = ["reviewer", "key", "page"]
SPOT_GRID_PX = 0.5       # fixed: shown candidates closer than a grid step are one spot
FEATURE_AGREE = 1e-3     # fixed: vectors of the same pixels agree to this


def latest_verdicts(records: DataFrame) -> DataFrame:
    """The last record per (reviewer, key, page) by clock, then file, then line."""
    rest = [c for c in records.columns if c not in RECORD]
    order = F.struct("at", "file_no", "line_no")
    return records.groupBy(*RECORD).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*RECORD, *[f"r.{c}" for c in rest])


def agreement(latest: DataFrame) -> DataFrame:
    """(key, page) judged by more than one reviewer."""
    return latest.groupBy("key", "page").agg(
        F.count(F.lit(1)).alias("n_reviewers"), F.min("reviewer").alias("first_reviewer"),
        F.max("reviewer").alias("last_reviewer")).where("n_reviewers > 1")


def grid(c) -> Column:
    return F.bround(F.col(c) / F.lit(SPOT_GRID_PX)).cast("long")


def spot_votes(shown: DataFrame) -> DataFrame:
    """Votes per (key, quantised spot); an abstention moves neither count."""
    keep = F.col("keep")
    votes = shown.groupBy("key", grid("y").alias("gy"), grid("x").alias("gx"), grid("z").alias("gz")).agg(
        F.max("y").alias("y"), F.max("x").alias("x"), F.max("z").alias("z"),
        F.sum(F.when(keep > 0, 1).otherwise(0)).alias("kept"),
        F.sum(F.when(keep >= 0, 1).otherwise(0)).alias("seen"),
        (F.max("feat") - F.min("feat")).alias("spread"))
    label = (
        F.when(F.col("spread") > FEATURE_AGREE, "inconsistent").when(F.col("seen") == 0, "undetermined")
        .when(F.col("kept") == F.col("seen"), "positive").when(F.col("kept") == 0, "negative").otherwise("contested"))
    return votes.withColumn("label", label)


def operating_point(shown: DataFrame) -> DataFrame:
    """The score threshold with the best F1 over observed scores rounded to 4 places.

    Rounded scores are at most 10,001 values, so the cumulative pass is bounded.
    The first (lowest) threshold wins a tie.
    """
    judged = shown.where((F.col("keep") >= 0) & F.col("p").isNotNull())
    at = judged.groupBy(F.round("p", 4).alias("t"), F.col("p")).agg(
        F.sum((F.col("keep") == 1).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    # a score below its own rounded threshold counts as denied there
    per = at.groupBy("t").agg(
        F.sum("pos").alias("pos"), F.sum("n").alias("n"),
        F.sum(F.when(F.col("p") < F.col("t"), F.col("pos")).otherwise(0)).alias("pos_below"),
        F.sum(F.when(F.col("p") < F.col("t"), F.col("n")).otherwise(0)).alias("n_below"))
    down = Window.orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = per.select("t", (F.sum("pos").over(down) - F.col("pos_below")).alias("tp"),
                   (F.sum("n").over(down) - F.col("n_below")).alias("called"),
                   F.sum("pos").over(whole).alias("n_kept"), F.sum("n").over(whole).alias("n"))
    precision = F.col("tp") / F.greatest(F.col("called"), F.lit(1))
    recall = F.col("tp") / F.greatest(F.col("n_kept"), F.lit(1))
    scored = c.where("n_kept > 0 and n_kept < n").select(
        "t", "n", "n_kept", precision.alias("precision"), recall.alias("recall"),
        (precision * recall * 2 / F.greatest(precision + recall, F.lit(1e-9))).alias("f1"))
    best = scored.agg(F.max_by(F.struct("t", "precision", "recall", "f1", "n", "n_kept"), F.struct(F.col("f1"), -F.col("t"))).alias("b"))
    return best.select(F.col("b.t").alias("p"), "b.precision", "b.recall", "b.f1", "b.n", "b.n_kept").where("p is not null")


def _by_score(scored: DataFrame, y: str, score: str) -> DataFrame:
    return scored.groupBy(F.col(score).alias("s")).agg(
        F.sum(F.col(y).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))


def pr_auc(scored: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Average precision; tied scores share the precision at the end of their run."""
    at = running_totals(_by_score(scored, y, score), "s", {"tp": "pos", "called": "n"}, descending=True)
    sums = at.agg(F.sum(F.col("tp") / F.col("called") * F.col("pos")).alias("a"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    return sums.select(F.when((F.col("p") > 0) & (F.col("p") < F.col("n")), F.col("a") / F.col("p")).alias("pr_auc"))


def roc_auc(scored: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Rank-sum AUC with average ranks for ties."""
    at = running_totals(_by_score(scored, y, score), "s", {"upto": "n"})
    rank = F.col("upto") - (F.col("n") - 1) / 2.0
    sums = at.agg(F.sum(rank * F.col("pos")).alias("ranks"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    n0 = F.col("n") - F.col("p")
    return sums.select(F.when((F.col("p") > 0) & (n0 > 0), (
        F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2.0) / (F.col("p") * n0)).alias("roc_auc"))


def label_summary(votes: DataFrame) -> DataFrame:
    return votes.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("n_groups"))


def holdout(rows: DataFrame, group: str, fraction: float, seed: int = 0) -> DataFrame:
    """Whole groups go to one side: max(1, round(fraction * groups)) groups, the first in the
    order of a seeded digest, are held out. Rows without a group are not."""
    order = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string"))), 1, 12), 16, 10).cast("long")
    groups = rows.where(F.col(group).isNotNull()).select(F.col(group).alias("__g"), order.alias("__o")).distinct()
    placed = ordered_index(groups, ["__o", "__g"], name="__k")
    most = F.greatest(F.lit(1), F.floor(F.lit(float(fraction)) * groups.agg(F.count("*")).scalar() + 0.5))
    held = checked_broadcast(placed.where(F.col("__k") < most).select("__g"))
    return rows.join(held, F.col(group) == F.col("__g"), "left").withColumn("held_out", F.col("__g").isNotNull()).drop("__g")
