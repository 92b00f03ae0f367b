"""Coverage states of the processing steps and the plan they imply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed state order: the least advanced modality speaks for the FOV.
STATES = ("missing", "partial", "done", "n/a")
POLICIES = ("existing", "redo", "skip")


def state(have, want) -> Column:
    h, w = F.col(have), F.col(want)
    return F.when(w <= 0, "n/a").when(h >= w, "done").when(h > 0, "partial").otherwise("missing")


def rank(c: str) -> Column:
    return F.coalesce(*[F.when(F.col(c) == s, F.lit(k)) for k, s in enumerate(STATES)])


def coverage(expected: DataFrame, present: DataFrame, keys: list[str], item: list[str]) -> DataFrame:
    """(keys, have, want, state): how many expected items are present."""
    marked = expected.join(present.select(*keys, *item).distinct().withColumn("__got", F.lit(1)), [*keys, *item], "left")
    out = marked.groupBy(*keys).agg(F.count("__got").alias("have"), F.count(F.lit(1)).alias("want"))
    return out.withColumn("state", state("have", "want"))


def worst_of(per_modality: DataFrame, keys: list[str]) -> DataFrame:
    """Combine modalities: worst state among those that apply, counts summed over them."""
    ranked = per_modality.withColumn("__r", rank("state"))
    real = F.col("state") != "n/a"
    out = ranked.groupBy(*keys).agg(
        F.min(F.when(real, F.col("__r"))).alias("__r"), F.coalesce(F.sum(F.when(real, F.col("have"))), F.lit(0)).alias("have"),
        F.coalesce(F.sum(F.when(real, F.col("want"))), F.lit(0)).alias("want"))
    name = F.coalesce(*[F.when(F.col("__r") == k, F.lit(s)) for k, s in enumerate(STATES)], F.lit("n/a"))
    return out.select(*keys, "have", "want", name.alias("state"))


def summarize(status: DataFrame) -> DataFrame:
    """Per step: FOV counts by state."""
    return status.groupBy("step").agg(*[F.sum((F.col("state") == s).cast("long")).alias(s.replace("/", "_")) for s in STATES])


def plan(status: DataFrame, policies: dict[str, str] | None = None) -> DataFrame:
    """(step, fov) to run: unfinished ones, everything that applies, or nothing."""
    for step, policy in (policies or {}).items():
        if policy not in POLICIES:
            raise ValueError(f"{step}: unknown policy {policy!r}")
    chosen = F.coalesce(*[F.when(F.col("step") == s, F.lit(p)) for s, p in (policies or {}).items()], F.lit("existing"))
    run = ((chosen == "existing") & F.col("state").isin("partial", "missing")) | ((chosen == "redo") & (F.col("state") != "n/a"))
    return status.where(run).select("step", "fov")


def pending(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(present.select(*keys).distinct(), keys, "left_anti")


def expected_targets(rounds: DataFrame, anchor: tuple[str, str, int] | None = None, tracing: list[tuple[str, str]] = (), tracing_channels: list[int] = (),
                     genes: list[tuple[str, str, int]] = (), channels: list[int] = (), chosen: list[tuple[str, str]] | None = None) -> DataFrame:
    """(modality, hybe, channel) the store should hold spots for.

    The anchor, every tracing round at every activated channel, the cell-cycle sources, and the
    channels of countable rounds (a name ending in _mRNA or _exon, no Rep_ or Toe_) that are nobody's
    fiducial. A round the run names is expected even where its own record disagrees. `channels`
    filters the union (none: all); `chosen` keeps named rounds (None: all, []: none).

    rounds(modality, hybe, readout_name, channels array<int>, fiducial_channel): the layout.
    """
    spark = rounds.sparkSession
    fiducials = [r[0] for r in rounds.select("fiducial_channel").where("fiducial_channel is not null").distinct().collect()]     # a handful of channels
    known = [r[0] for r in rounds.select("modality").distinct().collect()]                                                      # the project's modalities
    name = F.coalesce("readout_name", F.lit(""))
    countable = rounds.where(name.rlike("(_mRNA|_exon)$") & ~name.rlike("^(Rep_|Toe_)"))
    counted = countable.select("modality", "hybe", F.explode("channels").alias("channel")).where(~F.col("channel").isin(fiducials) if fiducials else F.lit(True))
    named = [anchor] if anchor else []
    named += [(m, h, c) for m, h in tracing for c in tracing_channels] + list(genes)
    stated = spark.createDataFrame([(m, h, int(c)) for m, h, c in named if m in known], "modality string, hybe string, channel int")
    out = stated.unionByName(counted.select("modality", "hybe", F.col("channel").cast("int").alias("channel"))).distinct()
    if channels:
        out = out.where(F.col("channel").isin([int(c) for c in channels]))
    if chosen is not None:
        out = out.join(spark.createDataFrame(list(chosen), "modality string, hybe string"), ["modality", "hybe"], "left_semi")
    return out
