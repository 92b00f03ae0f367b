"""Ring models as versioned tables: a start from given phases, the training octiles, save, load, score."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cycle_model import HARMONICS, PSEUDO, RingModel
from .stats import exact_quantiles

OCTILES, LEAST_CELLS = 8, 5        # fixed: classes of the total, and the cells a class must exceed
MODEL = ("genes array<string>, intercept array<double>, coef array<array<double>>, alpha double, spectrum array<double>, "
         "edges array<double>, mean array<double>, sd array<double>")


@dataclass
class StoredModel:
    """A ring model with the evidence per count of its training cells by octile of their total."""

    ring: RingModel
    edges: list[float] | None = None            # inner edges between the octiles
    mean: list[float | None] | None = None
    sd: list[float | None] | None = None


def centred_logs(n_genes: int):
    """Centred log counts of an array column `x`, one column per gene."""
    logs = F.transform("x", lambda v: F.ln(v + F.lit(PSEUDO)))
    middle = F.aggregate(logs, F.lit(0.0), lambda s, v: s + v) / n_genes
    return [F.get(logs, g) - middle for g in range(n_genes)]


def model_from_phases(cells: DataFrame, genes: list[str], alpha: float | None = None) -> RingModel:
    """Intercepts and harmonics of the centred log counts at given phases, in one aggregate.

    cells(x array<double>, theta_deg). The closed-form start of a fit whose cells already have
    phases; cells without one are left out.
    """
    z = centred_logs(len(genes))
    t = F.radians("theta_deg")
    waves = [f(t * k) for k in range(1, HARMONICS + 1) for f in (F.cos, F.sin)]
    aggs = [F.avg(v).alias(f"a{g}") for g, v in enumerate(z)]
    aggs += [(F.avg(v * w) * 2).alias(f"c{g}_{j}") for g, v in enumerate(z) for j, w in enumerate(waves)]
    row = cells.where("theta_deg is not null").agg(*aggs).first()
    if row["a0"] is None:
        raise ValueError("no cell has a phase")
    n = len(genes)
    return RingModel(list(genes), np.array([row[f"a{g}"] for g in range(n)]),
                     np.array([[row[f"c{g}_{j}"] for j in range(2 * HARMONICS)] for g in range(n)]), alpha)


def per_count(placed: DataFrame) -> DataFrame:
    return placed.withColumn("__fq", F.col("evidence") / F.greatest(F.col("total"), F.lit(1.0)))


def octile(edges: list[float]):
    return sum((F.when(F.col("total") >= F.lit(float(e)), 1).otherwise(0) for e in edges[1:]), F.when(F.col("total") >= F.lit(float(edges[0])), 1).otherwise(0))


def with_reference(model: RingModel, training: DataFrame) -> StoredModel:
    """The model with its training octiles; training is `place`d cells of the fit."""
    row = exact_quantiles(training, [], "total", {f"q{k}": k / OCTILES for k in range(1, OCTILES)}).first()
    if row is None or row["q1"] is None:
        raise ValueError("no training cells")
    edges = [float(row[f"q{k}"]) for k in range(1, OCTILES)]
    seen = {r["o"]: r for r in per_count(training).groupBy(octile(edges).alias("o")).agg(
        F.count("*").alias("n"), F.avg("__fq").alias("mean"), F.stddev_pop("__fq").alias("sd")).collect()}      # eight rows

    def told(name):
        return [float(seen[o][name]) if o in seen and seen[o]["n"] > LEAST_CELLS else None for o in range(OCTILES)]
    return StoredModel(model, edges, told("mean"), told("sd"))


def save_model(spark: SparkSession, model: StoredModel, root: str) -> int:
    """Write the model as the next version under `root`; earlier versions stay. Returns the version."""
    version = max(versions(spark, root), default=0) + 1
    r = model.ring
    row = (list(r.genes), [float(v) for v in r.intercept], [[float(v) for v in c] for c in r.coef], None if r.alpha is None else float(r.alpha),
           None if r.spectrum is None else [float(v) for v in r.spectrum], model.edges, model.mean, model.sd)
    spark.createDataFrame([row], MODEL).coalesce(1).write.mode("errorifexists").parquet(f"{root}/version={version}")
    return version


def versions(spark: SparkSession, root: str) -> list[int]:
    """Versions present under `root`, through the file system that holds it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    # a version counts once its writer has finished
    done = [n for n in names if n.startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in done)


def load_model(spark: SparkSession, root: str, version: int | None = None) -> StoredModel:
    known = versions(spark, root)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"no model version {version or ''} under {root}; there are {known}")
    r = spark.read.schema(MODEL).parquet(f"{root}/version={version or known[-1]}").first()
    ring = RingModel(list(r["genes"]), np.array(r["intercept"]), np.array(r["coef"]), r["alpha"],
                     spectrum=None if r["spectrum"] is None else np.array(r["spectrum"]))
    return StoredModel(ring, r["edges"], r["mean"], r["sd"])


def fit_z(placed: DataFrame, model: StoredModel) -> DataFrame:
    """Evidence per count against the training cells of the same octile; NULL where there were too few."""
    def of(values):
        return F.get(F.array(*[F.lit(v).cast("double") for v in values]), octile(model.edges))
    return per_count(placed).withColumn("fit_z", (F.col("__fq") - of(model.mean)) / (of(model.sd) + 1e-9)).drop("__fq")


def renamed(model: StoredModel, ring: RingModel) -> StoredModel:
    """The same reference under another frame of the ring (a rotation keeps every evidence)."""
    return replace(model, ring=ring)
