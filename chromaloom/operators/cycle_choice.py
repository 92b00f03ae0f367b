"""Choices around a ring model: dispersion by cross-validation, genes by backward elimination.

Every (concentration, fold) is a fit of its own, but all of them share each pass over the
cells: a task returns the sums of every fit that still runs, keyed by the fit's number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cycle_model import GRID, HARMONICS, PSEUDO, RingModel, _grid, _matrix, _posterior, _times, _weight, maximise, profiles, smooth_circle
from .stats import weighted_quantiles

ALPHAS = (10.0, 30.0, 100.0, 300.0, None)


def fov_fold(folds: int, seed: int = 0) -> Column:
    """Fold of a cell: its whole field is held out together."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col("fov")), F.lit(folds)).cast("int")


def _sums(cells: DataFrame, n_genes: int, rules: dict) -> dict:
    """Per fit: (S (T,G), N (T,), spectrum (T,)) in one pass. rules[fit] = (fold or None, q_of)."""
    def block(batches):
        total = {j: np.zeros((GRID, n_genes + 2)) for j in rules}
        for pdf in batches:
            x, fold, times = _matrix(pdf), pdf["fold"].to_numpy(), _times(pdf)
            for j, (held, q_of) in rules.items():
                kept = slice(None) if held is None else fold != held
                own, n = x[kept], times[kept]
                if len(own):
                    q, weight = q_of(own)
                    weight = weight * n
                    total[j] += np.column_stack([(q * weight[:, None]).T @ own, (q * (weight * own.sum(1))[:, None]).sum(0), n @ q])
        yield pd.DataFrame([(j, t, v.tolist()) for j, s in total.items() for t, v in enumerate(s)], columns=["fit", "t", "v"])

    rows = cells.mapInPandas(block, "fit int, t int, v array<double>")
    cols = [F.sum(F.get("v", g)).alias(f"v{g}") for g in range(n_genes + 2)]
    out = {j: np.zeros((GRID, n_genes + 2)) for j in rules}
    for r in rows.groupBy("fit", "t").agg(*cols).collect():               # fits x GRID rows
        out[r["fit"]][r["t"]] = [r[f"v{g}"] for g in range(n_genes + 2)]
    return {j: (s[:, :n_genes], s[:, n_genes], s[:, n_genes + 1]) for j, s in out.items()}


def _start_planes(cells: DataFrame, n_genes: int, folds: int) -> dict:
    """Per fold: mean, scale and principal plane of the centred log counts of the other folds."""
    def block(batches):
        acc: dict[int, np.ndarray] = {}
        for pdf in batches:
            z = np.log(_matrix(pdf) + PSEUDO)
            z -= z.mean(1, keepdims=True)
            one = np.column_stack([np.ones(len(z)), z])
            fold, times = pdf["fold"].to_numpy(), _times(pdf)
            for f in np.unique(fold):
                part = one[fold == f]
                acc[int(f)] = acc.get(int(f), 0) + (part * times[fold == f][:, None]).T @ part
        yield pd.DataFrame([(f, i, v.tolist()) for f, m in acc.items() for i, v in enumerate(m)], columns=["fold", "i", "v"])

    moment = np.zeros((folds, n_genes + 1, n_genes + 1))
    cols = [F.sum(F.get("v", g)).alias(f"v{g}") for g in range(n_genes + 1)]
    for r in cells.mapInPandas(block, "fold int, i int, v array<double>").groupBy("fold", "i").agg(*cols).collect():
        moment[r["fold"], r["i"]] = [r[f"v{g}"] for g in range(n_genes + 1)]
    out = {}
    for f in range(folds):
        m = moment.sum(0) - moment[f]
        n = max(m[0, 0], 1.0)
        mean = m[0, 1:] / n
        cov = m[1:, 1:] / n - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov), 0.0)) + 1e-9
        values, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
        plane = vectors[:, np.argsort(values)[::-1][:2]]
        out[f] = mean, sd, plane * np.sign(plane[np.abs(plane).argmax(0), [0, 1]]), m[0, 0]
    return out


def cross_fits(cells: DataFrame, genes: list[str], alphas=ALPHAS, folds: int = 3, iters: int = 20, tol: float = 1e-4) -> dict:
    """{(alpha, fold): RingModel} fitted on the cells outside the fold; cells(fov, x, fold) or their
    `profiles` by fold.

    One pass over the count vectors per EM iteration serves all fits; a settled fit leaves the passes.
    """
    cells = profiles(cells, "fold")
    g, grid = len(genes), _grid()
    planes = _start_planes(cells, g, folds)
    keys = [(a, f) for a in alphas for f in range(folds)]

    def starter(alpha, f):
        mean, sd, plane, _n = planes[f]

        def start(x):
            z = np.log(x + PSEUDO)
            z = (z - z.mean(1, keepdims=True) - mean) / sd @ plane
            q = np.exp(4 * np.cos(grid[None, :] - np.arctan2(z[:, 1], z[:, 0])[:, None]))
            return q / q.sum(1, keepdims=True), _weight(x, alpha)
        return start

    def expecter(model):
        prior = np.log(model.spectrum + 1e-300)
        return lambda x: (_posterior(model.loglik(x), prior)[0], _weight(x, model.alpha))

    models = {j: RingModel(list(genes), np.zeros(g), np.zeros((g, 2 * HARMONICS)), a) for j, (a, _f) in enumerate(keys)}
    sums = _sums(cells, g, {j: (f, starter(a, f)) for j, (a, f) in enumerate(keys)})
    running = set(models)
    for step in range(iters):
        for j in sorted(running):
            s, n, w = sums[j]
            old = models[j]
            models[j] = maximise(old, s, n)
            models[j].spectrum = smooth_circle(w)
            moved = max(np.abs(models[j].coef - old.coef).max(), np.abs(models[j].intercept - old.intercept).max())
            if step and moved < tol:
                running.discard(j)
        if not running or step + 1 == iters:
            break
        sums = _sums(cells, g, {j: (keys[j][1], expecter(models[j])) for j in running})
    return {key: models[j] for j, key in enumerate(keys)}


def choose_alpha(cells: DataFrame, genes: list[str], alphas=ALPHAS, folds: int = 3, iters: int = 20, seed: int = 0) -> DataFrame:
    """(alpha, score, n_cells, chosen): mean held-out evidence per concentration, NULL the multinomial.

    cells(fov, cell, x). Folds are whole fields; a cell is scored by the fits that did not see its
    field, under a uniform prior. The score is the mean over folds of the mean over cells.
    """
    kept = profiles(cells.select("x", fov_fold(folds, seed).alias("fold")), "fold")
    models = cross_fits(kept, genes, alphas, folds, iters)
    order = list(alphas)

    def score(batches):
        for pdf in batches:
            x, fold, times = _matrix(pdf), pdf["fold"].to_numpy(), _times(pdf)
            rows = []
            for f in np.unique(fold):
                own, n = x[fold == f], times[fold == f]
                for k, a in enumerate(order):
                    m = models[a, int(f)]
                    ev = _posterior(m.loglik(own), np.full(GRID, -np.log(GRID)))[1] + m.evidence_const(own)
                    rows.append((int(f), k, float(n @ ev), int(n.sum())))
            yield pd.DataFrame(rows, columns=["fold", "k", "s", "n"])

    per = kept.mapInPandas(score, "fold int, k int, s double, n long").groupBy("fold", "k").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    out = per.groupBy("k").agg(F.avg(F.col("s") / F.col("n")).alias("score"), F.sum("n").alias("n_cells"))
    rows = sorted(out.collect(), key=lambda r: r["k"])                    # one row per concentration
    best = max((r["score"] for r in rows), default=None)
    told = [(order[r["k"]], float(r["score"]), r["n_cells"], r["score"] == best) for r in rows]
    return cells.sparkSession.createDataFrame(told, "alpha double, score double, n_cells long, chosen boolean")


def _phases(ll: np.ndarray) -> np.ndarray:
    q = np.exp(ll - ll.max(1, keepdims=True))
    return (q / q.sum(1, keepdims=True)) @ np.exp(1j * _grid())


def drop_shifts(cells: DataFrame, model: RingModel, kept: list[int]) -> DataFrame:
    """(gene, n, err_deg, mean_R): how far phases move when one more of the kept genes is left out.

    cells(x) or their `profiles`. The placement is the multinomial one under a uniform prior, over the genes that
    stay. A cell's grid sums over the kept genes are made once; leaving out gene h takes its own
    term and its share of the composition away again, so one pass serves all candidates. Moves
    are against the placement with all genes of the model; err_deg is their exact median. A cell
    without a count in the genes that stay has no phase and is not judged.
    """
    lp = model.log_pi()
    pi = np.exp(lp)
    names = [model.genes[g] for g in kept]

    def score(batches):
        for pdf in batches:
            x, times = _matrix(pdf), pdf["times"].to_numpy()
            full = _phases(x @ lp.T)
            base, counts, share = x[:, kept] @ lp[:, kept].T, x[:, kept].sum(1), pi[:, kept].sum(1)
            for name, h in zip(names, kept, strict=True):
                without = base - np.outer(x[:, h], lp[:, h]) - np.outer(counts - x[:, h], np.log(share - pi[:, h]))
                z, told = _phases(without), counts > x[:, h]
                yield pd.DataFrame({"gene": name, "err": np.degrees(np.abs(np.angle(z * np.conj(full))))[told], "R": np.abs(z)[told], "times": times[told]})

    rows = profiles(cells).mapInPandas(score, "gene string, err double, R double, times long")
    errors = weighted_quantiles(rows, ["gene"], "err", "times", {"err_deg": 0.5})
    mean = rows.groupBy("gene").agg((F.sum(F.col("R") * F.col("times")) / F.sum("times")).alias("mean_R"))
    return errors.join(F.broadcast(mean), "gene")                          # one row per gene on either side


def backward_elimination(cells: DataFrame, model: RingModel, least: int = 2) -> list[dict]:
    """Drop order: the gene whose loss moves the phases least goes first, ties to panel order.

    One pass over the count vectors per dropped gene; only the per-gene medians reach the driver.
    """
    cells = profiles(cells)
    kept, steps = list(range(len(model.genes))), []
    while len(kept) > least:
        found = {r["gene"]: r for r in drop_shifts(cells, model, kept).collect()}
        if not found:
            break
        h = min(kept, key=lambda g: (found[model.genes[g]]["err_deg"], g))
        r = found[model.genes[h]]
        kept.remove(h)
        steps.append({"step": len(steps) + 1, "dropped": model.genes[h], "n_genes": len(kept), "err_deg": r["err_deg"], "mean_R": r["mean_R"]})
    return steps
