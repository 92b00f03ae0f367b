"""Detection matrix statistics: co-occurrence, FDR, and the quality null."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaloom.session import cut

from .stats import running, running_totals

NODES = 25          # fixed number of quadrature nodes
PRIOR_SIGMA = 10.0  # fixed prior width of the bin effects


def cooccurrence(polymer: DataFrame) -> DataFrame:
    """(bin_i <= bin_j, observed): alleles carrying both bins.

    Bins of one allele are bounded by the axis, so the list per allele and its
    pairs are too; counts combine before the only pixel-wise shuffle.
    """
    per = polymer.groupBy("allele_id").agg(F.collect_set("slot").alias("slots"))
    return per.select(F.explode("slots").alias("bin_i"), "slots").select(
        "bin_i", F.explode("slots").alias("bin_j")).where("bin_i <= bin_j").groupBy("bin_i", "bin_j").agg(
        F.count(F.lit(1)).alias("observed"))


def bh_fdr(tests: DataFrame, p: str = "p", q: str = "q") -> DataFrame:
    """Benjamini-Hochberg q-values; NULL p passes through as NULL.

    Equal p-values share a rank group, so the step-up minimum runs over distinct
    values; positions come from range buckets, not from one global window.
    """
    scored = tests.where(F.col(p).isNotNull() & ~F.isnan(p))
    distinct = scored.groupBy(F.col(p).alias("__p")).agg(F.count(F.lit(1)).alias("__c"))
    upto = running_totals(distinct, "__p", {"__rank": "__c"})
    total = scored.agg(F.count(F.lit(1)).alias("__m")).first()["__m"]
    if not total:
        return tests.withColumn(q, F.lit(None).cast("double"))
    upto = upto.withColumn("__raw", F.col("__p") * F.lit(float(total)) / F.col("__rank"))
    steps = running(upto, "__p", {"__q": "__raw"}, descending=True, how="min")
    picked = steps.select("__p", F.least(F.col("__q"), F.lit(1.0)).alias(q))
    return tests.join(picked, tests[p] == picked["__p"], "left").drop("__p")


def detection_patterns(alleles: DataFrame, polymer: DataFrame, n_slots: int) -> DataFrame:
    """(pattern, n): alleles grouped by which slots they carry; slots is a 0/1 string."""
    per = polymer.groupBy("allele_id").agg(F.collect_set("slot").alias("slots"))
    bits = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n_slots - 1)), lambda k: F.when(
        F.array_contains(F.coalesce(F.col("slots"), F.array().cast("array<int>")), k), "1").otherwise("0")), "")
    return alleles.select("allele_id").join(per, "allele_id", "left").groupBy(bits.alias("pattern")).agg(
        F.count(F.lit(1)).alias("n"))


def _nodes(n: int = NODES):
    x, w = np.polynomial.hermite_e.hermegauss(n)
    return x, np.log(w / w.sum())


def _log_posterior(bits: np.ndarray, b: np.ndarray, u: np.ndarray, logw: np.ndarray):
    ll = logw[None, :] + (bits @ b)[:, None] + bits.sum(1)[:, None] * u[None, :]
    ll -= np.logaddexp(0.0, b[None, :] + u[:, None]).sum(1)[None, :]
    norm = np.logaddexp.reduce(ll, axis=1)
    return np.exp(ll - norm[:, None]), norm


def _bits(patterns: pd.Series) -> np.ndarray:
    return np.array([[c == "1" for c in p] for p in patterns], float)


@dataclass
class QualityModel:
    b: np.ndarray
    tau: float
    loglik: float


def quality_sums(patterns: DataFrame, b, tau: float, n_slots: int) -> np.ndarray:
    """(nodes x (1 + slots)) expected counts and hits, plus the log-likelihood, over all alleles.

    Every task reduces its patterns to one block of (nodes x slots) numbers.
    """
    x, logw = _nodes()
    b = np.asarray(b, float)

    def block(batches):
        hits, weight, ll = np.zeros((len(x), n_slots)), np.zeros(len(x)), 0.0
        for pdf in batches:
            bits, n = _bits(pdf["pattern"]), pdf["n"].to_numpy(float)
            q, norm = _log_posterior(bits, b, x * tau, logw)
            q = q * n[:, None]
            hits += q.T @ bits
            weight += q.sum(0)
            ll += float((norm * n).sum())
        rows = [(k, j - 1, float(weight[k] if j == 0 else hits[k, j - 1])) for k in range(len(x)) for j in range(n_slots + 1)]
        yield pd.DataFrame(rows + [(-1, -1, ll)], columns=["node", "slot", "v"])

    sums = patterns.mapInPandas(block, "node int, slot int, v double").groupBy("node", "slot").agg(F.sum("v").alias("v"))
    out = np.zeros((len(x) + 1, n_slots + 1))
    for row in sums.collect():       # (nodes + 1) x (slots + 1) numbers
        out[row["node"], row["slot"] + 1] = row["v"]
    return out


def fit_quality_model(patterns: DataFrame, n_slots: int, max_iter: int = 60, tol: float = 1e-6) -> QualityModel:
    """EM for P(bin j seen | u) = sigmoid(b_j + u), u ~ N(0, tau^2).

    The expectation is one distributed pass; the maximisation works on the
    (nodes x slots) sums only, with Newton steps on b and tau.
    """
    x, _ = _nodes()
    b, tau, last = np.zeros(n_slots), 1.0, -np.inf
    for _step in range(max_iter):
        sums = quality_sums(patterns, b, tau, n_slots)
        weight, hits, ll = sums[:-1, 0], sums[:-1, 1:], sums[-1, 0] - (b**2).sum() / (2 * PRIOR_SIGMA**2)
        if abs(ll - last) < tol * max(1.0, abs(ll)):
            break
        last = ll
        for _inner in range(25):
            p = 1.0 / (1.0 + np.exp(-np.clip(b[None, :] + (x * tau)[:, None], -500, 500)))
            resid, curve = hits - weight[:, None] * p, weight[:, None] * p * (1 - p)
            grad = np.append(resid.sum(0) - b / PRIOR_SIGMA**2, (resid * x[:, None]).sum())
            hess = np.zeros((n_slots + 1, n_slots + 1))
            hess[np.arange(n_slots), np.arange(n_slots)] = curve.sum(0) + 1 / PRIOR_SIGMA**2
            hess[:n_slots, -1] = hess[-1, :n_slots] = (curve * x[:, None]).sum(0)
            hess[-1, -1] = (curve * (x**2)[:, None]).sum() + 1e-9
            step = np.linalg.solve(hess, grad)
            b, tau = b + step[:-1], max(tau + step[-1], 1e-4)
            if np.abs(step).max() < 1e-8:
                break
    return QualityModel(b, float(tau), float(last))


def margin_model(patterns: DataFrame, n_slots: int, tau: float) -> QualityModel:
    """The null with a stated spread and bin effects from the bins' own efficacies, in one aggregate."""
    hits = [F.sum(F.when(F.substring("pattern", k + 1, 1) == "1", F.col("n")).otherwise(0)).alias(f"h{k}") for k in range(n_slots)]
    row = patterns.agg(F.sum("n").alias("n"), *hits).first()
    if not row["n"]:
        raise ValueError("no alleles")
    e = (np.array([row[f"h{k}"] for k in range(n_slots)], float) + 0.5) / (row["n"] + 1.0)
    return QualityModel(np.log(e / (1 - e)), float(tau), float("nan"))


def with_normal_tail(table: DataFrame, z: str = "z", p: str = "p") -> DataFrame:
    """One-sided normal tail of a z column; for the few rows a slot-by-slot table has."""
    @F.pandas_udf("double")
    def tail(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if pd.isna(x) else 0.5 * math.erfc(x / math.sqrt(2.0)))
    return table.withColumn(p, tail(F.col(z)))


def posterior_efficiency(patterns: DataFrame, model: QualityModel, n_slots: int) -> DataFrame:
    """(pattern, n, u_mean, u_sd, predicted): posterior efficiency and null probabilities per slot."""
    x, logw = _nodes()
    b, tau = model.b, model.tau

    def score(batches):
        u = x * tau
        s = 1.0 / (1.0 + np.exp(-np.clip(b[None, :] + u[:, None], -500, 500)))
        for pdf in batches:
            q, _norm = _log_posterior(_bits(pdf["pattern"]), b, u, logw)
            mean = q @ u
            sd = np.sqrt(np.maximum((q * (u[None, :] - mean[:, None]) ** 2).sum(1), 0.0))
            yield pdf.assign(u_mean=mean, u_sd=sd, predicted=list(q @ s))

    return patterns.mapInPandas(score, "pattern string, n long, u_mean double, u_sd double, predicted array<double>")


def cooccurrence_z(observed: DataFrame, patterns: DataFrame, model: QualityModel, n_slots: int) -> DataFrame:
    """Per pixel: expected pairs under the null, z and ratio.

    Expectation and variance need the node weights and the node-by-node second
    moments of the posteriors; both are sums over tasks with bounded size.
    """
    x, logw = _nodes()
    b, tau = model.b, model.tau

    def moments(batches):
        m, w = np.zeros((len(x), len(x))), np.zeros(len(x))
        for pdf in batches:
            q, _norm = _log_posterior(_bits(pdf["pattern"]), b, x * tau, logw)
            n = pdf["n"].to_numpy(float)
            m += (q * n[:, None]).T @ q
            w += (q * n[:, None]).sum(0)
        rows = [(k, l, float(m[k, l])) for k in range(len(x)) for l in range(len(x))]
        yield pd.DataFrame(rows + [(k, -1, float(w[k])) for k in range(len(x))], columns=["k", "l", "v"])

    spark = observed.sparkSession
    m, w = np.zeros((len(x), len(x))), np.zeros(len(x))
    for row in patterns.mapInPandas(moments, "k int, l int, v double").groupBy("k", "l").agg(F.sum("v").alias("v")).collect():
        if row["l"] < 0:
            w[row["k"]] = row["v"]
        else:
            m[row["k"], row["l"]] = row["v"]
    s = 1.0 / (1.0 + np.exp(-np.clip(b[None, :] + (x * tau)[:, None], -500, 500)))
    rows = []
    for i in range(n_slots):
        for j in range(i + 1, n_slots):
            pair = s[:, i] * s[:, j]
            expected = float(w @ pair)
            rows.append((i, j, expected, max(expected - float(pair @ m @ pair), 1e-12)))
    null = spark.createDataFrame(rows, "bin_i int, bin_j int, expected double, variance double")
    # one row per pair of slots: a pair never seen together counts as observed 0
    both = F.broadcast(null).join(observed, ["bin_i", "bin_j"], "left").withColumn("observed", F.coalesce("observed", F.lit(0)))
    return with_normal_tail(both.select(
        "bin_i", "bin_j", "observed", "expected",
        ((F.col("observed") - F.col("expected")) / F.sqrt("variance")).alias("z"),
        ((F.col("observed") + 1e-9) / (F.col("expected") + 1e-9)).alias("ratio")))


def count_dispersion(patterns: DataFrame, model: QualityModel) -> DataFrame:
    """(ratio, p, var_obs, var_model): observed over expected variance of the per-allele counts.

    p is the upper tail of the sample variance under the null: its expectation is the variance of
    one allele's count and its own variance follows from that count's fourth moment, both from the
    exact distribution (a convolution over the bins), so no resampling is needed. NULL below two alleles.
    """
    x, logw = _nodes()
    s = 1.0 / (1.0 + np.exp(-np.clip(model.b[None, :] + (x * model.tau)[:, None], -500, 500)))
    pmf = np.zeros(len(model.b) + 1)
    for wk, seen in zip(np.exp(logw), s, strict=True):
        dist = np.array([1.0])
        for pj in seen:
            dist = np.convolve(dist, [1 - pj, pj])
        pmf += wk * dist
    k = np.arange(len(pmf)) - pmf @ np.arange(len(pmf))
    var_model, fourth = float(pmf @ k**2), float(pmf @ k**4)
    size = F.length(F.replace(F.col("pattern"), F.lit("0"), F.lit(""))).cast("double")
    n = F.col("n").cast("double")
    obs = patterns.agg(F.sum(n).alias("a"), F.sum(n * size).alias("s1"), F.sum(n * size * size).alias("s2"))
    a = F.col("a")
    obs = obs.where(a > 1).withColumn("var_obs", (F.col("s2") - F.col("s1") * F.col("s1") / a) / (a - 1))
    spread = F.sqrt((F.lit(fourth) - F.lit(var_model**2) * (a - 3) / (a - 1)) / a)
    return with_normal_tail(obs.withColumn("z", (F.col("var_obs") - F.lit(var_model)) / spread)).select(
        (F.col("var_obs") / F.lit(max(var_model, 1e-12))).alias("ratio"), "p", "var_obs", F.lit(var_model).alias("var_model"))


TRADE_BLOCK = 4000   # alleles that trade together within an epoch
EPOCHS, BURN = 5, 5  # times the alleles are dealt anew, and sweeps before an epoch's first sample


def count_null(alleles: DataFrame, polymer: DataFrame, n_slots: int, n_samples: int = 200, seed: int = 0, block: int = TRADE_BLOCK) -> DataFrame:
    """(bin_i, bin_j, observed, expected, variance, z, p): co-detection against shuffles that keep
    every allele's count and every bin's efficacy.

    Alleles trade in blocks of about `block`, dealt anew by hash in every epoch, so rows of any two
    alleles can meet and only the margins of the whole table are kept, whatever its size. The
    samples of an epoch are totals over all blocks, so expectation and variance are those of the
    whole table and do not depend on the number of blocks. A task holds one block at a time and
    the running totals (samples of an epoch x slots x slots); the axis may have any length.
    """
    per = polymer.groupBy("allele_id").agg(F.collect_set(F.col("slot").cast("int")).alias("slots"))
    hit = F.transform(F.sequence(F.lit(0), F.lit(n_slots - 1)), lambda j: F.coalesce(F.array_contains("slots", j), F.lit(False)).cast("int").cast("string"))
    state = cut(alleles.select("allele_id").join(per, "allele_id", "left").select(
        F.col("allele_id").cast("long").alias("allele_id"), F.array_join(hit, "").alias("pattern")))
    n_blocks = max(1, -(-state.count() // block))
    share = [n_samples // EPOCHS + (e < n_samples % EPOCHS) for e in range(EPOCHS)]
    totals = None

    def epoch(number: int, wanted: int):
        def trade(batches):
            sums = np.zeros((wanted, n_slots, n_slots))

            def run(key: int, held: list[pd.DataFrame]):
                rng = np.random.default_rng([seed, number, key])
                own = pd.concat(held).sort_values("allele_id")
                # a row per slot, so that a step below runs over all pairs
                bits = np.ascontiguousarray((np.frombuffer("".join(own["pattern"]).encode(), np.uint8).reshape(-1, n_slots) == ord("1")).T)
                for sweep in range(BURN + wanted):
                    # all pairs of one random matching trade at once: their rows are disjoint
                    at = rng.permutation(bits.shape[1])
                    half = len(at) // 2
                    a, b = at[:half], at[half: 2 * half]
                    mine, yours = bits[:, a], bits[:, b]
                    differ, lot = mine ^ yours, rng.random((n_slots, half))
                    left, need = differ.sum(0), (mine & differ).sum(0)
                    # as many of the differing slots as a had, every choice as likely: slot by slot
                    for j in range(n_slots):
                        take = differ[j] & (lot[j] * left < need)
                        left -= differ[j]
                        need -= take
                        bits[j, a], bits[j, b] = np.where(differ[j], take, mine[j]), np.where(differ[j], ~take, yours[j])
                    if sweep >= BURN:
                        table = bits.astype(np.float64)
                        sums[sweep - BURN] += table @ table.T
                told = np.ascontiguousarray(bits.T.astype(np.uint8) + ord("0")).view(f"S{n_slots}").ravel().astype(str)
                return pd.DataFrame({"sample": -1, "i": -1, "c": None, "allele_id": own["allele_id"].to_numpy(), "pattern": told})

            held, key = [], None
            for pdf in batches:
                for k, part in pdf.groupby("block", sort=True):
                    if held and k != key:
                        yield run(key, held)
                        held = []
                    key = int(k)
                    held.append(part)
            if held:
                yield run(key, held)
            flat = [(j, i, sums[j, i].tolist(), None, None) for j in range(wanted) for i in range(n_slots)]
            yield pd.DataFrame(flat, columns=["sample", "i", "c", "allele_id", "pattern"])
        return trade

    for number, wanted in enumerate(share):
        dealt = state.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), F.lit(number), "allele_id"), F.lit(n_blocks)).cast("int"))
        out = cut(dealt.repartition("block").sortWithinPartitions("block").mapInPandas(
            epoch(number, wanted), "sample int, i int, c array<double>, allele_id long, pattern string"))
        state = out.where("sample < 0").select("allele_id", "pattern")
        sums = out.where("sample >= 0").select((F.col("sample") + sum(share[:number])).alias("sample"), F.col("i").alias("bin_i"), F.posexplode("c").alias("bin_j", "c"))
        totals = sums if totals is None else totals.unionByName(sums)
    per_sample = totals.where("bin_i < bin_j").groupBy("sample", "bin_i", "bin_j").agg(F.sum("c").alias("c"))
    null = per_sample.groupBy("bin_i", "bin_j").agg(F.avg("c").alias("expected"), F.var_pop("c").alias("variance"))
    seen = cooccurrence(polymer.join(alleles.select("allele_id"), "allele_id", "left_semi")).where("bin_i < bin_j")
    both = null.join(seen, ["bin_i", "bin_j"], "left").withColumn("observed", F.coalesce("observed", F.lit(0)).cast("double"))
    z = (F.col("observed") - F.col("expected")) / F.sqrt(F.greatest(F.col("variance"), F.lit(1e-12)))
    return with_normal_tail(both.select("bin_i", "bin_j", "observed", "expected", "variance", z.alias("z")))
