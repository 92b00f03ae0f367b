"""Mixing against a direct computation of weights and permutations."""

import math

import pytest
from pyspark.sql import functions as F

from chromaloom.llm import mixing

SCHEMA = "doc_id long, source string, text string, tokens string"


def corpus(spark):
    rows, k = [], 0
    for source, n in (("a", 400), ("b", 90), ("c", 20), (None, 45), ("empty", 3)):
        for i in range(n):
            k += 1
            rows.append((k, source, None if source == "empty" and i else "" if source == "empty" else " ".join(["w"] * (1 + (i * 7) % 23)), "x"))
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_tokens(spark):
    texts = ["", None, " ", "a", " a", "a ", " a b\t\nc ", "é\xa0b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [r.n for r in df.orderBy("i").select(mixing.n_tokens().alias("n")).collect()]
    assert got == [0, 0, 0, 1, 1, 1, 3, 1]


@pytest.mark.parametrize("kind,target", [("repetition", 2.0), ("repetition", 1.0), ("repetition", 50.0), ("entropy", 0.9), ("entropy", 0.1)])
def test_weights(spark, kind, target):
    sizes = {"a": 5000, "b": 900, "c": 200, None: 450, "none": 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, tokens long")
    got = {r.source: r for r in mixing.source_weights(df, **{kind: target}).collect()}
    live = {s: n for s, n in sizes.items() if n}
    total = sum(live.values())
    p = {s: n / total for s, n in live.items()}

    def at(a):
        z = sum(x ** a for x in p.values())
        return {s: x ** a / z for s, x in p.items()}
    lo, hi = 0.0, 1.0
    for _ in range(60):
        a = (lo + hi) / 2
        q = at(a)
        if kind == "entropy":
            ok = -sum(x * math.log(x) for x in q.values()) >= target * math.log(len(q))
            lo, hi = (a, hi) if ok else (lo, a)
        else:
            e = [q[s] / p[s] for s in q]
            ok = max(e) <= target * min(e) * (1 + 1e-12)
            lo, hi = (lo, a) if ok else (a, hi)
    q = at(lo if kind == "entropy" else hi)
    for s in live:
        assert got[s].weight == pytest.approx(q[s], abs=1e-5)
    assert got["none"].weight == 0 and got["none"].epochs == 0
    assert min(got[s].epochs for s in live) == pytest.approx(1.0)


def brute_repeats(spark, rows, weights, budget):
    """Sort every source by place and cut at the budget."""
    df = spark.createDataFrame(rows, SCHEMA).select("doc_id", "source", F.xxhash64("doc_id", "text").alias("__doc"), mixing.n_tokens().alias("t"))
    out = {}
    by = {}
    for s, w in weights.items():
        epochs = w.epochs if budget is None else (w.weight * budget / w.tokens if w.tokens else 0.0)
        full = math.floor(epochs + 1e-9)
        left = math.floor(max(epochs - full, 0.0) * w.tokens + 1e-6)
        by[s] = (max(full, 1) if budget is None else full, left)
    full_of = spark.createDataFrame([(s, f) for s, (f, _) in by.items()], "s string, full long")
    placed = df.join(full_of, df["source"].eqNullSafe(full_of["s"])).withColumn("at", mixing.place("source", "__doc", "full", mixing.SEED)).collect()
    for s, (full, left) in by.items():
        used, open_ = 0, left > 0
        for r in sorted((r for r in placed if r.source == s), key=lambda r: (r["at"], r["__doc"])):
            used += r.t
            open_ = open_ and used <= left
            out[r.doc_id] = full + (1 if open_ else 0)
    return out


@pytest.mark.parametrize("budget", [None, 3000.0, 20000.0])
def test_repeats(spark, budget):
    rows, df = corpus(spark)
    got = mixing.mix(df, repetition=1.7, budget_tokens=budget).collect()
    assert len(got) == len(rows)
    sizes = df.groupBy("source").agg(F.sum(mixing.n_tokens()).alias("tokens"))
    weights = {r.source: r for r in mixing.source_weights(sizes, repetition=1.7).collect()}
    assert {r.doc_id: r.repeats for r in got} == brute_repeats(spark, rows, weights, budget)
    if budget:
        for s, w in weights.items():
            used = sum(r.repeats * r.tokens for r in got if r.source == s)
            assert w.weight * budget - 24 < used <= w.weight * budget + 1e-6


def test_stage_and_empty(spark):
    rows, df = corpus(spark)
    out = mixing.apply_mix(df, repetition=1.25)
    assert out.columns == df.columns
    n = out.groupBy("doc_id").count().collect()
    assert len(n) == len(rows) and {r["count"] for r in n} == {1, 2}
    assert mixing.mix(df.limit(0), repetition=2.0).count() == 0 and mixing.apply_mix(df.limit(0), repetition=2.0).count() == 0
    with pytest.raises(ValueError):
        mixing.source_weights(df.groupBy("source").agg(F.lit(1).alias("tokens")))
