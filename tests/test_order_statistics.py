import numpy as np
import pandas as pd
import pytest

from chromaloom.operators import detection, stats


@pytest.fixture
def big(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.choice(["hot", "b", None], 60_000, p=[0.8, 0.15, 0.05]), "v": rng.normal(size=60_000).round(3)})
    pdf.loc[rng.choice(60_000, 500), "v"] = None
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("few", [True, False])
def test_exact_quantiles_on_groups_above_the_sketch(big, few):
    pdf, df = big
    got = {r["g"]: r for r in stats.exact_quantiles(df, ["g"], "v", {"a": 0.05, "m": 0.5, "z": 1.0}, few).collect()}
    for g in ("hot", "b", None):
        v = pdf[pdf.g.isna() if g is None else pdf.g == g].v.dropna()
        assert got[g]["n"] == len(v)
        for name, p in (("a", 0.05), ("m", 0.5), ("z", 1.0)):
            assert got[g][name] == pytest.approx(np.quantile(v, p), abs=1e-12)


def test_global_quantile(big):
    pdf, df = big
    assert stats.exact_quantiles(df, [], "v", {"q": 0.73}).first()["q"] == pytest.approx(np.quantile(pdf.v.dropna(), 0.73), abs=1e-12)


def test_hot_groups_leave_the_in_memory_path(big, monkeypatch):
    pdf, df = big
    monkeypatch.setattr(stats, "HOT_GROUP", 20_000)
    df = df.where("g is not null")
    got = {r["g"]: r["m"] for r in stats.group_quantiles(df, ["g"], "v", {"m": 0.5}, df.groupBy("g").count().withColumnRenamed("count", "n")).collect()}
    for g in ("hot", "b"):
        assert got[g] == pytest.approx(pdf[pdf.g == g].v.median(), abs=1e-12)


def test_ordered_index_is_the_global_order(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 20_000), "x": rng.integers(0, 500, 20_000), "id": range(20_000)})
    out = stats.ordered_index(spark.createDataFrame(pdf), ["x", "id"], ["k"]).toPandas().sort_values("id")
    want = pdf.sort_values(["k", "x", "id"]).groupby("k").cumcount().sort_index()
    assert (out.idx.to_numpy() == want.to_numpy()).all()


@pytest.mark.parametrize("down", [False, True])
def test_running_totals(spark, down):
    pdf = pd.DataFrame({"s": np.random.default_rng(3).permutation(5_000) / 7.0, "n": 1})
    pdf["w"] = (pdf.s * 7 % 5).round()
    out = stats.running_totals(spark.createDataFrame(pdf), "s", {"c": "n", "t": "w"}, down).toPandas().sort_values("s", ascending=not down)
    assert (out.c.to_numpy() == np.arange(1, 5001)).all()
    assert np.allclose(out.t.to_numpy(), out.w.cumsum().to_numpy())


def test_bh_fdr_passes_missing_through(spark):
    p = [0.01, 0.04, 0.03, None, 0.5, 0.04]
    out = detection.bh_fdr(spark.createDataFrame([(k, v) for k, v in enumerate(p)], "id int, p double")).toPandas().sort_values("id")
    known = np.array([v for v in p if v is not None])
    order = np.argsort(known)
    raw = np.minimum.accumulate((known[order] * 5 / np.arange(1, 6))[::-1])[::-1]
    want = np.empty(5)
    want[order] = raw
    assert np.isnan(out.q.iloc[3])
    assert np.allclose(out.q.drop(out.index[3]).to_numpy(), want)
