"""Ring models: store, frames, dispersion choice and elimination."""

import numpy as np
import pytest

from chromaloom.operators import cycle_choice as CC
from chromaloom.operators import cycle_frame as CF
from chromaloom.operators import cycle_model as CM
from chromaloom.operators import cycle_store as CS

GENES = [f"g{i}" for i in range(6)]
CELLS = "fov int, cell long, x array<double>, theta_deg double"


def simulated(n, seed, alpha=None, total=(60, 300)):
    rng = np.random.default_rng(seed)
    coef = np.column_stack([rng.normal(0, 1.0, (6, 2)), rng.normal(0, 0.3, (6, 2))])
    a, theta = rng.normal(0, 0.5, 6), rng.uniform(0, 2 * np.pi, n)
    basis = np.column_stack([f(k * theta) for k in (1, 2) for f in (np.cos, np.sin)])
    pi = np.exp(basis @ coef.T + a)
    pi /= pi.sum(1, keepdims=True)
    if alpha:
        pi = np.stack([rng.dirichlet(alpha * p) for p in pi])
    x = np.stack([rng.multinomial(int(s), p) for s, p in zip(rng.integers(*total, n), pi)]).astype(float)
    return x, theta, coef, a


def frame(spark, x, theta, fovs=9):
    return spark.createDataFrame([(i % fovs, i, list(map(float, v)), float(np.degrees(t))) for i, (v, t) in enumerate(zip(x, theta))], CELLS)


@pytest.fixture(scope="module")
def sample(spark):
    x, theta, coef, a = simulated(900, 1)
    df = frame(spark, x, theta).cache()
    return df, x, theta, CS.model_from_phases(df, GENES)


def test_model_from_phases_places_cells_where_they_are(spark, sample):
    df, x, theta, model = sample
    placed = {r.cell: r.theta_deg for r in CM.place(df, model).collect()}
    gap = np.abs(np.angle(np.exp(1j * (np.radians([placed[i] for i in range(len(x))]) - theta))))
    assert np.degrees(np.median(gap)) < 10


def test_save_load_and_score(spark, sample, tmp_path):
    df, _, _, model = sample
    root = str(tmp_path / "rings")
    training = CM.place(df.where("fov < 5"), model)
    stored = CS.with_reference(model, training)
    assert CS.versions(spark, root) == [] and CS.save_model(spark, stored, root) == 1
    other = CS.renamed(stored, CF.rotate(model, 0.3))
    assert CS.save_model(spark, other, root) == 2 and CS.versions(spark, root) == [1, 2]
    one, two = CS.load_model(spark, root, 1), CS.load_model(spark, root)
    assert np.array_equal(one.ring.coef, model.coef) and np.array_equal(two.ring.coef, other.ring.coef)
    assert one.edges == stored.edges and one.mean == stored.mean and one.ring.alpha is None
    with pytest.raises(FileNotFoundError):
        CS.load_model(spark, root, 7)
    got = CS.fit_z(CM.place(df, one.ring), one)
    # the training cells are their own standard, and cells of other fields are measured by it
    z = np.array([(r.fov, r.fit_z) for r in got.collect()])
    assert abs(z[z[:, 0] < 5, 1].mean()) < 1e-6 and abs(z[z[:, 0] >= 5, 1].mean()) < 0.3
    # a rotation changes no evidence
    turned = {r.cell: r.fit_z for r in CS.fit_z(CM.place(df, two.ring), two).collect()}
    near = [abs(turned[r.cell] - r.fit_z) for r in got.collect()]
    assert np.median(near) < 0.05


def test_small_octiles_have_no_score(spark, sample):
    df, _, _, model = sample
    stored = CS.with_reference(model, CM.place(df.limit(20), model))
    assert stored.mean == [None] * 8
    assert CS.fit_z(CM.place(df, model), stored).where("fit_z is not null").count() == 0
    with pytest.raises(ValueError):
        CS.with_reference(model, CM.place(df.limit(0), model))
    with pytest.raises(ValueError):
        CS.model_from_phases(df.limit(0), GENES)


def test_orientation_by_roles(sample):
    model = sample[3]
    at = CF.peaks(model)
    order = sorted(GENES, key=at.get)
    early, late = order[:2], order[3:5]
    turned, shift, flip = CF.orient(CF.rotate(model, 1.1, True), early, late)
    mean = lambda m, g: np.degrees(np.angle(np.mean([np.exp(1j * CF.peaks(m)[k]) for k in g]))) % 360
    e, l = mean(turned, early), mean(turned, late)
    assert min(e, 360 - e) < 6 and 0 < l < 180
    with pytest.raises(ValueError):
        CF.orient(model, ["other"], late)


@pytest.mark.parametrize("flip", [False, True])
def test_rotation_moves_profiles_and_spectrum_together(sample, flip):
    model = sample[3]
    model.spectrum = np.arange(1, CM.GRID + 1) / 100.0
    model.spectrum = model.spectrum / model.spectrum.sum()
    steps = 7
    turned = CF.rotate(model, steps * 2 * np.pi / CM.GRID, flip)
    old = ((-1 if flip else 1) * np.arange(CM.GRID) + steps) % CM.GRID
    assert np.allclose(turned.log_pi(), model.log_pi()[old]) and np.allclose(turned.spectrum, model.spectrum[old])
    model.spectrum = None


def test_dna_sawtooth_tells_the_direction(spark):
    rng = np.random.default_rng(4)
    theta = rng.uniform(0, 360, 4000)
    dna = 1 + theta / 360 + rng.normal(0, 0.02, 4000)                 # climbs all the way round, halves at 0
    df = spark.createDataFrame([(float(t), float(v), float(-t % 360)) for t, v in zip(theta, dna)], "theta_deg double, dna double, mirrored double")
    ratio, n = CF.dna_direction(df, "dna")
    back, _ = CF.dna_direction(df.select(df.mirrored.alias("theta_deg"), "dna"), "dna")
    assert n == 4000 and ratio > 3 and back < 0.5
    assert CF.dna_direction(df.limit(50), "dna") == (None, 50)
    model = CM.RingModel(GENES, np.zeros(6), np.ones((6, 4)))
    same, _, flipped = CF.orient_by_dna(model, df, "dna")
    assert same is model and not flipped
    assert CF.orient_by_dna(model, df.select(df.mirrored.alias("theta_deg"), "dna"), "dna")[2]


def test_concentration_is_recovered(spark):
    x, theta, *_ = simulated(1500, 7, alpha=30.0)
    out = {r.alpha: r for r in CC.choose_alpha(frame(spark, x, theta), GENES, alphas=(5.0, 30.0, 1000.0, None), iters=6).collect()}
    assert out[30.0].chosen and sum(r.chosen for r in out.values()) == 1 and out[30.0].n_cells == 1500
    assert out[None].score < out[30.0].score and out[5.0].score < out[30.0].score


def test_shared_passes_equal_single_fits(spark):
    x, theta, *_ = simulated(400, 8)
    df = frame(spark, x, theta).withColumn("fold", CC.fov_fold(2))
    df = spark.createDataFrame(df.collect(), df.schema)
    models = CC.cross_fits(df, GENES, (50.0, None), 2, iters=3)
    for (alpha, fold), m in models.items():
        alone = CC.cross_fits(df, GENES, (alpha,), 2, iters=3)[alpha, fold]
        assert np.allclose(m.coef, alone.coef, atol=1e-8)
        whole = CM.fit(df.where(df.fold != fold), GENES, alpha, iters=3, tol=-1)
        assert np.allclose(m.log_pi(), whole.log_pi(), atol=1e-3)


def test_elimination_equals_placing_without_each_gene(spark, sample):
    df, x, _, model = sample
    steps = CC.backward_elimination(df, model)
    lp, turn = model.log_pi(), np.exp(1j * np.arange(CM.GRID) * 2 * np.pi / CM.GRID)

    def phases(kept):
        part = lp[:, kept] - np.log(np.exp(lp[:, kept]).sum(1, keepdims=True))
        ll = x[:, kept] @ part.T
        q = np.exp(ll - ll.max(1, keepdims=True))
        return (q / q.sum(1, keepdims=True)) @ turn

    full, kept = phases(list(range(6))), list(range(6))
    for s in steps:
        errors = {g: np.degrees(np.median(np.abs(np.angle(phases([k for k in kept if k != g]) * np.conj(full))))) for g in kept}
        best = min(kept, key=lambda g: (errors[g], g))
        assert s["dropped"] == GENES[best] and s["err_deg"] == pytest.approx(errors[best], abs=1e-6)
        kept.remove(best)
    assert len(steps) == 4 and len(kept) == 2
    assert CC.backward_elimination(df.limit(0), model) == []


def test_equal_counts_are_read_once(spark):
    """A pass reads each count vector once; three copies of every cell give the sums of three cells."""
    x, theta, *_ = simulated(300, 9)
    df = frame(spark, x, theta)
    thrice = df.unionByName(df).unionByName(df)
    counted = CM.profiles(thrice)
    assert counted.count() == len({tuple(r) for r in x.tolist()})
    assert counted.groupBy().sum("times").first()[0] == 900
    one, three = CM.composition_moments(CM.profiles(df), 6), CM.composition_moments(counted, 6)
    assert np.allclose(one[0], three[0]) and np.allclose(one[1], three[1]) and three[2] == 3 * one[2]
    model = CM.fit(thrice, GENES, 50.0, iters=2, tol=-1)
    direct = {r.cell: r for r in CM.place(df, model).collect()}
    looked_up = {r.cell: r for r in CM.place(df, model, counted).collect()}
    assert direct.keys() == looked_up.keys()
    assert all(np.allclose(list(direct[c]), list(looked_up[c])) for c in direct)


def test_weighted_quantiles_equal_those_of_the_written_out_values(spark, monkeypatch):
    from chromaloom.operators import stats

    rng = np.random.default_rng(10)
    rows = [("ab"[int(g)], float(v), int(t)) for g, v, t in zip(rng.integers(0, 2, 60), rng.integers(0, 20, 60), rng.integers(1, 25_000, 60), strict=True)]
    df = spark.createDataFrame([*rows, ("a", None, 3), ("b", float("nan"), 3), ("a", 100.0, 0)], "g string, v double, t long")
    want = {g: np.quantile(np.repeat([v for k, v, _ in rows if k == g], [t for k, _, t in rows if k == g]), [0.25, 0.5]) for g in "ab"}
    for limit in (stats.HOT_GROUP, 5):
        monkeypatch.setattr(stats, "HOT_GROUP", limit)
        got = {r.g: r for r in stats.weighted_quantiles(df, ["g"], "v", "t", {"q": 0.25, "m": 0.5}).collect()}
        assert all(np.allclose([got[g].q, got[g].m], want[g]) and got[g].n == sum(t for k, _, t in rows if k == g) for g in "ab")
