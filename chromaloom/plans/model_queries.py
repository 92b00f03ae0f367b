"""Fitted models, chain paths, multiplicities, barcode types and the verdict stream."""

import uuid

from pyspark.sql import functions as F

from chromaloom.functions.scalar import r
from chromaloom.operators import celltype as CT
from chromaloom.operators import chains as CH
from chromaloom.operators import cycle_model as CM
from chromaloom.operators import cellcycle as C
from chromaloom.operators import detection as DET
from chromaloom.operators import multiplicity as MU
from chromaloom.operators import paths as PA
from chromaloom.operators import sites as S
from chromaloom.session import cut, ensure_checkpoint_dir
from chromaloom.sources import tables as T
from chromaloom.streaming import verdicts as SV

from .common import SOURCES, polymer_of
from .registry import query


def patterns(spark, d):
    return cut(DET.detection_patterns(T.alleles(spark, d), polymer_of(spark, d), T.N_SLOTS))


@query("quality_model")
def quality_model(spark, d):
    """Per-bin detection effects and the spread of the per-allele efficiency."""
    m = DET.fit_quality_model(patterns(spark, d), T.N_SLOTS)
    return spark.createDataFrame([(k, float(b), m.tau) for k, b in enumerate(m.b)], "slot int, b double, tau double")


@query("posterior_efficiency")
def posterior_efficiency(spark, d):
    p = patterns(spark, d)
    return DET.posterior_efficiency(p, DET.fit_quality_model(p, T.N_SLOTS), T.N_SLOTS)


@query("cooccurrence_z")
def cooccurrence_z(spark, d):
    p = patterns(spark, d)
    return DET.cooccurrence_z(DET.cooccurrence(polymer_of(spark, d)), p, DET.fit_quality_model(p, T.N_SLOTS), T.N_SLOTS)


@query("count_dispersion")
def count_dispersion(spark, d):
    p = patterns(spark, d)
    return DET.count_dispersion(p, DET.fit_quality_model(p, T.N_SLOTS))


# The null with a stated spread: bin effects from the efficacies, quadrature nodes by rule.
GIVEN_TAU = 0.7
GIVEN_SQL = f"""
pat AS MATERIALIZED (SELECT pattern, count(*) AS n FROM (SELECT a.allele_id, string_agg(CASE WHEN p.slot IS NULL THEN '0' ELSE '1' END, '' ORDER BY s.slot) AS pattern
  FROM m_alleles a CROSS JOIN (SELECT unnest(range(7)) AS slot) s LEFT JOIN m_polymer p ON p.allele_id = a.allele_id AND p.slot = s.slot GROUP BY 1) GROUP BY 1),
nodes AS (SELECT * FROM (VALUES {", ".join(f"({k}, CAST({x!r} AS DOUBLE), CAST({w!r} AS DOUBLE))" for k, (x, w) in enumerate(zip(*(v.tolist() for v in DET._nodes()), strict=True)))}) AS t(k, x, lw)),
bits AS MATERIALIZED (SELECT pattern, n, j, substr(pattern, CAST(j AS INTEGER) + 1, 1) = '1' AS hit FROM pat, (SELECT unnest(range(7)) AS j)),
eff AS (SELECT j, ln(e / (1 - e)) AS b FROM (SELECT j, (sum(CASE WHEN hit THEN n ELSE 0 END) + 0.5) / (sum(n) + CAST(1 AS DOUBLE)) AS e FROM bits GROUP BY 1)),
sg AS MATERIALIZED (SELECT k, j, x * {GIVEN_TAU} AS u, lw, 1 / (1 + exp(-(b + x * {GIVEN_TAU}))) AS s FROM nodes, eff),
post AS MATERIALIZED (SELECT pattern, n, k, u, exp(l - max(l) OVER (PARTITION BY pattern)) / sum(exp(l - mx)) OVER (PARTITION BY pattern) AS q FROM (
  SELECT *, max(l) OVER (PARTITION BY pattern) AS mx FROM (SELECT pattern, n, k, any_value(u) AS u, any_value(lw) + sum(CASE WHEN hit THEN ln(s) ELSE ln(1 - s) END) AS l FROM bits JOIN sg USING (j) GROUP BY 1, 2, 3)))"""


def given_null(spark, d):
    p = patterns(spark, d)
    return p, DET.margin_model(p, T.N_SLOTS, GIVEN_TAU)


@query("posterior_efficiency_given", f"""
WITH {GIVEN_SQL}, m AS (SELECT pattern, any_value(n) AS n, sum(q * u) AS um, sum(q * u * u) AS u2 FROM post GROUP BY 1),
pr AS (SELECT pattern, sum(q * s) AS p0 FROM post JOIN sg USING (k) WHERE j = 0 GROUP BY 1)
SELECT pattern, n, round(um, 6) AS u_mean, round(sqrt(greatest(u2 - um * um, 0)), 6) AS u_sd, round(p0, 6) AS predicted_first FROM m JOIN pr USING (pattern)""")
def posterior_efficiency_given(spark, d):
    """Posterior of every pattern's efficiency under the stated null."""
    p, m = given_null(spark, d)
    out = DET.posterior_efficiency(p, m, T.N_SLOTS)
    return out.select("pattern", "n", r("u_mean").alias("u_mean"), r("u_sd").alias("u_sd"), r(F.get("predicted", 0)).alias("predicted_first"))


@query("cooccurrence_z_given", f"""
WITH {GIVEN_SQL}, w AS (SELECT k, sum(n * q) AS w FROM post GROUP BY 1), mm AS (SELECT a.k AS k, b.k AS l, sum(a.n * a.q * b.q) AS m FROM post a JOIN post b USING (pattern) GROUP BY 1, 2),
pr AS MATERIALIZED (SELECT a.k, a.j AS bin_i, b.j AS bin_j, a.s * b.s AS p FROM sg a JOIN sg b ON a.k = b.k AND a.j < b.j),
e AS (SELECT bin_i, bin_j, sum(w * p) AS e FROM pr JOIN w USING (k) GROUP BY 1, 2),
v AS (SELECT x.bin_i, x.bin_j, sum(x.p * m * y.p) AS v FROM pr x JOIN mm ON mm.k = x.k JOIN pr y ON y.k = mm.l AND y.bin_i = x.bin_i AND y.bin_j = x.bin_j GROUP BY 1, 2),
o AS (SELECT a.j AS bin_i, b.j AS bin_j, sum(a.n) AS o FROM bits a JOIN bits b ON a.pattern = b.pattern AND a.j < b.j WHERE a.hit AND b.hit GROUP BY 1, 2)
SELECT CAST(bin_i AS INTEGER) AS bin_i, CAST(bin_j AS INTEGER) AS bin_j, CAST(coalesce(o, 0) AS BIGINT) AS observed, round(e, 4) AS expected, round((coalesce(o, 0) - e) / sqrt(greatest(e - v, 1e-12)), 4) AS z
FROM e JOIN v USING (bin_i, bin_j) LEFT JOIN o USING (bin_i, bin_j)""")
def cooccurrence_z_given(spark, d):
    """Co-detection z of every pair of slots under the stated null."""
    p, m = given_null(spark, d)
    z = DET.cooccurrence_z(DET.cooccurrence(polymer_of(spark, d)), p, m, T.N_SLOTS)
    return z.select("bin_i", "bin_j", F.col("observed").cast("long").alias("observed"), r("expected", 4).alias("expected"), r("z", 4).alias("z"))


@query("count_dispersion_given", f"""
WITH RECURSIVE {GIVEN_SQL}, cv AS (SELECT k, any_value(exp(lw)) AS w, CAST(-1 AS BIGINT) AS j, 0 AS c, CAST(1 AS DOUBLE) AS p FROM sg GROUP BY 1
  UNION ALL SELECT k, w, j, c, sum(p) FROM (SELECT cv.k, cv.w, sg.j, cv.c + h AS c, cv.p * CASE WHEN h = 1 THEN s ELSE 1 - s END AS p FROM cv JOIN sg ON sg.k = cv.k AND sg.j = cv.j + 1, (VALUES (0), (1)) hh(h)) GROUP BY k, w, j, c),
pmf AS (SELECT c, sum(w * p) AS p FROM cv WHERE j = 6 GROUP BY 1), mu AS (SELECT sum(p * c) AS mu FROM pmf),
mo AS (SELECT sum(p * pow(c - mu, 2)) AS v, sum(p * pow(c - mu, 4)) AS f FROM pmf, mu),
ob AS (SELECT sum(n) AS a, var_samp_n AS var_obs FROM (SELECT n, (sum(n * c * c) OVER () - pow(sum(n * c) OVER (), 2) / sum(n) OVER ()) / (sum(n) OVER () - 1) AS var_samp_n FROM (SELECT n, CAST(length(replace(pattern, '0', '')) AS DOUBLE) AS c FROM pat)) GROUP BY 2)
SELECT round(var_obs / v, 6) AS ratio, round(var_obs, 6) AS var_obs, round(v, 6) AS var_model FROM ob, mo""")
def count_dispersion_given(spark, d):
    """Spread of the per-allele counts against the stated null."""
    return DET.count_dispersion(*given_null(spark, d)).select(*[r(c).alias(c) for c in ("ratio", "var_obs", "var_model")])


def composed(spark, d):
    """Cells with their whole-panel counts: one gene per (modality, round)."""
    s = T.spots(spark, d).where((F.col("cell") >= 0) & (F.col("p_exist").isNull() | (F.col("p_exist") >= 0.5)))
    n = T.N_SLOTS
    x = F.array(*[F.sum((F.col("hybe") == h).cast("double")) for h in T.HYBES])
    return s.groupBy("fov", "cell").agg(x.alias("x")), [f"gene_{k + 1}" for k in range(n)]


@query("cycle_model_fit")
def cycle_model_fit(spark, d):
    """The fitted ring: intercept, harmonics and information share per gene."""
    cells, genes = composed(spark, d)
    m = CM.fit(cells, genes, alpha=100.0, iters=40)
    share = CM.fisher_share(m)
    rows = [(g, float(m.intercept[k]), [float(v) for v in m.coef[k]], float(share[g]), len(m.history)) for k, g in enumerate(genes)]
    return spark.createDataFrame(rows, "gene string, intercept double, harmonics array<double>, fisher_share double, n_iter int")


@query("cycle_placement")
def cycle_placement(spark, d):
    """Fit, then place every cell: phase, certainty and the verdict columns."""
    cells, genes = composed(spark, d)
    cells = cut(cells)
    counted = CM.profiles(cells)
    placed = CM.place(cells, CM.fit(counted, genes, alpha=100.0, iters=40), counted)
    return CM.fit_z(cut(placed)).drop("evidence")


def chain_points(spark, d):
    c = T.candidates(spark, d).where("cell >= 0")
    return c.select("fov", "cell", F.col("cand").alias("point"), "slot", (F.col("y") * 0.208).alias("y_um"), (F.col("x") * 0.208).alias("x_um"),
                    (F.col("z") * 0.2).alias("z_um"))


def _walks(n_slots: int, points: str, p: str) -> list[str]:
    """SQL: the chains ending at every point of `points`, slot by slot, in tables {p}0 and later."""
    cost = """p.w + (0.5 * ((q.y-p.y)*(q.y-p.y) + (q.x-p.x)*(q.x-p.x)) / vxy + 0.5 * (q.z-p.z)*(q.z-p.z) / vz + ln(vxy) + 0.5 * ln(vz) + 1.5 * ln(2 * pi())) - q.clutter"""
    out = [f"{p}0 AS MATERIALIZED (SELECT *, CAST(0 AS DOUBLE) AS w, [point] AS chain FROM {points} WHERE slot = 0)"]
    for s in range(1, n_slots):
        out.append(f"""{p}{s} AS MATERIALIZED (SELECT * FROM {p}{s - 1} UNION ALL SELECT q.*, coalesce(b.w, 0) AS w, CASE WHEN b.w IS NULL THEN [q.point] ELSE list_append(b.chain, q.point) END AS chain
FROM (SELECT * FROM {points} WHERE slot = {s}) q LEFT JOIN (SELECT fov, cell, point, w, chain FROM (SELECT *, row_number() OVER (PARTITION BY fov, cell, point ORDER BY w, p_slot, p_point) AS rn FROM (
  SELECT q.fov, q.cell, q.point, p.slot AS p_slot, p.point AS p_point, p.chain, {cost} AS w FROM {points} q JOIN (SELECT *, pow(CAST(0.0572 AS DOUBLE) * pow(({s} - slot) * CAST(50 AS DOUBLE), CAST(0.267 AS DOUBLE)), 2) + 2 * pow(CAST(0.031 AS DOUBLE), 2) AS vxy,
    pow(CAST(0.0572 AS DOUBLE) * pow(({s} - slot) * CAST(50 AS DOUBLE), CAST(0.267 AS DOUBLE)), 2) + 2 * pow(CAST(0.076 AS DOUBLE), 2) AS vz FROM {p}{s - 1}) p ON p.fov = q.fov AND p.cell = q.cell
  WHERE q.slot = {s}) WHERE w < 0) WHERE rn = 1) b ON b.fov = q.fov AND b.cell = q.cell AND b.point = q.point)""")
    out.append(f"{p}_best AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fov, cell ORDER BY w, slot, point) AS rn FROM {p}{n_slots - 1} WHERE w < 0) WHERE rn = 1)")
    return out


CHAIN_POINTS = """pts AS MATERIALIZED (SELECT fov, cell, cand AS point, slot, y * CAST(0.208 AS DOUBLE) AS y, x * CAST(0.208 AS DOUBLE) AS x, z * CAST(0.2 AS DOUBLE) AS z,
  ln(CAST(500 AS DOUBLE) / count(*) OVER (PARTITION BY fov, cell)) AS clutter FROM m_candidates WHERE cell >= 0)"""
CHAIN_COLUMNS = "fov, cell, {} round(w, 5) AS weight, len(chain) AS n_points, chain[1] AS first_point, chain[len(chain)] AS last_point"


def _chain_sql(n_slots: int) -> str:
    return "WITH " + ",\n".join([CHAIN_POINTS, *_walks(n_slots, "pts", "d")]) + f"\nSELECT {CHAIN_COLUMNS.format('')} FROM d_best"


def _disjoint_sql(n_slots: int) -> str:
    """The second chain walks what the first left, under the same price."""
    rest = "rest AS MATERIALIZED (SELECT * FROM pts WHERE (fov, cell, point) NOT IN (SELECT fov, cell, unnest(chain) FROM d_best))"
    parts = [CHAIN_POINTS, *_walks(n_slots, "pts", "d"), rest, *_walks(n_slots, "rest", "e")]
    return "WITH " + ",\n".join(parts) + f"""
SELECT {CHAIN_COLUMNS.format('CAST(0 AS INTEGER) AS rank,')} FROM d_best UNION ALL SELECT {CHAIN_COLUMNS.format('CAST(1 AS INTEGER) AS rank,')} FROM e_best"""


AXIS_KB = PA.uniform_separation(T.N_SLOTS, 50.0)
# The test tables' points lie microns apart on seven slots: two loci and no prior let chains show.
SHORT_AXIS = PA.PathRule(min_loci=2, prior=0.0)
# plain greedy extraction: cheapest first, all under the price of the whole cell
GREEDY = PA.PathRule(min_loci=2, sweeps=0, clutter_rounds=1, volume_um3=CH.CLUTTER_VOLUME_UM3)


def greedy_chains(spark, d, k):
    p = PA.cell_paths(chain_points(spark, d), AXIS_KB, k=k, rule=GREEDY)
    c = p.select("fov", "cell", F.posexplode("paths").alias("rank", "p"))
    return c.select("fov", "cell", "rank", r("p.weight", 5).alias("weight"), F.size("p.points").cast("long").alias("n_points"),
                    F.element_at("p.points", 1).alias("first_point"), F.element_at("p.points", -1).alias("last_point"))


@query("chain_paths", _chain_sql(T.N_SLOTS))
def chain_paths(spark, d):
    """The cheapest chain through each cell's candidates."""
    return greedy_chains(spark, d, 1).drop("rank")


@query("disjoint_chains", _disjoint_sql(T.N_SLOTS))
def disjoint_chains(spark, d):
    """Two chains per cell without a point in common, the cheaper first."""
    return greedy_chains(spark, d, 2)


@query("disjoint_paths")
def disjoint_paths(spark, d):
    """Up to two settled chains per cell: swept, uncrossed, priced by what they leave."""
    p = PA.cell_paths(chain_points(spark, d), AXIS_KB, k=2, rule=SHORT_AXIS)
    return p.select("fov", "cell", "n_points", "k", r("cost", 5).alias("cost"), F.transform("paths", lambda x: x["points"]).alias("points"))


@query("path_count")
def path_count(spark, d):
    """How many chains pay for themselves, and what every count tried was worth."""
    p = PA.cell_paths(chain_points(spark, d), AXIS_KB, rule=SHORT_AXIS)
    return p.select("fov", "cell", "n_points", "k", r("cost", 5).alias("cost"), F.transform("scores", lambda x: F.round(x, 5)).alias("scores"))


@query("trace_assembly")
def trace_assembly(spark, d):
    """The point every trace takes in every slot, beside the number of sites the cell's geometry proposes."""
    points = cut(chain_points(spark, d))
    traces = PA.trace_rows(PA.cell_paths(points, AXIS_KB, rule=SHORT_AXIS), points)
    sites = S.spatial_multiplicity(points.withColumn("bin", F.col("slot")), T.N_SLOTS).select("fov", "cell", F.col("k").alias("proposed"))
    return traces.join(sites, ["fov", "cell"], "left").select("fov", "cell", "allele", "slot", "point", r("weight", 5).alias("weight"), "proposed")


@query("binomial_multiplicity", """
WITH c AS (SELECT fov, cell, s.slot, count(k.cand) AS c FROM (SELECT fov, cell FROM m_cells) CROSS JOIN (SELECT unnest(range(7)) AS slot) s
  LEFT JOIN m_candidates k USING (fov, cell, slot) GROUP BY 1, 2, 3),
kk AS (SELECT unnest(range(1, 4)) AS k), mx AS (SELECT fov, cell, ln(greatest(max(c), 1) + CAST(1 AS DOUBLE)) AS span FROM c GROUP BY 1, 2),
e AS (SELECT fov, cell, k, least(greatest(avg(least(c, k)) / k, 1e-6), 1 - 1e-6) AS e FROM c, kk GROUP BY 1, 2, 3),
l AS (SELECT fov, cell, k, e, sum(CASE WHEN c <= k THEN ln(exp(ln(CAST(0.95 AS DOUBLE)) + ln(CAST(factorial(CAST(k AS INTEGER)) / (factorial(CAST(c AS INTEGER)) * factorial(CAST(k - c AS INTEGER))) AS DOUBLE)) + c * ln(e) + (k - c) * ln(1 - e)) + exp(ln(CAST(0.05 AS DOUBLE)) - span))
      ELSE ln(CAST(0.05 AS DOUBLE)) - span END) AS ll FROM (SELECT * FROM c JOIN mx USING (fov, cell)) JOIN e USING (fov, cell) GROUP BY 1, 2, 3, 4),
t AS (SELECT *, max(ll) OVER (PARTITION BY fov, cell) AS top FROM l)
SELECT f.fov, f.cell, CASE WHEN seen THEN CAST(k AS INTEGER) ELSE 0 END AS k, CASE WHEN seen THEN round(e, 6) ELSE 0 END AS efficiency, CASE WHEN seen THEN round(ll, 6) END AS loglik, CASE WHEN seen THEN 'fitted' ELSE 'no spots' END AS reason
FROM (SELECT *, row_number() OVER (PARTITION BY fov, cell ORDER BY k) AS rn FROM t WHERE ll >= top - 1) f JOIN (SELECT fov, cell, sum(c) > 0 AS seen FROM c GROUP BY 1, 2) USING (fov, cell) WHERE rn = 1""")
def binomial_multiplicity(spark, d):
    """Every cell, spots or none; the seven-slot axis lowers the bins a fit needs."""
    m = MU.binomial_multiplicity(MU.bin_counts(chain_points(spark, d), T.N_SLOTS, T.cells(spark, d)), min_support=T.N_SLOTS)
    return m.select("fov", "cell", "k", r("efficiency").alias("efficiency"), r("loglik").alias("loglik"), "reason")


@query("repeat_calibration")
def repeat_calibration(spark, d):
    """Localisation spread from the repeat round (slot 5 re-images slot 1)."""
    poly = polymer_of(spark, d)

    def side(slot, p):
        return poly.where(F.col("slot") == slot).select("allele_id", *[F.col(c).alias(f"{p}{c}") for c in ("y_um", "x_um", "z_um")])
    v = side(1, "a").join(side(5, "b"), "allele_id").select(*[(F.col(f"a{c}_um") - F.col(f"b{c}_um")).alias(f"d{c}") for c in "yxz"])
    cal = MU.repeat_calibration(cut(v))
    return spark.createDataFrame([(cal["n"], cal["sigma_xy"], cal["sigma_z"], cal["mix"])], "n double, sigma_xy double, sigma_z double, mix double")


IMAGE_SQL = """
img AS (SELECT fov, channel, CAST(trunc(raw_y) AS INTEGER) AS y, CAST(trunc(raw_x) AS INTEGER) AS x, max(brightness) - 30000 AS value FROM m_spots WHERE brightness IS NOT NULL GROUP BY 1, 2, 3, 4)"""
TYPES = {488: "WT", 555: "KI", 635: "KO"}


def image(spark, d):
    s = T.spots(spark, d).where("brightness is not null")
    return s.groupBy("fov", "channel", F.col("raw_y").cast("int").alias("y"), F.col("raw_x").cast("int").alias("x")).agg((F.max("brightness") - 30000).alias("value"))


@query("barcode_vote", f"""
WITH {IMAGE_SQL}, top AS (SELECT *, row_number() OVER (PARTITION BY fov, y, x ORDER BY value DESC, channel) AS rn FROM img),
v AS (SELECT p.fov, p.cell, CASE WHEN value > 0 THEN CASE channel WHEN 488 THEN 'WT' WHEN 555 THEN 'KI' ELSE 'KO' END ELSE '' END AS celltype, count(*) AS votes
      FROM m_pixels p JOIN top t ON t.fov = p.fov AND t.y = p.y AND t.x = p.x WHERE rn = 1 GROUP BY 1, 2, 3)
SELECT fov, cell, celltype, votes FROM (SELECT *, row_number() OVER (PARTITION BY fov, cell ORDER BY votes DESC, celltype) AS rn FROM v) WHERE rn = 1""")
def barcode_vote(spark, d):
    return CT.barcode_vote(T.mask_pixels(T.cells(spark, d)), image(spark, d), TYPES)


@query("barcode_median", f"""
WITH {IMAGE_SQL}, m AS (SELECT p.fov, p.cell, channel, median(value) AS m FROM m_pixels p JOIN img t ON t.fov = p.fov AND t.y = p.y AND t.x = p.x GROUP BY 1, 2, 3)
SELECT fov, cell, CASE WHEN m > 0 THEN CASE channel WHEN 488 THEN 'WT' WHEN 555 THEN 'KI' ELSE 'KO' END ELSE '' END AS celltype
FROM (SELECT *, row_number() OVER (PARTITION BY fov, cell ORDER BY m DESC, channel) AS rn FROM m) WHERE rn = 1""")
def barcode_median(spark, d):
    return CT.barcode_median(T.mask_pixels(T.cells(spark, d)), image(spark, d), TYPES)


@query("mask_sums", """
WITH img AS (SELECT fov, CAST(trunc(raw_y) AS INTEGER) AS y, CAST(trunc(raw_x) AS INTEGER) AS x, max(brightness) AS value FROM m_spots WHERE brightness IS NOT NULL GROUP BY 1, 2, 3),
o AS (SELECT fov, count(*) AS n_out, median(value) AS outside FROM img WHERE (fov, y, x) NOT IN (SELECT fov, y, x FROM m_pixels) GROUP BY 1),
b AS (SELECT fov, CASE WHEN coalesce(n_out, 0) >= n * 0.01 THEN outside ELSE p5 END AS bg FROM (SELECT fov, count(*) AS n, quantile_cont(value, 0.05) AS p5 FROM img GROUP BY 1) LEFT JOIN o USING (fov))
SELECT p.fov, p.cell, count(*) AS area, round(avg(value), 6) AS mask_mean, round(median(value), 4) AS mask_median, round(sum(greatest(value - bg, 0)), 3) AS sum_above_bg, round(max(bg), 4) AS background
FROM m_pixels p JOIN img ON img.fov = p.fov AND img.y = p.y AND img.x = p.x JOIN b ON b.fov = p.fov GROUP BY 1, 2""")
def mask_sums(spark, d):
    img = image(spark, d).groupBy("fov", "y", "x").agg((F.max("value") + 30000).alias("value"))
    m = CT.mask_sums(T.mask_pixels(T.cells(spark, d)), img)
    return m.select("fov", "cell", "area", r("mask_mean", 6).alias("mask_mean"), r("mask_median", 4).alias("mask_median"),
                    r("sum_above_bg", 3).alias("sum_above_bg"), r("background", 4).alias("background"))


@query("gene_screen", """
WITH c AS (SELECT c.cell, s.modality, s.hybe, s.channel, count(p.uid) AS candidates, count(p.uid) FILTER (p.p_exist IS NULL OR p.p_exist >= 0.5) AS n
  FROM m_cells c CROSS JOIN m_sources s LEFT JOIN m_spots p ON p.cell = c.cell AND p.fov = c.fov AND p.modality = s.modality AND p.hybe = s.hybe AND p.channel = s.channel GROUP BY ALL),
f AS (SELECT modality, hybe, channel, least(CAST(floor(theta_deg * 12 / 360.0) AS INTEGER), 11) AS bin, avg(candidates) AS c, avg(n) AS a FROM c JOIN m_placed t ON t.cell = c.cell WHERE theta_deg IS NOT NULL GROUP BY 1, 2, 3, 4),
k AS (SELECT *, rank() OVER (PARTITION BY modality, hybe, channel ORDER BY c) + (count(*) OVER (PARTITION BY modality, hybe, channel, c) - 1) / 2.0 AS rc,
      rank() OVER (PARTITION BY modality, hybe, channel ORDER BY a) + (count(*) OVER (PARTITION BY modality, hybe, channel, a) - 1) / 2.0 AS ra FROM f)
SELECT modality, hybe, channel, count(*) AS n_bins, round(corr(rc, ra), 6) AS rho, round(max(c) / greatest(min(c), 1), 6) AS cand_swing, round(max(a) / greatest(min(a), 0.5), 6) AS acc_swing,
       count(*) >= 6 AND max(abs(c - a)) > 1e-8 AS judged, count(*) >= 6 AND max(abs(c - a)) > 1e-8 AND max(a) / greatest(min(a), 0.5) >= 1.5 AND corr(rc, ra) < 0.3 AS refused FROM k GROUP BY 1, 2, 3""")
def gene_screen(spark, d):
    s = CT.screen_genes(C.count_table(T.cells(spark, d), T.spots(spark, d), SOURCES), T.placements(spark, d))
    return s.select("modality", "hybe", "channel", "n_bins", *[r(c).alias(c) for c in ("rho", "cand_swing", "acc_swing")], "judged", "refused")


@query("stream_latest_verdict", "SELECT reviewer, key, page, file_no, line_no, value FROM m_latest")
def stream_latest_verdict(spark, d):
    """The verdict log read as a file stream: keyed state emits the records that became the latest."""
    schema = T.table(spark, d, "events").schema
    root = f"{ensure_checkpoint_dir(spark)}/verdicts-{uuid.uuid4().hex}"
    records = T.verdict_columns(SV.read_events(spark, d, schema))
    SV.follow(records, root).awaitTermination()
    return SV.current(spark, root).select("reviewer", "key", "page", "file_no", "line_no", "value")


@query("count_null")
def count_null(spark, d):
    """Co-detection z against margin-preserving trades, over all alleles."""
    return DET.count_null(T.alleles(spark, d), polymer_of(spark, d), T.N_SLOTS)


def _poisson(u: str) -> str:
    return " + ".join(f"CAST({u} >= {t} AS INTEGER)" for t in C.POISSON_STEPS)


@query("direction_ci", f"""
WITH t AS (SELECT celltype, radians(theta_deg) AS t, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 1073741824 AS c, CAST('0x' || substr(h, 9, 8) AS BIGINT) % 1073741824 AS s FROM (
  SELECT celltype, theta_deg, md5('12345:' || CAST(fov AS VARCHAR) || ':' || CAST(cell AS VARCHAR)) AS h FROM m_placed JOIN m_cells USING (fov, cell) WHERE theta_deg IS NOT NULL)),
d AS (SELECT celltype, b, t, (((c + (b + 1) * s) % 2147483647) * 48271 % 2147483647) * 48271 % 2147483647 AS u
      FROM t, (SELECT unnest(range(500)) AS b)),
s AS (SELECT celltype, b, sum(({_poisson("u")}) * cos(t)) AS c, sum(({_poisson("u")}) * sin(t)) AS s FROM d GROUP BY 1, 2),
m AS (SELECT celltype, count(*) AS n, degrees(atan2(avg(sin(t)), avg(cos(t)))) AS m FROM t GROUP BY 1),
g AS (SELECT celltype, n, m, abs((degrees(atan2(s, c)) - m + 180) - 360 * floor((degrees(atan2(s, c)) - m + 180) / 360) - 180) AS gap FROM s JOIN m USING (celltype))
SELECT celltype, n, round(any_value(m) - 360 * floor(any_value(m) / 360), 4) AS mean_deg, round(quantile_cont(gap, 0.95), 4) AS half_width_deg FROM g GROUP BY 1, 2""")
def direction_ci(spark, d):
    """Circular mean per celltype with its bootstrap interval."""
    t = T.placements(spark, d).join(T.cells(spark, d).select("fov", "cell", "celltype"), ["fov", "cell"])
    out = C.direction_ci(t, ["celltype"])
    return out.select("celltype", "n", F.round("mean_deg", 4).alias("mean_deg"), F.round("half_width_deg", 4).alias("half_width_deg"))


@query("spot_classifier")
def spot_classifier(spark, d):
    """A linear head on spot features; whole cells are held out and calibrate its score."""
    from chromaloom.operators import classify, labels

    s = T.spots(spark, d).where("cell >= 0 and p_exist is not null and brightness is not null")
    rows = s.select("fov", "cell", "uid", (F.col("p_exist") >= 0.5).cast("double").alias("y"), F.ln("brightness").alias("log_brightness"),
                    F.col("raw_y"), F.col("raw_z"), F.concat_ws("/", "fov", "cell").alias("group"))
    split = cut(labels.holdout(rows, "group", 0.3, seed=3))
    head = classify.train(split.where("not held_out"), split.where("held_out"), ["log_brightness", "raw_y", "raw_z"])
    return head.score(split).select("fov", "cell", "uid", "y", "held_out", "p_exist")
