"""Scans, sinks bookkeeping and point filters."""

from pyspark.sql import functions as F

from chromaloom.functions.scalar import accepted, closed_bin, from_learned_engine, planes_from_end, r
from chromaloom.operators.stats import exact_quantiles
from chromaloom.operators import quality_gate as QG
from chromaloom.sources import store
from chromaloom.sources import tables as T

from .registry import query


@query("scan_slice", """
SELECT fov, uid, cell, raw_y, raw_x, raw_z FROM m_spots WHERE fov = 3 AND modality = 'DNA' AND hybe = 'Hyb_002' AND channel = 488""")
def scan_slice(spark, d):
    s = T.spots(spark, d)
    return s.where("fov = 3 and modality = 'DNA' and hybe = 'Hyb_002' and channel = 488").select(
        "fov", "uid", "cell", "raw_y", "raw_x", "raw_z")


@query("spot_slices", "SELECT fov, modality, hybe, channel, count(*) AS n_spots FROM m_spots GROUP BY 1, 2, 3, 4")
def spot_slices(spark, d):
    return store.spot_slices(T.spots(spark, d))


@query("fov_counts", """
SELECT fov, n_cells, coalesce(n_spots, 0) AS n_spots, n_alleles FROM (SELECT fov, count(*) AS n_cells FROM m_cells GROUP BY 1)
LEFT JOIN (SELECT fov, count(*) AS n_spots FROM m_spots GROUP BY 1) USING (fov)
LEFT JOIN (SELECT fov, count(*) AS n_alleles FROM m_alleles GROUP BY 1) USING (fov)""")
def fov_counts(spark, d):
    return store.fov_counts(T.cells(spark, d), T.spots(spark, d), T.alleles(spark, d))


@query("manifest_rebuild", "SELECT fov, max(uid) AS max_uid, count(*) AS n_spots FROM m_spots GROUP BY 1")
def manifest_rebuild(spark, d):
    return store.uid_floor(T.spots(spark, d))


@query("allocate_uids", """
WITH dealt AS (SELECT CAST(l_orderkey % 25 AS INTEGER) AS fov, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_orderkey % 256 AS b FROM lineitem)
SELECT fov, l_orderkey, l_linenumber, l_partkey, l_suppkey,
       1000 + row_number() OVER (PARTITION BY fov ORDER BY b, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS new_uid FROM dealt""")
def allocate_uids(spark, d):
    li = T.table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % T.N_FOV).cast("int").alias("fov"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    floor = T.cells(spark, d).groupBy("fov").agg(F.lit(1000).cast("long").alias("max_uid"))
    return store.allocate_uids(li, floor, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "l_orderkey")


@query("merge_matrices", """
WITH old AS (SELECT fov, modality, hybe, w_yt AS yt, w_xt AS xt FROM m_within),
fresh AS (SELECT fov, modality, hybe, w_yt + 1 AS yt, w_xt - 1 AS xt FROM m_within WHERE hybe IN ('Hyb_002', 'Hyb_003'))
SELECT fov, modality, hybe, round(yt, 6) AS yt, round(xt, 6) AS xt FROM (
SELECT * FROM fresh UNION ALL SELECT * FROM old WHERE (fov, modality, hybe) NOT IN (SELECT fov, modality, hybe FROM fresh))""")
def merge_matrices(spark, d):
    old = T.fov_matrices(spark, d).select("fov", "modality", "hybe", F.col("h_within.yt").alias("yt"), F.col("h_within.xt").alias("xt"))
    fresh = old.where(F.col("hybe").isin("Hyb_002", "Hyb_003")).withColumns({"yt": F.col("yt") + 1, "xt": F.col("xt") - 1})
    return store.merge_matrices(old, fresh, ["fov", "modality", "hybe"]).select("fov", "modality", "hybe", r("yt").alias("yt"), r("xt").alias("xt"))


@query("append_missing", """
WITH cached AS (SELECT fov, modality, hybe, channel, count(*) AS n FROM m_spots WHERE fov < 10 GROUP BY 1, 2, 3, 4),
fresh AS (SELECT fov, modality, hybe, channel, count(*) + 1 AS n FROM m_spots GROUP BY 1, 2, 3, 4)
SELECT * FROM cached UNION ALL SELECT * FROM fresh WHERE (fov, modality, hybe, channel) NOT IN (SELECT fov, modality, hybe, channel FROM cached)""")
def append_missing(spark, d):
    s = T.spots(spark, d)
    keys = ["fov", "modality", "hybe", "channel"]
    cached = s.where("fov < 10").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    fresh = s.groupBy(*keys).agg((F.count(F.lit(1)) + 1).alias("n"))
    return store.append_missing(cached, fresh, keys)


@query("container_diff", """
WITH old AS (SELECT * FROM m_spots WHERE raw_z > 0.5), new AS (SELECT * REPLACE (CASE WHEN raw_y > 45 THEN NULL ELSE p_exist END AS p_exist) FROM m_spots WHERE raw_z < 7.5)
SELECT coalesce(o.cell, n.cell) AS cell, coalesce(o.uid, n.uid) AS uid,
       CASE WHEN o.uid IS NULL THEN 'added' WHEN n.uid IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM (SELECT * FROM old WHERE cell >= 0) o FULL JOIN (SELECT * FROM new WHERE cell >= 0) n ON o.cell = n.cell AND o.uid = n.uid
WHERE o.uid IS NULL OR n.uid IS NULL OR o.p_exist IS DISTINCT FROM n.p_exist OR o.brightness IS DISTINCT FROM n.brightness""")
def container_diff(spark, d):
    s = T.spots(spark, d).where("cell >= 0")
    old = s.where("raw_z > 0.5")
    new = s.where("raw_z < 7.5").withColumn("p_exist", F.when(F.col("raw_y") <= 45, F.col("p_exist")))
    return store.container_diff(old, new, ["cell", "uid"], ["p_exist", "brightness"])


@query("stale_inputs", """
WITH stamps AS (SELECT fov, max(raw_y) AS mtime, count(*) AS size FROM m_spots GROUP BY 1),
cached AS (SELECT fov, max(raw_y) AS mtime, count(*) AS size FROM m_spots WHERE NOT (fov = 4 AND hybe = 'Hyb_007') AND fov < 20 GROUP BY 1)
SELECT s.fov FROM stamps s LEFT JOIN cached c ON c.fov = s.fov WHERE c.fov IS NULL OR s.mtime <> c.mtime OR s.size <> c.size""")
def stale_inputs(spark, d):
    s = T.spots(spark, d)

    def stamp(df):
        return df.groupBy("fov").agg(F.max("raw_y").alias("mtime"), F.count(F.lit(1)).alias("size"))
    return store.stale_keys(stamp(s), stamp(s.where("not (fov = 4 and hybe = 'Hyb_007') and fov < 20")), ["fov"])


@query("accepted_spots", "SELECT fov, modality, hybe, channel, count(*) AS n_accepted FROM m_spots WHERE p_exist IS NULL OR p_exist >= 0.5 GROUP BY 1, 2, 3, 4")
def accepted_spots(spark, d):
    return T.spots(spark, d).where(accepted("p_exist")).groupBy(*store.SLICE).agg(F.count(F.lit(1)).alias("n_accepted"))


@query("p_gate_summary", """
SELECT CAST(count(*) AS BIGINT) AS n_total, count(p_exist) AS n_scored, count(*) - count(p_exist) AS n_unscored,
       count(*) FILTER (p_exist >= 0.5) AS n_kept, count(*) FILTER (p_exist < 0.5) AS n_denied,
       round(count(*) FILTER (p_exist >= 0.5) / CAST(count(p_exist) AS DOUBLE), 6) AS kept_frac,
       min(p_exist) = max(p_exist) AS degenerate, round(median(p_exist), 6) AS p_median, min(p_exist) AS p_min, max(p_exist) AS p_max FROM m_spots""")
def p_gate_summary(spark, d):
    s = T.spots(spark, d)
    kept = F.sum(F.coalesce((F.col("p_exist") >= 0.5).cast("long"), F.lit(0)))
    one = s.agg(F.count(F.lit(1)).alias("n_total"), F.count("p_exist").alias("n"), kept.alias("n_kept"),
                F.min("p_exist").alias("p_min"), F.max("p_exist").alias("p_max"))
    med = exact_quantiles(s, [], "p_exist", {"q": 0.5})
    return one.withColumn("q", med.select("q").scalar()).select(
        "n_total", F.col("n").alias("n_scored"), (F.col("n_total") - F.col("n")).alias("n_unscored"), "n_kept",
        (F.col("n") - F.col("n_kept")).alias("n_denied"), r(F.col("n_kept") / F.col("n")).alias("kept_frac"),
        (F.col("p_min") == F.col("p_max")).alias("degenerate"), r("q").alias("p_median"), "p_min", "p_max")


@query("p_gate_hist", """
SELECT least(CAST(floor(p_exist * 50) AS INTEGER), 49) AS bin, count(*) AS n FROM m_spots WHERE p_exist BETWEEN 0 AND 1 GROUP BY 1""")
def p_gate_hist(spark, d):
    return T.spots(spark, d).select(closed_bin("p_exist", 0.0, 1.0, 50).alias("bin")).where("bin is not null").groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"))


@query("p_gate_apply", """
SELECT fov, modality, count(*) AS n_surviving FROM m_spots WHERE NOT coalesce(p_exist < 0.5, FALSE) GROUP BY 1, 2""")
def p_gate_apply(spark, d):
    denied = F.coalesce(F.col("p_exist") < 0.5, F.lit(False))
    return T.spots(spark, d).where(~denied).groupBy("fov", "modality").agg(F.count(F.lit(1)).alias("n_surviving"))


@query("p_gate_examples", """
SELECT denied, uid, p_exist, mix FROM (SELECT p_exist < 0.5 AS denied, uid, p_exist, (uid * 7919) % 1000003 AS mix,
  row_number() OVER (PARTITION BY p_exist < 0.5 ORDER BY (uid * 7919) % 1000003, uid, cell) AS rn
  FROM m_spots WHERE abs(p_exist - 0.5) <= 0.15) WHERE rn <= 4""")
def p_gate_examples(spark, d):
    """Four kept and four denied spots near the threshold, in seeded hash order (a top-k report)."""
    s = T.spots(spark, d).where("abs(p_exist - 0.5) <= 0.15").select(
        (F.col("p_exist") < 0.5).alias("denied"), "uid", "p_exist", "cell", (F.col("uid") * 7919 % 1000003).alias("mix"))
    sides = [s.where(F.col("denied") == side).orderBy("mix", "uid", "cell").limit(4) for side in (True, False)]
    return sides[0].unionByName(sides[1]).drop("cell")


@query("gate_quantity", """
WITH s AS (SELECT 'scored' AS source, p_exist, l_q / CAST(50 AS DOUBLE) AS p FROM (SELECT *, raw_y AS l_q FROM m_spots) UNION ALL SELECT 'ranked', NULL, raw_y / CAST(50 AS DOUBLE) FROM m_spots
  UNION ALL SELECT 'bare', NULL, NULL FROM m_spots),
q AS (SELECT source, CASE WHEN count(p_exist) > 0 THEN 'p_exist' WHEN count(p) > 0 THEN 'p' END AS quantity FROM s GROUP BY 1),
v AS (SELECT s.source, quantity, CASE quantity WHEN 'p_exist' THEN p_exist WHEN 'p' THEN p END AS v FROM s JOIN q USING (source))
SELECT source, quantity, coalesce(quantity = 'p_exist', FALSE) AS calibrated, count(*) AS n_total, count(v) AS n_scored, count(*) FILTER (v < 0.5) AS n_denied, count(*) FILTER (v >= 0.5) AS n_kept,
  round(min(v), 6) AS v_min, round(max(v), 6) AS v_max, coalesce(min(v) = max(v), FALSE) AS degenerate FROM v GROUP BY 1, 2""")
def gate_quantity(spark, d):
    """The gated quantity of a calibrated set, of a set with a ranking only, and of a bare one."""
    s = T.spots(spark, d)
    nothing = F.lit(None).cast("double")
    sets = {"scored": s.withColumn("p", F.col("raw_y") / 50.0), "ranked": s.withColumns({"p_exist": nothing, "p": F.col("raw_y") / 50.0}),
            "bare": s.withColumns({"p_exist": nothing, "p": nothing})}
    reports = [QG.gate_report(t, 0.5).withColumn("source", F.lit(name)) for name, t in sets.items()]
    return reports[0].unionByName(reports[1]).unionByName(reports[2]).withColumns({c: r(c) for c in ("v_min", "v_max")})


@query("edge_gate", """
SELECT fov, modality, count(*) AS n, count(*) FILTER (least(greatest(raw_z, 0), greatest(9 - 1 - raw_z, 0)) < 3) AS n_denied,
       round(avg(least(greatest(raw_z, 0), greatest(9 - 1 - raw_z, 0))), 6) AS mean_planes FROM m_spots GROUP BY 1, 2""")
def edge_gate(spark, d):
    planes = planes_from_end("raw_z", F.lit(9.0))
    return T.spots(spark, d).groupBy("fov", "modality").agg(
        F.count(F.lit(1)).alias("n"), F.sum((planes < 3).cast("long")).alias("n_denied"), r(F.avg(planes)).alias("mean_planes"))


@query("learned_engine", """
SELECT z_status, p_exist IS NOT NULL AND z_status = 'accepted' AS learned, count(*) AS n FROM m_spots GROUP BY 1, 2""")
def learned_engine(spark, d):
    return T.spots(spark, d).groupBy("z_status", from_learned_engine("p_exist", "z_status").alias("learned")).agg(
        F.count(F.lit(1)).alias("n"))


@query("homeless_counts", """
SELECT fov, modality, hybe, channel, count(*) AS homeless FROM m_spots WHERE cell < 0 AND (p_exist IS NULL OR p_exist >= 0.5) GROUP BY 1, 2, 3, 4""")
def homeless(spark, d):
    from chromaloom.operators.expression import homeless_counts
    return homeless_counts(T.spots(spark, d))


@query("population_summary", """
SELECT CASE WHEN celltype = '' THEN 'Unassigned' ELSE celltype END AS celltype, count(*) AS n_cells,
       CAST(sum(coalesce(s.n, 0)) AS BIGINT) AS n_spots, CAST(sum(coalesce(a.n, 0)) AS BIGINT) AS n_alleles
FROM m_cells c LEFT JOIN (SELECT cell, count(*) AS n FROM m_spots WHERE cell >= 0 GROUP BY 1) s ON s.cell = c.cell
LEFT JOIN (SELECT cell, count(*) AS n FROM m_alleles WHERE cell >= 0 GROUP BY 1) a ON a.cell = c.cell GROUP BY 1""")
def population_summary(spark, d):
    def n(df, name):
        return df.where("cell >= 0").groupBy("fov", "cell").agg(F.count(F.lit(1)).alias(name))
    j = T.cells(spark, d).join(n(T.spots(spark, d), "s"), ["fov", "cell"], "left").join(n(T.alleles(spark, d), "a"), ["fov", "cell"], "left")
    label = F.when(F.col("celltype") == "", "Unassigned").otherwise(F.col("celltype")).alias("celltype")
    return j.groupBy(label).agg(F.count(F.lit(1)).alias("n_cells"), F.coalesce(F.sum("s"), F.lit(0)).alias("n_spots"),
                                F.coalesce(F.sum("a"), F.lit(0)).alias("n_alleles"))
