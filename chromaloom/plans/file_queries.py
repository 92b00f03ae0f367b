"""Readers, sinks and caches: files written from the tables, read back by the library, and compared."""

import uuid

from pyspark.sql import functions as F

from chromaloom.functions import text as TX
from chromaloom.functions.scalar import r
from chromaloom.operators import cycle_frame as CF
from chromaloom.operators import expression as E
from chromaloom.operators import frames as FR
from chromaloom.operators import polymer as P
from chromaloom.operators import readout as RO
from chromaloom.operators import repeats as RP
from chromaloom.operators import status as ST
from chromaloom.session import ensure_checkpoint_dir
from chromaloom.sources import cache as CA
from chromaloom.sources import store
from chromaloom.sources import tables as T

from .common import polymer_of
from .registry import query


def scratch(spark, name: str) -> str:
    """A folder of its own beside the checkpoints, where every executor can write."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def text_of(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query("readout_codes", """
WITH p AS (SELECT p_partkey, p_partkey % 800 + 1 AS a, p_size AS b, p_partkey % 50 + 1 AS c FROM part)
SELECT p_partkey, position, datatype, CAST(number AS INTEGER) AS number, name FROM (
SELECT p_partkey, k AS position, 'H' AS datatype, a + k AS number, NULL AS name FROM p, (SELECT unnest(range(3)) AS k)
UNION ALL SELECT p_partkey, 3, 'R', b, NULL FROM p UNION ALL SELECT p_partkey, 4, 'T', b, NULL FROM p UNION ALL SELECT p_partkey, 5, 'R', c, NULL FROM p
UNION ALL SELECT p_partkey, 6, 'T', c, NULL FROM p UNION ALL SELECT p_partkey, 7, 'B', c, NULL FROM p UNION ALL SELECT p_partkey, 9, 'H', NULL, 'DAPI' FROM p)""")
def readout_codes(spark, d):
    """A trial's rounds as numbers, letters, codes, a skip and a name."""
    p = T.table(spark, d, "part")
    a, b, c = F.col("p_partkey") % 800 + 1, F.col("p_size"), F.col("p_partkey") % 50 + 1
    line = text_of(a, "-", a + 2, " r", b, ", T", b, " -", c, " ", c + 1000, " ", c + 2000, " 0 DAPI")
    return TX.explode_readout_codes(p.select("p_partkey", line.alias("codes")), "codes").drop("codes").withColumn("position", F.col("position").cast("int"))


@query("layout_from_csv", """
SELECT hybe, readout_id, datatype, CAST(hybe_num AS INTEGER) AS hybe_num, [fiducial_channel, 600 + hybe_num % 3] AS channels, fiducial_channel, CASE WHEN hybe_num % 2 = 0 THEN [600 + hybe_num % 3] ELSE [NULL] END AS pair_channels,
  CASE WHEN hybe_num % 2 = 0 THEN [readout_id + 1000] ELSE [readout_id] END AS pair_ids, readout_name, CAST((80 - 4 - 2) // 2 AS INTEGER) AS planes FROM m_layout""")
def layout_from_csv(spark, d):
    """A layout written as the CSV an experiment carries, and parsed again."""
    lay = T.layout(spark, d)
    other = 600 + F.col("hybe_num") % 3
    sheet = lay.select(
        F.col("hybe").alias("FolderName"), F.col("readout_id").alias("Readouts"), F.lower("datatype").alias("DataType"), F.col("hybe_num").alias("HybNum"),
        text_of("[", F.col("fiducial_channel"), ", ", other, "]").alias("channels"), F.col("fiducial_channel").alias("fiducialChannel"),
        F.when(F.col("hybe_num") % 2 == 0, text_of(other, ":", F.col("readout_id") + 1000)).alias("readoutChannels"),
        F.lit(80).alias("totalFrames"), F.col("readout_name").alias("rnaNames"), F.lit(4).alias("bufferFrames"), F.lit(2).alias("bufferFramesEnd"))
    path = scratch(spark, "layout")
    sheet.write.option("header", True).csv(path)
    out = store.read_layout(spark, path)
    return out.select("hybe", "readout_id", "datatype", "hybe_num", "channels", "fiducial_channel", F.transform("readouts", lambda x: x["channel"]).alias("pair_channels"),
                      F.transform("readouts", lambda x: x["readout_id"]).alias("pair_ids"), "readout_name", "planes")


@query("probe_design_bed", "SELECT CAST(rid AS INTEGER) AS rid, chrom, s AS start, e AS \"end\" FROM m_design")
def probe_design_bed(spark, d):
    p = T.probe_design(spark, d)
    path = scratch(spark, "bed")
    p.select(F.concat_ws("\t", "chrom", "start", "end", F.concat(F.lit("PANEL_"), F.col("rid").cast("string")), F.lit("1"), F.lit("+"))).write.text(path)
    return store.read_probe_bed(spark, path)


@query("verdict_log_files", """
SELECT reviewer, count(*) AS n, CAST(sum(page) AS BIGINT) AS pages, CAST(sum(n_shown) AS BIGINT) AS n_shown FROM (
SELECT reviewer, page, 1 + line_no % 3 AS n_shown FROM m_verdicts WHERE line_no % 17 <> 0) GROUP BY 1""")
def verdict_log_files(spark, d):
    """Reviewer logs as JSON lines, every seventeenth of them broken off."""
    v = T.verdicts(spark, d)
    shown = F.transform(F.sequence(F.lit(0), F.col("line_no") % 3), lambda k: F.struct(
        k.cast("double").alias("y"), F.lit(1.0).alias("x"), F.lit(0.0).alias("z"), F.lit(1).alias("keep")))
    line = F.to_json(F.struct("reviewer", "key", "page", shown.alias("shown")))
    path = scratch(spark, "log")
    v.select(F.when(F.col("line_no") % 17 == 0, F.substring(line, 1, 20)).otherwise(line)).write.text(path)
    return store.read_verdict_log(spark, path).groupBy("reviewer").agg(
        F.count("*").alias("n"), F.sum("page").alias("pages"), F.sum(F.size("shown")).cast("long").alias("n_shown"))


@query("spots_round_trip", """
SELECT fov, modality, hybe, channel, count(DISTINCT uid) AS n, round(sum(y) / 100, 4) AS y FROM (SELECT fov, modality, hybe, channel, uid, min(raw_y) AS y FROM m_spots WHERE hybe IN ('Hyb_001', 'Hyb_002') GROUP BY ALL) WHERE fov < 12 OR hybe = 'Hyb_002' GROUP BY ALL""")
def spots_round_trip(spark, d):
    """Slices written, the second round's written again, one of them read by its full name or field."""
    s = T.spots(spark, d).where("hybe in ('Hyb_001', 'Hyb_002')").groupBy(*store.SLICE, "uid").agg(F.min("raw_y").alias("raw_y"))
    path = scratch(spark, "spots")
    store.write_spots(s.where("fov < 12"), path)
    store.write_spots(s.where("hybe = 'Hyb_002'"), path)
    return store.read_spots(spark, path).groupBy(*store.SLICE).agg(F.count("uid").alias("n"), r(F.sum("raw_y") / 100, 4).alias("y"))


@query("sheet_csv", "SELECT cell, celltype, CAST(fov AS BIGINT) AS fov, round(area, 4) AS area FROM m_cells")
def sheet_csv(spark, d):
    c = T.cells(spark, d).select("celltype", F.col("fov").cast("long").alias("fov"), "cell", F.round("area", 4).alias("area"))
    path = scratch(spark, "sheet")
    store.write_sheet(c, path)
    return store.read_sheet(spark, path, "celltype string, fov long, cell long, area double").withColumn("celltype", F.coalesce("celltype", F.lit("")))


@query("result_bundle", """
SELECT k AS bundle, n, celltypes FROM (SELECT 'first' AS k, count(*) AS n, count(DISTINCT celltype) AS celltypes FROM m_cells UNION ALL SELECT 'second', count(*), count(DISTINCT celltype) FROM m_cells WHERE fov < 5)""")
def result_bundle(spark, d):
    """Two results under one name: the second takes the next suffix."""
    c = T.cells(spark, d)
    at, out = scratch(spark, "result"), None
    for name, part in (("first", c), ("second", c.where("fov < 5"))):
        path = store.write_result(part.select("fov", "cell"), part.groupBy("celltype").count(), {"clauses": [["fov"]]}, {"run": name}, at)
        n = spark.read.parquet(f"{path}/table").agg(F.count("*").alias("n"))
        side = spark.read.json(f"{path}/sidecar").groupBy(F.get_json_object("params", "$.run").alias("bundle")).agg(F.count("*").alias("celltypes"))
        both = side.withColumn("n", n.select("n").scalar())
        out = both if out is None else out.unionByName(both)
    return out.select("bundle", "n", "celltypes")


@query("fov_index", """
WITH r AS (SELECT DISTINCT hybe AS folder, fov FROM m_spots)
SELECT folder, fov, CAST(CASE WHEN folder = 'Hyb_003' AND fov % 2 = 0 THEN fov + 100 WHEN fov < 10 THEN fov * 2 ELSE fov - 1 END AS INTEGER) AS "index" FROM r""")
def fov_index(spark, d):
    """File numbers of fields: the folder's own map, then the common one, then the number before."""
    rounds = T.spots(spark, d).select(F.col("hybe").alias("folder"), "fov").distinct()
    own = rounds.where("folder = 'Hyb_003' and fov % 2 = 0").select("folder", "fov", (F.col("fov") + 100).alias("index"))
    star = rounds.where("fov < 10").select(F.lit("*").alias("folder"), "fov", (F.col("fov") * 2).alias("index")).distinct()
    return store.resolve_fov_index(rounds, own.unionByName(star)).select("folder", "fov", F.col("index").cast("int").alias("index"))


@query("readout_pairs", """
SELECT p_partkey, CAST(p_size % 400 AS INTEGER) AS channel, CAST(p_partkey % 1000 AS INTEGER) AS readout_id FROM part UNION ALL SELECT p_partkey, 747, CAST(p_size AS INTEGER) FROM part""")
def readout_pairs(spark, d):
    p = T.table(spark, d, "part")
    pairs = TX.readout_pairs(text_of(F.col("p_size") % 400, ":", F.col("p_partkey") % 1000, ", 747:", F.col("p_size")))
    return p.select("p_partkey", F.explode(pairs).alias("x")).select("p_partkey", "x.channel", "x.readout_id")


@query("readout_map_text", """
SELECT panel, hybe, channel, CAST(rindex AS INTEGER) AS rindex, dtype, CAST(CASE WHEN dtype = 'H' THEN row_number() OVER (PARTITION BY panel, dtype ORDER BY rindex, channel, hybe) - 1 ELSE -1 END AS INTEGER) AS pindex,
  CAST(200 AS INTEGER) AS slots FROM m_records""")
def readout_map_text(spark, d):
    """Readout maps written as one text per panel and parsed again."""
    texts = RO.map_text(RO.dense_index(T.readout_records(spark, d)), ["panel"])
    declared = texts.withColumn("text", F.concat(F.lit("slots=200,"), F.col("text")))
    return TX.explode_map(declared, "text").select("panel", "e.hybe", "e.channel", "e.rindex", "e.dtype", "e.pindex", "slots")


@query("fit_gate", """
SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM (SELECT CASE WHEN amplitude IS NULL THEN 'fit failed' WHEN z < 1 OR z > 8 - 1 - 1 THEN 'stack end' WHEN cand % 9 = 0 THEN 'at bound (sx, sz)' WHEN quality < 0.02 THEN 'occupancy'
  WHEN greatest(y / 400, x / 1000) * 2 > 0.2 THEN 'lateral uncertainty' WHEN z / 100 * 2 > 0.09 THEN 'axial uncertainty' END AS reason FROM m_candidates) GROUP BY 1""")
def fit_gate(spark, d):
    """Why fitted positions are refused, first reason first."""
    c = T.candidates(spark, d).select(
        F.col("amplitude").isNotNull().alias("found"), "z", F.when(F.col("cand") % 9 == 0, F.array(F.lit("sx"), F.lit("sz"))).otherwise(F.array().cast("array<string>")).alias("at_bound"),
        F.col("quality").alias("occupancy"), (F.col("y") / 400).alias("ci_y_um"), (F.col("x") / 1000).alias("ci_x_um"), (F.col("z") / 100).alias("ci_z_um"))
    reason = P.fit_rejection(F.lit(8), z_trim=1, min_occupancy=0.02, max_uncert_xy_nm=200, max_uncert_z_nm=90)
    return c.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("cycle_time_of_cells", """
WITH h AS (SELECT i, coalesce(n, 0) AS n FROM (SELECT unnest(range(72)) AS i) LEFT JOIN (SELECT least(CAST(floor(theta_deg / 5) AS INTEGER), 71) AS i, count(*) AS n FROM m_placed WHERE theta_deg IS NOT NULL GROUP BY 1) USING (i)),
s AS (SELECT a.i, avg(b.n) AS w FROM h a JOIN h b ON (b.i - a.i + 74) % 72 <= 4 GROUP BY 1),
c AS (SELECT i, (sum(w) OVER (ORDER BY i) - first(w) OVER (ORDER BY i) / 2) / sum(w) OVER () % 1.0 AS tau FROM s)
SELECT fov, cell, round(a.tau + (b.tau - a.tau) * (theta_deg / 5 - floor(theta_deg / 5)), 6) AS tau FROM m_placed
JOIN c a ON a.i = CAST(floor(theta_deg / 5) AS INTEGER) % 72 JOIN c b ON b.i = (CAST(floor(theta_deg / 5) AS INTEGER) + 1) % 72 WHERE theta_deg IS NOT NULL""")
def cycle_time_of_cells(spark, d):
    """Every phase as elapsed share of the cycle, by the density of all phases."""
    t = T.placements(spark, d).where("theta_deg is not null")
    return t.select("fov", "cell", r(CF.clock_column(CF.cycle_clock(t))).alias("tau"))


CACHE_SOURCES = [("DNA", "Hyb_001", 488), ("RNA", "Hyb_003", 635)]


def cached_expression(spark, d):
    """A cache of fields below 20, from before field 3 gained cells and a slice of field 5 was made anew."""
    cells, spots = T.cells(spark, d), T.spots(spark, d)
    fresh = E.expression_table(cells, spots, CACHE_SOURCES).drop("celltype")
    stamps = spots.where(F.struct("modality", "hybe", "channel").isin(*[F.struct(F.lit(m), F.lit(h), F.lit(c)) for m, h, c in CACHE_SOURCES])).groupBy("fov", *CA.SOURCE).agg(
        F.max("uid").alias("mtime"), F.count("*").alias("size"))
    path = scratch(spark, "expression")
    old = stamps.withColumn("size", F.when((F.col("fov") == 5) & (F.col("modality") == "DNA"), F.col("size") + 1).otherwise(F.col("size")))
    CA.write_expression(fresh.where("fov < 20 and not (fov = 3 and cell % 2 = 0)").withColumn("n_spots", F.col("n_spots") + 1000), old.where("fov < 20"), path)
    rows, known = CA.read_expression(spark, path)
    return rows, CA.usable_sources(rows, known, cells, stamps), fresh


USABLE_SQL = """
st AS (SELECT DISTINCT fov, modality, hybe, channel FROM m_spots WHERE (modality, hybe, channel) IN (('DNA', 'Hyb_001', 488), ('RNA', 'Hyb_003', 635))),
us AS (SELECT *, fov < 20 AND fov <> 3 AS covered, fov < 20 AND NOT (fov = 5 AND modality = 'DNA') AS same_inputs FROM st)"""


@query("expression_cache_usable", f"WITH {USABLE_SQL} SELECT *, covered AND same_inputs AS usable FROM us")
def expression_cache_usable(spark, d):
    """Which cached sources still describe the cells and files there are."""
    return cached_expression(spark, d)[1]


@query("expression_cache_rows", f"""WITH {USABLE_SQL} SELECT e.fov, cell, modality, hybe, channel, CASE WHEN covered AND same_inputs THEN n_spots + 1000 ELSE n_spots END AS n_spots FROM m_expr e JOIN us USING (fov, modality, hybe, channel)""")
def expression_cache_rows(spark, d):
    """Cached rows (marked by 1,000 spots more) where usable, fresh ones elsewhere."""
    return CA.cached_or_fresh(*cached_expression(spark, d)).select("fov", "cell", *CA.SOURCE, "n_spots")


@query("speckle_scan", """
SELECT fov, cell, uid, raw_y AS y, raw_x AS x FROM m_spots WHERE modality = 'RNA' AND hybe = 'Hyb_002' AND fov = 4 AND cell IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 25 = 4 AND o_orderkey < 2000)""")
def speckle_scan(spark, d):
    """Speckles of some cells of one field, without their images."""
    s = T.spots(spark, d).where("modality = 'RNA' and hybe = 'Hyb_002' and cell >= 0")
    path = scratch(spark, "speckles")
    CA.write_speckles(s.select("fov", "cell", "uid", F.col("raw_y").alias("y"), F.col("raw_x").alias("x"), F.encode(F.repeat(F.lit("pixel"), 50), "utf-8").alias("lab")), path)
    return CA.read_speckles(spark, path, 4, [k for k in range(2000) if k % 25 == 4], images=False).select("fov", "cell", "uid", "y", "x")


@query("repeat_report", """
WITH k AS (SELECT fov, cell, allele_id, CASE slot WHEN 5 THEN 102 ELSE 101 + slot END AS rid, slot < 5 AS h, y_um, x_um, z_um FROM m_polymer WHERE slot <= 5),
p AS (SELECT a.rid, NOT b.h AS same, sqrt((a.y_um-b.y_um)*(a.y_um-b.y_um) + (a.x_um-b.x_um)*(a.x_um-b.x_um) + (a.z_um-b.z_um)*(a.z_um-b.z_um)) AS d
  FROM k a JOIN k b USING (fov, cell, allele_id) WHERE a.h AND a.rid = 102 AND ((b.h AND b.rid <> 102) OR (NOT b.h AND b.rid = 102)))
SELECT CAST(rid AS INTEGER) AS readout_id, count(*) FILTER (same) AS n, round(median(d) FILTER (same), 6) AS median_um, count(*) FILTER (NOT same) AS n_null, round(median(d) FILTER (NOT same), 6) AS null_median_um,
  median(d) FILTER (same) < median(d) FILTER (NOT same) AS beats_null FROM p GROUP BY 1""")
def repeat_report(spark, d):
    """Every repeated readout of the layout against its null."""
    slots = T.layout(spark, d).where("modality = 'DNA'").select((F.col("hybe_num") - 1).alias("slot"), "readout_id", "datatype")
    out = RP.repeat_report(RP.repeat_distances(polymer_of(spark, d), slots))
    return out.withColumns({c: r(c) for c in ("median_um", "null_median_um")})


@query("expected_targets", """
WITH l AS (SELECT modality, hybe, fiducial_channel, CASE WHEN hybe_num % 2 = 0 THEN readout_name || '_mRNA' WHEN hybe_num = 7 THEN 'Toe_exon_exon' ELSE readout_name END AS name, unnest([488, 555, 635]) AS channel FROM m_layout)
SELECT DISTINCT modality, hybe, CAST(channel AS INTEGER) AS channel FROM (
SELECT 'DNA' AS modality, 'Hyb_001' AS hybe, 635 AS channel UNION ALL SELECT 'DNA', h, c FROM (VALUES ('Hyb_003'), ('Toe_050')) a(h), (VALUES (635), (747)) b(c) UNION ALL SELECT 'RNA', 'Hyb_005', 555
UNION ALL SELECT modality, hybe, channel FROM l WHERE name LIKE '%\\_mRNA' ESCAPE '\\' AND channel NOT IN (488, 555)) WHERE channel IN (635, 747)""")
def expected_targets(spark, d):
    """Anchor, tracing rounds, gene sources and countable rounds, kept to the chosen channels."""
    n = F.col("hybe_num")
    lay = T.layout(spark, d).select("modality", "hybe", "fiducial_channel", F.array(F.lit(488), F.lit(555), F.lit(635)).alias("channels"),
                                    F.when(n % 2 == 0, F.concat("readout_name", F.lit("_mRNA"))).when(n == 7, "Toe_exon_exon").otherwise(F.col("readout_name")).alias("readout_name"))
    return ST.expected_targets(lay, ("DNA", "Hyb_001", 635), [("DNA", "Hyb_003"), ("DNA", "Toe_050"), ("none", "Hyb_001")], [635, 747], [("RNA", "Hyb_005", 555)], [635, 747])


@query("key_bins", """
WITH u AS (SELECT DISTINCT fov, allele_id, 'Hyb_00' || CAST(slot + 1 AS VARCHAR) AS hybe, CASE WHEN fov >= 12 THEN 488 END AS channel FROM m_candidates
  UNION SELECT fov, allele_id, 'Hyb_003', NULL FROM m_alleles WHERE allele_id % 13 = 0),
s AS (SELECT * FROM (VALUES ('Hyb_001', 488, 101, 'H', 0), ('Hyb_002', 488, 102, 'H', 1), ('Hyb_003', 488, 103, 'H', 2), ('Hyb_003', 635, 104, 'H', 3), ('Hyb_006', 488, 102, 'R', -1)) t(hybe, channel, rindex, dtype, pindex))
SELECT u.fov, u.allele_id, u.hybe, u.channel, s.rindex, s.dtype, s.pindex FROM u JOIN s ON s.hybe = u.hybe AND (s.channel = u.channel OR (u.channel IS NULL AND u.hybe <> 'Hyb_003'))""")
def key_bins(spark, d):
    """The bin of every key an allele uses in any of its parts; a bare Hyb_003 fills two slots and has none."""
    channel = F.when(F.col("fov") >= 12, 488).alias("channel")
    cand = T.candidates(spark, d).select("fov", "allele_id", F.concat(F.lit("Hyb_00"), (F.col("slot") + 1).cast("string")).alias("hybe"), channel)
    rejected = T.alleles(spark, d).where("allele_id % 13 = 0").select("fov", "allele_id", F.lit("Hyb_003").alias("hybe"), F.lit(None).cast("int").alias("channel"))
    slots = spark.createDataFrame([("Hyb_001", 488, 101, "H", 0), ("Hyb_002", 488, 102, "H", 1), ("Hyb_003", 488, 103, "H", 2), ("Hyb_003", 635, 104, "H", 3), ("Hyb_006", 488, 102, "R", -1)],
                                  "hybe string, channel int, rindex int, dtype string, pindex int")
    return RO.bins_of_keys([cand, rejected], slots)


@query("reference_points", """
SELECT s.fov, uid, round(w_yy * raw_y + w_yx * raw_x + w_yt, 9) AS ref_y, round(w_xy * raw_y + w_xx * raw_x + w_xt, 9) AS ref_x, round(raw_y, 8) AS back_y, round(raw_x, 8) AS back_x
FROM m_spots s JOIN m_within w USING (fov, modality, hybe)""")
def reference_points(spark, d):
    """Spots carried into the reference frame and back into their round's own."""
    s = T.spots(spark, d).where("hybe <> 'Hyb_005'").select("fov", "uid", "modality", "hybe", F.col("raw_y").alias("y"), F.col("raw_x").alias("x"))
    m = T.fov_matrices(spark, d)
    there = FR.map_points(s, m).select("fov", "uid", "modality", "hybe", F.col("ref_y").alias("y"), F.col("ref_x").alias("x"))
    back = FR.map_points(there, m, inverse=True)
    return back.select("fov", "uid", *[r(a, k).alias(b) for a, b, k in (("y", "ref_y", 9), ("x", "ref_x", 9), ("raw_y", "back_y", 8), ("raw_x", "back_x", 8))])
