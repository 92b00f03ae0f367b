import json

import pytest
from pyspark.sql import functions as F

from chromaloom.functions import affine, text
from chromaloom.operators import cellcycle, frames, labels, status
from chromaloom.sources import store
from chromaloom.streaming import verdicts as stream

SPOT = "fov int, modality string, hybe string, channel int, uid long, brightness double"


def test_slice_replacement_touches_only_its_slices(spark, tmp_path):
    path = str(tmp_path / "spots")
    store.write_spots(spark.createDataFrame([(1, "RNA", "Hyb_001", 555, 1, 1.0), (1, "RNA", "Hyb_002", 555, 2, 2.0), (2, "RNA", "Hyb_001", 555, 1, 3.0)], SPOT), path)
    store.write_spots(spark.createDataFrame([(1, "RNA", "Hyb_001", 555, 9, 9.0)], SPOT), path)
    got = {(r["fov"], r["hybe"], r["uid"]) for r in store.read_spots(spark, path).collect()}
    assert got == {(1, "Hyb_001", 9), (1, "Hyb_002", 2), (2, "Hyb_001", 1)}
    one = store.read_spots(spark, path, 1, "RNA", "Hyb_002", 555)
    assert one.count() == 1 and "PartitionFilters: [isnotnull" in one._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="duplicate uid"):
        store.write_spots(spark.createDataFrame([(1, "RNA", "Hyb_001", 555, 9, 9.0), (1, "RNA", "Hyb_001", 555, 9, 8.0)], SPOT), path)


def test_uids_are_dense_and_above_the_floor(spark):
    rows = spark.range(5000).select((F.col("id") % 3).cast("int").alias("fov"), "id")
    floor = spark.createDataFrame([(0, 99), (1, 4)], "fov int, max_uid long")
    out = store.allocate_uids(rows, floor, ["id"], "id").groupBy("fov").agg(F.min("new_uid").alias("lo"), F.max("new_uid").alias("hi"), F.count_distinct("new_uid").alias("n"))
    got = {r["fov"]: (r["lo"], r["hi"] - r["lo"] + 1 == r["n"]) for r in out.collect()}
    assert got == {0: (100, True), 1: (5, True), 2: (0, True)}


def test_probe_bed_and_fov_map(spark, tmp_path):
    (tmp_path / "design.bed").write_text("chr1\t100\t300\tREG_001\nchr1\tx\t5\tREG_9\ntrack name\nchr2\t10\t30\tREG_002\textra\n")
    got = {r["rid"]: (r["chrom"], r["start"], r["end"]) for r in store.read_probe_bed(spark, str(tmp_path / "design.bed")).collect()}
    assert got == {1: ("chr1", 100, 300), 2: ("chr2", 10, 30)}
    rounds = spark.createDataFrame([("A", 1), ("A", 2), ("B", 1), ("B", 3)], "folder string, fov int")
    fmap = spark.createDataFrame([("A", 1, 7), ("*", 1, 5), ("*", 2, 6)], "folder string, fov int, index int")
    out = {(r["folder"], r["fov"]): r["index"] for r in store.resolve_fov_index(rounds, fmap).collect()}
    assert out == {("A", 1): 7, ("A", 2): 6, ("B", 1): 5, ("B", 3): 2}


def test_verdict_log_skips_broken_lines(spark, tmp_path):
    rec = {"reviewer": "a", "key": "k", "page": 1, "at": "2024-01-01T10:00:00", "shown": [{"y": 1, "x": 2, "z": 0, "keep": 1}]}
    (tmp_path / "a.jsonl").write_text(json.dumps(rec) + "\n{broken\n")
    log = store.read_verdict_log(spark, str(tmp_path)).collect()
    assert len(log) == 1 and log[0]["shown"][0]["keep"] == 1 and log[0]["file_name"] == "a.jsonl"


def test_results_never_overwrite(spark, tmp_path):
    df = spark.range(3)
    at = str(tmp_path / "r")
    paths = [store.write_result(part, df.groupBy().count(), {"clauses": []}, {"bins": k}, at) for k, part in enumerate((df, df.limit(1), df.limit(2)))]
    assert paths == [at, f"{at}_2", f"{at}_3"] and [spark.read.parquet(f"{p}/table").count() for p in paths] == [3, 1, 2]
    assert store.fits_sheet(df)


def test_text_parsers(spark):
    one = spark.range(1).select(
        text.int_list(F.lit("[488, 555]")).alias("ints"), text.readout_pairs(F.lit("635:1, 747:51")).alias("pairs"),
        text.file_name_parts(F.lit("/d/run_Pos12__stain_a_003_RAW_ch02.tif")).alias("name"), text.reference_target(F.lit("Hyb_103(cell 3)->Hyb_101 [ok]")).alias("target"),
        text.parse_map_entries(F.lit("slots=80,Hyb_001|635|1|h|0, Hyb_002|635|2|R|-1")).alias("entries"), text.declared_slots(F.lit("slots=80,a|1|1|H|0")).alias("slots"))
    r = one.first()
    assert r["ints"] == [488, 555] and [tuple(p) for p in r["pairs"]] == [(635, 1), (747, 51)]
    assert tuple(r["name"]) == (12, "stain_a", 3, 2) and r["target"] == "Hyb_101" and r["slots"] == 80
    assert [tuple(e) for e in r["entries"]] == [("Hyb_001", 635, 1, "H", 0), ("Hyb_002", 635, 2, "R", -1)]
    assert text.parse_number_ranges("1-3, 7,2") == [1, 2, 3, 7]


def test_affine_algebra(spark):
    a = affine.make(yy=F.lit(0.9), yx=F.lit(-0.2), yt=F.lit(5.0), xy=F.lit(0.2), xx=F.lit(0.95), xt=F.lit(-3.0))
    df, h = affine.of("a").stage(spark.range(1).select(a.alias("a")), "h")
    df, inv = affine.inverse(h).stage(df, "i")
    df, both = affine.compose(inv, h).stage(df, "b")
    y, x = h.y(F.lit(2.0), F.lit(7.0)), h.x(F.lit(2.0), F.lit(7.0))
    r = df.select(*both, inv.y(y, x).alias("y"), inv.x(y, x).alias("x")).first()
    assert [round(v, 12) for v in r] == [1, 0, 0, 0, 1, 0, 2, 7]


def test_hub_is_the_modality_without_a_bridge(spark):
    mods = spark.createDataFrame([("DNA",), ("RNA",)], "modality string")
    assert frames.infer_hub(mods, mods.where("modality = 'RNA'")) == "DNA"
    with pytest.raises(ValueError):
        frames.infer_hub(mods, mods.limit(0))


def test_votes(spark):
    rows = [("r1", 1), ("r2", 0), ("r3", -1)]
    shown = spark.createDataFrame([(w, "k", 0, 1.0, float(s), 0.0, k if s == 0 else (-1 if s == 1 else 1), 1.0 if s < 3 or w != "r2" else 1.5) for s in range(4) for w, k in rows],
                                  "reviewer string, key string, page int, y double, x double, z double, keep int, feat double")
    got = {r["x"]: r["label"] for r in labels.spot_votes(shown).collect()}
    assert got == {0.0: "contested", 1.0: "undetermined", 2.0: "positive", 3.0: "inconsistent"}


def test_one_class_has_no_auc(spark):
    one = spark.createDataFrame([(1, 0.2), (1, 0.4)], "y int, score double")
    assert labels.roc_auc(one).first()[0] is None and labels.pr_auc(one).first()[0] is None
    s = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)], "y int, score double")
    assert labels.roc_auc(s).first()[0] == pytest.approx(0.875)


def test_plan_policies(spark):
    s = spark.createDataFrame([("a", 1, "done"), ("a", 2, "partial"), ("b", 1, "n/a"), ("b", 2, "done")], "step string, fov int, state string")
    got = {(r["step"], r["fov"]) for r in status.plan(s, {"b": "redo"}).collect()}
    assert got == {("a", 2), ("b", 2)}
    with pytest.raises(ValueError):
        status.plan(s, {"a": "later"})


def test_first_listed_arc_wins(spark):
    arcs = [{"name": "G1", "start_deg": 300, "end_deg": 60}, {"name": "S", "start_deg": 60, "end_deg": 200}]
    df = spark.createDataFrame([(0.0,), (60.0,), (300.0,), (250.0,), (None,)], "theta_deg double")
    assert [r[0] for r in df.select(cellcycle.categorize("theta_deg", arcs)).collect()] == ["G1", "G1", "G1", "", ""]
    assert {r["category"] for r in cellcycle.assign(df, arcs, {"min_R": 0.5}).collect()} == {""}


def test_windowed_submissions_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("a", "2024-01-01 10:00:00"), ("a", "2024-01-01 11:00:00"), ("b", "2024-01-02 09:00:00"), ("a", "2024-01-09 00:00:00")],
                          "reviewer string, t string").selectExpr("reviewer", "timestamp(t) as at").coalesce(1).write.parquet(str(src))
    q = (stream.submissions_per_window(stream.read_events(spark, str(src), spark.read.parquet(str(src)).schema, glob="*.parquet"))
         .writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {(r["reviewer"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 2), ("b", 1)}


def test_layout_fasta_files_and_stamps(spark, tmp_path):
    head = "FolderName,Readouts,DataType,HybNum,channels,fiducialChannel,channelLayout,totalFrames,readoutChannels,bufferFrames\n"
    (tmp_path / "layout.csv").write_text(head + 'Hyb_001,1,h,1,"[488, 635, 747]",488,x,310,"635:1, 747:51",10\nHyb_002,2,R,2,"[488, 635]",488,x,200,,\n')
    got = {r["hybe"]: r for r in store.read_layout(spark, str(tmp_path / "layout.csv")).collect()}
    assert got["Hyb_001"]["planes"] == 100 and [tuple(p) for p in got["Hyb_001"]["readouts"]] == [(635, 1), (747, 51)]
    assert [tuple(p) for p in got["Hyb_002"]["readouts"]] == [(None, 2)] and got["Hyb_002"]["buffer_frames"] == 0 and got["Hyb_002"]["planes"] == 100
    (tmp_path / "bad.csv").write_text(head + 'Hyb_001,1,h,1,"[488, 635]",488,x,310,"747:1",10\n')
    with pytest.raises(Exception, match="bad readoutChannels"):
        store.read_layout(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "d.fasta").write_text(">lib_RSF1_003_chr20:100-200 x\nACGT\n>p gene=RSF1_007 chr2:5-9\nA\n>none\n")
    assert {r["rid"]: (r["chrom"], r["start"]) for r in store.read_probe_fasta(spark, str(tmp_path / "d.fasta")).collect()}[3] == ("chr20", 100)
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "run_Pos3__job_12_RAW_ch01.tif").write_bytes(b"1234")
    (tmp_path / "img" / "note.txt").write_text("x")
    f = store.discover_files(spark, str(tmp_path / "img")).collect()
    assert [(r["fov"], r["job"], r["idx"], r["size"]) for r in f] == [(3, "job", 12, 4)]
    spark.range(10).withColumn("fov", F.lit(1)).write.parquet(str(tmp_path / "t"))
    stamps = store.input_stamps(spark, str(tmp_path / "t"), ["fov"])
    assert stamps.count() == 1 and store.stale_keys(stamps, stamps, ["fov"]).count() == 0
    assert store.order_columns(spark.createDataFrame([(1, 2, 3)], "z int, b int, a int"), ["b"]).columns == ["b", "a", "z"]
    assert store.property_type({"int", "float"}) == "double" and store.property_type(set()) == "double"
    with pytest.raises(ValueError):
        store.property_type({"int", "string"})


def codes_of(spark, line):
    rows = text.explode_readout_codes(spark.createDataFrame([(line,)], "codes string"), "codes").orderBy("position").collect()
    return [(r["position"], r["datatype"], r["number"], r["name"]) for r in rows]


def test_readout_codes(spark):
    assert codes_of(spark, "1-3 r5, R10\tT10 B130 DAPI 0 -7 1050 2007") == [
        (0, "H", 1, None), (1, "H", 2, None), (2, "H", 3, None), (3, "R", 5, None), (4, "R", 10, None), (5, "T", 10, None), (6, "B", 130, None),
        (7, "H", None, "DAPI"), (9, "R", 7, None), (10, "T", 50, None), (11, "B", 7, None)]
    assert codes_of(spark, "r104-r105 t9-10 7-b8") == [(0, "R", 104, None), (1, "R", 105, None), (2, "T", 9, None), (3, "T", 10, None), (4, "B", 7, None), (5, "B", 8, None)]
    assert codes_of(spark, "  ") == []


@pytest.mark.parametrize("line", ["1000", "2000", "3000", "r0", "h1000", "5-3", "r4-t6", "-3-5", "a-b", "1.5", "r104-1100"])
def test_codes_outside_the_grammar_are_refused(spark, line):
    with pytest.raises(Exception):
        codes_of(spark, line)


def test_sheet_has_a_mark_and_reads_back(spark, tmp_path):
    df = spark.createDataFrame([("é, x", 1), (None, 2)], "name string, n int")
    store.write_sheet(df.coalesce(1), str(tmp_path / "s"))
    raw = next((tmp_path / "s").glob("part-*.csv")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfname,n")
    assert sorted(map(tuple, store.read_sheet(spark, str(tmp_path / "s"), "name string, n int").collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_a_slice_is_one_file(spark, tmp_path):
    df = spark.range(200).selectExpr("cast(id % 3 as int) fov", "'DNA' modality", "'Hyb_001' hybe", "488 channel", "id uid").repartition(8)
    store.write_spots(df, str(tmp_path / "p"))
    assert len(list((tmp_path / "p").rglob("part-*.parquet"))) == 3


def test_map_entries_keep_their_digits(spark):
    line = ",".join(f"Hyb_{k}|{k}|{k}|H|{k if k % 2 else -1}" for k in range(13))
    got = spark.range(1).select(text.parse_map_entries(F.lit(line)).alias("e")).first()["e"]
    assert [tuple(e) for e in got] == [(f"Hyb_{k}", k, k, "H", k if k % 2 else -1) for k in range(13)]


def test_a_map_text_is_read_once(spark):
    """The text does not travel with its entries, whose number it would multiply."""
    from chromaloom.functions import text as TX

    df = spark.createDataFrame([("p", "slots=9, a|488|1|h|0,b|555|2|R|-1"), ("q", "c|488|3|H|0")], "panel string, text string")
    out = TX.explode_map(df, "text")
    assert sorted((r.panel, r.slots, r.e.hybe, r.e.dtype, r.e.pindex) for r in out.collect()) == [("p", 9, "a", "H", 0), ("p", 9, "b", "R", -1), ("q", None, "c", "H", 0)]
    above = out._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert "regexp_extract" not in above and "text" not in above
