"""Lake layout of the model tables: partitioned parquet, slice replacement, exports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chromaloom.functions.text import file_name_parts, int_list, readout_pairs

SLICE = ["fov", "modality", "hybe", "channel"]
UID_BUCKETS = 256
SLICE_ROWS = 5_000_000       # rows of one file of a slice
SHEET_ROWS = 1_048_575      # fixed row limit of a spreadsheet


def write_spots(spots: DataFrame, path: str) -> None:
    """Replace exactly the slices present in `spots`; a duplicate uid inside a slice is refused."""
    dup = spots.groupBy(*SLICE, "uid").count().where("count > 1").limit(1)
    if not dup.isEmpty():
        raise ValueError("duplicate uid inside a slice")
    # one task per slice, so a slice is one file and not one per task; a very large one is cut by rows
    (spots.repartition(*SLICE).write.option("maxRecordsPerFile", SLICE_ROWS).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*SLICE).parquet(path))


def write_by_fov(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fov").parquet(path)


def read_spots(spark: SparkSession, path: str, fov=None, modality=None, hybe=None, channel=None) -> DataFrame:
    """A fully named slice prunes to one partition folder."""
    df = spark.read.parquet(path)
    for name, value in (("fov", fov), ("modality", modality), ("hybe", hybe), ("channel", channel)):
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def spot_slices(spots: DataFrame) -> DataFrame:
    return spots.groupBy(*SLICE).agg(F.count(F.lit(1)).alias("n_spots"))


def fov_counts(cells: DataFrame, spots: DataFrame, alleles: DataFrame) -> DataFrame:
    """Per FOV: number of cells, spots and alleles, from three map-side combined counts."""
    def n(df, name):
        return df.groupBy("fov").agg(F.count(F.lit(1)).alias(name))
    out = n(cells, "n_cells").join(n(spots, "n_spots"), "fov", "full").join(n(alleles, "n_alleles"), "fov", "full")
    return out.select("fov", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n_cells", "n_spots", "n_alleles")])


def allocate_uids(new_rows: DataFrame, floor: DataFrame, order: list[str], deal_by: str) -> DataFrame:
    """uid = floor(fov) + 1, +2, ...: unique per FOV and never below an issued one.

    Rows of a FOV are dealt into buckets, numbered inside a bucket and shifted by
    the bucket offsets, so a FOV with most rows never sits in one task.
    """
    dealt = new_rows.withColumn("__b", F.pmod(F.col(deal_by), F.lit(UID_BUCKETS)).cast("int"))
    counts = dealt.groupBy("fov", "__b").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy("fov").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)   # <= UID_BUCKETS rows
    offsets = counts.select("fov", "__b", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    local = F.row_number().over(Window.partitionBy("fov", "__b").orderBy(*order))
    out = dealt.withColumn("__rn", local).join(offsets, ["fov", "__b"]).join(floor.select("fov", "max_uid"), "fov", "left")
    return out.withColumn("new_uid", F.coalesce("max_uid", F.lit(-1)) + F.col("__off") + F.col("__rn")).drop(
        "__b", "__rn", "__off", "max_uid")


def uid_floor(spots: DataFrame, uid: str = "uid") -> DataFrame:
    return spots.groupBy("fov").agg(F.max(uid).alias("max_uid"), F.count(F.lit(1)).alias("n_spots"))


def merge_matrices(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace the old ones of the same key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def append_missing(cached: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Append mode: cached groups stay, only uncovered ones are added."""
    return cached.unionByName(fresh.join(cached.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def stale_keys(stamps: DataFrame, cached_stamps: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose input stamp (modification time, size) differs from the cached one or is new."""
    old = cached_stamps.select(*keys, F.col("mtime").alias("__m"), F.col("size").alias("__s"))
    same = F.col("mtime").eqNullSafe(F.col("__m")) & F.col("size").eqNullSafe(F.col("__s"))
    return stamps.join(old, keys, "left").where(~same).select(*keys)


def container_diff(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, change): added, removed or changed; missing values compare equal."""
    def packed(df, name):
        return df.select(*keys, F.struct(*fields).alias(name))
    both = packed(old, "__o").join(packed(new, "__n"), keys, "full")
    change = F.when(F.col("__o").isNull(), "added").when(F.col("__n").isNull(), "removed").when(
        ~F.col("__o").eqNullSafe(F.col("__n")), "changed")
    return both.select(*keys, change.alias("change")).where(F.col("change").isNotNull())


def write_sheet(df: DataFrame, path: str, mark: bool = True) -> None:
    """CSV folder; partitions are written in parallel and published by the committer.

    With `mark` every file opens with a byte order mark, by which spreadsheets know UTF-8.
    """
    named = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0]) if mark else df
    named.write.mode("errorifexists").option("header", True).csv(path)


def read_sheet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A sheet back as a table; the mark before the first header is skipped with the header."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)


def fits_sheet(df: DataFrame) -> bool:
    """Whether a spreadsheet could hold the rows; callers fall back to CSV otherwise."""
    return df.limit(SHEET_ROWS + 1).count() <= SHEET_ROWS


def free_path(spark: SparkSession, path: str) -> str:
    """`path`, or the first of path_2, path_3, ... that does not exist yet."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    taken, k = path, 1
    while fs.exists(jvm.org.apache.hadoop.fs.Path(taken)):
        k += 1
        taken = f"{path}_{k}"
    return taken


def write_result(df: DataFrame, summary: DataFrame, gate: dict, params: dict, path: str) -> str:
    """A result table with its sidecar (gate, per-celltype counts, parameters). A taken name gets
    the next suffix, nothing is overwritten; returns the path written."""
    path = free_path(df.sparkSession, path)
    df.write.mode("errorifexists").parquet(f"{path}/table")
    side = summary.withColumns({"gate": F.lit(json.dumps(gate)), "params": F.lit(json.dumps(params))})
    side.write.mode("errorifexists").json(f"{path}/sidecar")
    return path


def read_verdict_log(spark: SparkSession, path: str) -> DataFrame:
    """Append-only reviewer log, one JSON record per line; broken lines are skipped, not fatal."""
    schema = ("reviewer string, key string, page int, at timestamp_ntz, seed long, "
              "shown array<struct<y: double, x: double, z: double, keep: int, p: double, feat: array<double>>>, "
              "added array<struct<y: double, x: double>>, _broken string")
    log = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    return log.select("*", F.col("_metadata.file_name").alias("file_name")).where(F.col("_broken").isNull()).drop("_broken")


def read_probe_bed(spark: SparkSession, path: str) -> DataFrame:
    """BED region table -> (rid, chrom, start, end); the name's trailing number is the readout id."""
    f = F.split("value", "\t")
    rid = F.nullif(F.regexp_extract(F.element_at(f, 4), r"(\d+)\s*$", 1), F.lit("")).cast("int")
    rows = spark.read.text(path).where(F.size(f) >= 4).where(
        F.element_at(f, 2).rlike(r"^\d+$") & F.element_at(f, 3).rlike(r"^\d+$")).select(
        rid.alias("rid"), F.element_at(f, 1).alias("chrom"), F.element_at(f, 2).cast("long").alias("start"),
        F.element_at(f, 3).cast("long").alias("end"), F.monotonically_increasing_id().alias("line"))
    return _one_per_readout(rows, -F.col("line"))


def read_probe_fasta(spark: SparkSession, path: str) -> DataFrame:
    """FASTA headers `...name_001_chr20:100-200` -> (rid, chrom, start, end); the first header of an id wins."""
    h = F.trim(F.substring("value", 2, 100000))
    before = F.regexp_extract(h, r"^(.*?):\d+-\d+", 1)
    token = r"((?:chr|Chr|CHR|NC_|NW_|NT_|scaffold|contig)[0-9A-Za-z_.]*)$"
    chrom = F.regexp_extract(before, token, 1)
    gene = F.regexp_extract(h, r"gene=(\S+)", 1)
    name = F.when(gene != "", gene).otherwise(F.rtrim(F.regexp_replace(before, token, ""), F.lit("_")))
    rows = spark.read.text(path).where(F.col("value").startswith(">") & h.rlike(r":\d+-\d+")).select(
        F.nullif(F.regexp_extract(name, r"(\d+)\s*$", 1), F.lit("")).cast("int").alias("rid"),
        F.when(chrom != "", chrom).otherwise(F.element_at(F.split(before, "_"), -1)).alias("chrom"),
        F.regexp_extract(h, r":(\d+)-(\d+)", 1).cast("long").alias("start"),
        F.regexp_extract(h, r":(\d+)-(\d+)", 2).cast("long").alias("end"), F.monotonically_increasing_id().alias("line"))
    return _one_per_readout(rows, F.col("line"))


def _one_per_readout(rows: DataFrame, order) -> DataFrame:
    out = rows.where(F.col("rid").isNotNull()).groupBy("rid").agg(F.min_by(F.struct("chrom", "start", "end"), order).alias("r")).select("rid", "r.*")
    if out.limit(1).isEmpty():
        raise ValueError("the design carries no readout regions")
    return out


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """Layout table from CSV: list columns parsed, optional columns defaulted, frames per channel derived."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)

    def optional(name, default=None):
        return F.col(name) if name in raw.columns else F.lit(default).cast("string")

    channels = int_list("channels")
    pairs = readout_pairs(optional("readoutChannels", ""))
    own = F.array(F.struct(F.lit(None).cast("int").alias("channel"), F.col("Readouts").cast("int").alias("readout_id")))
    lost = F.exists(pairs, lambda p: ~F.array_contains(channels, p["channel"]) | (p["channel"] == F.col("fiducialChannel").cast("int")))
    twice = F.size(F.array_distinct(F.transform(pairs, lambda p: p["readout_id"]))) < F.size(pairs)
    checked = F.when(F.coalesce(lost | twice, F.lit(False)), F.raise_error(F.concat(F.lit("bad readoutChannels in "), F.col("FolderName"))).cast(
        "array<struct<channel:int,readout_id:int>>")).when(F.size(pairs) > 0, pairs).otherwise(own)
    start, end = (F.coalesce(optional(c).cast("int"), F.lit(0)) for c in ("bufferFrames", "bufferFramesEnd"))
    return raw.select(
        F.col("FolderName").alias("hybe"), F.col("Readouts").cast("int").alias("readout_id"), checked.alias("readouts"),
        F.upper("DataType").alias("datatype"), F.col("HybNum").cast("int").alias("hybe_num"), channels.alias("channels"),
        F.col("fiducialChannel").cast("int").alias("fiducial_channel"), optional("channelLayout").alias("channel_layout"),
        F.col("totalFrames").cast("int").alias("total_frames"), optional("rnaNames").alias("readout_name"),
        start.alias("buffer_frames"), end.alias("buffer_frames_end"),
        F.floor((F.col("totalFrames").cast("int") - start - end) / F.size(channels)).cast("int").alias("planes"))


def discover_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, fov, job, idx, channel_no) of the image files under a folder; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(
        "path", F.col("length").alias("size"), "modificationTime")
    return files.withColumn("n", file_name_parts("path")).where(F.col("n").isNotNull()).select("path", "size", "modificationTime", "n.*")


def input_stamps(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """(keys, mtime, size): newest modification and total size of the files behind each key."""
    per_file = spark.read.parquet(path).groupBy(*keys, "_metadata.file_path").agg(
        F.max("_metadata.file_modification_time").alias("m"), F.max("_metadata.file_size").alias("s"))
    return per_file.groupBy(*keys).agg(F.max("m").alias("mtime"), F.sum("s").alias("size"))


def order_columns(df: DataFrame, declared: list[str]) -> DataFrame:
    """Declared columns in their order, then whatever else the table carries, sorted."""
    return df.select(*[c for c in declared if c in df.columns], *sorted(c for c in df.columns if c not in declared))


def property_type(kinds: set[str]) -> str:
    """Spark type of an open property from the kinds (bool, int, float, string) its values show."""
    if kinds <= {"bool"} and kinds:
        return "boolean"
    if kinds <= {"bool", "int"} and kinds:
        return "bigint"
    if kinds <= {"bool", "int", "float"}:
        return "double"
    if kinds == {"string"}:
        return "string"
    raise ValueError(f"a property cannot mix {sorted(kinds)}")


def resolve_fov_index(rounds: DataFrame, fov_map: DataFrame) -> DataFrame:
    """File index of each (folder, fov): the folder's own row, else the `*` row, else fov - 1."""
    own = fov_map.where(F.col("folder") != "*").select("folder", "fov", F.col("index").alias("__own"))
    star = fov_map.where(F.col("folder") == "*").select("fov", F.col("index").alias("__star"))
    return rounds.join(own, ["folder", "fov"], "left").join(star, "fov", "left").withColumn(
        "index", F.coalesce("__own", "__star", F.col("fov") - 1)).drop("__own", "__star")
