"""String parsing helpers: layout text, readout codes, ranges, map text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalar import col


def int_list(text) -> Column:
    """`[488, 555]` -> array<int>."""
    inner = F.regexp_replace(col(text), r"[\[\]\s]", "")
    return F.when(inner == "", F.array().cast("array<int>")).otherwise(F.split(inner, ",").cast("array<int>"))


def readout_pairs(text) -> Column:
    """`635:1, 747:51` -> array<struct<channel, readout_id>>."""
    parts = F.split(F.regexp_replace(col(text), r"\s", ""), ",")
    return F.transform(
        F.filter(parts, lambda p: p != ""),
        lambda p: F.struct(
            F.split_part(p, F.lit(":"), F.lit(1)).cast("int").alias("channel"),
            F.split_part(p, F.lit(":"), F.lit(2)).cast("int").alias("readout_id"),
        ),
    )


def _code_list(token: Column) -> Column:
    """One token of a round list as array<struct<code, name>>; anything else is an error.

    n is a hybe, -n a repeat, 1000+n a toe, 2000+n a barcode, 0 a skip; h, r, t and b before a number
    say the same; ranges run between plain numbers with one letter at most; a bare name is a
    named hybe.
    """
    span, lettered = r"^([hHrRtTbB]?)(\d+)-([hHrRtTbB]?)(\d+)$", r"^([hHrRtTbB])(\d+)$"
    entry = "array<struct<code:bigint,name:string>>"
    la, lb = (F.upper(F.regexp_extract(token, span, k)) for k in (1, 3))
    lo, hi = (F.regexp_extract(token, span, k).try_cast("bigint") for k in (2, 4))

    def refuse(why: str) -> Column:
        return F.raise_error(F.concat(token, F.lit(f": {why}"))).cast(entry)

    def coded(letter: Column, n: Column) -> Column:
        return F.when(letter == "R", -n).when(letter == "T", n + 1000).when(letter == "B", n + 2000).otherwise(n)

    def one(code: Column) -> Column:
        return F.array(F.struct(code.alias("code"), F.lit(None).cast("string").alias("name")))

    letter = F.when(la != "", la).when(lb != "", lb).otherwise("H")
    numbered = F.transform(F.sequence(lo, F.greatest(lo, hi)), lambda n: F.struct(coded(letter, n).alias("code"), F.lit(None).cast("string").alias("name")))
    single, at = F.upper(F.regexp_extract(token, lettered, 1)), F.regexp_extract(token, lettered, 2).try_cast("bigint")
    return (F.when(token.rlike(span), F.when((la != "") & (lb != "") & (la != lb), refuse("range ends disagree"))
                   .when(hi < lo, refuse("descending range"))
                   .when((letter != "H") & ((lo < 1) | (hi > 999)), refuse("the number must be 1 to 999")).otherwise(numbered))
            .when(token.rlike(lettered), F.when((at < 1) | (at > 999) | at.isNull(), refuse("the number must be 1 to 999")).otherwise(one(coded(single, at))))
            .when(token.rlike(r"^-?\d+$"), one(token.try_cast("bigint")))
            .when(token.rlike(r"^[A-Za-z][A-Za-z0-9]*$"), F.array(F.struct(F.lit(None).cast("bigint").alias("code"), token.alias("name"))))
            .otherwise(refuse("neither a readout code nor a name")))


def explode_readout_codes(df: DataFrame, text: str) -> DataFrame:
    """`1-3 r5 T10 DAPI 0` -> one row per round: position, datatype, number and, of a named hybe, its name.

    Positions count the skipped rounds (0), which have no row. Codes outside the grammar (1000,
    2000, 3000 and above) and tokens of no form are errors, never silently left out.
    """
    tokens = F.filter(F.split(F.trim(F.col(text)), r"[,\s]+"), lambda t: t != "")
    codes = F.flatten(F.transform(tokens, _code_list))
    c = F.col("__c.code")
    bad = c.isin(1000, 2000) | (c >= 3000)
    kind = (F.when(F.col("__c.name").isNotNull(), "H").when(bad, F.raise_error(F.concat(F.lit("readout code outside the grammar: "), c.cast("string"))).cast("string"))
            .when(c < 0, "R").when(c < 1000, "H").when(c < 2000, "T").otherwise("B"))
    number = F.when(c < 0, -c).otherwise(c % 1000)
    out = df.select("*", F.posexplode(codes).alias("position", "__c"))
    return out.where(F.coalesce(c != 0, F.lit(True))).select(
        *df.columns, "position", kind.alias("datatype"), number.cast("int").alias("number"), F.col("__c.name").alias("name"))


def file_name_parts(path) -> Column:
    """`{opener}_Pos{fov}__{job}_{idx}_RAW_ch{cc}.tif` -> struct<fov, job, idx, channel_no>; NULL when it does not match."""
    spec = r"(?i)_Pos(\d+)__(.+)_(\d+)_RAW_ch(\d+)\.tiff?$"
    hit = col(path).rlike(spec)
    return F.when(hit, F.struct(
        F.regexp_extract(path, spec, 1).cast("int").alias("fov"),
        F.regexp_extract(path, spec, 2).alias("job"),
        F.regexp_extract(path, spec, 3).cast("int").alias("idx"),
        F.regexp_extract(path, spec, 4).cast("int").alias("channel_no"),
    ))


def map_entry(hybe, channel, rindex, dtype, pindex) -> Column:
    """One `hybe|channel|rindex|dtype|pindex` entry of a readout-map text."""
    return F.concat_ws("|", col(hybe), col(channel).cast("string"), col(rindex).cast("string"),
                       col(dtype), col(pindex).cast("string"))


def parse_map_entries(text) -> Column:
    """Readout-map text -> array<struct<hybe, channel, rindex, dtype, pindex>>."""
    pieces = F.filter(F.transform(F.split(col(text), ","), lambda t: F.trim(t)),
                      lambda p: (p != "") & ~F.lower(p).startswith("slots="))
    field = lambda p, k: F.trim(F.split_part(p, F.lit("|"), F.lit(k)))
    return F.transform(pieces, lambda p: F.struct(
        field(p, 1).alias("hybe"), field(p, 2).cast("int").alias("channel"),
        field(p, 3).cast("int").alias("rindex"), F.upper(field(p, 4)).alias("dtype"),
        field(p, 5).cast("int").alias("pindex")))


def declared_slots(text) -> Column:
    """The `slots=<n>` prefix of a readout-map text, NULL when absent."""
    return F.nullif(F.regexp_extract(F.lower(col(text)), r"slots=(\d+)", 1), F.lit("")).cast("int")


def explode_map(df: DataFrame, text: str) -> DataFrame:
    """One row per entry of a readout-map text: the other columns, `slots` and the entry `e`.

    The text is read once and stays behind: beside the explode it would be carried, and the
    declaration sought anew, with every one of its entries.
    """
    others = [c for c in df.columns if c != text]
    read = df.select(*others, declared_slots(text).alias("slots"), parse_map_entries(text).alias("__entries"))
    return read.select(*others, "slots", F.explode("__entries").alias("e"))


def parse_number_ranges(text: str) -> list[int]:
    """`1-5,7,9-10` -> sorted unique numbers (a run parameter, parsed on the driver)."""
    out: set[int] = set()
    for part in (p.strip() for p in str(text or "").split(",")):
        if part:
            lo, _, hi = part.replace(" ", "").partition("-")
            out.update(range(int(lo), int(hi or lo) + 1))
    return sorted(out)


def reference_target(sequence) -> Column:
    """`A(cell 3)->B [...]` -> `B`; NULL when no target is named."""
    return F.nullif(F.trim(F.regexp_extract(col(sequence), r"->\s*([^\[\(]*)", 1)), F.lit(""))
