"""Benchmark decontamination over item-sized windows, in DataFrame operations.

Words are lower-cased runs of letters and digits. For every benchmark item of m words,
windows of m words in the documents are compared with it by the exact weighted similarity
of their 5-word shingles, sum of the smaller over sum of the larger multiplicities; 0.8 or
more is contamination. Every filter in front of that test follows from the bound, so none
can lose a pair that passes it. With n = m - 4 shingles in the item,

* a window needs at least 0.8 n positions whose shingle stands in some item of its size
  (a bounded hash join against the benchmark's shingles, checked before it is broadcast);
* at most n - 0.8 n of an item's shingles can be missing from a window, so of any
  n - ceil(0.8 n) + 1 shingles one is there: windows and items meet on the item's rarest;
* c positions of a window with shingles of the item bound the similarity from above.

A window's similarity does not fall when it moves right to the next shared shingle, so
windows that open at one reach the largest value; those that close at one are formed as
well. Fingerprints by blocks of a 64-bit SimHash are not used as a filter: an edge cut off
an item changes k words but only k shingles, and no radius follows from the similarity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromaloom.session import checked_broadcast, cut

SHINGLE = 5
RADIUS = 11                    # for `hamming_blocks` only
BENCH_ROWS = 2_000_000         # benchmark shingles or document ids a broadcast may hold


def words(text: str = "text") -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _kept(df: DataFrame, name: str, value: Column) -> DataFrame:
    """`value` as a column that later expressions read instead of computing it again."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_shingles(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, hw (word hashes) and sh (hashes of the shingles, one per start)."""
    hashed = _kept(df, "hw", F.transform(words(), lambda w: F.xxhash64(w))).select(*keys, "hw")
    last = F.size("hw") - SHINGLE
    sh = F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
                                       lambda i: F.xxhash64(*[F.get("hw", i + j) for j in range(SHINGLE)]))).otherwise(
        F.array().cast("array<long>"))
    return hashed.select("*", sh.alias("sh"))


def hamming_blocks(sim: str, radius: int = RADIUS) -> Column:
    """array<struct<block, value>>: 64 bits in radius + 1 blocks."""
    sizes = [64 // (radius + 1) + (1 if b < 64 % (radius + 1) else 0) for b in range(radius + 1)]
    out, at = [], 0
    for b, size in enumerate(sizes):
        out.append(F.struct(F.lit(b).alias("block"), F.shiftrightunsigned(sim, at).bitwiseAND(F.lit((1 << size) - 1)).alias("value")))
        at += size
    return F.array(*out)


def _found(docs: DataFrame, benchmark: DataFrame, num: int, den: int) -> DataFrame:
    """doc_id, h (hash of the text), start, m, item_id and similarity of every window that passes."""
    items = with_shingles(benchmark.select("item_id", "text").distinct(), ["item_id"])
    items = cut(items.where(F.size("sh") > 0).select("item_id", F.xxhash64("hw").alias("item_key"), F.size("hw").alias("m"), "sh"))
    wanted = checked_broadcast(items.select("m", F.explode("sh").alias("s")).distinct(), BENCH_ROWS)
    base = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    marks = with_shingles(base, ["doc_id", "h"]).select("doc_id", "h", F.posexplode("sh").alias("pos", "s")).join(wanted, "s")
    places = marks.groupBy("doc_id", "h", "m").agg(F.sort_array(F.collect_set("pos")).alias("p"))
    n = F.col("m") - (SHINGLE - 1)
    least = F.ceil(n * num / F.lit(den)).cast("int")
    opens = F.filter("p", lambda x, i: F.get("p", i + least - 1) < x + n)
    closes = F.filter("p", lambda x, i: (x >= n) & (i >= least - 1) & (F.get("p", i - least + 1) > x - n))
    front = F.when((F.get("p", F.lit(0)) < n) & (F.get("p", least - 1) < n), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    starts = F.explode(F.array_distinct(F.concat(opens, F.transform(closes, lambda x: x - n + 1), front)))
    windows = cut(places.select("doc_id", "h", "m", starts.alias("start")))
    ids = checked_broadcast(windows.select(F.col("doc_id").alias("__d"), F.col("h").alias("__h")).distinct(), BENCH_ROWS)
    picked = base.join(ids, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("h") == F.col("__h")), "left_semi")
    picked = with_shingles(picked.dropDuplicates(["doc_id", "h"]), ["doc_id", "h"])
    per_doc = windows.groupBy(F.col("doc_id").alias("__d"), F.col("h").alias("__h")).agg(F.collect_list(F.struct("start", "m")).alias("w"))
    both = picked.join(per_doc, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("h") == F.col("__h")))
    spans = both.select("doc_id", "h", "sh", F.explode("w").alias("w")).select(
        "doc_id", "h", F.col("w.start").alias("start"), F.col("w.m").alias("m"),
        F.slice("sh", F.col("w.start") + 1, F.col("w.m") - (SHINGLE - 1)).alias("sh"))
    spans = cut(spans)
    key = ["doc_id", "h", "start", "m"]
    # the rarest shingles of an item: what many items share leads to none of them
    flat = items.select("item_key", "m", F.explode("sh").alias("s"))
    order = Window.partitionBy("item_key").orderBy("df", "s")
    rare = items.dropDuplicates(["item_key"]).select("item_key", "m", F.explode("sh").alias("s")).join(
        flat.distinct().groupBy("s").agg(F.count("*").alias("df")), "s")
    rare = rare.withColumn("at", F.row_number().over(order)).where(F.col("at") <= n - least + 1).select(
        F.col("item_key").alias("__key"), F.col("m").alias("__m"), F.col("s").alias("__s")).distinct()
    probes = spans.select(*key, F.explode(F.array_distinct("sh")).alias("s"))
    met = probes.join(checked_broadcast(rare, BENCH_ROWS), (F.col("m") == F.col("__m")) & (F.col("s") == F.col("__s")))
    pairs = met.select(*key, F.col("__key").alias("item_key")).distinct()
    pairs = cut(pairs)
    sides = items.select(F.col("item_key").alias("__key"), F.col("sh").alias("__sh")).dropDuplicates(["__key"])
    left = pairs.join(spans.select(*[F.col(c).alias(f"__{c}") for c in key], "sh"),
                      F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("h") == F.col("__h"))
                      & (F.col("start") == F.col("__start")) & (F.col("m") == F.col("__m")))
    left = left.join(checked_broadcast(sides, 100_000), F.col("item_key") == F.col("__key"))
    inside = F.size(F.filter("sh", lambda x: F.array_contains("__sh", x)))
    left = left.where(inside * den >= (F.size("sh") + F.size("__sh") - inside) * num)
    counts = left.select(*key, "item_key", F.explode(F.concat(
        F.transform("sh", lambda x: F.struct(x.alias("s"), F.lit(1).alias("a"), F.lit(0).alias("b"))),
        F.transform("__sh", lambda x: F.struct(x.alias("s"), F.lit(0).alias("a"), F.lit(1).alias("b"))))).alias("c"))
    pair = [*key, "item_key"]
    counts = counts.groupBy(*pair, "c.s").agg(F.sum("c.a").alias("a"), F.sum("c.b").alias("b"))
    found = counts.groupBy(*pair).agg(F.sum(F.least("a", "b")).alias("common"), F.sum(F.greatest("a", "b")).alias("union"))
    found = found.where(F.col("common") * den >= F.col("union") * num).withColumn("similarity", F.col("common") / F.col("union"))
    return found.join(checked_broadcast(items.select("item_id", F.col("item_key").alias("__key")), 100_000), F.col("item_key") == F.col("__key"))


def contaminated(docs: DataFrame, benchmark: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, item_id, similarity, start and n_words of every contaminated document and item.

    `start` is the word at which the most similar window of the item's size begins (the
    first of equal ones). Null and empty texts, items and texts with fewer than five words
    match nothing. Repeated rows of one document give one result row per item; repeated
    rows of an item count once, different texts under one item_id are different items with
    the same id. Other columns are not read. A null doc_id or item_id is kept as null.
    """
    found = _found(docs, benchmark, num, den)
    best = found.groupBy("doc_id", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("d"), "start", "m")).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.d")).alias("similarity"), F.col("b.start").alias("start"), F.col("b.m").alias("n_words"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of `docs` whose text is not contaminated, whatever other rows share their id; columns and their order stay."""
    hit = _found(docs, benchmark, num, den).select(F.col("doc_id").alias("__hit"), F.col("h").alias("__x")).distinct()
    return docs.join(checked_broadcast(hit, BENCH_ROWS), F.col("doc_id").eqNullSafe(F.col("__hit")) & (F.xxhash64("text") == F.col("__x")), "left_anti")
