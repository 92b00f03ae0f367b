"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame operations.

The paragraphs of a text (its lines, cut further at sentence ends) are hashed to digests;
the set of digests is kept in a sketch of `cells` cells in three equal parts. A digest goes
to one cell of each part, which holds the number of its digests, their XOR and the XOR of
their checksums. Sketches of two versions are subtracted cell by cell: common digests
cancel. Peeling then takes cells with a single digest left (checksum fits), notes the digest
and removes it from its other cells until nothing is left, which recovers the digests that
differ. If cells remain, the pair is retried with a larger sketch.

State is one row per non-empty cell; a peeling step handles one part, so that a digest is
found once, and is one generator and one grouped sum. All steps of a level group by keys the
rows are already partitioned by, so a level is one shuffle whatever the number of steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromaloom.session import checked_broadcast, cut

BASE_CELLS = 24            # cells of the fingerprint itself
STEPS = 12                 # peeling steps of a level, four over each part
ROOM = 1.6                 # cells per digest that may differ
RETRIES = 8                # each retry doubles the cells
PLAN_ROWS = 1_000_000      # narrow rows (five numbers) a broadcast may hold


def pieces(text: Column) -> Column:
    """Distinct paragraph digests of a text: 32 bits of the hash of every trimmed piece."""
    parts = F.transform(F.split(text, r"\n|(?<=[.!?])[ \t\r\f\x0B]+"), lambda p: F.trim(p))
    return F.array_distinct(F.transform(F.array_remove(parts, ""), lambda p: (F.xxhash64(p).bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(1 << 31)).cast("int")))


def checksum(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(99)).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def cell_of(digest: Column, part: Column | int, width: Column, seed: int) -> Column:
    part = F.lit(part) if isinstance(part, int) else part
    return (part * width + F.pmod(F.xxhash64(digest, part, F.lit(seed)), width)).cast("int")


def cells(rows: DataFrame, keys: list[str], digest: str, sign: Column, width: Column, seed: int = 0) -> DataFrame:
    """keys, width, cell, n, x (XOR of digests), c (XOR of checksums): the sketch of each key.

    With signs +1 and -1 for two versions this is their difference, for sketches add up.
    """
    d = F.col(digest)
    spread = rows.select(*keys, width.cast("int").alias("width"), sign.cast("int").alias("__s"), d.alias("__d"), checksum(d).alias("__k"),
                         F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("__part"))
    placed = spread.select(*keys, "width", cell_of(F.col("__d"), F.col("__part"), F.col("width"), seed).alias("cell"), "__s", "__d", "__k")
    return placed.groupBy(*keys, "width", "cell").agg(
        F.sum("__s").cast("int").alias("n"), F.bit_xor("__d").alias("x"), F.bit_xor("__k").alias("c"))


def peel(state: DataFrame, keys: list[str], seed: int = 0, steps: int = STEPS) -> DataFrame:
    """keys, plus, minus (recovered digests of either side) and left (cells not resolved)."""
    for step in range(steps):
        part = step % 3
        pure = ((F.col("cell") >= part * F.col("width")) & (F.col("cell") < (part + 1) * F.col("width"))
                & (F.abs("n") == 1) & (F.col("c") == checksum(F.col("x"))))

        def row(cell, n, x, c):
            return F.struct(cell.cast("int").alias("cell"), n.cast("int").alias("n"), x.cast("int").alias("x"), c.cast("int").alias("c"))

        other = [row(cell_of(F.col("x"), p, F.col("width"), seed), -F.col("n"), F.col("x"), F.col("c")) for p in range(3) if p != part]
        found = row(F.when(F.col("n") > 0, -1).otherwise(-2), F.lit(1), F.lit(0), F.lit(0))
        stay = row(F.col("cell"), F.col("n"), F.col("x"), F.col("c"))
        moved = state.select(*keys, "width", F.explode(F.when(pure, F.array(found, *other)).otherwise(F.array(stay))).alias("r"))
        moved = moved.select(*keys, "width", "r.*")
        state = moved.groupBy(*keys, "width", "cell").agg(
            F.sum("n").cast("int").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("c").alias("c")).where("cell < 0 or n <> 0 or x <> 0 or c <> 0")
    return state.groupBy(*keys).agg(
        F.sum(F.when(F.col("cell") == -1, F.col("n")).otherwise(0)).alias("plus"),
        F.sum(F.when(F.col("cell") == -2, F.col("n")).otherwise(0)).alias("minus"),
        F.count(F.when(F.col("cell") >= 0, 1)).alias("left"))


def likeness(pairs: DataFrame, keys: list[str], spread: list[str]) -> DataFrame:
    """keys and near, the share of common digests in all digests of two versions.

    `pairs` has two digest arrays, a and b, per row; `spread` are the keys to deal rows by.
    Sizes travel with the fingerprints; the common part follows from them and the recovered
    differences. The first sketch has room for ROOM times as many digests as could differ;
    a pair whose cells do not resolve is retried with twice as many cells, drawn anew. Pairs
    without a row in the result have equal digests (or none) and are alike.
    """
    parts = max(2, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    done, todo = None, pairs
    for attempt in range(RETRIES):
        dealt = todo.select(*keys, "a", "b").where(F.size("a") + F.size("b") > 0).repartition(parts, *spread)
        sized = dealt.select(*keys, F.size("a").alias("na"), F.size("b").alias("nb"), F.posexplode(F.concat("a", "b")).alias("pos", "__g"))
        wide = [*keys, "na", "nb"]
        width = F.ceil(((F.col("na") + F.col("nb")) * ROOM * 2 ** attempt + BASE_CELLS) / 3)
        start = cells(sized, wide, "__g", F.when(F.col("pos") < F.col("na"), 1).otherwise(-1), width, seed=attempt)
        got = peel(start.where("n <> 0 or x <> 0 or c <> 0"), wide, seed=attempt)
        ok = (F.col("left") == 0) & (F.col("na") - F.col("plus") == F.col("nb") - F.col("minus")) & (F.col("plus") <= F.col("na"))
        near = (F.col("na") - F.col("plus")) / (F.col("nb") + F.col("plus"))
        got = cut(got.select(*keys, near.alias("near"), ok.alias("ok")))
        solved = got.where("ok").select(*keys, "near")
        done = solved if done is None else done.unionByName(solved)
        open_ = got.where(~F.col("ok")).select(*keys)
        if not open_.limit(1).count():
            return done
        todo = pairs.join(checked_broadcast(open_, PLAN_ROWS), keys, "left_semi")
    raise RuntimeError(f"differences did not peel in {RETRIES} sketch sizes")


def as_text(rows: DataFrame, keys: list[str], names: dict[int, str], kind: str = "kind") -> DataFrame:
    """keys and one text per kind: cells as cell.n.digests.checksums in hexadecimal, by cell."""
    one = F.concat_ws(".", F.hex("cell"), F.hex("n"), F.hex(F.col("x").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), F.hex("c"))
    listed = rows.select(*keys, kind, F.struct("cell", one.alias("t")).alias("r")).groupBy(*keys).agg(
        *[F.array_sort(F.collect_list(F.when(F.col(kind) == k, F.col("r")))).alias(name) for k, name in names.items()])
    return listed.select(*keys, *[F.concat(F.lit(f"{BASE_CELLS}:"), F.array_join(F.transform(name, lambda r: r["t"]), ";")).alias(name)
                                  for name in names.values()])


def neighbours(narrow: DataFrame) -> DataFrame:
    """d, h, n, next_d, next_h: the next document in descending order of (doc_id, h).

    `narrow` has doc_id, its non-null form d, h and n. Rows are ranked inside range
    partitions; the last row of the partition before (a table with one row per partition)
    precedes the first of the next, and the first row of all is followed by the last. A
    single document is its own neighbour.
    """
    parts = max(2, int(narrow.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut(narrow.repartitionByRange(parts, F.asc_nulls_first("doc_id"), "h").select("doc_id", "d", "h", "n", F.spark_partition_id().alias("p")))
    rank, one = F.struct("doc_id", "h", "d"), F.struct("d", "h")
    ends = dealt.groupBy("p").agg(F.max(rank).alias("last"))
    top = ends.agg(F.max("last")).first()[0]
    wrap = F.struct(F.lit(top["d"] if top else None).cast("long").alias("d"), F.lit(top["h"] if top else None).cast("long").alias("h"))
    ends = ends.select(F.col("p").alias("q"), F.coalesce(F.lag(F.struct(F.col("last.d").alias("d"), F.col("last.h").alias("h"))).over(Window.orderBy("p")), wrap).alias("edge"))
    inner = Window.partitionBy("p").orderBy(F.asc_nulls_first("doc_id"), "h")
    out = dealt.withColumn("before", F.lag(one).over(inner)).join(F.broadcast(ends), F.col("p") == F.col("q"))
    out = out.withColumn("before", F.coalesce("before", "edge"))
    return out.select("d", "h", "n", F.col("before.d").alias("next_d"), F.col("before.h").alias("next_h"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited version, in which the last half is replaced.

    Result: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. The edited text replaces the last floor(n / 2) code points by the first as
    many (or all) of the next document in descending doc_id order; the last document is
    followed by the first, a single one by itself. Null texts are empty. Rows with one
    doc_id and different texts are different documents, ordered by the text's hash; equal
    rows are one document whose result is repeated. A null doc_id is a document below all
    others. Other columns are not read.

    Texts move once: a document sends its first half to its own key, and as much of its
    beginning as is wanted, with its digests, to the key of the document before it.
    """
    parts = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("d"), F.xxhash64("text", F.col("doc_id").isNull()).alias("h"), "text")
    counted = cut(base.groupBy("doc_id", "d", "h").agg(F.count("*").alias("times"), F.max(F.length("text")).alias("n")))
    repeated = counted.where("times > 1").select("d", "h", "times")
    if repeated.limit(1).count():
        base = base.dropDuplicates(["d", "h"])
    order = cut(neighbours(counted.select("doc_id", "d", "h", "n")))
    sends = checked_broadcast(order.select(F.col("next_d").alias("from_d"), F.col("next_h").alias("from_h"), F.col("d").alias("to_d"), F.col("h").alias("to_h"),
                                           F.floor(F.col("n") / 2).cast("int").alias("half")), PLAN_ROWS)
    n = F.length("text")
    own = base.select("doc_id", "d", "h", n.cast("long").alias("n_chars"), F.col("text").substr(F.lit(1), (n - F.floor(n / 2)).cast("int")).alias("kept"),
                      pieces(F.col("text")).alias("a")).repartition(parts, "d", "h")
    sent = base.join(sends, (F.col("d") == F.col("from_d")) & (F.col("h") == F.col("from_h"))).select(
        "to_d", "to_h", F.col("text").substr(F.lit(1), F.col("half")).alias("head"), pieces(F.col("text")).alias("b")).repartition(parts, "to_d", "to_h")
    both = own.join(sent, (F.col("d") == F.col("to_d")) & (F.col("h") == F.col("to_h")))
    both = both.select("doc_id", "d", "h", "n_chars", "a", "b", F.explode(F.array(F.concat("kept", "head"))).alias("edited"))
    table = cut(both.select("doc_id", "d", "h", "n_chars", F.unhex(F.sha2("edited", 256)).alias("sha"), "a", pieces(F.col("edited")).alias("e"), "b"))
    key = ["d", "h"]

    def two(first, second):
        return F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), *v) for k, v in enumerate((first, second))])).alias("v")

    pairs = table.select(*key, two((F.col("a").alias("a"), F.col("e").alias("b")), (F.col("a").alias("a"), F.col("b").alias("b")))).select(*key, "v.*")
    near = likeness(pairs, [*key, "kind"], key).groupBy(*key).agg(
        F.max(F.when(F.col("kind") == 0, F.col("near"))).alias("near_edited"), F.max(F.when(F.col("kind") == 1, F.col("near"))).alias("near_next"))
    dealt = table.select(*key, "a", "e").repartition(parts, *key).select(*key, two((F.col("a").alias("x"),), (F.col("e").alias("x"),)))
    sketch = cells(dealt.select(*key, "v.kind", F.explode("v.x").alias("__g")), [*key, "kind"], "__g", F.lit(1), F.lit(BASE_CELLS // 3))
    texts = as_text(sketch, key, {0: "fingerprint", 1: "edited_fingerprint"})
    out = table.select("doc_id", *key, "n_chars", "sha").join(near, key, "left").join(texts, key, "left")
    out = out.join(checked_broadcast(repeated, PLAN_ROWS), key, "left").withColumn(
        "__k", F.explode(F.sequence(F.lit(1), F.coalesce("times", F.lit(1)).cast("int"))))
    empty = F.lit(f"{BASE_CELLS}:")
    return out.select("doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), F.coalesce("fingerprint", empty).alias("fingerprint"),
                      F.coalesce("edited_fingerprint", empty).alias("edited_fingerprint"),
                      F.coalesce("near_edited", F.lit(1.0)).alias("near_edited"), F.coalesce("near_next", F.lit(1.0)).alias("near_next"))
