"""Mixing of sources: temperature weights and their realisation as block permutations.

Source i with the share p_i of all tokens gets the weight q_i ~ p_i^a. The exponent a is
bisected so that the mix meets a target: an entropy (as a fraction of its largest value) or
a repetition limit (how often the most repeated source is read while the least repeated one
is read once). The budget then gives every source w_i * budget tokens. A source is read in
epochs; each epoch is a permutation of its blocks, drawn by hash from (seed, source, epoch),
and inside a block the documents follow in hash order. Whole epochs repeat every document;
the last, partial epoch takes the prefix of its permutation that fits the budget.

The prefix is found without sorting a source: documents have a 60-bit place in the
permutation, and a radix search sums tokens per digit (1,024 cells a source and level),
enters the cell in which the budget ends, and repeats. Each level is one grouped sum that is
combined before the shuffle; only the documents of one last cell are ordered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromaloom.session import checked_broadcast, cut

SEED = 17
DIGIT = 10                 # bits per radix level
BITS = 60                  # bits of a place
BLOCK_BITS = 20            # a source has 2^20 blocks
LEVELS = 3                 # levels searched before the last cell is ordered
SECTIONS = 33              # points per round of the exponent search
ROUNDS = 6                 # rounds; each narrows the interval 16-fold
EXPONENTS = (0.0, 1.0)     # 0 gives equal weights, 1 the shares as they are


def n_tokens(text: str = "text") -> Column:
    """Words of a text (runs without ASCII white space); null and empty texts have none."""
    one = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " "))
    spaces = F.length(one) - F.length(F.replace(one, F.lit(" "), F.lit("")))
    return F.when(one == "", 0).otherwise(spaces + 1).cast("long")


def source_weights(sizes: DataFrame, entropy: float | None = None, repetition: float | None = None) -> DataFrame:
    """source, tokens, share, exponent, weight and epochs for every row of `sizes` (source, tokens).

    Exactly one target: `entropy` in (0, 1], the entropy of the weights over the logarithm
    of the number of sources (the largest exponent that reaches it is taken), or `repetition`
    >= 1, the largest allowed ratio of epochs between two sources (the smallest exponent that
    keeps it is taken). Exponents run over [0, 1]; a target the unchanged shares already meet
    gives 1. Sources without tokens get weight 0 and no epoch. `epochs` is how often a source
    is read when the one read least is read exactly once. The search runs on the source table
    as grouped sums, whatever the number of sources; a few totals pass the driver.
    """
    if (entropy is None) == (repetition is None):
        raise ValueError("give either an entropy or a repetition limit")
    live = cut(sizes.select("source", F.col("tokens").cast("double").alias("tokens")))
    total, n = live.agg(F.coalesce(F.sum("tokens"), F.lit(0.0)), F.count(F.when(F.col("tokens") > 0, 1))).first()
    p = live.where("tokens > 0").select((F.col("tokens") / F.lit(total)).alias("p"))
    lo, hi = EXPONENTS
    for _ in range(ROUNDS):
        grid = [lo + (hi - lo) * k / (SECTIONS - 1) for k in range(SECTIONS)]
        at = p.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(SECTIONS)])))
        at = at.withColumn("a", F.element_at(F.array(*[F.lit(g) for g in grid]), F.col("k") + 1))
        sums = at.groupBy("k").agg(F.sum(F.pow("p", F.col("a"))).alias("z"), F.sum(F.pow("p", F.col("a")) * F.log("p") * F.col("a")).alias("u"),
                                   F.max(F.pow("p", F.col("a") - 1)).alias("most"), F.min(F.pow("p", F.col("a") - 1)).alias("least"))
        h = F.log("z") - F.col("u") / F.col("z")
        if entropy is not None:
            ok = F.lit(n <= 1) | (h >= entropy * math.log(max(n, 1)) - 1e-12)
            best = sums.where(ok).agg(F.max("k")).first()[0]
            best = 0 if best is None else best
            lo, hi = grid[best], grid[min(best + 1, SECTIONS - 1)]
        else:
            ok = F.col("most") <= F.lit(repetition) * F.col("least") * (1 + 1e-12)
            best = sums.where(ok).agg(F.min("k")).first()[0]
            best = SECTIONS - 1 if best is None else best
            lo, hi = grid[max(best - 1, 0)], grid[best]
        if lo == hi:
            break
    exponent = lo if entropy is not None else hi
    raw = live.select("source", "tokens", (F.col("tokens") / F.lit(total) if total else F.lit(0.0)).alias("share"))
    raw = raw.withColumn("raw", F.when(F.col("tokens") > 0, F.pow("share", F.lit(exponent))).otherwise(0.0))
    z, least = raw.agg(F.sum("raw"), F.min(F.when(F.col("tokens") > 0, F.col("raw") / F.col("share")))).first()
    return cut(raw.select(
        "source", F.col("tokens").cast("long").alias("tokens"), "share", F.lit(exponent).alias("exponent"),
        (F.col("raw") / F.lit(z) if z else F.lit(0.0)).alias("weight"),
        F.when(F.col("tokens") > 0, F.col("raw") / F.col("share") / F.lit(least or 1.0)).otherwise(0.0).alias("epochs")))


def place(source: str, doc: str, epoch: str, seed: int) -> Column:
    """60-bit place in the permutation of an epoch: the block's hash first, then the document's."""
    block = F.pmod(F.xxhash64(F.lit(seed), F.col(doc)), F.lit(1 << BLOCK_BITS))
    high = F.xxhash64(F.lit(seed), F.col(source), F.col(epoch), block).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
    low = F.xxhash64(F.lit(seed + 1), F.col(source), F.col(epoch), F.col(doc)).bitwiseAND(F.lit((1 << (BITS - BLOCK_BITS)) - 1))
    return F.shiftleft(high, BITS - BLOCK_BITS).bitwiseOR(low)


def permutation_bounds(rows: DataFrame, weights: DataFrame, budget_tokens: float | None = None, seed: int = SEED) -> DataFrame:
    """__s (source), full, bound_place, bound_doc: a row is read `full` times, and once more
    when its (place, key) in epoch `full` lies before the bound.

    `rows` has source, __doc (key) and __tokens. Without `budget_tokens` the source read
    least is read exactly once, so every row is kept; otherwise source i gets
    weight_i * budget_tokens tokens. The partial epoch ends before the first document that
    would pass the budget.
    """
    if budget_tokens is None:
        want = weights.select(F.col("source").alias("__s"), "tokens", "epochs")
    else:
        want = weights.select(F.col("source").alias("__s"), "tokens", F.when(
            F.col("tokens") > 0, F.col("weight") * F.lit(float(budget_tokens)) / F.col("tokens")).otherwise(0.0).alias("epochs"))
    # a number of epochs within 1e-9 of a whole one counts as that
    want = want.withColumn("full", F.floor(F.col("epochs") + 1e-9).cast("long"))
    part = F.greatest(F.col("epochs") - F.col("full"), F.lit(0.0)) * F.col("tokens")
    if budget_tokens is None:      # sources without tokens are kept as they are
        want = want.withColumn("full", F.greatest("full", F.lit(1)))
    want = cut(want.withColumn("left", F.floor(part + 1e-6).cast("long")).select("__s", "full", "left"))
    open_ = checked_broadcast(want.where("left > 0").select("__s", "full"))
    narrow = cut(rows.join(open_, F.col("source").eqNullSafe(F.col("__s"))).select(
        "source", "__doc", "__tokens", place("source", "__doc", "full", seed).alias("__place")))
    state = want.where("left > 0").select("__s", F.lit(0).cast("long").alias("prefix"), "left")
    for level in range(LEVELS):
        shift = BITS - DIGIT * (level + 1)
        cells = narrow.groupBy("source", F.shiftright("__place", shift).alias("cell")).agg(F.sum("__tokens").alias("t"))
        sums = cells.join(checked_broadcast(state), F.col("source").eqNullSafe(F.col("__s")) & (F.shiftright("cell", DIGIT) == F.col("prefix")))
        w = Window.partitionBy("__s").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        over = sums.withColumn("upto", F.sum("t").over(w)).where("upto > left")
        entered = over.groupBy("__s").agg(F.min(F.struct("cell", (F.col("left") - F.col("upto") + F.col("t")).alias("left"))).alias("m"))
        # a source whose budget does not end inside has room for the whole epoch
        state = cut(state.select("__s", F.col("prefix").alias("old")).join(
            entered.select(F.col("__s").alias("__t"), "m"), F.col("__s").eqNullSafe(F.col("__t")), "left").select(
            "__s", F.coalesce("m.cell", F.lit(1 << (DIGIT * (level + 1)))).alias("prefix"), F.coalesce("m.left", F.lit(0)).alias("left")))
    shift = BITS - DIGIT * LEVELS
    spot = narrow.join(checked_broadcast(state), F.col("source").eqNullSafe(F.col("__s")) & (F.shiftright("__place", shift) == F.col("prefix")))
    w = Window.partitionBy("source").orderBy("__place", "__doc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = spot.withColumn("upto", F.sum("__tokens").over(w)).where("upto > left").groupBy("source").agg(
        F.min(F.struct("__place", "__doc")).alias("b")).select(F.col("source").alias("__t"), "b")
    ends = state.join(stop, F.col("__s").eqNullSafe(F.col("__t")), "left").select(
        F.col("__s").alias("__u"), F.coalesce("b.__place", F.shiftleft("prefix", shift)).alias("bound_place"),
        F.coalesce("b.__doc", F.lit(-(1 << 63))).alias("bound_doc"))
    return cut(want.join(ends, F.col("__s").eqNullSafe(F.col("__u")), "left").select(
        "__s", "full", F.coalesce("bound_place", F.lit(-1)).alias("bound_place"), F.coalesce("bound_doc", F.lit(0)).alias("bound_doc")))


def read_counts(rows: DataFrame, bounds: DataFrame, seed: int = SEED) -> DataFrame:
    """`rows` (source, __doc and others) with `repeats`. The bounds have one row per source;
    they are broadcast when a count finds them small and joined by source otherwise."""
    at = place("source", "__doc", "full", seed)
    inside = (at < F.col("bound_place")) | ((at == F.col("bound_place")) & (F.col("__doc") < F.col("bound_doc")))
    return rows.join(checked_broadcast(bounds), F.col("source").eqNullSafe(F.col("__s"))).withColumn(
        "repeats", F.col("full") + F.when(inside, 1).otherwise(0)).drop("__s", "full", "bound_place", "bound_doc")


def mix(docs: DataFrame, entropy: float | None = None, repetition: float | None = None, budget_tokens: float | None = None,
        seed: int = SEED) -> DataFrame:
    """doc_id, source, tokens, weight, epochs and repeats for every row of `docs` (doc_id, source, text).

    A null source is a source of its own. Rows with equal doc_id, source and text share
    their place in the permutation and so their repeats. Empty texts have no tokens; an
    empty table gives an empty result. Other columns are not read.
    """
    rows = cut(docs.select("doc_id", "source", F.xxhash64("doc_id", "text").alias("__doc"), n_tokens().alias("__tokens")))
    weights = source_weights(rows.groupBy("source").agg(F.sum("__tokens").alias("tokens")), entropy, repetition)
    got = read_counts(rows, permutation_bounds(rows, weights, budget_tokens, seed), seed)
    named = checked_broadcast(weights.select(F.col("source").alias("__w"), "weight", "epochs"))
    return got.join(named, F.col("source").eqNullSafe(F.col("__w"))).select(
        "doc_id", "source", F.col("__tokens").alias("tokens"), "weight", "epochs", "repeats")


def apply_mix(docs: DataFrame, entropy: float | None = None, repetition: float | None = None, seed: int = SEED) -> DataFrame:
    """The rows of `docs`, each as often as the mix reads it; columns and their order stay.

    Every row is read at least once, so nothing is lost; rows of sources that the mix raises
    are repeated. Texts are not shuffled: a row needs its source's bound only. A row travels as one
    struct, so its columns may have any names. Null ids and texts, ties and repeated rows are rows
    like others; an empty table gives an empty one.
    """
    keyed = docs.select(F.struct("*").alias("__row"), "source", F.xxhash64("doc_id", "text").alias("__doc"))
    rows = cut(docs.select("source", F.xxhash64("doc_id", "text").alias("__doc"), n_tokens().alias("__tokens")))
    weights = source_weights(rows.groupBy("source").agg(F.sum("__tokens").alias("tokens")), entropy, repetition)
    got = read_counts(keyed, permutation_bounds(rows, weights, None, seed), seed)
    return got.select("__row", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))).alias("__copy")).select("__row.*")
