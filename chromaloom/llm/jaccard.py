"""Near-duplicate join on word shingles through parity sketches.

Method. The 64-bit hash of every shingle is dropped into a bit sketch by XOR, so a bit
holds the parity of the shingles on it. One differing shingle flips at most one bit, hence
the Hamming distance of two sketches is at most the symmetric difference d of the sets. For
sets linked at Jaccard >= t, d <= (1-t)/(1+t) * (|A|+|B|). A size band fixes the largest
such d (T) and cuts the sketch into K = T + 1 + e segments: linked sets agree on at least
1 + e whole segments (pigeonhole), so joining equal segments of a band loses no link. A
sketch has K * 2^32 bits and is kept as one 64-bit digest per segment (XOR of the mixed bit
positions, equal exactly when the segments are equal up to 2^-64 chance). Equal segments
with few shingles or none say little: a passage that documents share fills them. Sets with
at most e such poor segments skip them, for one of the 1 + e agreements is then rich; the
few sets with more join them too. A set is probed in its own band and, when a partner of the next band could be linked
to it, in that band as well.

Verification first compares folds of the sketches, two bits and more for a shingle (the
Hamming bound again; the wider of two folds is folded on to the other's width); only texts
of sets that this leaves open travel, and a task intersects their sets exactly.

Hot keys. Equal sets are one class: a task emits a set once, classes meet as equal rows. In
a batch, sets that share a segment are tied to the first of them under a key of the batch,
and only that first one goes to the shared key, so a bucket holds at most one row per batch
however many near copies it has. Buckets emit a star (smallest set to the others), not all
pairs; pairs that a star leaves open are compared afterwards, only across components, and
leave a task as a forest: what travels grows with the sets, not with their pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chromaloom.llm.common import min_labels
from chromaloom.session import checked_broadcast, cut

RATIO = 1.5            # band edges grow by this factor
SPARE = 3.0            # standard deviations of poor segments that a set may have without joining them
FOLD_WORDS = 16        # 64-bit words of the smallest folded sketch
MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
NARROW = "if(size({f}) <= {m}, {f}, transform(sequence(0, {m} - 1), i -> aggregate(sequence(i, size({f}) - 1, {m}), 0L, (s, j) -> s ^ {f}[j])))"
HAMMING = "aggregate(zip_with({}, {}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)".format(
    *(NARROW.format(f=f, m="least(size(fa), size(fb))") for f in ("fa", "fb")))
BATCH_IDS = 1_000_000  # candidate set ids a broadcast may hold (16 MB)
CHUNK_WORDS = 1 << 18  # words of folds that are compared at a time
CHUNK_KEYS = 1 << 18   # keys a batch of sets may have, and pairs a task collects before it keeps their forest
TASK_TEXTS = 1_024     # texts a task takes from Arrow at a time
UNIT_ROWS = 4_096      # rows of a bucket that are compared as one block
UNIT_SHINGLES = 1 << 21  # shingles of a cluster that are compared as one block (16 MB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * MIX1
    x = (x ^ (x >> np.uint64(33))) * MIX2
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text.

    A-Z are lower-cased, words are maximal runs without ASCII white space. With fewer than
    k words the whole sequence is one shingle; without a word (or text) the set is empty.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    size = min(k, n)
    h = np.zeros(n - size + 1, np.uint64)
    for j in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + mix(w[j:n - size + 1 + j] + np.uint64(j))
    return np.unique(mix(h + np.uint64(size)))


def band_plan(band: int, num: int, den: int) -> tuple[int, int, int, int]:
    """(largest distance T, segments K, spare agreements e, shingles m of a rich segment).

    e covers the poor segments (fewer than m shingles) of the band's middle sizes; m is the
    largest for which they stay under a third.
    """
    lo, hi = math.ceil(RATIO ** band), math.ceil(RATIO ** (band + 1)) - 1
    t = (den - num) * 2 * hi // (den + num)
    for m in (4, 3, 2, 1):
        e, size = 0, (lo + hi) / 2 if m > 1 else lo
        for _ in range(200):
            k = t + 1 + e
            rate = size / k
            poor = k * math.exp(-rate) * sum(rate ** j / math.factorial(j) for j in range(m))
            need = math.ceil(poor + SPARE * math.sqrt(poor))
            if need <= e or 3 * e > k:
                break
            e = need
        if m == 1 or (need <= e and 3 * e <= k):
            return t, t + 1 + e, e, m
    raise AssertionError


def band_of(n: int) -> int:
    b = int(math.log(n) / math.log(RATIO))
    while math.ceil(RATIO ** (b + 1)) <= n:
        b += 1
    while math.ceil(RATIO ** b) > n:
        b -= 1
    return b


def reach(n: int, hi: int, num: int, den: int) -> int:
    """Largest distance between a set of n shingles and a linked set of at most hi."""
    return (den - num) * (n + min(hi, n * den // num)) // (den + num)


def segment_keys(h: np.ndarray, band: int, plan: tuple[int, int, int, int], num: int, den: int) -> np.ndarray:
    """Join keys of a set in a band, from its leading segments.

    A set whose links are at most T' apart only needs its first T' + 1 + e segments: of two
    linked sets the one with fewer still agrees with the other on 1 + e of them. One key per
    rich segment; if more than e are poor, the poor ones (and the empty ones) join too.
    """
    t, k, e, m = plan
    if t == 0:
        return np.empty(0, np.uint64)          # linked sets of this band are equal sets
    used = min(k, reach(len(h), math.ceil(RATIO ** (band + 1)) - 1, num, den) + 1 + e)
    seg = ((h >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)      # sorted, as h is
    cut_at = int(np.searchsorted(seg, used))
    h, seg = h[:cut_at], seg[:cut_at]
    salt = np.uint64(band * 1_000_003)
    keys, rich, filled = np.empty(0, np.uint64), np.zeros(0, bool), seg[:0]
    if cut_at:
        starts = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
        filled = seg[starts]
        keys = mix(np.bitwise_xor.reduceat(mix(h), starts) + mix(filled + salt))
        rich = np.diff(np.append(starts, cut_at)) >= m
    if used - int(rich.sum()) <= e:
        return keys[rich]
    if used - len(filled) <= e:
        return keys
    empty = np.setdiff1d(np.arange(used, dtype=np.uint64), filled)
    return np.concatenate((keys, mix(mix(empty + salt) + np.uint64(1))))


def set_id(h: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(h.tobytes()) if len(h) else 0


def _signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def fold_words(n: int) -> int:
    """Words of the fold of a set of n shingles: a power of two, two to four bits a shingle, FOLD_WORDS at least."""
    return max(FOLD_WORDS, 1 << max(0, math.ceil(n / 32) - 1).bit_length())


def folded(h: np.ndarray, words: int) -> np.ndarray:
    """Parities of a set's shingles on 64 * words places, packed in words."""
    bits = np.bincount((h & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def slices(batches, rows: int):
    """The batches in slices, so that a task never holds the Python texts of a whole batch."""
    for b in batches:
        yield from (b.slice(lo, rows) for lo in range(0, b.num_rows, rows))


def describe(k: int):
    """Task: one row (doc_id, h, n_shingles, sid, fold) per document; h is its text's hash, sid identifies the set."""
    def run(batches):
        for b in slices(batches, TASK_TEXTS):
            n, sid, fold = [], [], []
            for text in b.column("text").to_pylist():
                h = shingles(text, k)
                n.append(len(h))
                sid.append(set_id(h))
                fold.append(folded(h, fold_words(len(h))))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), b.column("h"), pa.array(n, pa.int64()), pa.array(_signed(sid)), pa.array(fold, pa.list_(pa.int64()))],
                ["doc_id", "h", "n_shingles", "sid", "fold"])
    return run


def probe(k: int, num: int, den: int):
    """Task: the bucket rows (gkey, sid, key) of every set, once per set and task.

    gkey names a bucket; the sets of a batch that share one are tied to the first of them
    under a key of their own, and only the first goes to the bucket. key names the bucket of
    a row under such a key of its own, and is null elsewhere. A batch is what has about
    CHUNK_KEYS keys.
    """
    def emit(keys, sids):
        key, sid = np.concatenate(keys), np.concatenate(sids)
        order = np.argsort(key, kind="stable")
        sorted_key, sorted_sid = key[order], sid[order]
        first = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
        lead = sorted_sid[np.flatnonzero(first)][np.cumsum(first) - 1]
        tied = np.concatenate((~first[1:], [False])) | ~first       # members of groups of two and more
        local = mix(sorted_key + mix(lead + np.uint64(7)))
        keep = np.zeros(len(key), bool)
        keep[order] = first                                         # rows of a set stay together, they pack better
        gkey = np.concatenate((key[keep], local[tied]))
        who = np.concatenate((sid[keep], sorted_sid[tied]))
        of = np.concatenate((np.zeros(int(keep.sum()), np.uint64), sorted_key[tied]))
        of = pa.array(_signed(of), mask=np.arange(len(of)) < keep.sum())
        return pa.RecordBatch.from_arrays([pa.array(_signed(gkey)), pa.array(_signed(who)), of], ["gkey", "sid", "key"])

    def run(batches):
        seen, plans, keys, sids, held = set(), {}, [], [], 0
        for b in slices(batches, TASK_TEXTS):
            for text in b.column("text").to_pylist():
                h = shingles(text, k)
                n = len(h)
                if not n:
                    continue
                sid = set_id(h)
                if sid in seen:
                    continue
                seen.add(sid)
                own = band_of(n)
                bands = [own] + ([own + 1] if n * den >= num * math.ceil(RATIO ** (own + 1)) else [])
                for band in bands:
                    if band not in plans:
                        plans[band] = band_plan(band, num, den)
                    got = segment_keys(h, band, plans[band], num, den)
                    keys.append(got)
                    sids.append(np.full(len(got), sid, np.uint64))
                    held += len(got)
                if held >= CHUNK_KEYS:
                    yield emit(keys, sids)
                    keys, sids, held = [], [], 0
        if held:
            yield emit(keys, sids)
    return run


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    inter = len(np.intersect1d(x, y, assume_unique=True))
    return inter * den >= (len(x) + len(y) - inter) * num


def settle(group: dict, num: int, den: int, merged: bool) -> list[tuple[int, int]]:
    """Links among the sets of a group (sid: component, hashes) that are of different components.

    Sets that links found so far connect are not compared again, so a group has at most one
    link less than sets; with `merged` a component counts as connected from the start.
    """
    sid, hashes = list(group), [h for _, h in group.values()]
    component = np.unique([c for c, _ in group.values()], return_inverse=True)[1]
    if not component.any():
        return []
    root = component.copy() if merged else np.arange(len(sid))
    n, out = np.array([len(h) for h in hashes]), []
    folds = np.stack([folded(h, 2 * fold_words(int(n.mean()))) for h in hashes]).view(np.uint64)
    for j in range(1, len(sid)):
        near = np.flatnonzero((component[:j] != component[j]) & (root[:j] != root[j])
                              & (np.minimum(n[:j], n[j]) * den >= np.maximum(n[:j], n[j]) * num))
        apart = np.bitwise_count(folds[near] ^ folds[j]).sum(1, dtype=np.int64)
        ok = apart * (den + num) <= (n[near] + n[j]) * (den - num)
        for i in near[ok][np.argsort(apart[ok], kind="stable")]:
            if root[i] != root[j] and linked(hashes[i], hashes[j], num, den):
                root[root == root[j]] = root[i]
                out.append((min(sid[i], sid[j]), max(sid[i], sid[j])))
    return out


def unit_links(k: int, num: int, den: int, merged: bool):
    """Task over rows (c, u, sid, component, text) sorted by (c, u): links (a, b) inside every unit (c, u)."""
    def run(batches):
        unit, group = None, {}

        def batch(links):
            return pa.RecordBatch.from_arrays([pa.array([x[j] for x in links], pa.int64()) for j in range(2)], ["a", "b"])

        for rows in slices(batches, TASK_TEXTS):
            found = []
            for c, u, sid, component, text in zip(*(rows.column(x).to_pylist() for x in ("c", "u", "sid", "component", "text"))):
                if (c, u) != unit:
                    found += settle(group, num, den, merged) if len(group) > 1 else []
                    unit, group = (c, u), {}
                if sid not in group:                        # repeated rows
                    group[sid] = component, shingles(text, k)
            yield batch(found)
        if len(group) > 1:
            yield batch(settle(group, num, den, merged))
    return run


def units(rows: DataFrame, of: str, weight, limit: int) -> DataFrame:
    """`rows` (`of`, sid, component, ...) with the unit u of their `of` in which they are compared.

    What weighs up to `limit` is one unit. Above it, rows are dealt over blocks and a unit is
    a pair of blocks; the heaviest component has blocks of its own, which are not paired with
    each other, for only rows of different components are compared.
    """
    per = rows.groupBy(of, "component").agg(F.sum(weight).alias("w")).groupBy(of).agg(F.sum("w").alias("w"), F.max(F.struct("w", "component")).alias("top"))
    # at most one row per `limit` of weight
    hot = F.broadcast(per.where(F.col("w") > limit).select(
        F.col(of).alias("__of"), F.col("top.component").alias("__top"), F.ceil(F.col("top.w") / limit).alias("__bt"),
        F.greatest(F.ceil((F.col("w") - F.col("top.w")) / limit), F.lit(1)).alias("__bo")))
    place, top = F.xxhash64("sid"), F.col("component") == F.col("__top")
    block = F.when(F.col("__of").isNull(), 0).when(top, F.col("__bo") + F.pmod(place, "__bt")).otherwise(F.pmod(place, "__bo"))
    last = F.when(F.col("__of").isNull(), 0).when(top, F.col("__bo") - 1).otherwise(F.col("__bo") + F.col("__bt") - 1)
    dealt = rows.join(hot, F.col(of) == F.col("__of"), "left").select(
        *rows.columns, block.cast("long").alias("__x"), F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("__y"))
    return dealt.select(*rows.columns, (F.shiftleft(F.least("__x", "__y"), 31) + F.greatest("__x", "__y")).alias("u"))


def exact_links(rows: DataFrame, reps: DataFrame, docs: DataFrame, k: int, num: int, den: int, merged: bool) -> DataFrame:
    """Links (a, b) of different components inside every c of `rows` (c, sid, component), as `settle` finds them.

    The sets are computed again where they are compared, from the text of one document of
    each (`reps`), which its id and the hash of its text name.
    """
    named = units(rows.join(reps.select("sid", "n", F.col("doc_id").alias("__d"), F.col("h").alias("__h")), "sid"), "c", "n", UNIT_SHINGLES)
    ids = checked_broadcast(named.select("c", "u", "sid", "component", "__d", "__h"), BATCH_IDS)
    texts = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("h") == F.col("__h"))).select("c", "u", "sid", "component", "text")
    parts = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return texts.repartition(parts, "c", "u").sortWithinPartitions("c", "u").mapInArrow(unit_links(k, num, den, merged), "a long, b long").distinct()


def star_links(stars: DataFrame, reps: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b) among `stars` (a, b), one row per b; the folds see most pairs off before texts travel."""
    data = reps.select("sid", "n", "fold")
    both = stars.join(data.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("fold").alias("fb")), "b").join(
        data.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("fold").alias("fa")), "a")
    total = F.col("na") + F.col("nb")
    near = cut(both.where((F.least("na", "nb") * den >= F.greatest("na", "nb") * num) & (F.expr(HAMMING) * (den + num) <= total * (den - num))).select("a", "b"))
    # the others of a star are compared with its first only
    rows = near.select(F.col("a").alias("c"), F.col("b").alias("sid"), F.lit(0).cast("long").alias("component")).unionByName(
        near.select(F.col("a").alias("c"), F.col("a").alias("sid"), F.lit(1).cast("long").alias("component")).distinct())
    return exact_links(rows, reps, docs, k, num, den, merged=False)


def meetings(num: int, den: int, forest: bool = False):
    """Task over rows (c, g, sid, component, n, fold) sorted by the width of fold and by (c, g):
    pairs (c, a, b) of different components that meet on a shared key in folds of one width and
    may be linked, each once per batch.

    The parities in the folds of the two sets may differ in no more places than linked sets
    differ in shingles. Rows of differences have 128 parities s0, s1 instead, and nd and tail:
    both tails must be long enough. So a pair of a dense group that is not linked is a
    comparison of a few words here and becomes no row. A key's rows are all a task holds of it.
    With `forest`, a pair that earlier pairs of the task connect is left out.
    """
    def may_link(x: dict, y: dict) -> np.ndarray:
        bound = (den - num) * (x["n"] + y["n"])
        ok = x["component"] != y["component"]
        if "tail" in x:
            ok = ok & ((2 * np.minimum(x["tail"], y["tail"]) - x["nd"] - y["nd"]) * (den + num) + bound >= 0)
        else:
            ok = ok & (np.minimum(x["n"], y["n"]) * den >= np.maximum(x["n"], y["n"]) * num)
        at, words = np.flatnonzero(ok), x["s"].shape[-1]
        bound = np.broadcast_to(bound, ok.shape)[at]
        step = max(1, CHUNK_WORDS // words)
        for lo in range(0, len(at), step):
            some = at[lo:lo + step]
            apart = np.bitwise_count(x["s"][x["i"][some]] ^ y["s"][y["i"][some]]).sum(1, dtype=np.int64)
            ok[some] = apart * (den + num) <= bound[lo:lo + step]
        return ok

    def picked(col: dict, i: np.ndarray) -> dict:
        return {k: v if k == "s" else v[i] for k, v in col.items()} | {"i": i}

    def even(batches):
        for b in batches:
            if "fold" not in b.schema.names:
                yield b
                continue
            width = pc.list_value_length(b.column("fold")).to_numpy(zero_copy_only=False)
            at = [0, *(np.flatnonzero(np.diff(width)) + 1).tolist(), len(width)]
            yield from (b.slice(lo, hi - lo) for lo, hi in zip(at, at[1:]))

    def spanning(pairs: np.ndarray, root: dict) -> np.ndarray:
        def find(v):
            while (up := root.setdefault(v, v)) != v:
                root[v] = root[up]
                v = up
            return v

        new = np.zeros(len(pairs), bool)
        for j, (a, b) in enumerate(pairs[:, 1:].tolist()):
            if (x := find(a)) != (y := find(b)):
                root[x], new[j] = y, True
        return pairs[new]

    def run(batches):
        held, root = None, {}               # rows of the last key, which the next batch may go on with
        for batch in even(batches):
            size = batch.num_rows
            if not size:
                continue
            col = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c not in ("fold", "s0", "s1")}
            # unsigned words: the count of a negative number's bits is that of its absolute value
            if "fold" in batch.schema.names:
                col["s"] = batch.column("fold").flatten().to_numpy(zero_copy_only=False).reshape(size, -1).view(np.uint64)
            else:
                col["s"] = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("s0", "s1")], 1).view(np.uint64)
            told = {k: v for k, v in col.items() if k not in ("c", "g", "sid")}
            c, g, sid = col["c"], col["g"], col["sid"]
            found, many = [], 0

            def keep(c_, x, y):
                nonlocal found, many
                found.append(np.stack((c_, np.minimum(x, y), np.maximum(x, y)), 1))
                many += len(x)
                if forest and many >= CHUNK_KEYS:
                    found, many = [spanning(np.concatenate(found), {})], 0

            starts = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (c[1:] != c[:-1]))))
            ends = np.append(starts[1:], size)
            if held is not None and held["g"][0] == g[0] and held["c"][0] == c[0] and held["s"].shape[1] == col["s"].shape[1]:
                all_held = picked(held, np.arange(len(held["g"])))
                for j in range(ends[0]):
                    at = np.flatnonzero(may_link(all_held, picked(told, np.full(len(held["g"]), j))))
                    if len(at):
                        keep(np.full(len(at), c[j]), held["sid"][at], np.full(len(at), sid[j]))
            else:
                held = None
            mixed = np.minimum.reduceat(col["component"], starts) != np.maximum.reduceat(col["component"], starts)
            last = np.repeat(np.where(mixed, ends, starts), ends - starts)      # rows of unmixed keys meet nothing
            i, step = np.arange(size), 1
            while True:
                i = i[i + step < last[i]]
                if not len(i):
                    break
                ok = i[may_link(picked(told, i), picked(told, i + step))]
                if len(ok):
                    keep(c[ok], sid[ok], sid[ok + step])
                step += 1
            tail = {k: v[starts[-1]:] for k, v in col.items()}
            if held is not None and len(starts) == 1:
                tail = {k: np.concatenate((held[k], v)) for k, v in tail.items()}
            held = tail
            if found:
                pairs = np.unique(np.concatenate(found), axis=0)
                if forest:
                    pairs = spanning(pairs, root)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, j].copy()) for j in range(3)], ["c", "a", "b"])
    return run


def open_links(shared: DataFrame, label: DataFrame, reps: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between different components (`label`: node, component) of sets in a bucket of `shared` (key, sid).

    Linked sets share a bucket. Sets of a bucket meet with their folds in a sorted stream
    (`meetings`), and a task keeps a forest of the pairs that may be linked: what these
    connect is a cluster, and a set that may be linked to nothing is in none. The texts of a
    cluster then meet once, and a task compares the sets that its links do not yet connect. So
    pairs are comparisons, never rows, and a bucket that many passages tie to others is no
    cluster. Buckets of the same sets are compared once.
    """
    rows = shared.select("key", "sid").distinct().join(label.select(F.col("node").alias("sid"), "component"), "sid", "left").withColumn(
        "component", F.coalesce("component", "sid"))
    same = [F.count("*").alias("m"), F.bit_xor(F.xxhash64("sid")).alias("x"), F.bit_xor(F.xxhash64("sid", F.lit(1))).alias("y")]
    keys = rows.groupBy("key").agg(*same, F.min("component").alias("p"), F.max("component").alias("q")).where("p <> q")
    rows = cut(rows.join(keys.groupBy("m", "x", "y").agg(F.min("key").alias("key")).select("key"), "key", "left_semi"))
    # folds of one width meet; a set that may be linked to one of the next smaller width joins there too, folded on to it
    half = F.expr("zip_with(slice(fold, 1, size(fold) div 2), slice(fold, size(fold) div 2 + 1, size(fold) div 2), (x, y) -> x ^ y)")
    below = (F.size("fold") > FOLD_WORDS) & (F.col("n") * num <= F.size("fold") * (16 * den))
    data = reps.select("sid", "n", F.explode(F.when(below, F.array("fold", half)).otherwise(F.array("fold"))).alias("fold"))
    met = units(rows, "key", F.lit(1), UNIT_ROWS).join(data, "sid").select(
        F.col("u").alias("c"), F.col("key").alias("g"), "sid", "component", "n", "fold", F.size("fold").alias("w"))
    parts = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = met.repartition(parts, "w", "c", "g").sortWithinPartitions("w", "c", "g").drop("w")
    pairs = cut(dealt.mapInArrow(meetings(num, den, forest=True), "c long, a long, b long").select("a", "b").distinct())
    cluster = min_labels(pairs, cut).select(F.col("node").alias("sid"), F.col("component").alias("c"))
    members = cluster.join(rows.select("sid", "component").distinct(), "sid")
    return exact_links(members, reps, docs, k, num, den, merged=True)


def _components(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, h, n_shingles, component (a set id, null for empty sets), component_id and n_links of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    described = cut(docs.mapInArrow(describe(k), "doc_id long, h long, n_shingles long, sid long, fold array<long>"))
    reps = described.where("n_shingles > 0").groupBy("sid").agg(F.min(F.struct("doc_id", "h", F.col("n_shingles").alias("n"), "fold")).alias("r"))
    reps = cut(reps.select("sid", "r.doc_id", "r.h", "r.n", "r.fold"))
    w = Window.partitionBy("gkey")
    rows = docs.select("text").mapInArrow(probe(k, num, den), "gkey long, sid long, key long")
    shared = rows.withColumn("a", F.min("sid").over(w)).withColumn("z", F.max("sid").over(w)).where("a <> z")
    shared = cut(shared.select(F.coalesce("key", "gkey").alias("key"), "sid", "a"))
    met = shared.where("sid <> a").groupBy("a", F.col("sid").alias("b")).agg(F.count("*").alias("times"))
    # every set is compared with the pivot it shares most buckets with
    best = met.groupBy("b").agg(F.min(F.struct((-F.col("times")).alias("t"), "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    links = cut(star_links(best, reps, docs, k, num, den))
    label = cut(min_labels(links, cut))
    # what is left: sets that share a bucket and that links, so far, do not connect
    more = links.unionByName(open_links(shared, label, reps, docs, k, num, den))
    links = cut(more.distinct())
    label = cut(min_labels(links, cut))
    ends = links.select(F.col("a").alias("sid")).unionByName(links.select(F.col("b").alias("sid"))).groupBy("sid").agg(F.count("*").alias("n_links"))
    filled = described.where("n_shingles > 0")
    node = filled.groupBy("sid").agg(F.min("doc_id").alias("low"))
    node = node.join(label.select(F.col("node").alias("sid"), "component"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    low = node.groupBy("component").agg(F.min("low").alias("component_id"))
    named = node.join(low, "component").join(ends, "sid", "left").select("sid", "component", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return described.join(named, "sid", "left").select(
        "doc_id", "h", "n_shingles", "component",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"))


def components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every row of `docs` (doc_id, text).

    Two documents are linked when den * |A and B| >= num * |A or B| for their sets of
    distinct k-word shingles; component_id is the smallest doc_id reachable by links.
    Empty sets (null, empty or white text) are linked with nothing and keep their own id.
    n_links counts the verified links of the document's set to other sets found while
    joining (at least one for a set that has a link), not copies of the set itself.
    Repeated rows and repeated ids give one result row each; other columns are ignored.
    A null doc_id is kept; its component is the smallest id of its group, or null.
    """
    return _components(docs, k, num, den).select("doc_id", "n_shingles", "component_id", "n_links")


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of `docs` without the near copies: of every component one row stays.

    It is a row with the component's smallest doc_id, a null only where all are null; rows
    are told apart by id and text, so a repeated or null id keeps a row in every component
    it leads. Documents without words are no copies of anything and all stay. Columns and
    their order are those of `docs`.
    """
    found = cut(_components(docs, k, num, den).select("doc_id", "h", "n_shingles", "component"))
    lead = found.where("n_shingles > 0").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "h")).alias("r"))
    lead = lead.select(F.col("r.doc_id").alias("__d"), F.col("r.h").alias("__y"), F.lit(True).alias("__lead"))
    texts = found.where("n_shingles > 0").groupBy(F.col("doc_id").alias("__key"), F.col("h").alias("__x")).agg(F.count("*").alias("__m"))
    # most rows stay as they are: named are those that go and those of which one stays
    named = texts.join(lead, F.col("__key").eqNullSafe(F.col("__d")) & (F.col("__x") == F.col("__y")), "left").where("__lead is null or __m > 1")
    named = checked_broadcast(named.select("__key", "__x", F.coalesce("__lead", F.lit(False)).alias("__one")), BATCH_IDS)
    rows = docs.withColumnRenamed("doc_id", "__id").withColumn("__h", F.xxhash64("text"))
    told = rows.join(named, F.col("__id").cast("long").eqNullSafe(F.col("__key")) & (F.col("__h") == F.col("__x")), "left")
    first = told.where("__one").withColumn("__k", F.row_number().over(Window.partitionBy("__id", "__h").orderBy("__h"))).where("__k = 1").drop("__k")
    return told.where("__one is null").unionByName(first).withColumnRenamed("__id", "doc_id").select(*docs.columns)
