"""Line dedup by a segment-partition edit join.

Two lines are linked when their edit distance (insert, delete, substitute a code point) is
at most `k`. A line of n code points is cut into k + 1 segments of nearly equal length; a
line within distance k of it contains one of the segments unchanged, shifted by a few
places. Segments of the shorter line go to an index keyed by (length, segment number,
segment), the other line probes every substring that could be that segment: with l the
length difference, segment i (from 0, start p) can only begin at p - i .. p + i counted from
the front and, counted from the back with k - i segments behind it, at p + l - (k - i) ..
p + l + (k - i). Candidates are verified by Myers' bit-parallel edit distance, run in bands
of one machine word that follow the diagonal and stop above k.

Equal lines are one class before anything is joined: a task emits a line once. Rows carry a
signature, 32 parities of code points and 32 of neighbouring pairs; an edit flips at most 2
of the first and 4 of the second, so most lines that merely share a segment are told apart
in the sorted stream of a key and never become rows. A key's index rows (24 bytes each) are
all a task holds of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaloom.llm.common import min_labels
from chromaloom.session import checked_broadcast, cut

DISTANCE = 2
MIN_NEAR = 16          # lines with fewer code points are duplicates of equal lines only
BASE = 0x9E3779B97F4A7C15   # of the running hashes; odd, so it has an inverse
CHUNK = 500_000        # code points that are hashed together
MANY = 64              # rows of a key up to which the keys of a batch are compared together
LINE_IDS = 1_000_000   # candidate line ids a broadcast may hold


def segments(n: int, k: int) -> list[tuple[int, int]]:
    """(start, length) of the k + 1 segments of a line of n code points, short ones first."""
    base, more = divmod(n, k + 1)
    out, at = [], 0
    for i in range(k + 1):
        size = base + (1 if i >= k + 1 - more else 0)
        out.append((at, size))
        at += size
    return out


def probe_starts(n: int, length: int, i: int, start: int, size: int, k: int) -> range:
    """Starts of the substrings of a line of n code points that may equal segment i of a
    line of `length` <= n code points."""
    shift = n - length
    low = max(0, start - i, start + shift - (k - i))
    high = min(n - size, start + i, start + shift + (k - i))
    return range(low, high + 1)


def probes(n: int, k: int) -> list[tuple[int, int, int, int]]:
    """(seed of length and segment, start, end, role) of the keys of a line of n code points;
    role 0 is a segment of the line itself."""
    out = []
    for length in range(max(MIN_NEAR, n - k), n + 1):
        for i, (start, size) in enumerate(segments(length, k)):
            for p in probe_starts(n, length, i, start, size, k):
                out.append(((length << 8) | i, p, p + size, 0 if length == n and p == start else 1))
    return out


def edit_within(a: str, b: str, k: int) -> bool:
    """Edit distance of a and b <= k by bit-parallel columns in a diagonal band (k <= 31).

    Bit 63 of the word is the row k below the diagonal, lower bits the rows above it. The
    word moves one row down per column, so the score of its lowest row grows with the
    diagonal differences until that row is the last one of `a`; from there on the score
    follows the horizontal differences of that row, which climbs one bit per column.
    """
    n, m = len(a), len(b)
    if abs(n - m) > k:
        return False
    p = 0
    while p < min(n, m) and a[p] == b[p]:
        p += 1
    a, b = a[p:], b[p:]
    p = 0
    while p < min(len(a), len(b)) and a[-1 - p] == b[-1 - p]:
        p += 1
    a, b = a[:len(a) - p], b[:len(b) - p]
    n, m = len(a), len(b)
    if not n or not m:
        return max(n, m) <= k
    if n <= k:
        return max(n, m) <= k or _plain_distance(a, b) <= k
    full = (1 << 64) - 1
    at: dict[str, list[int]] = {}
    for r, c in enumerate(a):
        at.setdefault(c, []).append(r)
    plus, minus, score, limit = (full << (63 - k)) & full, 0, k, k + m - (n - k)
    row = 1 << 62
    for j in range(m):
        low, eq = j + k - 63, 0
        for r in at.get(b[j], ()):
            if low <= r <= j + k:
                eq |= 1 << (r - low)
        diag = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        up = (minus | ~(diag | plus)) & full
        down = diag & plus
        if j < n - k:
            score += not diag >> 63
        else:
            score += bool(up & row) - bool(down & row)
            row >>= 1
        if score > limit:
            return False
        plus = (down | ~((diag >> 1) | up)) & full
        minus = (diag >> 1) & up
    return score <= k


def _plain_distance(a: str, b: str) -> int:
    """Distance of two very short strings."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j] + 1, row[j + 1] + 1, last + (x != y))
    return row[-1]


def _signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def clean(line: str) -> str:
    return " ".join(line.split())


def text_lines(text: str | None) -> list[str]:
    """Lines of a text with white space runs as one space, ends trimmed, empty ones left out."""
    return [x for x in map(clean, (text or "").split("\n")) if x]


def line_id(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Hashes:
    """Hashes of any substring of the lines of a chunk: differences of one running polynomial sum, modulo 2^64.

    Equal substrings have equal hashes wherever they stand; a chance meeting of others is one more candidate only.
    """

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def read(self, lines: list[str]) -> None:
        """Takes the lines (none empty) of a chunk; `starts` are their first places in it, `signatures` their parities."""
        c = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(self.up) <= len(c):
            size = max(2 * len(self.up), len(c) + 1)
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                power = np.full(size, base, np.uint64)
                power[0] = 1
                setattr(self, name, np.cumprod(power))
        self.starts = np.cumsum([0, *map(len, lines)])[:-1]
        self.sums = np.zeros(len(c) + 1, np.uint64)
        np.cumsum(mixed(c.astype(np.uint64)) * self.up[:len(c)], out=self.sums[1:])
        bits = np.uint64(1) << (((c[:-1] * np.uint32(0x9E3779B1) + c[1:]) * np.uint32(0x85EBCA6B)) >> np.uint32(27)).astype(np.uint64)
        bits[self.starts[1:] - 1] = 0                   # a pair lies inside a line
        parities = np.uint64(1) << ((c & np.uint32(31)) + np.uint32(32)).astype(np.uint64)
        parities[:-1] |= bits
        self.signatures = np.bitwise_xor.reduceat(parities, self.starts)

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (self.sums[high] - self.sums[low]) * self.down[low]


def describe(batches):
    """Task: (doc_id, k, lid) of every line."""
    for b in batches:
        doc, k, lid = [], [], []
        for name, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            for i, line in enumerate(text_lines(text)):
                doc.append(name), k.append(i), lid.append(line_id(line))
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(k, pa.int32()), pa.array(_signed(lid))], ["doc_id", "k", "lid"])


def emit(distance: int):
    """Task: index rows (role 0) and probe rows (role 1) of every line, once per line and task.

    Lines are taken in chunks; rows of a line stay together, they pack better.
    """
    def run(batches):
        seen: set[int] = set()
        begin: dict[int, int] = {}                      # where the plan of a length begins in `plans`
        count: dict[int, int] = {}
        plans, hashes = [np.empty(0, np.int64)] * 4, Hashes()

        def rows(chunk: list[str], own: list[int]) -> pa.RecordBatch:
            nonlocal plans
            hashes.read(chunk)
            size, new, end = [len(x) for x in chunk], [], len(plans[0])
            for n in set(size).difference(begin):
                begin[n] = end + len(new)
                new.extend(probes(n, distance))
                count[n] = end + len(new) - begin[n]
            if new:
                plans = [np.concatenate((x, np.array(y, np.int64))) for x, y in zip(plans, zip(*new))]
            each = np.array([count[n] for n in size])
            total = int(each.sum())
            at = np.arange(total) + np.repeat(np.array([begin[n] for n in size]) - np.cumsum(each) + each, each)
            seed, low, high, role = (x[at] for x in plans)
            first = np.repeat(hashes.starts, each)
            key = mixed(hashes.of(first + low, first + high) + seed.astype(np.uint64) * np.uint64(BASE))
            return pa.RecordBatch.from_arrays(
                [pa.array(_signed(key)), pa.array(role.astype(np.int8)), pa.array(_signed(np.repeat(np.array(own, np.uint64), each))),
                 pa.array(_signed(np.repeat(hashes.signatures, each)))], ["key", "role", "lid", "sig"])

        for b in batches:
            chunk, own, size = [], [], 0
            for text in b.column("text").to_pylist():
                for line in text_lines(text):
                    if len(line) < MIN_NEAR:
                        continue
                    name = line_id(line)
                    if name in seen:
                        continue
                    seen.add(name)
                    chunk.append(line), own.append(name)
                    size += len(line)
                    if size >= CHUNK:
                        yield rows(chunk, own)
                        chunk, own, size = [], [], 0
            if chunk:
                yield rows(chunk, own)
    return run


_LOW = np.uint64(0xFFFFFFFF)


def candidates(distance: int):
    """Task over rows sorted by (key, role): pairs (a, b) of lines that meet and whose
    signatures allow the distance, each pair once per batch."""
    def close(x, y):
        d = x ^ y
        return (np.bitwise_count(d >> np.uint64(32)) <= 2 * distance) & (np.bitwise_count(d & _LOW) <= 4 * distance)

    def run(batches):
        held_key, held_lid, held_sig = None, np.empty(0, np.uint64), np.empty(0, np.uint64)
        for b in batches:
            key = b.column("key").to_numpy()
            role = b.column("role").to_numpy()
            lid = b.column("lid").to_numpy().view(np.uint64)
            sig = b.column("sig").to_numpy().view(np.uint64)
            if not len(key):
                continue
            edge = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
            # the first group may go on from the last batch, the last one into the next; of the others only
            # groups with an index row and different lines can give pairs
            inside = np.arange(1, len(edge) - 2)
            size, index = np.diff(edge), np.add.reduceat((role == 0).astype(np.int64), edge[:-1])
            inside = inside[(size[inside] > 1) & (index[inside] > 0)]
            inside = inside[np.minimum.reduceat(lid, edge[:-1])[inside] != np.maximum.reduceat(lid, edge[:-1])[inside]]
            large = inside[size[inside] > MANY]
            groups = {0, len(edge) - 2} | set(large.tolist())
            found_a, found_b = [], []
            some, step = inside[size[inside] <= MANY], 0
            while len(some):                            # the step-th index row of every group with all behind it
                left = size[some] - step - 1
                x = np.repeat(edge[some] + step, left)
                y = np.arange(len(x)) - np.repeat(np.cumsum(left) - left, left) + x + 1
                ok = np.flatnonzero(close(sig[x], sig[y]) & (lid[x] != lid[y]))
                found_a.append(lid[x[ok]])
                found_b.append(lid[y[ok]])
                step += 1
                some = some[(index[some] > step) & (size[some] > step + 1)]
            for g in sorted(groups):
                lo, hi = edge[g], edge[g + 1]
                split = lo + int((role[lo:hi] == 0).sum())
                index_lid, index_sig = lid[lo:split], sig[lo:split]
                if held_key is not None and key[lo] == held_key:
                    old_lid, old_sig = held_lid, held_sig
                else:
                    old_lid, old_sig = held_lid[:0], held_sig[:0]
                everyone_lid, everyone_sig = np.concatenate((old_lid, index_lid)), np.concatenate((old_sig, index_sig))
                for j in range(lo, hi):
                    known = len(old_lid) + j - lo if j < split else len(everyone_lid)
                    ok = close(everyone_sig[:known], sig[j])
                    if ok.any():
                        other = everyone_lid[:known][ok]
                        other = other[other != lid[j]]
                        found_a.append(other)
                        found_b.append(np.full(len(other), lid[j], np.uint64))
                if g == len(edge) - 2:
                    held_key, held_lid, held_sig = key[lo], everyone_lid, everyone_sig
            if sum(map(len, found_a)):
                a, c = np.concatenate(found_a).view(np.int64), np.concatenate(found_b).view(np.int64)
                pairs = np.unique(np.stack((np.minimum(a, c), np.maximum(a, c)), 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])
    return run


def near_lines(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) between different lines, by line id, of at most `distance` edits."""
    parts = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select("text").mapInArrow(emit(distance), "key long, role byte, lid long, sig long")
    dealt = rows.repartition(parts, "key").sortWithinPartitions("key", "role")
    pairs = cut(dealt.mapInArrow(candidates(distance), "a long, b long").distinct())
    wanted = pairs.select(F.col("a").alias("w")).unionByName(pairs.select(F.col("b").alias("w"))).distinct()

    def lines(batches):
        seen: set[int] = set()
        for b in batches:
            lid, line = [], []
            for text in b.column("text").to_pylist():
                for x in text_lines(text):
                    own = line_id(x)
                    if len(x) >= MIN_NEAR and own not in seen:
                        seen.add(own)
                        lid.append(own), line.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(lid)), pa.array(line, pa.string())], ["lid", "line"])

    texts = docs.select("text").mapInArrow(lines, "lid long, line string").join(
        checked_broadcast(wanted, LINE_IDS), F.col("lid") == F.col("w"), "left_semi")
    texts = cut(texts.dropDuplicates(["lid"]))
    both = pairs.join(texts.select(F.col("lid").alias("a"), F.col("line").alias("x")), "a").join(
        texts.select(F.col("lid").alias("b"), F.col("line").alias("y")), "b")

    def verify(batches):
        for b in batches:
            ok = [edit_within(x, y, distance) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist())]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return cut(both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"))


def line_classes(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, k, lid, class_id, n_links and is_kept of every line of `docs` (doc_id, text).

    Lines are equal after white space is normalised (`text_lines`), near when at most
    `distance` edits apart and at least MIN_NEAR code points long. A class is what equal and
    near lines connect; its line with the smallest (doc_id, k) is kept, a null doc_id being
    smaller than all. Texts without lines give no row. Other columns are not read.
    """
    own = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(describe, "doc_id long, k int, lid long"))
    links = near_lines(docs, distance)
    label = cut(min_labels(links, cut)).select(F.col("node").alias("__n"), "component")
    ends = links.select(F.col("a").alias("__e")).unionByName(links.select(F.col("b").alias("__e"))).groupBy("__e").agg(F.count("*").alias("n_links"))
    near = cut(label.join(ends, F.col("__n") == F.col("__e")).select("__n", "component", "n_links"))
    rows = own.join(near, F.col("lid") == F.col("__n"), "left").select(
        "doc_id", "k", "lid", F.coalesce("component", "lid").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    first = rows.groupBy(F.col("class_id").alias("__c")).agg(F.min(F.struct("doc_id", "k")).alias("f"), F.count("*").alias("class_size"))
    return rows.join(first, F.col("class_id") == F.col("__c")).select(
        "doc_id", "k", "lid", "class_id", "class_size", "n_links",
        (F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("k") == F.col("f.k"))).alias("is_kept"))


def line_report(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, n_lines, n_kept, n_near and n_links of every row of `docs`.

    n_kept counts lines kept as the first of their class, n_near lines with a near line of
    another text, n_links those other lines. Documents without lines have zeros; rows that
    share a doc_id share its counts.
    """
    per = line_classes(docs, distance).groupBy(F.col("doc_id").alias("__d")).agg(
        F.count("*").alias("n_lines"), F.sum(F.col("is_kept").cast("long")).alias("n_kept"),
        F.count(F.when(F.col("n_links") > 0, 1)).alias("n_near"), F.sum("n_links").alias("n_links"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(per, F.col("doc_id").eqNullSafe(F.col("__d")), "left").select(
        "doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_lines", "n_kept", "n_near", "n_links")])
