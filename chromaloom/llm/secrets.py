"""Secret scans with a random forest that removes false findings.

A broad pattern finds candidates (runs of key characters with a digit). Each candidate is
described by its length, the transitions between its character classes, how much of it is
covered by dictionary words, whether it reads like a path or address, and the words next to
it. A random forest trained from labelled findings decides which candidates are secrets.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaloom.session import cut

MIN_LENGTH = 12
TRAIN_ROWS = 4000          # labelled findings the forest learns from, at most about half per label
TREES, DEPTH, LEAF = 25, 8, 4
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=.@:%~-]{{{MIN_LENGTH},}}")

# Names that announce a credential, and what assigns it.
KEY_WORDS = frozenset("token key apikey secret password passwd pwd auth bearer credential credentials private access passphrase "
                      "client_secret api_key access_key".split())
ASSIGNS = frozenset(["=", ":", ":=", "=>", "->"])
CLASSES = 5                # lower, upper, digit, separator, other
FEATURES = 10 + CLASSES * CLASSES + 9


def dictionary(path: str, least: int = 4) -> frozenset[str]:
    """Words of a public vocabulary file: pieces that open a word and have `least` letters or more."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    return frozenset(p[1:].lower() for p in names if p.startswith("▁") and len(p) > least and p[1:].isalpha())


def _classes(value: str) -> np.ndarray:
    return np.array([0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c in "/._-:=@" else 4 for c in value])


def coverage(value: str, known: frozenset[str]) -> float:
    """Share of the candidate's characters inside dictionary words (longest first, left to right)."""
    low, at, hit = value.lower(), 0, 0
    while at < len(low):
        for size in range(min(14, len(low) - at), 3, -1):
            if low[at:at + size] in known:
                hit += size
                at += size
                break
        else:
            at += 1
    return hit / len(low)


def describe(text: str, start: int, end: int, known: frozenset[str]) -> list[float]:
    """The features of the candidate text[start:end]."""
    value = text[start:end]
    c = _classes(value)
    n = len(value)
    share = np.bincount(c, minlength=CLASSES) / n
    counts = np.unique(np.array(list(value)), return_counts=True)[1] / n
    moves = np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES) / max(1, n - 1)
    before, after = text[max(0, start - 60):start], text[end:end + 30]
    left = before.replace('"', " ").replace("'", " ").split()
    words = [w.strip(".,;:=()[]{}<>").lower() for w in left[-3:]]
    right = after.split()
    assigned = bool(left) and (left[-1] in ASSIGNS or left[-1][-1] in "=:")
    return [float(n), float(-(counts * np.log2(counts)).sum()), *share.tolist(), coverage(value, known),
            float((c[1:] != c[:-1]).mean()) if n > 1 else 0.0, float(all(x in "0123456789abcdefABCDEF" for x in value)),
            *moves.tolist(),
            float(value.count("/") + value.count("\\")), float(value.count(".")), float("@" in value or "://" in value), float(value[0] in "/~."),
            float(any(w in KEY_WORDS for w in words)), float(assigned), float(before[-1:] in "\"'" and before != ""),
            float(after[:1] in "\"'" and after != ""), float(bool(right) and right[0][:1].isalpha())]


def scan(docs: DataFrame, known: frozenset[str]) -> DataFrame:
    """doc_id, start, length and features of every candidate in the whole texts.

    Null and empty texts have none; repeated rows repeat their candidates; other columns are
    not read. Positions count code points.
    """
    def run(batches):
        for b in batches:
            doc, start, size, feats = [], [], [], []
            for name, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                for m in CANDIDATE.finditer(text or ""):
                    if any(x.isdigit() for x in m[0]):
                        doc.append(name), start.append(m.start()), size.append(m.end() - m.start())
                        feats.append(describe(text, m.start(), m.end(), known))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(feats, pa.list_(pa.float64()))],
                ["doc_id", "start", "length", "features"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, features array<double>")


@dataclass
class Forest:
    """Trees as flat arrays: feature (-1 at a leaf), threshold, left and right child, share of secrets."""
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Mean share of secrets over the trees; without trees nothing is a secret."""
        total = np.zeros(len(x))
        for feature, threshold, left, right, share in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(DEPTH + 1):
                f = feature[node]
                inner = f >= 0
                go = x[np.arange(len(x)), np.maximum(f, 0)] <= threshold[node]
                node = np.where(inner, np.where(go, left[node], right[node]), node)
            total += share[node]
        return total / max(1, len(self.trees))


def _grow(x, y, rng):
    feature, threshold, left, right, share = [], [], [], [], []
    tries = max(1, int(math.sqrt(x.shape[1])) + 1)

    def build(rows, depth):
        at = len(feature)
        for a, v in ((feature, -1), (threshold, 0.0), (left, 0), (right, 0), (share, float(y[rows].mean()))):
            a.append(v)
        if depth == DEPTH or len(rows) < 2 * LEAF or share[at] in (0.0, 1.0):
            return at
        best = None
        for f in rng.permutation(x.shape[1])[:tries]:
            values = np.unique(x[rows, f])
            if len(values) < 2:
                continue
            middle = (values[1:] + values[:-1]) / 2
            for t in middle[np.unique(np.linspace(0, len(middle) - 1, 16).astype(int))]:
                go = x[rows, f] <= t
                k = int(go.sum())
                if k < LEAF or len(rows) - k < LEAF:
                    continue
                p, q = y[rows[go]].mean(), y[rows[~go]].mean()
                impurity = k * p * (1 - p) + (len(rows) - k) * q * (1 - q)
                if best is None or impurity < best[0]:
                    best = (impurity, f, t)
        if best is None:
            return at
        go = x[rows, best[1]] <= best[2]
        feature[at], threshold[at] = int(best[1]), float(best[2])
        left[at] = build(rows[go], depth + 1)
        right[at] = build(rows[~go], depth + 1)
        return at

    build(rng.integers(0, len(x), len(x)), 0)
    return tuple(np.array(v) for v in (feature, threshold, left, right, share))


def fit(findings: DataFrame, train_rows: int = TRAIN_ROWS, seed: int = 5) -> Forest:
    """A forest from labelled `findings` (features, is_secret); rows without a label are skipped.

    About train_rows / 2 rows of each label are used, picked by a hash of their features;
    only they reach the driver. With one label or none the forest has no tree, or trees of
    that label only.
    """
    rows = findings.where("is_secret is not null").select("features", F.col("is_secret").cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    share = F.lit(0.0)
    for label, count in counts.items():
        share = F.when(F.col("y") == label, F.lit(min(1.0, train_rows / 2 / count))).otherwise(share)
    picked = rows.where(F.pmod(F.xxhash64("features"), F.lit(1_000_003)) < share * 1_000_003).limit(2 * train_rows).collect()
    if not picked:
        return Forest([])
    data = sorted((tuple(r["features"]), r["y"]) for r in picked)
    x, y = np.array([d[0] for d in data]), np.array([d[1] for d in data], float)
    return Forest([_grow(x, y, np.random.default_rng(seed + k)) for k in range(TREES)])


def classify(found: DataFrame, forest: Forest, least: float = 0.5) -> DataFrame:
    """doc_id, start, length, score and is_secret (score >= least) of every candidate."""
    def run(batches):
        for b in batches:
            x = np.array(b.column("features").to_pylist(), float).reshape(-1, FEATURES)
            score = forest.score(x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("length"), pa.array(score), pa.array(score >= least)],
                                             ["doc_id", "start", "length", "score", "is_secret"])
    return found.select("doc_id", "start", "length", "features").mapInArrow(
        run, "doc_id long, start long, length long, score double, is_secret boolean")


def labelled(found: DataFrame) -> DataFrame:
    """Findings with a label where the surroundings settle it: an assignment to a credential
    name is a secret, a candidate without name and assignment is none, the rest has no label."""
    named, assigned = F.get("features", FEATURES - 5) > 0, F.get("features", FEATURES - 4) > 0
    return found.withColumn("is_secret", F.when(named & assigned, True).when(~named & ~assigned, False))


def scan_and_classify(docs: DataFrame, known: frozenset[str], findings: DataFrame | None = None) -> DataFrame:
    """Scan `docs`, train from `findings` (or from the candidates their surroundings label) and classify."""
    found = cut(scan(docs, known))
    return classify(found, fit(labelled(found) if findings is None else findings))
