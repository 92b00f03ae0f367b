"""Language identification with error-correcting output codes.

Every language gets a codeword; one binary classifier per code bit predicts that bit from
hashed character n-grams of the whole text. Decoding picks the codeword with the smallest
logistic loss, each bit weighted by how well its classifier separated the training rows.
A text whose two best codewords are nearly as likely is flagged as ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMS = 4096            # hashed n-gram dimensions
CODE_BITS = 15         # classifiers
SAMPLE_ROWS = 3000     # training rows at most, spread evenly over the languages
EPOCHS = 120
UNDETERMINED = "und"
MARGIN = 0.05          # probability gap under which a prediction is ambiguous


@dataclass
class Model:
    """Languages in sorted order, their codewords (+1/-1), bit weights and classifiers."""
    langs: list[str]
    codes: np.ndarray
    bit_weight: np.ndarray
    weights: np.ndarray
    bias: np.ndarray


_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.array([chr(i).isalpha() for i in range(0x10000)]))
    return _LETTER[0]


def features(text: str | None) -> np.ndarray | None:
    """Square roots of the shares of hashed 1- to 3-grams of letters; None without a letter.

    Letters are lower-cased, every run of other characters becomes one separator.
    """
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    small = c < 0x10000
    letter = _letters()[np.where(small, c, 0)]
    if not small.all():
        letter = letter | np.array([x >= 0x10000 and chr(x).isalpha() for x in c.tolist()])
    if not letter.any():
        return None
    keep = letter | np.concatenate(([True], letter[:-1]))       # the first of a run of separators
    c = np.concatenate((np.zeros(1, np.uint32), np.where(letter, c, 0)[keep].astype(np.uint32), np.zeros(1, np.uint32)))
    out = np.zeros(DIMS)
    for n in (1, 2, 3):
        if len(c) < n:
            continue
        h = np.full(len(c) - n + 1, n, np.uint32)
        for j in range(n):
            h = (h ^ c[j:len(c) - n + 1 + j]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        out += np.bincount(h & np.uint32(DIMS - 1), minlength=DIMS) / len(h)
    return np.sqrt(out / out.sum()).astype(np.float32)


def codewords(n: int, bits: int = CODE_BITS) -> np.ndarray:
    """n codewords of +1/-1, from a seeded search for a large smallest distance.

    Every bit splits the languages and no bit repeats another or its complement while
    enough splits exist.
    """
    if n < 2:
        return np.ones((n, bits), np.int8)
    rng, best, best_d = np.random.default_rng(11), None, -1
    for _ in range(200):
        cols, seen = [], set()
        for _ in range(50 * bits):
            col = rng.permutation(np.where(np.arange(n) % 2 == rng.integers(2), 1, -1)) if n > 2 else np.array([1, -1])
            key = tuple((col * col[0]).tolist())
            if key in seen and len(seen) < 2 ** (n - 1) - 1 and len(cols) < len(seen) + 3:
                continue
            seen.add(key)
            cols.append(col)
            if len(cols) == bits:
                break
        while len(cols) < bits:
            cols.append(cols[len(cols) % max(1, len(seen))])
        m = np.array(cols).T
        d = min(int((m[i] != m[j]).sum()) for i in range(n) for j in range(i))
        if d > best_d:
            best, best_d = m, d
    return best.astype(np.int8)


def _vectors(batches):
    for b in batches:
        found = [features(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("lang"), pa.array([None if f is None else f.tobytes() for f in found], pa.binary())], ["lang", "vector"])


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Train on `docs` (doc_id, text, lang): rows with a language and a letter.

    At most about `sample_rows` rows are used, chosen per language by a hash of the text
    (the rule does not depend on row order); counts of the languages cover all rows. Only
    sampled vectors reach the driver, DIMS * 4 bytes each. Without labelled rows the model
    knows no language and every prediction is undetermined.
    """
    rows = docs.select("text", "lang").where("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.ones((0, CODE_BITS), np.int8), np.ones(CODE_BITS), np.zeros((DIMS, CODE_BITS)), np.zeros(CODE_BITS))
    share = max(1, sample_rows // len(langs))
    cut_at = F.lit(0.0)
    for name in langs:
        cut_at = F.when(F.col("lang") == name, F.lit(min(1.0, share / counts[name]))).otherwise(cut_at)
    picked = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < cut_at * 1_000_003)
    got = picked.mapInArrow(_vectors, "lang string, vector binary").where("vector is not null").limit(2 * sample_rows).toArrow()
    names, vectors = got.column("lang").to_pylist(), got.column("vector").to_pylist()
    order = sorted(range(len(names)), key=lambda i: (names[i], vectors[i]))
    langs = sorted(set(names))
    x = np.stack([np.frombuffer(vectors[i], np.float32) for i in order]) if order else np.zeros((0, DIMS), np.float32)
    y = np.array([langs.index(names[i]) for i in order], int)
    codes = codewords(len(langs))
    target = (codes[y] if len(y) else np.zeros((0, CODE_BITS))).astype(np.float32)
    weights, bias = np.zeros((DIMS, CODE_BITS), np.float32), np.zeros(CODE_BITS, np.float32)
    row_weight = np.ones(len(y), np.float32)
    for k in range(len(langs)):                      # each language counts alike
        row_weight[y == k] = len(y) / (len(langs) * max(1, (y == k).sum()))
    step_w, step_b = np.zeros_like(weights), np.zeros_like(bias)
    for _ in range(EPOCHS if len(y) else 0):
        slope = -target / (1 + np.exp(np.clip(target * (x @ weights + bias), -30, 30))) * row_weight[:, None] / len(y)
        step_w = 0.9 * step_w - 8.0 * (x.T @ slope + 1e-5 * weights)
        step_b = 0.9 * step_b - 2.0 * slope.sum(0)
        weights, bias = weights + step_w, bias + step_b
    if len(y):
        right = (((x @ weights + bias) * target > 0) * row_weight[:, None]).sum(0) / row_weight.sum()
        bit_weight = np.maximum(2 * right - 1, 0.0)
        bit_weight = bit_weight / bit_weight.sum() * CODE_BITS if bit_weight.sum() else np.ones(CODE_BITS)
    else:
        bit_weight = np.ones(CODE_BITS)
    return Model(langs, codes, bit_weight, weights, bias)


def decode(model: Model, x: np.ndarray) -> np.ndarray:
    """Probabilities over the languages from loss-weighted distances to the codewords."""
    f = x @ model.weights + model.bias
    loss = np.logaddexp(0, -f[:, None, :] * model.codes[None]) @ model.bit_weight
    p = np.exp(loss.min(1, keepdims=True) - loss)
    return p / p.sum(1, keepdims=True)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) and ambiguous for every row, from the text alone.

    Null text and text without a letter: `und`, score 0, not ambiguous. Of equally likely
    languages the first in sorted order wins. Repeated rows give repeated results; other
    columns are not read.
    """
    def run(batches):
        for b in batches:
            lang, score, open_ = [], [], []
            texts = b.column("text").to_pylist()
            for at in range(0, len(texts), 256):
                found = [features(t) for t in texts[at:at + 256]]
                have = [f for f in found if f is not None]
                p = iter(decode(model, np.stack(have))) if have and model.langs else None
                for f in found:
                    if f is None or p is None:
                        lang.append(UNDETERMINED), score.append(0.0), open_.append(False)
                        continue
                    q = next(p)
                    best = int(np.argmax(q))
                    rest = np.delete(q, best)
                    lang.append(model.langs[best]), score.append(float(q[best]))
                    open_.append(bool(len(rest) and q[best] - rest.max() < MARGIN))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(open_, pa.bool_())],
                ["doc_id", "lang_pred", "score", "ambiguous"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def held_out(doc_id):
    """Rows no model learns from: crc32 of the id as text leaves 1 modulo 3 (a null id leaves 0)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def keep_identified(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of `docs` whose text has a language the classifiers settle on.

    Rows without a letter and ambiguous rows are rejected, by text, so equal texts share
    their fate. Columns and their order are those of `docs`.
    """
    model = fit(docs.where(~held_out("doc_id")), sample_rows)
    columns = docs.columns

    def run(batches):
        for b in batches:
            texts, keep = b.column("text").to_pylist(), []
            for at in range(0, len(texts), 256):
                found = [features(t) for t in texts[at:at + 256]]
                have = [f for f in found if f is not None]
                p = iter(decode(model, np.stack(have))) if have and model.langs else None
                for f in found:
                    top = None if f is None or p is None else np.sort(next(p))[::-1]
                    keep.append(top is not None and not (len(top) > 1 and top[0] - top[1] < MARGIN))
            yield b.filter(pa.array(keep, pa.bool_()))
    return docs.mapInArrow(run, docs.schema).select(*columns)
