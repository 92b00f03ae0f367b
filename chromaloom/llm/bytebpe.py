"""Byte-level BPE: texts to ids by a table of ranks, and ids back to bytes.

A text is cut by the tokenizer's pattern; every distinct piece is encoded once per slice of a
batch. Pieces of similar length lie in one padded matrix of symbols. A round looks at every row
at once: the leftmost pair with the smallest rank is merged, the row closes up by one column,
and only the two pairs around the merge are looked up again, in an open-addressing table of
(left id, right id). Rows without a pair left leave the matrix, so it shrinks in both directions.
"""

from __future__ import annotations

import base64
import heapq
import sys
from array import array
from collections import ChainMap
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
import tiktoken
from pyspark.sql import DataFrame

NONE = np.int32(2**31 - 1)                # no such pair
EMPTY = np.uint64(2**64 - 1)              # free place of the pair table
MIX = np.uint64(0x9E3779B97F4A7C15)       # multiplier of the pair hash
EDGES = (3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768, 1024)    # widths of the matrices
WIDTHS = [next(e for e in EDGES if n <= e) for n in range(EDGES[-1] + 1)]                # of a piece's length
CELLS = 1 << 20                           # symbols of one matrix
SLICE_CHARS = 1 << 20                     # code points encoded together, and pieces of a long text at a time
MEMO_PIECES = 400_000                     # pieces a task remembers; the memo is emptied when full
MEMO_CHARS = 64                           # longer pieces are not remembered


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64 token and rank per line) in order of their ranks.

    Ranks must run from 0 without a gap and hold every single byte.
    """
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    tokens = [ranks.get(i) for i in range(len(ranks))]
    if None in tokens or len(set(tokens)) < len(pairs):
        raise ValueError("ranks must be 0 to n - 1, each token once")
    return tokens


class PairTable:
    """Rank of the token that two adjacent tokens make, for whole arrays at once."""

    def __init__(self, tokens: list[bytes]):
        rank = {t: i for i, t in enumerate(tokens)}
        keys, values = [], []
        for merged, t in enumerate(tokens):
            for cut in range(1, len(t)):
                left, right = rank.get(t[:cut]), rank.get(t[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(merged)
        keys, values = np.array(keys, np.uint64), np.array(values, np.int32)
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, EMPTY)
        self.values = np.full(1 << self.bits, NONE)
        at = self._home(keys)
        while len(keys):
            # of the keys that want one free place the first takes it, the others step on
            free = self.keys[at] == EMPTY
            place, first = np.unique(at[free], return_index=True)
            winners = np.flatnonzero(free)[first]
            self.keys[place], self.values[place] = keys[winners], values[winners]
            rest = np.ones(len(keys), bool)
            rest[winners] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & (len(self.keys) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; NONE where there is no such token or a symbol is padding (-1)."""
        keys = (left.astype(np.int64).view(np.uint64) << np.uint64(32)) | right.astype(np.uint32)
        out = np.full(keys.shape, NONE)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = keys.ravel()[todo]
        at = self._home(keys)
        while len(todo):
            found = self.keys[at]
            hit = found == keys
            out.ravel()[todo[hit]] = self.values[at[hit]]
            on = ~hit & (found != EMPTY)
            todo, keys, at = todo[on], keys[on], (at[on] + 1) & (len(self.keys) - 1)
        return out


class Encoder:
    """Merges of whole matrices; made once from the tokens and shipped with the tasks."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.single = np.array([self.rank.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.single < 0).any():
            raise ValueError("every single byte needs a rank")
        self.pairs = PairTable(tokens)

    def pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of every piece. A piece that is a token itself is that token."""
        out: list = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            own = self.rank.get(p)
            if own is not None or not p:
                out[i] = [] if own is None else [own]
            elif len(p) > EDGES[-1]:
                out[i] = self._long(p)
            else:
                by_width.setdefault(WIDTHS[len(p)], []).append(i)
        for width, members in by_width.items():
            step = max(1, CELLS // width)
            for k in range(0, len(members), step):
                part = members[k:k + step]
                for i, ids in zip(part, self._matrix([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _matrix(self, pieces: list[bytes], width: int) -> list[list[int]]:
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        m = np.full((len(pieces), width), -1, np.int32)
        m[np.arange(width) < sizes[:, None]] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        r = self.pairs(m[:, :-1], m[:, 1:])
        live, out = np.arange(len(pieces)), [None] * len(pieces)
        while len(live):
            at = r.argmin(1) if r.shape[1] else np.zeros(len(live), np.int64)
            rows = np.arange(len(live))
            best = r[rows, at] if r.shape[1] else np.full(len(live), NONE)
            done = best == NONE
            if done.any():
                for i, ids in zip(live[done].tolist(), m[done].tolist(), strict=True):
                    out[i] = ids[:ids.index(-1)] if ids[-1] < 0 else ids
                on = ~done
                m, r, live, at, best = m[on], r[on], live[on], at[on], best[on]
                rows = np.arange(len(live))
                if not len(live):
                    break
            m[rows, at] = best
            # every live row closes up by one column behind its merge
            m = np.where(np.arange(m.shape[1] - 1) > at[:, None], m[:, 1:], m[:, :-1])
            r = np.where(np.arange(r.shape[1] - 1) > at[:, None], r[:, 1:], r[:, :-1])
            before = np.flatnonzero(at > 0)
            r[before, at[before] - 1] = self.pairs(m[before, at[before] - 1], best[before])
            after = np.flatnonzero(at < r.shape[1])
            r[after, at[after]] = self.pairs(best[after], m[after, at[after] + 1])
        return out

    def _long(self, piece: bytes) -> list[int]:
        """The same rule for a piece beyond the widest matrix: a heap of (rank, place) over a
        linked row, so that a piece of n bytes takes n log n steps."""
        ids = self.single[np.frombuffer(piece, np.uint8)].astype(np.int64)
        n = len(ids)
        ranks = self.pairs(ids[:-1], ids[1:])
        heap = [(int(r), i) for i, r in enumerate(ranks.tolist()) if r != NONE]
        heapq.heapify(heap)
        ids, rank = ids.tolist(), [*ranks.tolist(), int(NONE)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        memo: dict[tuple[int, int], int] = {}

        def pair(i: int) -> None:
            j = after[i]
            if j >= n:
                rank[i] = int(NONE)
                return
            key = ids[i], ids[j]
            if key not in memo:
                memo[key] = int(self.pairs(np.array(key[:1]), np.array(key[1:]))[0])
            rank[i] = memo[key]
            if rank[i] != NONE:
                heapq.heappush(heap, (rank[i], i))

        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or rank[i] != r:
                continue
            j = after[i]
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            pair(i)
            if before[i] >= 0:
                pair(before[i])
        return [x for x in ids if x >= 0]


@lru_cache(maxsize=1)
def newer_characters() -> str:
    """The letters and numbers that the regex module knows and the tokenizer library's own
    Unicode tables do not: there they are neither. Asked of the library itself."""
    points = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    single = {bytes([b]): b for b in range(256)}
    newer: set[str] = set()
    for kind in (r"\p{L}", r"\p{N}"):
        own = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=single, special_tokens={})
        newer |= set(regex.findall(kind, points)) - set(bytes(own.encode_ordinary(points)).decode())
    return "".join(sorted(newer))


class Cutter:
    """Cuts a text into pieces by the tokenizer's pattern, with the tokenizer's classes."""

    def __init__(self, pattern: str, newer: str):
        # white space is Unicode's property in the tokenizer's matcher
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.newer = np.zeros(sys.maxunicode + 1, bool)
        self.newer[list(map(ord, newer))] = True

    def __call__(self, text: str):
        if not text.isascii():
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            found = self.newer[codes]
            if found.any():
                # a noncharacter is no letter, number or space either, and as long as what it stands for
                masked = np.where(found, np.uint32(0xFFFF), codes).tobytes().decode("utf-32-le")
                return (text[m.start():m.end()] for m in self.pattern.finditer(masked))
        return (m.group() for m in self.pattern.finditer(text)) if len(text) > SLICE_CHARS else self.pattern.findall(text)


def encode(docs: DataFrame, tokens: list[bytes], pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of every row, over the whole text.

    Null and empty texts have no ids. Repeated rows give repeated results, a null doc_id stays
    null; other columns are not read. Of several pairs with the smallest rank the leftmost is
    merged. The encoder (tokens and pair table) is bounded by the rank file and travels with the
    task; a text is cut and encoded in slices, so a task holds the ids of one slice of a batch.
    """
    encoder, newer = Encoder(tokens), newer_characters()

    def run(batches):
        cut, memo = Cutter(pattern, newer), {}

        def learn(pieces) -> dict:
            """Ids of every given piece; short pieces stay in the memo."""
            wanted = set(pieces)
            new = [p for p in wanted if p not in memo]
            if not new:
                return memo
            fresh = dict(zip(new, encoder.pieces([p.encode() for p in new]), strict=True))
            known = memo if len(memo) + len(new) <= MEMO_PIECES else {p: memo[p] for p in wanted if p in memo}
            if known is not memo:
                memo.clear()
                memo.update(known)
            memo.update((p, v) for p, v in fresh.items() if len(p) <= MEMO_CHARS)
            return memo if all(len(p) <= MEMO_CHARS for p in new) else ChainMap(fresh, memo)

        for b in batches:
            names, texts = b.column("doc_id"), b.column("text")
            k, size = 0, b.num_rows
            while k < size:
                first, chars, rows = k, 0, []
                while k < size and (k == first or chars < SLICE_CHARS):
                    text = texts[k].as_py() or ""
                    chars += len(text)
                    rows.append(text)
                    k += 1
                values, offsets = array("i"), [0]
                if len(rows) == 1 and chars > SLICE_CHARS:
                    found = iter(cut(rows[0]))
                    while some := list(islice(found, SLICE_CHARS // 4)):
                        values.extend(chain.from_iterable(map(learn(some).__getitem__, some)))
                    offsets.append(len(values))
                else:
                    split = [list(cut(t)) for t in rows]
                    known = learn(list(chain.from_iterable(split)))
                    for pieces in split:
                        values.extend(chain.from_iterable(map(known.__getitem__, pieces)))
                        offsets.append(len(values))
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(values, np.int32) if values else [], pa.int32()))
                yield pa.RecordBatch.from_arrays([names.slice(first, k - first).cast(pa.int64()), ids], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokens: list[bytes]) -> DataFrame:
    """doc_id, ids and decoded (binary): the bytes of every id in order. Null ids decode to
    no bytes; an id without a token is an error."""
    def run(batches):
        blob = np.frombuffer(b"".join(tokens), np.uint8)
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        starts = np.cumsum(sizes) - sizes

        def joined(ids: np.ndarray) -> bytes:
            long = sizes[ids]
            ends = np.cumsum(long)
            return blob[np.repeat(starts[ids] - ends + long, long) + np.arange(ends[-1])].tobytes()

        for b in batches:
            for k in range(0, b.num_rows, 128):
                part = b.slice(k, 128)
                column = part.column("ids").fill_null([])
                ids, counts = column.flatten().to_numpy(zero_copy_only=False), pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
                if len(ids) and not 0 <= ids.min() <= ids.max() < len(tokens):
                    raise ValueError("an id has no token")
                data = b"".join(joined(ids[j:j + SLICE_CHARS // 4]) for j in range(0, len(ids), SLICE_CHARS // 4))
                ends = np.concatenate(([0], np.cumsum(sizes[ids])))
                offsets = ends[np.concatenate(([0], np.cumsum(counts)))]
                out = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), out.cast(pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
