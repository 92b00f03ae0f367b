"""Token ids in a compact binary format: an adaptive context-mixing range coder.

File format. A row of the file is a segment: whole documents in ascending doc_id order,
their ids concatenated and cut into blocks of BLOCK ids. Every block is coded on its own
(model and coder start anew) and carries the CRC-32 of its ids, so blocks can be read in any
order and damage is found per block. Columns: part, segment, doc_id[], n_tokens[] and
blocks[{n, crc, data}], stored as Parquet in the shared folder; Spark commits the files.

Coder of a block. Three predictions exist for the next id: order 2 and order 1 (the id that
last followed the same two ids, or the same id, in hashed tables) and order 0 (a cache slot,
chosen by the low byte, that holds the last id with that byte). The event "order 2 hits,
else order 1, else order 0, else none" is one symbol of four. Its probabilities mix counts
of two adaptive models, one keyed by the confidences and agreement of the predictions, one
by the last three events. Order 0 adds the low byte, "none" adds the whole id. A 64-bit
carry-less range coder writes 16-bit words.

All blocks of a task advance in step as NumPy lanes; integer and correctly rounded
arithmetic only, so every machine codes and decodes alike.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaloom.llm.common import running_offsets
from chromaloom.session import checked_broadcast, cut, ensure_checkpoint_dir

BLOCK = 2048               # ids per block
SEGMENT = 32 * BLOCK       # ids after which a segment is closed
FLUSH = 32 * SEGMENT       # ids coded at once by a task (32-bit each)
END_ID = 1
MEMO = 250_000             # words a task remembers
MEMO_CHARS = 32            # longer words are not remembered
SLOTS2, SLOTS1 = 2048, 1024
BITS = 12                  # probability bits of an event
MERGED = 18                # ids of so many bits share one renormalisation with their event
U16, U64 = np.uint16, np.uint64
WORD = U64(16)
TOP, BOTTOM = U64(1 << 48), U64(1 << 32)


class Lanes:
    """Models of many blocks at the same position; lanes leave from the end of the arrays."""

    def __init__(self, n: int, id_bits: int):
        self.id_bits = id_bits
        self.t2 = np.zeros((n, SLOTS2), np.uint32)        # id << 2 | confidence
        self.t1 = np.zeros((n, SLOTS1), np.uint32)
        self.t0 = np.zeros((n, 256), np.uint32)
        self.m1 = np.ones((4, n * 32), np.int32)
        self.m2 = np.ones((4, n * 64), np.int32)
        self.a = np.zeros(n, np.uint32)
        self.b = np.zeros(n, np.uint32)
        self.past = np.zeros(n, np.int64)
        self.row = np.arange(n)

    def shrink(self, n: int) -> None:
        self.t2, self.t1, self.t0 = self.t2[:n], self.t1[:n], self.t0[:n]
        self.a, self.b, self.past, self.row = self.a[:n], self.b[:n], self.past[:n], self.row[:n]

    def predict(self):
        """(order-2 id, order-1 id, bounds of the four events: cumulated frequencies from 0)."""
        self.i2 = self.row * SLOTS2 + (((self.a * np.uint32(0x9E3779B1)) ^ (self.b * np.uint32(0x85EBCA6B))) >> np.uint32(21)).astype(np.int64)
        self.i1 = self.row * SLOTS1 + ((self.a * np.uint32(0x9E3779B1)) >> np.uint32(22)).astype(np.int64)
        self.c2, self.c1 = self.t2.ravel().take(self.i2), self.t1.ravel().take(self.i1)
        p2, p1 = self.c2 >> np.uint32(2), self.c1 >> np.uint32(2)
        near = ((self.c2 & np.uint32(3)) * np.uint32(4) + (self.c1 & np.uint32(3))).astype(np.int64)
        self.k1 = self.row * 32 + near + 16 * (p1 == p2)
        self.k2 = self.row * 64 + self.past
        # column by column: rows of four are too short to pay for a call
        cum = [self.m1[0].take(self.k1) + self.m2[0].take(self.k2)]
        for j in (1, 2, 3):
            cum.append(cum[-1] + self.m1[j].take(self.k1) + self.m2[j].take(self.k2))
        scale = ((1 << BITS) - 8) / cum[3]
        upper = np.empty((5, len(scale)), np.int64)         # upper[e] to upper[e + 1] is event e
        upper[0], upper[4] = 0, 1 << BITS
        for j in (0, 1, 2):
            upper[j + 1] = (cum[j] * scale).astype(np.int64) + (2 * j + 2)
        return p2, p1, upper

    def update(self, ids: np.ndarray, event: np.ndarray) -> None:
        # lanes differ in their keys, so a flat place occurs once
        self.m1.ravel()[event * self.m1.shape[1] + self.k1] += 20
        self.m2.ravel()[event * self.m2.shape[1] + self.k2] += 12
        hit2, hit1 = (self.c2 >> np.uint32(2)) == ids, (self.c1 >> np.uint32(2)) == ids
        s2 = np.minimum((self.c2 & np.uint32(3)) + np.uint32(1), np.uint32(3)) * hit2
        s1 = np.minimum((self.c1 & np.uint32(3)) + np.uint32(1), np.uint32(3)) * hit1
        self.t2.ravel()[self.i2] = (ids << np.uint32(2)) | s2
        self.t1.ravel()[self.i1] = (ids << np.uint32(2)) | s1
        self.t0.ravel()[self.row * 256 + (ids & np.uint32(255))] = ids
        self.b, self.a = self.a, ids
        self.past = (self.past * 4 + event) & 63


def _extra_bits(event: np.ndarray, id_bits: int) -> np.ndarray:
    return np.array([0, 0, 8, id_bits], U64)[event]


def encode_blocks(blocks: list[np.ndarray], id_bits: int) -> list[bytes]:
    """Codes of blocks of ids (uint32), all coded in step; an empty block has an empty code."""
    order = sorted(range(len(blocks)), key=lambda k: -len(blocks[k]))
    sizes = np.array([len(blocks[k]) for k in order])
    out = [b""] * len(blocks)
    if not len(sizes) or sizes[0] == 0:
        return out
    n, steps = int((sizes > 0).sum()), int(sizes[0])
    ids = np.zeros((steps, n), np.uint32)
    for lane in range(n):
        ids[:sizes[lane], lane] = blocks[order[lane]]
    model = Lanes(n, id_bits)
    low, span = np.zeros(n, U64), np.full(n, 0xFFFFFFFFFFFFFFFF, U64)
    words, used = np.zeros((n, steps * 2 + 8), U16), np.zeros(n, np.int64)
    rest = np.zeros((2, len(sizes)), U64)
    active = n
    for t in range(steps):
        while sizes[active - 1] <= t:
            active -= 1
            rest[0, active] = low[active]
        if active < len(low):
            low, span, used_now = low[:active], span[:active], used[:active]
            model.shrink(active)
        else:
            used_now = used[:active]
        x = ids[t, :active]
        p2, p1, upper = model.predict()
        slot = model.t0.ravel().take(model.row * 256 + (x & np.uint32(255)))
        event = np.where(x == p2, 0, np.where(x == p1, 1, np.where(x == slot, 2, 3)))
        at = event * active + model.row
        below, hi = upper.ravel().take(at), upper.ravel().take(at + active)
        span = span >> U64(BITS)
        low = low + below.astype(U64) * span
        span = span * (hi - below).astype(U64)
        if id_bits > MERGED:
            low, span = _emit(low, span, words, used_now)
        bits = _extra_bits(event, id_bits)
        span = span >> bits
        low = low + (x.astype(U64) & ((U64(1) << bits) - U64(1))) * span
        low, span = _emit(low, span, words, used_now)
        model.update(x, event)
    rest[0, :active] = low
    for lane in range(n):
        tail = int(rest[0, lane]).to_bytes(8, "big")
        out[order[lane]] = words[lane, :used[lane]].astype(">u2").tobytes() + tail
    return out


def _emit(low, span, words, used):
    """Write the settled top words of the lanes; a span that got too short is cut to fit."""
    while True:
        settled = (low ^ (low + span)) < TOP
        short = span < BOTTOM
        todo = np.flatnonzero(settled | short)
        if not len(todo):
            return low, span
        cut_ = todo[~settled[todo]]
        if len(cut_):
            span[cut_] = (~low[cut_] + U64(1)) & (BOTTOM - U64(1))
        words[todo, used[todo]] = (low[todo] >> U64(48)).astype(U16)
        used[todo] += 1
        low[todo] <<= WORD
        span[todo] <<= WORD


def decode_blocks(codes: list[bytes], sizes: list[int], id_bits: int) -> list[np.ndarray]:
    """Ids of the blocks, the inverse of `encode_blocks`."""
    order = sorted(range(len(codes)), key=lambda k: -sizes[k])
    size = np.array([sizes[k] for k in order])
    out = [np.zeros(0, np.uint32)] * len(codes)
    if not len(size) or size[0] == 0:
        return out
    n, steps = int((size > 0).sum()), int(size[0])
    width = max(len(c) for c in codes) // 2 + 4
    words = np.zeros((n, width), U64)
    for lane in range(n):
        w = np.frombuffer(codes[order[lane]], ">u2")
        words[lane, :len(w)] = w
    code = np.zeros(n, U64)
    for j in range(4):
        code = (code << WORD) | words[:, j]
    used = np.full(n, 4, np.int64)
    model = Lanes(n, id_bits)
    low, span = np.zeros(n, U64), np.full(n, 0xFFFFFFFFFFFFFFFF, U64)
    ids = np.zeros((steps, n), np.uint32)
    active = n
    for t in range(steps):
        while size[active - 1] <= t:
            active -= 1
        if active < len(low):
            low, span, code, used = low[:active], span[:active], code[:active], used[:active]
            model.shrink(active)
        p2, p1, upper = model.predict()
        span = span >> U64(BITS)
        at = np.minimum((code - low) // span, U64((1 << BITS) - 1)).astype(np.int64)
        event = (at >= upper[1]).astype(np.int64) + (at >= upper[2]) + (at >= upper[3])
        at = event * active + model.row
        below, hi = upper.ravel().take(at), upper.ravel().take(at + active)
        low = low + below.astype(U64) * span
        span = span * (hi - below).astype(U64)
        if id_bits > MERGED:
            low, span, code = _fill(low, span, code, words, used)
        bits = _extra_bits(event, id_bits)
        span = span >> bits
        extra = ((code - low) // span).astype(np.uint32)
        low = low + np.where(event > 1, extra, 0).astype(U64) * span
        low, span, code = _fill(low, span, code, words, used)
        slot = model.t0.ravel().take(model.row * 256 + (extra & np.uint32(255)))
        x = np.where(event == 0, p2, np.where(event == 1, p1, np.where(event == 2, slot, extra))).astype(np.uint32)
        model.update(x, event)
        ids[t, :active] = x
    for lane in range(n):
        out[order[lane]] = ids[:size[lane], lane].copy()
    return out


def _fill(low, span, code, words, used):
    while True:
        settled = (low ^ (low + span)) < TOP
        todo = np.flatnonzero(settled | (span < BOTTOM))
        if not len(todo):
            return low, span, code
        cut_ = todo[~settled[todo]]
        if len(cut_):
            span[cut_] = (~low[cut_] + U64(1)) & (BOTTOM - U64(1))
        code[todo] = (code[todo] << WORD) | words[todo, used[todo]]
        used[todo] += 1
        low[todo] <<= WORD
        span[todo] <<= WORD


# a mark between a letter and a space is a piece of its own, as the tokenizer's pattern cuts it
MARK = re.compile(r"([a-z])([,.;:!?])(?=[ \n])")


class Encoder:
    """Ids of whole texts through the tokenizers library, remembering words.

    The tokenizer cuts a text at white space before it merges, and its normal form (NFC,
    lower case) never joins characters across a space, so a text's ids are those of its
    space-separated words; a word is sent to the library once and its ids are kept. A mark at
    a word's end is a word of its own, and ASCII text is lower-cased first, so that a word is
    not kept in several forms.
    """

    JOINED = 500
    known: dict[str, Encoder] = {}

    @classmethod
    def of(cls, definition: str) -> Encoder:
        """The encoder of this process, with the words of its earlier tasks."""
        if definition not in cls.known:
            cls.known.clear()
            cls.known[definition] = cls(definition)
        return cls.known[definition]

    def __init__(self, definition: str):
        import json
        import os

        # Spark has a task on every core; the library's own threads would wait for each other, each with memory of its own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.memo: dict[str, bytes] = {}
        # new words go to the library in one text, parted by a special token no word contains
        special = [t for t in json.loads(definition).get("added_tokens") or [] if t.get("special") and len(t["content"]) > 3]
        self.part = (special[0]["content"], special[0]["id"]) if special else None
        self.letters = letters_apart(definition)
        self.special = [t["content"].lower() for t in json.loads(definition).get("added_tokens") or []]

    def _words(self, text: str) -> list[str]:
        if self.letters:
            low = text.lower() if text.isascii() else text
            # a special token is told by its case
            text = MARK.sub(r"\1 \2", text if any(x in low for x in self.special) else low)
        return text.replace("\n", " ").split(" ")

    def _learn(self, words: list[str]) -> None:
        if self.letters:
            # a word of a-z is its own normal form and one piece: the library's model cuts it without the steps before
            cut_, memo, rest = self.tokenizer.model.tokenize, self.memo, []
            for w in words:
                if w.isascii() and w.isalpha() and w.islower():
                    ids = [t.id for t in cut_(w)]
                    memo[w] = struct.pack(f"<{len(ids)}I", *ids)
                else:
                    rest.append(w)
            words = rest
        plain = [w for w in words if self.part is None or "<" in w or self.part[0] in w]
        for w, e in zip(plain, self.tokenizer.encode_batch_fast(plain, add_special_tokens=False)):
            self.memo[w] = np.array(e.ids, "<u4").tobytes()
        if self.part is None:
            return
        alone = set(plain)
        words = [w for w in words if w not in alone]
        groups = [words[k:k + self.JOINED] for k in range(0, len(words), self.JOINED)]
        joined = [f" {self.part[0]} ".join(g) for g in groups]
        for g, e in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            stops = np.flatnonzero(ids == self.part[1])
            data, edge = ids.tobytes(), [-1, *stops.tolist(), len(ids)]
            for k, w in enumerate(g):
                self.memo[w] = data[4 * (edge[k] + 1):4 * edge[k + 1]]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        split = [self._words(t) if t else [] for t in texts]
        new = list({w for words in split for w in words} - self.memo.keys())
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = list({w for words in split for w in words})
        self._learn(new)
        got = self.memo.__getitem__
        out = [b"".join(map(got, words)) for words in split]
        for w in new:
            if len(w) > MEMO_CHARS:
                del self.memo[w]
        return out


def word_local(definition: str) -> bool:
    """True when the tokenizer's rules cut at white space, as `Encoder` takes for granted."""
    import json

    spec = json.loads(definition)
    kinds = json.dumps(spec.get("pre_tokenizer") or {})
    steps = json.dumps(spec.get("normalizer") or {})
    return "\\\\s" in kinds and '"invert": true' in kinds and all(x not in steps for x in ("Prepend", "Strip"))


def letters_apart(definition: str) -> bool:
    """True when letters and marks are cut apart and ASCII text may be lower-cased before the rest."""
    import json

    spec = json.loads(definition)
    normal = spec.get("normalizer") or {}
    steps = [x["type"] for x in normal.get("normalizers") or [normal] if x]
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    split = cuts[0].get("pattern", {}).get("Regex", "") if cuts else ""
    alone = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    bytes_ = [x for x in cuts[1:] if x["type"] == "ByteLevel" and not x.get("add_prefix_space") and not x.get("use_regex")]
    return (steps[-1:] == ["Lowercase"] and set(steps) <= {"NFC", "Replace", "Lowercase"} and split == alone and len(cuts) == 2 and len(bytes_) == 1
            and all(x.get("pattern") == {"Regex": "\\s+"} for x in normal.get("normalizers") or [] if x["type"] == "Replace"))


def vocabulary_bits(definition: str) -> int:
    from tokenizers import Tokenizer

    return max(8, (Tokenizer.from_str(definition).get_vocab_size() + 1).bit_length())


FILE_SCHEMA = "segment int, doc_id array<long>, n_tokens array<int>, blocks array<struct<n int, crc long, data binary>>"


def _segments(docs: list[tuple[int, bytes]], first: int, id_bits: int):
    """Rows of the file for documents (id, little-endian ids) in order."""
    groups, open_, size = [], [], 0
    for d in docs:
        open_.append(d)
        size += len(d[1]) // 4
        if size >= SEGMENT:
            groups.append(open_)
            open_, size = [], 0
    if open_:
        groups.append(open_)
    blocks, counts = [], []
    for g in groups:
        ids = np.frombuffer(b"".join(x for _, x in g), "<u4").astype(np.uint32)
        own = [ids[k:k + BLOCK] for k in range(0, len(ids), BLOCK)]
        counts.append(len(own))
        blocks.extend(own)
    codes, at = encode_blocks(blocks, id_bits), 0
    for k, g in enumerate(groups):
        rows = [{"n": len(blocks[j]), "crc": zlib.crc32(blocks[j].astype("<u4").tobytes()), "data": codes[j]} for j in range(at, at + counts[k])]
        at += counts[k]
        yield {"segment": first + k, "doc_id": [d for d, _ in g], "n_tokens": [len(x) // 4 for _, x in g], "blocks": rows}


def write_ids(docs: DataFrame, path: str, definition: str, end_id: int = END_ID, tasks: int | None = None) -> int:
    """Tokenize `docs` (doc_id, text) and write the id file to `path`; returns the number of parts.

    Documents are dealt by ranges of doc_id (ties by the text's hash), so parts and the rows
    in them are in ascending order. Null text is empty and has the end id only. Rows with a
    null doc_id come first. The file is written by Spark's committer: a lost executor's task
    is run again and leaves no half part.
    """
    spark = docs.sparkSession
    n = tasks or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    end, id_bits = np.array([end_id], "<u4").tobytes(), vocabulary_bits(definition)
    if not word_local(definition):
        raise ValueError("the tokenizer does not cut at white space")

    def run(batches):
        encoder, buffer, size, segment = Encoder.of(definition), [], 0, 0
        schema = pa.schema([("segment", pa.int32()), ("doc_id", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int32())),
                            ("blocks", pa.list_(pa.struct([("n", pa.int32()), ("crc", pa.int64()), ("data", pa.binary())])))])

        def flush():
            nonlocal buffer, size, segment
            rows = list(_segments(buffer, segment, id_bits))
            segment, buffer, size = segment + len(rows), [], 0
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        for b in batches:
            # a slice at a time becomes Python text, not a whole batch
            for at in range(0, b.num_rows, 250):
                part = b.slice(at, 250)
                for name, ids in zip(part.column("doc_id").to_pylist(), encoder(part.column("text").to_pylist())):
                    buffer.append((name, ids + end))
                    size += len(ids) // 4 + 1
                    if size >= FLUSH:
                        yield flush()
        if buffer:
            yield flush()

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranged = keyed.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    coded = ranged.mapInArrow(run, FILE_SCHEMA)
    coded.select(F.spark_partition_id().alias("part"), "*").write.mode("error").parquet(path)
    return n


def read_ids(spark: SparkSession, path: str, id_bits: int, keep_ids: bool = False) -> DataFrame:
    """part, segment, k (place in the segment), doc_id, n_tokens, ids_crc32 and, on request,
    the ids, decoded from the file. A block whose checksum fails raises."""
    schema = "part int, segment int, k int, doc_id long, n_tokens long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")

    def rows(pending):
        codes = [x["data"] for r in pending for x in r["blocks"]]
        sizes = [x["n"] for r in pending for x in r["blocks"]]
        found, at = decode_blocks(codes, sizes, id_bits), 0
        out = {c.split()[0]: [] for c in schema.split(", ")}
        for r in pending:
            own = found[at:at + len(r["blocks"])]
            for x, ids in zip(r["blocks"], own):
                if zlib.crc32(ids.astype("<u4").tobytes()) != x["crc"]:
                    raise ValueError(f"damaged block in part {r['part']}, segment {r['segment']}")
            at += len(own)
            data, p = np.concatenate(own) if own else np.zeros(0, np.uint32), 0
            for k, (name, n) in enumerate(zip(r["doc_id"], r["n_tokens"])):
                ids = data[p:p + n]
                p += n
                for c, v in zip(out, (r["part"], r["segment"], k, name, n, zlib.crc32(ids.astype("<u4").tobytes()))):
                    out[c].append(v)
                if keep_ids:
                    out["ids"].append(ids.astype(np.int32))
        return out

    def run(batches):
        kinds = {"part": pa.int32(), "segment": pa.int32(), "k": pa.int32(), "ids": pa.list_(pa.int32())}
        pending, size = [], 0
        for b in batches:
            for r in b.to_pylist():
                pending.append(r)
                size += sum(r["n_tokens"])
                if size >= FLUSH:
                    out = rows(pending)
                    yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()], list(out))
                    pending, size = [], 0
        if pending:
            out = rows(pending)
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()], list(out))

    return spark.read.parquet(path).mapInArrow(run, schema)


def round_trip(docs: DataFrame, definition: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row of `docs`, read back from the id file.

    `start` is the number of ids of all documents before it in ascending doc_id order
    (repeated ids follow each other). Totals pass per part and per segment only. Other
    columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_ids(docs, path, definition, end_id)
    back = cut(read_ids(spark, path, vocabulary_bits(definition)))
    parts = running_offsets(back.groupBy("part").agg(F.sum("n_tokens").alias("n")), "part", "n", "before").select("part", "before")
    from pyspark.sql import Window

    inner = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    segs = back.groupBy("part", "segment").agg(F.sum("n_tokens").alias("n")).withColumn(
        "inside", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(F.broadcast(parts), "part")
    own = Window.partitionBy("part", "segment").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    return back.join(checked_broadcast(segs.select("part", "segment", (F.col("before") + F.col("inside")).alias("base")), 200_000), ["part", "segment"]).withColumn(
        "start", F.col("base") + F.coalesce(F.sum("n_tokens").over(own), F.lit(0))).select("doc_id", "start", "n_tokens", "ids_crc32")
