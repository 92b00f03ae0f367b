"""Byte-level BPE against the tiktoken library and against a plain merge loop."""

import hashlib
import random
import sys

import public_tokenizers as P
import pytest
import tiktoken

from chromaloom.llm import bytebpe, queries

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def tokens():
    return bytebpe.read_ranks(RANKS)


@pytest.fixture(scope="module")
def library(tokens):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def slow(piece, rank):
    """Merge the leftmost pair of the smallest rank, one at a time."""
    if piece in rank:
        return [rank[piece]]
    parts = [bytes([b]) for b in piece]
    while True:
        found = [(rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank]
        if not found:
            return [rank[p] for p in parts]
        i = min(found)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_small_vocabularies_with_unreachable_tokens():
    """Random tokens: lower ranks may contain higher ones, so the order of merges matters."""
    r = random.Random(5)
    for _ in range(60):
        extra = {bytes(r.choice(b"ab") for _ in range(r.randrange(2, 6))) for _ in range(r.randrange(1, 14))}
        vocabulary = [bytes([b]) for b in range(256)] + r.sample(sorted(extra), len(extra))
        e, rank = bytebpe.Encoder(vocabulary), {t: i for i, t in enumerate(vocabulary)}
        pieces = [bytes(r.choice(b"abc") for _ in range(r.randrange(0, 40))) for _ in range(60)]
        assert e.pieces(pieces) == [slow(p, rank) for p in pieces]
        # the way of long pieces follows the same rule
        assert [e._long(p) for p in pieces if len(p) > 1 and p not in rank] == [slow(p, rank) for p in pieces if len(p) > 1 and p not in rank]


def test_every_code_point_is_cut_like_the_library(library, tokens):
    points = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    cut, encoder = bytebpe.Cutter(P.PATTERN, bytebpe.newer_characters()), bytebpe.Encoder(tokens)
    for k in range(0, len(points), 4096):
        text = "".join(f"a{c} {c}1{c}'s" for c in points[k:k + 4096])
        pieces = [p.encode() for p in cut(text)]
        assert [i for ids in encoder.pieces(pieces) for i in ids] == library.encode_ordinary(text), hex(ord(points[k]))


def test_texts_match_library(spark, tokens, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    r = random.Random(1)
    odd = [None, "", " ", "\n\n  x", "  two  spaces ", "漢字かな交じり文", "don't we'll I'M", "q" * 5000, "ab" * 3000 + "é" * 900, "\u0085\x1c\x1d  　x",
           "👩‍👩‍👧 emoji", "1234567 89", "a\x00b", "\u0558x\u088f1 \U00016ea0 ", "".join(chr(r.randrange(32, 0x2FFF)) for _ in range(3000)), "z " * 700_000, "same", "same"]
    rows = [(x.doc_id, x.text) for x in docs.collect()] + [(-i if i else None, t) for i, t in enumerate(odd)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, ids int, decoded string")
    got = queries.byte_bpe_digests(df, tokens, P.PATTERN).collect()
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((str(i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((str(x.doc_id), x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in got) == sorted(want)
    assert queries.byte_bpe_digests(df.limit(0), tokens, P.PATTERN).count() == 0


def test_memo_overflow_keeps_ids(spark, tokens, library, monkeypatch):
    monkeypatch.setattr(bytebpe, "MEMO_PIECES", 5)
    monkeypatch.setattr(bytebpe, "MEMO_CHARS", 4)
    monkeypatch.setattr(bytebpe, "SLICE_CHARS", 40)
    texts = ["some words come again and words again", "again some more wordy words", "x" * 300 + " again words"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.doc_id: x.ids for x in bytebpe.encode(df, tokens, P.PATTERN).collect()} == {i: library.encode_ordinary(t) for i, t in enumerate(texts)}


def test_rank_file_faults(tmp_path):
    (tmp_path / "gap").write_text("YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        bytebpe.read_ranks(str(tmp_path / "gap"))
    with pytest.raises(ValueError):
        bytebpe.Encoder([b"a", b"b"])


def test_decode_of_given_ids(spark, tokens):
    df = spark.createDataFrame([(1, [5, 400, 50255]), (2, []), (3, None), (4, [0])], "doc_id long, ids array<int>")
    got = {x.doc_id: bytes(x.decoded) for x in bytebpe.decode(df, tokens).collect()}
    assert got == {1: tokens[5] + tokens[400] + tokens[50255], 2: b"", 3: b"", 4: tokens[0]}
    with pytest.raises(Exception, match="no token"):
        bytebpe.decode(spark.createDataFrame([(1, [50256])], "doc_id long, ids array<int>"), tokens).collect()
