"""The id file: exact round trips and the tokenizer's own ids."""

import random
import uuid
import zlib

import numpy as np
import pytest

from chromaloom.llm import tokens
from chromaloom.llm.queries import tokenizer_file

with open(tokenizer_file("word_bpe_49k.json"), encoding="utf-8") as f:
    DEFINITION = f.read()

TEXTS = [(7, "The cat sat on the mat. The cat sat!"), (2, None), (3, ""), (30, "  tabs\tand\nnew lines é É 漢字 <|endoftext|> don't 12 3 "),
         (31, "a" * 3000 + " " + "ab " * 30000), (32, "\x1c odd \xa0 white　space"), (None, "no id")]


def wanted(rows):
    from tokenizers import Tokenizer

    t, out, at = Tokenizer.from_str(DEFINITION), [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_contract(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in TEXTS], "doc_id long, text string, part string").repartition(3)
    got = [tuple(r) for r in tokens.round_trip(df, DEFINITION).collect()]
    assert sorted(got, key=lambda r: r[1]) == wanted(TEXTS)


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "x y")] * 3, "doc_id long, text string")
    assert sorted(r.start for r in tokens.round_trip(df, DEFINITION).collect()) == [0, 3, 6]
    assert tokens.round_trip(spark.createDataFrame([], "doc_id long, text string"), DEFINITION).count() == 0


@pytest.mark.parametrize("bits", [8, 16, 20])
def test_coder(bits):
    r = random.Random(3)
    blocks = [np.array([r.randrange(2 ** bits) if r.random() < p else r.randrange(9) for _ in range(n)], np.uint32)
              for p, n in ((0, 500), (1, 500), (.3, tokens.BLOCK), (0, 1), (.5, 0), (0, 7), (1, tokens.BLOCK))]
    codes = tokens.encode_blocks(blocks, bits)
    back = tokens.decode_blocks(codes, [len(b) for b in blocks], bits)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, back))
    assert len(codes[0]) < 500 * 4 / 4
    alone = tokens.encode_blocks([blocks[2]], bits)[0]
    assert (tokens.decode_blocks([alone], [len(blocks[2])], bits)[0] == blocks[2]).all()
    assert tokens.encode_blocks([], bits) == [] and alone == codes[2]


def test_damage_is_found(spark):
    from chromaloom.session import ensure_checkpoint_dir
    from pyspark.sql import functions as F

    at = f"{ensure_checkpoint_dir(spark)}/ids-{uuid.uuid4().hex}"
    df = spark.createDataFrame([(1, "some words to write down")], "doc_id long, text string")
    tokens.write_ids(df, at, DEFINITION)
    bad = at + "-bad"
    flip = F.transform("blocks", lambda b: b.withField("crc", b["crc"] + 1))
    spark.read.parquet(at).withColumn("blocks", flip).write.parquet(bad)
    with pytest.raises(Exception, match="damaged block"):
        tokens.read_ids(spark, bad, tokens.vocabulary_bits(DEFINITION)).collect()
    ids = tokens.read_ids(spark, at, tokens.vocabulary_bits(DEFINITION), keep_ids=True).first().ids
    assert ids[-1] == tokens.END_ID


def test_words_in_every_case_and_beside_marks_have_the_librarys_ids():
    """ASCII text is lower-cased and cut at marks before the memo; a special token is told by its case."""
    from tokenizers import Tokenizer

    texts = ["Don't! we'll. it's, 's. a.b. x,\ny; Ab!? \nend.", "A<|ENDOFTEXT|>B c, d", "<|endoftext|>. <|endoftext|>a. E <|StartOfText|>, f.",
             "3a. a3, _a. a's. a't, l'l.", "h\u0331. H\u0331. \u00c9, K. \u03a3. \u0391\u03a3, a.\u0300 b", "\u03b1\u03a3. n,\u0301 x", "a, \x85 b.\u00a0c. ", None, ""]
    encoder = tokens.Encoder.of(DEFINITION)
    assert encoder is tokens.Encoder.of(DEFINITION) and encoder.letters
    t = Tokenizer.from_str(DEFINITION)
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder(texts)] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_a_word_is_kept_once_in_a_bounded_memo(monkeypatch):
    encoder = tokens.Encoder(DEFINITION)
    encoder(["Word word, WORD. word; word!", "word"])
    assert set(encoder.memo) == {"word", ",", ".", ";", "word!"}
    monkeypatch.setattr(tokens, "MEMO", 50)
    for k in range(20):
        encoder([" ".join(f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[k % 10]}" for i in range(10))])
        assert len(encoder.memo) <= 50
