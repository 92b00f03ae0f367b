"""Token counts against the tokenizers library's own unigram model."""

import random

import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from chromaloom.llm import counts
from chromaloom.llm.queries import tokenizer_file


def library(vocabulary):
    t = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary], 0, False))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=counts.SPACE, prepend_scheme="always", split=True)
    return t


def test_small_vocabularies_with_ties():
    r = random.Random(2)
    for _ in range(150):
        pieces = {"".join(r.choice("ab" + counts.SPACE) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(1, 12))}
        vocabulary = [(p, -float(r.randrange(1, 4))) for p in sorted(pieces)]
        a = counts.automaton(vocabulary)
        # the library takes its unknown entry's score into the smallest score
        unknown = min(0.0, min(s for _, s in vocabulary)) - counts.UNKNOWN_PENALTY
        tok = library(vocabulary)
        for _ in range(30):
            word = "".join(r.choice("abc") for _ in range(r.randrange(0, 9)))
            want = len(tok.encode(word).ids) if word else None
            if word:
                assert counts.word_count(a, unknown, counts.SPACE + word) == want, (vocabulary, word)


def test_texts_match_library(spark):
    vocabulary = counts.unigram_vocabulary(tokenizer_file("piece_bpe_32k.model"))
    tok = library(vocabulary)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [
        (-1, None), (-2, ""), (-3, " "), (-4, "  two  spaces "), (-5, "漢字 and\nlines\tand ▁ bars"), (-6, "q" * 5000), (None, "x"), (-7, "a"), (-7, "a")]
    got = sorted((str(r.doc_id), r.n_tokens) for r in counts.count_tokens(
        spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, n_tokens int"), vocabulary).collect())
    assert got == sorted((str(i), len(tok.encode(t).ids) if t else 0) for i, t in rows)


@pytest.mark.parametrize("vocabulary", [[], [("", -1.0)]])
def test_empty_vocabulary(spark, vocabulary):
    df = spark.createDataFrame([(1, "ab cd"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in counts.count_tokens(df, vocabulary).collect()} == {1: 2, 2: 0}
    assert counts.count_tokens(df.limit(0), vocabulary).count() == 0
