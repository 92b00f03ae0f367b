"""Token counts without tokens: a Viterbi pass that carries score and piece count only.

An Aho-Corasick automaton over the vocabulary lists all pieces that end at a position; the
best path to that position keeps its score, its number of pieces and whether it ends in an
unknown character. Rules of the tokenizer that are kept exactly: a later candidate replaces
an earlier one only if its score is strictly larger, candidates come in order of their
start; a character without a piece of its own costs the smallest score minus 10; a run of
unknown characters is one piece. Texts are cut at spaces: a space is written as U+2581 and
opens a word, and the text itself opens with one.
"""

from __future__ import annotations

import math

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
MEMO_WORDS = 400_000      # words whose counts a task remembers; the memo is emptied when full


def unigram_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces of a public sentencepiece model with unigram scores from their rank.

    The file orders its pieces by merge rank; rank r gets the Zipf score -ln(r + 2).
    Control, byte and unknown pieces are left out.
    """
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())
             if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return [(p, -math.log(r + 2)) for r, p in enumerate(names)]


def automaton(vocabulary: list[tuple[str, float]]):
    """Automaton with (length, score) per piece; of a piece given twice the last score holds."""
    a = ahocorasick.Automaton()
    for piece, score in vocabulary:
        if piece:
            a.add_word(piece, (len(piece), score))
    if len(a):
        a.make_automaton()
    return a


def word_count(a, unknown: float, word: str) -> int:
    """Pieces of the best path over one word."""
    n = len(word)
    score, pieces, open_ = [-math.inf] * (n + 1), [0] * (n + 1), [False] * (n + 1)
    single = [False] * n
    ends: list[list] = [[] for _ in range(n)]
    if len(a):
        for end, found in a.iter(word):
            ends[end].append(found)
            if found[0] == 1:
                single[end] = True
    score[0] = 0.0
    for end in range(n):
        best, count, unk = -math.inf, 0, False
        for length, own in sorted(ends[end], reverse=True):      # longest first: earliest start
            start = end + 1 - length
            total = own + score[start]
            if total > best:
                best, count, unk = total, pieces[start] + 1, False
        if not single[end]:
            total = unknown + score[end]
            if total > best:
                best, count, unk = total, pieces[end] + (0 if open_[end] else 1), True
        score[end + 1], pieces[end + 1], open_[end + 1] = best, count, unk
    return pieces[n]


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]]) -> DataFrame:
    """doc_id and n_tokens of every row, over the whole text.

    Null and empty texts have 0 tokens. An empty vocabulary makes every word one unknown
    piece. Repeated rows give repeated results; other columns are not read. The vocabulary
    is bounded by its file and travels with the task.
    """
    unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY

    def run(batches):
        a, memo = automaton(vocabulary), {}
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                if not text:
                    out.append(0)
                    continue
                text = text.replace(" ", SPACE)
                words = (text if text[0] == SPACE else SPACE + text).split(SPACE)[1:]
                total = 0
                for w in words:
                    n = memo.get(w)
                    if n is None:
                        if len(memo) >= MEMO_WORDS:
                            memo.clear()
                        n = word_count(a, unknown, SPACE + w)
                        if len(w) <= 64:
                            memo[w] = n
                    total += n
                out.append(total)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(out, pa.int64())], ["doc_id", "n_tokens"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long")
