"""The pipeline stage by stage against plain versions of each stage, and the registered queries."""

import uuid

import corpus_pipeline
from chromaloom.llm import mixing
from chromaloom.llm.queries import QUERIES
from chromaloom.session import ensure_checkpoint_dir

from .test_decontam import grams, words
from .test_jaccard import brute
from .test_tokens import wanted

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        at = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, D).write.parquet(at)
        docs = spark.read.parquet(at)
        seen.append([(r.doc_id, r.text, r.source) for r in docs.collect()] if name != "token_ids" else [tuple(r) for r in docs.collect()])
        assert name == "token_ids" or docs.columns == columns
    start = {r.doc_id: r.text for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    language, unique, clean, mixed, ids = seen
    assert all(any(c.isalpha() for c in start[i]) for i, _, _ in language) and len(language) >= 0.98 * len(start)
    parts = brute([(i, t) for i, t, _ in language], 5, 80, 100)
    assert sorted(i for i, _, _ in unique) == sorted({c for _, _, c in parts.values()})
    items = [grams(words(r.text)) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    held = {i for i, t, _ in unique if any(g and sum((grams(words(t)) & g).values()) >= sum(g.values()) for g in items)}
    kept = {i for i, _, _ in clean}
    assert not held & kept and len(kept) >= len(unique) - 3 * len(held) - 3
    assert {i for i, _, _ in mixed} == kept
    times = {}
    for i, _, _ in mixed:
        times[i] = times.get(i, 0) + 1
    assert set(times.values()) <= {1, 2}
    plan = mixing.mix(spark.createDataFrame(clean, "doc_id long, text string, source string"), repetition=corpus_pipeline.REPETITION)
    assert times == {r.doc_id: r.repeats for r in plan.collect()}
    assert sorted(ids, key=lambda r: r[1]) == wanted([(i, t) for i, t, _ in mixed])


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontaminate", "mix_sources", "token_ids"]


def test_stage_mix_takes_any_rows_and_column_names(spark):
    rows = [(k, f"text number {k} " * (k % 5), "hot" if k % 3 else f"s{k % 7}", k, 7, 8, 9) for k in range(200)]
    rows += [(None, None, None, 0, 7, 8, 9), (5, "", "s1", 0, 7, 8, 9), (6, "same", "s2", 0, 7, 8, 9), (6, "same", "s2", 0, 7, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, full int, repeats int, bound_place int")
    out = corpus_pipeline.mix_sources(spark, docs, D)
    assert out.columns == docs.columns
    got = [tuple(r) for r in out.collect()]
    assert set(got) == set(rows) and all(r[4:] == (7, 8, 9) for r in got)
    assert got.count(rows[-1]) in (2, 4)
    empty = corpus_pipeline.mix_sources(spark, docs.limit(0), D)
    assert empty.columns == docs.columns and empty.count() == 0
