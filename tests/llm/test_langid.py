"""Language identification: held-out accuracy and odd rows."""

from chromaloom.llm import langid
from chromaloom.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = QUERIES["op8_language_id"](spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == 1000
    out = [r for r in got if r.held_out]
    assert 250 < len(out) < 420
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_codewords_differ():
    for n in (2, 3, 4, 7, 20):
        codes = langid.codewords(n)
        assert len({tuple(c) for c in codes.tolist()}) == n
        assert all(0 < (col == 1).sum() < n for col in codes.T)


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, score string"
    train = [(i, t * (1 + i % 3), lang, "s") for i, (t, lang) in enumerate([("the cat and the dog ", "en"), ("der hund und die katze ", "de"), ("??", "de")] * 40)]
    rows = [(1, None, None, "x"), (2, "", "en", "x"), (3, "12 !?", "en", "x"), (4, "the dog", None, "x"), (4, "the dog", None, "x"), (None, "und die", "en", "x"),
            (6, "漢字", None, None), (7, "the cat " * 40000, None, None)]
    model = langid.fit(spark.createDataFrame(train, schema))
    assert model.langs == ["de", "en"]
    df = spark.createDataFrame(rows, schema).repartition(3)
    got = sorted((str(r.doc_id), r.lang_pred) for r in langid.predict(df, model).collect())
    assert got[:3] == [("1", "und"), ("2", "und"), ("3", "und")] and got[3:5] == [("4", "en")] * 2 and ("7", "en") in got and got[-1] == ("None", "de")
    empty = langid.fit(df.limit(0))
    assert {r.lang_pred for r in langid.predict(df, empty).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0


def test_filter_keeps_columns(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    more = docs.unionByName(spark.createDataFrame([(-1, "123", "en", "s", 3), (-2, None, "en", "s", 0)], docs.schema))
    kept = langid.keep_identified(more)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {-1, -2} and len(ids) >= 0.98 * docs.count()
