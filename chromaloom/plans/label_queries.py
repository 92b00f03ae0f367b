"""Reviewer verdicts, votes, agreement and score quality."""

from pyspark.sql import functions as F

from chromaloom.functions.scalar import r
from chromaloom.operators import clicks as CK
from chromaloom.operators import labels as L
from chromaloom.sources import tables as T

from .registry import query


def latest(spark, d):
    return L.latest_verdicts(T.verdicts(spark, d))


@query("latest_verdict", "SELECT reviewer, key, page, file_no, line_no, value FROM m_latest")
def latest_verdict(spark, d):
    return latest(spark, d).select("reviewer", "key", "page", "file_no", "line_no", "value")


@query("reviewer_agreement", """
SELECT key, page, count(*) AS n_reviewers, min(reviewer) AS first_reviewer, max(reviewer) AS last_reviewer FROM m_latest GROUP BY 1, 2 HAVING count(*) > 1""")
def reviewer_agreement(spark, d):
    return L.agreement(latest(spark, d))


@query("label_votes", "SELECT key, y, x, z, kept, seen, label FROM m_labelled")
def label_votes(spark, d):
    return L.spot_votes(T.shown(latest(spark, d))).select("key", "y", "x", "z", "kept", "seen", "label")


@query("label_summary", "SELECT label, count(*) AS n, count(DISTINCT key) AS n_groups FROM m_labelled GROUP BY 1")
def label_summary(spark, d):
    return L.label_summary(L.spot_votes(T.shown(latest(spark, d))))


@query("operating_point", """
WITH j AS (SELECT p, CASE WHEN keep = 1 THEN 1 ELSE 0 END AS y FROM m_shown WHERE keep >= 0 AND p IS NOT NULL),
t AS (SELECT DISTINCT round(p, 4) AS t FROM j),
s AS (SELECT t, CAST(sum(CASE WHEN p >= t THEN y END) AS DOUBLE) AS tp, count(*) FILTER (p >= t) AS called, CAST(sum(y) AS BIGINT) AS n_kept, count(*) AS n
      FROM t, (SELECT p, y FROM j) GROUP BY 1),
f AS (SELECT t AS p, n, n_kept, tp / greatest(called, 1) AS precision, tp / greatest(n_kept, 1) AS recall,
      2 * (tp / greatest(called, 1)) * (tp / greatest(n_kept, 1)) / greatest(tp / greatest(called, 1) + tp / greatest(n_kept, 1), 1e-9) AS f1 FROM s)
SELECT round(p, 4) AS p, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, n, n_kept FROM f ORDER BY round(f1, 12) DESC, p LIMIT 1""")
def operating_point(spark, d):
    o = L.operating_point(T.shown(latest(spark, d)))
    return o.select(r("p", 4).alias("p"), r("precision").alias("precision"), r("recall").alias("recall"), r("f1").alias("f1"), "n", "n_kept")


@query("pr_auc", """
WITH g AS (SELECT score, sum(y) AS pos, count(*) AS n FROM m_scored GROUP BY 1),
c AS (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS called FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT round(sum(tp / CAST(called AS DOUBLE) * pos) / sum(pos), 6) AS pr_auc FROM c""")
def pr_auc(spark, d):
    return L.pr_auc(T.scored_labels(spark, d)).select(r("pr_auc").alias("pr_auc"))


@query("roc_auc", """
WITH k AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM m_scored)
SELECT round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (CAST(count(*) FILTER (y = 1) AS DOUBLE) * count(*) FILTER (y = 0)), 6) AS roc_auc FROM k""")
def roc_auc(spark, d):
    return L.roc_auc(T.scored_labels(spark, d)).select(r("roc_auc").alias("roc_auc"))


@query("label_holdout", """
WITH g AS (SELECT DISTINCT key FROM m_labelled),
o AS (SELECT key, row_number() OVER (ORDER BY substr(md5('7:' || CAST(key AS VARCHAR)), 1, 12), key) <= greatest(1, floor(CAST(0.3 AS DOUBLE) * count(*) OVER () + 0.5)) AS held_out FROM g)
SELECT held_out, count(*) AS n, count(DISTINCT key) AS n_keys FROM m_labelled JOIN o USING (key) GROUP BY 1""")
def label_holdout(spark, d):
    """Whole keys go to one side (seeded hash); counts per side."""
    side = L.holdout(L.spot_votes(T.shown(latest(spark, d))), "key", 0.3, seed=7)
    return side.groupBy("held_out").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("n_keys"))


ADDED_SQL = """
SELECT key, reviewer, CAST((line_no * 37) % 240 AS DOUBLE) / 2 AS y, CAST((line_no * 91 + page) % 300 AS DOUBLE) / 3 AS x FROM m_latest"""


@query("added_click_spots", f"""
WITH RECURSIVE cl AS ({ADDED_SQL}), o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY y, x, reviewer) AS i FROM cl),
st AS (SELECT key, CAST(0 AS BIGINT) AS i, []::STRUCT(y DOUBLE, x DOUBLE, n BIGINT, w VARCHAR[])[] AS s FROM (SELECT DISTINCT key FROM o)
  UNION ALL SELECT key, i, CASE WHEN hit IS NULL THEN list_append(s, {{'y': y, 'x': x, 'n': 1::BIGINT, 'w': [reviewer]}})
    ELSE list_transform(s, lambda c, k: CASE WHEN k = hit THEN {{'y': c.y + y, 'x': c.x + x, 'n': c.n + 1, 'w': list_append(c.w, reviewer)}} ELSE c END) END
  FROM (SELECT o.key, o.i, o.y, o.x, o.reviewer, st.s, nullif(coalesce(list_position(list_transform(st.s, lambda c: pow(c.y / c.n - o.y, 2) + pow(c.x / c.n - o.x, 2) <= 16), true), 0), 0) AS hit
    FROM st JOIN o ON o.key = st.key AND o.i = st.i + 1)),
last AS (SELECT key, s FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY i DESC) AS rn FROM st) WHERE rn = 1)
SELECT key, round(c.y / c.n, 3) AS y, round(c.x / c.n, 3) AS x, c.n AS n_clicks, len(list_distinct(c.w))::BIGINT AS added_by FROM (SELECT key, unnest(s) AS c FROM last)""")
def added_click_spots(spark, d):
    """Clicks of the latest records, one spot per place, with how many reviewers marked it."""
    newest = latest(spark, d)
    clicks = newest.select("key", "reviewer", (F.pmod(F.col("line_no") * 37, F.lit(240)).cast("double") / 2).alias("y"),
                           (F.pmod(F.col("line_no") * 91 + F.col("page"), F.lit(300)).cast("double") / 3).alias("x"))
    return CK.added_spots(clicks).select("key", r("y", 3).alias("y"), r("x", 3).alias("x"), "n_clicks", F.size("reviewers").cast("long").alias("added_by"))
