"""Registered queries of the text operators, with their reference SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaloom.llm import bytebpe, counts, decontam, dialogue, extract, fingerprints, jaccard, langid, lines, merkle, mixing, secrets, tokens
from chromaloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
grams AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM words),
sizes AS (SELECT doc_id, len(g)::BIGINT AS n FROM grams),
flat AS (SELECT doc_id, unnest(g) AS s FROM grams),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM flat x JOIN flat y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 90 * (p.n + q.n - c)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT reach.a, sym.b FROM reach JOIN sym ON reach.b = sym.a)
SELECT doc_id, n AS n_shingles, (SELECT min(b) FROM reach WHERE a = doc_id) AS component_id FROM sizes
"""


@query("op2_ngram_jaccard_join", OP2_SQL)
def op2_ngram_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return jaccard.components(docs, k=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


@query("op8_language_id")
def op8_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    out = langid.held_out("doc_id")
    model = langid.fit(docs.where(~out))
    return langid.predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score", "ambiguous")


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, d: str) -> DataFrame:
    vocabulary = counts.unigram_vocabulary(tokenizer_file("piece_bpe_32k.model"))
    return counts.count_tokens(table(spark, d, "documents"), vocabulary)


@query("op4_source_mixing")
def op4_source_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), repetition=2.0)


@query("op6_benchmark_decontamination")
def op6_benchmark_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontam.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("op9_html_extraction")
def op9_html_extraction(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract(table(spark, d, "pages"))


@query("op7_token_id_output")
def op7_token_id_output(spark: SparkSession, d: str) -> DataFrame:
    with open(tokenizer_file("word_bpe_49k.json"), encoding="utf-8") as f:
        definition = f.read()
    return tokens.round_trip(table(spark, d, "documents"), definition)


@query("op1_document_fingerprints")
def op1_document_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, d, "documents"))


@query("op5_line_dedup")
def op5_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    return lines.line_report(table(spark, d, "documents"))


@query("op3_secret_scan")
def op3_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    known = secrets.dictionary(tokenizer_file("piece_bpe_32k.model"))
    return secrets.scan_and_classify(table(spark, d, "documents"), known)


def byte_bpe_digests(docs: DataFrame, ranks: list[bytes], pattern: str) -> DataFrame:
    """Count and digests of the ids of every text and of the bytes they decode to."""
    coded = bytebpe.decode(bytebpe.encode(docs, ranks, pattern), ranks)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op11_byte_bpe")
def op11_byte_bpe(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    ranks = bytebpe.read_ranks(tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe_digests(table(spark, d, "documents"), ranks, public_tokenizers.PATTERN)


OP12_SQL = r"""
WITH RECURSIVE digits AS (
  SELECT doc_id, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
           lambda x: list_concat([ascii(x)::BIGINT], [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])))),
         lambda c, v: CASE WHEN v >= 0 THEN xor(c, v) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
marked AS (SELECT d.*, coalesce(xor(c, 4294967295::BIGINT) % 7 = 0, false) AS hit FROM documents d LEFT JOIN digits USING (doc_id)),
written AS (
  SELECT doc_id, lang, hit,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END ||
    CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END ||
    CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head,
    CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END AS n0,
    CASE WHEN n_chars IS NULL THEN '-' ELSE strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) END AS n1,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail FROM marked),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM (
    SELECT doc_id, lang, sha256(head || n0 || tail) AS leaf, sha256(head || CASE WHEN hit THEN n1 ELSE n0 END || tail) AS tested FROM written)),
nodes AS (
  SELECT lang, 0 AS lvl, idx, n, leaf AS h FROM leaves
  UNION ALL
  SELECT lang, lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY lang, lvl, idx // 2, n),
subroots AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS lvl, idx, n, subroot AS h FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY lvl, idx // 2, n),
climb AS (
  SELECT doc_id, lang, leaf, lang AS tree, false AS top, 0 AS lvl, idx, n, '' AS proof, tested AS h FROM leaves
  UNION ALL
  SELECT c.doc_id, c.lang, c.leaf, CASE WHEN c.n = 1 THEN NULL ELSE c.tree END, c.n = 1 OR c.top,
    CASE WHEN c.n = 1 THEN 0 ELSE c.lvl + 1 END, CASE WHEN c.n = 1 THEN s.idx ELSE c.idx // 2 END, CASE WHEN c.n = 1 THEN s.n ELSE (c.n + 1) // 2 END,
    c.proof || CASE WHEN c.n = 1 THEN '' ELSE coalesce(x.h, '') END,
    CASE WHEN c.n = 1 THEN c.h WHEN c.idx % 2 = 1 THEN sha256(x.h || c.h) ELSE sha256(c.h || coalesce(x.h, '')) END
  FROM climb c
  LEFT JOIN (SELECT false AS top, lang AS tree, lvl, idx, h FROM nodes UNION ALL SELECT true, NULL, lvl, idx, h FROM tops) x
    ON x.top = c.top AND x.tree IS NOT DISTINCT FROM c.tree AND x.lvl = c.lvl AND x.idx = xor(c.idx, 1)
  LEFT JOIN subroots s ON NOT c.top AND c.n = 1 AND s.lang IS NOT DISTINCT FROM c.lang
  WHERE c.n > 1 OR NOT c.top)
SELECT c.doc_id, c.leaf, s.subroot, r.h AS root, sha256(c.proof) AS proof_sha256, c.h AS folded_root, c.h = r.h AS verified
FROM climb c JOIN subroots s ON s.lang IS NOT DISTINCT FROM c.lang CROSS JOIN (SELECT h FROM tops WHERE n = 1) r WHERE c.top AND c.n = 1
"""


@query("op12_merkle_manifest", OP12_SQL)
def op12_merkle_manifest(spark: SparkSession, d: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return merkle.manifest(table(spark, d, "documents"), tampered).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"), "folded_root", "verified")


def _plus(x: str, cost: int | str, edit: str) -> str:
    """SQL: a script (cost in six digits, then its edits) with one edit more; null stays null."""
    return f"lpad((left({x}, 6)::INT + {cost})::VARCHAR, 6, '0') || substr({x}, 7) || '{edit}'"


OP13_SQL = rf"""
WITH RECURSIVE keyed AS (
  SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kinds AS (
  SELECT k, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(k, ''),
           lambda x: list_concat([ascii(x)::BIGINT], [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])))),
         lambda c, v: CASE WHEN v >= 0 THEN xor(c, v) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END), 4294967295::BIGINT) % 20 AS kind
  FROM (SELECT DISTINCT k FROM keyed)),
damaged AS (
  SELECT g, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM keyed JOIN kinds USING (k) JOIN (VALUES (0), (1)) c(copy) ON copy = 0 OR kind = 3 WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS i,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
    CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS r FROM damaged),
marked AS (
  SELECT *, CASE WHEN body = '' THEN 'b' WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'k' END AS fault,
    lag(r) OVER (PARTITION BY g ORDER BY i) AS past FROM placed),
counted AS (
  SELECT g, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (past IS NOT NULL AND past || r NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY g),
best AS (
  SELECT g, 0::BIGINT AS i, '000000' AS e, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM counted
  UNION ALL
  SELECT g, i, {_plus("e", 4, "D")},
    least({_plus("s", 4, "D")}, CASE WHEN r = 's' AND stays THEN {_plus("e", "cut", "K")} END),
    least({_plus("u", 4, "D")}, CASE WHEN stays THEN least({_plus("e", "cut + 3", "R")}, {_plus("s", "cut + 3", "R")}, {_plus("a", "cut + 3", "R")}) END,
      CASE WHEN stays AND r = 'u' THEN least({_plus("e", "cut", "K")}, {_plus("s", "cut", "K")}, {_plus("a", "cut", "K")}) END),
    least({_plus("a", 4, "D")}, CASE WHEN stays THEN {_plus("u", "cut + 3", "R")} END, CASE WHEN stays AND r = 'a' THEN {_plus("u", "cut", "K")} END)
  FROM (
    SELECT g, i, e, s, u, least(a, {_plus("u", 3, "I")}) AS a, r, stays, cut FROM (
      SELECT b.g, m.i, e, s, least(u, {_plus("e", 3, "I")}, {_plus("s", 3, "I")}, {_plus("a", 3, "I")}) AS u, a, m.r,
        m.fault IN ('t', 'k') AS stays, CASE WHEN m.fault = 't' THEN 3 ELSE 0 END AS cut
      FROM best b JOIN marked m ON m.g = b.g AND m.i = b.i + 1))),
ended AS (
  SELECT g, least(e, a, {_plus("least(u, " + _plus("s", 3, "I") + ")", 3, "I")}) AS script FROM best JOIN counted USING (g) WHERE i = n),
edits AS (SELECT g, generate_subscripts(string_split(substr(script, 7), ''), 1) AS j, unnest(string_split(substr(script, 7), '')) AS edit FROM ended),
walked AS (
  SELECT g, j, edit, sum((edit <> 'I')::INT) OVER w AS i, sum((edit <> 'D')::INT) OVER w AS place, sum((edit <> 'D')::INT) OVER (PARTITION BY g) % 2 AS sys
  FROM edits WINDOW w AS (PARTITION BY g ORDER BY j ROWS UNBOUNDED PRECEDING)),
lines AS (
  SELECT w.g, w.j, CASE WHEN edit = 'K' THEN role WHEN (place - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END AS line
  FROM walked w LEFT JOIN marked m ON m.g = w.g AND m.i = w.i WHERE edit <> 'D'),
texts AS (SELECT g, string_agg(line, chr(10) ORDER BY j) AS body FROM lines GROUP BY g)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(left(script, 6)::BIGINT, 0) AS cost, coalesce(substr(script, 7), '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT g, conv_id FROM keyed) k LEFT JOIN counted USING (g) LEFT JOIN ended USING (g) LEFT JOIN texts USING (g)
"""


@query("op13_conversation_repair", OP13_SQL)
def op13_conversation_repair(spark: SparkSession, d: str) -> DataFrame:
    return dialogue.repair_damaged(table(spark, d, "conversations"))
