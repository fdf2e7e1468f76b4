"""The corpus operators' queries over the whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm.common import documents, held_out, labels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnloom.llm.lines import dropped, indexed

    docs = documents(spark, sf_dir)
    return dropped(docs, indexed(docs), "kept_sha256 string")


ORACLE["op9_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(1, 1 + len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), k AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), r AS (
  SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), m AS (
  SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND k.doc_id > r.first_doc AS gone FROM k LEFT JOIN r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnloom.llm.docstats import BASE
    from turnloom.llm.rules import fit_decision_list, judged

    docs = documents(spark, sf_dir)
    rules = fit_decision_list(docs, labels(spark, sf_dir))
    return judged(docs, rules).select("doc_id", *BASE, "base_failed", "kept")


@query
def op7_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnloom.llm.gif import digests, media_table

    return digests(media_table(documents(spark, sf_dir)))


@query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from turnloom.llm.bpe import Bpe, digests

    return digests(documents(spark, sf_dir), Bpe.load(public_tokenizers.path("word_bpe_49k.json")))


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnloom.llm.toxicity import fit, scored

    docs = documents(spark, sf_dir)
    out = held_out(F.col("doc_id"), 4, 2)
    model = fit(docs, labels(spark, sf_dir), ~out)
    return scored(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_clauses")


@query
def op2_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnloom.llm.rff import fit, scored

    docs = documents(spark, sf_dir)
    out = held_out(F.col("doc_id"), 3, 1)
    model = fit(docs, labels(spark, sf_dir), ~out)
    return scored(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnloom.llm.substrings import without_repeats

    return without_repeats(documents(spark, sf_dir), "kept_sha256 string")


ORACLE["op8_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS ws FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i, ws FROM w WHERE len(ws) >= 20
), k AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS k FROM s
), g AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM k) WHERE r > 1
), c AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM g
), p AS (
  SELECT doc_id, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS word FROM w
), m AS (
  SELECT p.doc_id, p.pos, p.word, c.pos IS NOT NULL AS gone FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.pos = c.pos
), a AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM m GROUP BY doc_id
)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN a ON w.doc_id = a.doc_id
"""


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnloom.llm.suffixes import without_repeats

    return without_repeats(documents(spark, sf_dir), "kept_sha256 string")


ORACLE["op6_suffix_dedup"] = r"""
WITH t AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS x FROM documents
), v AS (
  SELECT doc_id, o, octet_length(b) - 99 - o AS n, x[2 * o + 1 : 2 * o + 598] AS y FROM (SELECT doc_id, b, x, unnest(range(0, octet_length(b) - 99, 200)) AS o FROM t WHERE octet_length(b) >= 100)
), s AS (
  SELECT doc_id, o + unnest(range(least(n, 200))) AS i, unnest(range(least(n, 200))) AS j, y FROM v
), k AS (
  SELECT doc_id, i, md5_number(y[2 * j + 1 : 2 * j + 200]) AS k FROM s
), g AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM k) WHERE r > 1
), e AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM g
), o AS (
  SELECT doc_id, i, sum((before IS NULL OR i > before + 100)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM e
), p AS (
  SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM o GROUP BY doc_id, n
), c AS (
  SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS kept_from FROM p
), d AS (
  SELECT c.doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, string_agg(x[2 * kept_from + 1 : 2 * a], '' ORDER BY a) || any_value(x)[2 * max(z) + 1 :] AS kept FROM c JOIN t ON t.doc_id = c.doc_id GROUP BY c.doc_id
)
SELECT t.doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM t LEFT JOIN d ON t.doc_id = d.doc_id
"""


@query
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnloom.llm.near import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


ORACLE["op5_ngram_jaccard_join"] = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS ws FROM documents
), i AS (
  SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM t WHERE len(ws) > 0
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS g FROM i
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT c.a, c.b FROM c JOIN n x ON c.a = x.doc_id JOIN n y ON c.b = y.doc_id WHERE 5 * c.k >= 4 * (x.n + y.n - c.k)
  UNION
  SELECT x.doc_id, y.doc_id FROM t x JOIN t y ON x.text = y.text AND x.doc_id < y.doc_id
), l AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM t UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), k AS (
  SELECT a AS doc_id, min(b) AS class_id FROM r GROUP BY a
), d AS (
  SELECT a AS doc_id, count(*) AS n FROM l GROUP BY a
)
SELECT k.doc_id, k.class_id, coalesce(d.n, 0) AS n_links FROM k LEFT JOIN d ON k.doc_id = d.doc_id
"""


@query
def op4_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnloom.llm.packing import packed

    return packed(documents(spark, sf_dir))
