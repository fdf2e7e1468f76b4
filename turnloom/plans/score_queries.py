"""Queries that score a hypothesis: overlaps, timelines, DER, cpWER."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.operators import cpwer as cp
from turnloom.operators import der
from turnloom.plans.catalog import query
from turnloom.plans.fixtures import H_SQL, hypothesis, utterances


OVERLAP_SQL = """m AS (
  SELECT r.clip_id, r.speaker_id AS ref_speaker, h.speaker_id AS hyp_speaker, sum(least(r.end_s, h.end_s) - greatest(r.start_s, h.start_s)) AS overlap_s
  FROM u r JOIN h ON r.clip_id = h.clip_id AND r.start_s < h.end_s AND h.start_s < r.end_s GROUP BY ALL
)"""
LINE_SQL = """pt AS (
  SELECT clip_id, start_s AS t0 FROM u UNION SELECT clip_id, end_s FROM u UNION SELECT clip_id, start_s FROM h UNION SELECT clip_id, end_s FROM h
), ln AS (
  SELECT clip_id, t0, lead(t0) OVER (PARTITION BY clip_id ORDER BY t0) AS t1 FROM pt
), li AS (
  SELECT * FROM ln WHERE t1 IS NOT NULL
)"""
# at most three speakers a side: all injective maps of X, Y, Z, "-" standing for a speaker without a partner
DER_SQL = f"""{H_SQL}, {OVERLAP_SQL}, {LINE_SQL},
nm AS (SELECT clip_id, speaker_id AS s FROM u GROUP BY ALL),
pr AS (
  SELECT c.clip_id, x.s AS x, y.s AS y, z.s AS z FROM (SELECT DISTINCT clip_id FROM u) c,
  LATERAL (SELECT s FROM nm WHERE nm.clip_id = c.clip_id UNION ALL SELECT '-') x, LATERAL (SELECT s FROM nm WHERE nm.clip_id = c.clip_id UNION ALL SELECT '-') y, LATERAL (SELECT s FROM nm WHERE nm.clip_id = c.clip_id UNION ALL SELECT '-') z
  WHERE (x.s <> y.s OR x.s = '-') AND (x.s <> z.s OR x.s = '-') AND (y.s <> z.s OR y.s = '-')
), sc AS (
  SELECT pr.clip_id, x, y, z, coalesce(sum(overlap_s), 0) AS v FROM pr LEFT JOIN m ON m.clip_id = pr.clip_id AND ((hyp_speaker = 'X' AND ref_speaker = x) OR (hyp_speaker = 'Y' AND ref_speaker = y) OR (hyp_speaker = 'Z' AND ref_speaker = z)) GROUP BY ALL
), bs AS (
  SELECT clip_id, x, y, z FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY round(v, 6) DESC, x DESC, y DESC, z DESC) AS k FROM sc) WHERE k = 1
), ra AS (
  SELECT li.clip_id, t0, t1, list(DISTINCT speaker_id) FILTER (WHERE speaker_id IS NOT NULL) AS r FROM li LEFT JOIN u ON u.clip_id = li.clip_id AND u.start_s <= t0 AND u.end_s >= t1 GROUP BY ALL
), ha AS (
  SELECT li.clip_id, t0, t1, list(DISTINCT speaker_id) FILTER (WHERE speaker_id IS NOT NULL) AS h, list(DISTINCT CASE speaker_id WHEN 'X' THEN x WHEN 'Y' THEN y WHEN 'Z' THEN z END) FILTER (WHERE speaker_id IS NOT NULL) AS hm
  FROM li LEFT JOIN h ON h.clip_id = li.clip_id AND h.start_s <= t0 AND h.end_s >= t1 LEFT JOIN bs ON bs.clip_id = li.clip_id GROUP BY ALL
), df AS (
  SELECT ra.clip_id, sum(greatest(0, coalesce(len(r), 0) - coalesce(len(h), 0)) * (ra.t1 - ra.t0)) AS miss_s, sum(greatest(0, coalesce(len(h), 0) - coalesce(len(r), 0)) * (ra.t1 - ra.t0)) AS fa_s,
         sum((least(coalesce(len(r), 0), coalesce(len(h), 0)) - coalesce(len(list_intersect(r, hm)), 0)) * (ra.t1 - ra.t0)) AS conf_s
  FROM ra JOIN ha ON ra.clip_id = ha.clip_id AND ra.t0 = ha.t0 GROUP BY ALL
), dr AS (
  SELECT df.clip_id, round(miss_s, 5) AS miss_s, round(fa_s, 5) AS false_alarm_s, round(conf_s, 5) AS confusion_s, round(tot, 5) AS total_ref_s, round((miss_s + fa_s + conf_s) / tot, 5) AS rate
  FROM df JOIN (SELECT clip_id, sum(end_s - start_s) AS tot FROM u GROUP BY clip_id) t ON df.clip_id = t.clip_id
)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    u = utterances(spark, sf_dir)
    return u, hypothesis(u)


@query("speaker_overlap_matrix", f"WITH {H_SQL}, {OVERLAP_SQL} SELECT clip_id, ref_speaker, hyp_speaker, round(overlap_s, 6) AS overlap_s FROM m")
def speaker_overlap_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return der.overlap_matrix(*_sides(spark, sf_dir)).withColumn("overlap_s", F.round("overlap_s", 6))


@query("elementary_intervals", f"WITH {H_SQL}, {LINE_SQL} SELECT clip_id, t0, t1 FROM li")
def elementary_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return der.elementary_intervals(*_sides(spark, sf_dir))


@query("der", f"WITH {DER_SQL} SELECT * FROM dr")
def der_by_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = der.diarization_error_rate(*_sides(spark, sf_dir))
    return out.select("clip_id", *[F.round(c, 5).alias(c) for c in ("miss_s", "false_alarm_s", "confusion_s", "total_ref_s", "rate")])


@query("der_components", f"WITH {DER_SQL} SELECT round(sum(miss_s), 3) AS miss_s, round(sum(false_alarm_s), 3) AS false_alarm_s, round(sum(confusion_s), 3) AS confusion_s, count(*) AS clips FROM dr")
def der_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = der.components(*_sides(spark, sf_dir))
    return c.agg(*[F.round(F.sum(F.round(k, 5)), 3).alias(k) for k in ("miss_s", "false_alarm_s", "confusion_s")], F.count("*").alias("clips"))


@query("der_from_sot", f"WITH {DER_SQL} SELECT clip_id, rate FROM dr")
def der_from_sot(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnloom.operators.sot import serialize

    u, h = _sides(spark, sf_dir)
    return der.der_from_sot(serialize(u), serialize(h)).select("clip_id", F.round("rate", 5).alias("rate"))


# word edits of every pair of streams, a row of the table at a time; then the pairing that saves most against deleting and inserting everything
CPWER_SQL = f"""{H_SQL}, rs AS (
  SELECT clip_id, speaker_id, list_filter(string_split(string_agg(text, ' ' ORDER BY start_s, end_s, ord), ' '), lambda x: x <> '') AS w FROM u GROUP BY ALL
), hs AS (
  SELECT clip_id, speaker_id, list_filter(string_split(string_agg(text, ' ' ORDER BY start_s, end_s, ord), ' '), lambda x: x <> '') AS w FROM h GROUP BY ALL
), pq AS (
  SELECT row_number() OVER () AS p, rs.clip_id, rs.speaker_id AS r, hs.speaker_id AS h, rs.w AS rw, hs.w AS hw FROM rs JOIN hs ON rs.clip_id = hs.clip_id
), rx AS (
  SELECT p, unnest(rw) AS word, unnest(range(1, len(rw) + 1)) AS i FROM pq
), hx AS (
  SELECT p, unnest(hw) AS word, unnest(range(1, len(hw) + 1)) AS j FROM pq
), ed AS (
  SELECT p, 0::BIGINT AS i, unnest(range(len(hw) + 1)) AS j, unnest(range(len(hw) + 1)) AS v FROM pq
  UNION ALL
  SELECT p, i, j, min(base - j) OVER (PARTITION BY p ORDER BY j) + j FROM (
    SELECT ed.p, rx.i, ed.j, CASE WHEN ed.j = 0 THEN rx.i ELSE least(v + 1, lag(v) OVER (PARTITION BY ed.p ORDER BY ed.j) + (rx.word <> hx.word)::BIGINT) END AS base
    FROM ed JOIN rx ON rx.p = ed.p AND rx.i = ed.i + 1 LEFT JOIN hx ON hx.p = ed.p AND hx.j = ed.j)
), sv AS (
  SELECT clip_id, r, h, len(rw) + len(hw) - v AS saved FROM pq JOIN ed ON ed.p = pq.p AND ed.i = len(rw) AND ed.j = len(hw)
), nm AS (
  SELECT clip_id, speaker_id AS s FROM rs UNION ALL SELECT DISTINCT clip_id, '-' FROM rs
), pr AS (
  SELECT x.clip_id, x.s AS x, y.s AS y, z.s AS z FROM nm x JOIN nm y ON x.clip_id = y.clip_id JOIN nm z ON x.clip_id = z.clip_id
  WHERE (x.s <> y.s OR x.s = '-') AND (x.s <> z.s OR x.s = '-') AND (y.s <> z.s OR y.s = '-')
), bs AS (
  SELECT clip_id, max(saved) AS saved FROM (SELECT pr.clip_id, x, y, z, coalesce(sum(saved), 0) AS saved FROM pr LEFT JOIN sv ON sv.clip_id = pr.clip_id AND (h = 'X' AND r = x OR h = 'Y' AND r = y OR h = 'Z' AND r = z) GROUP BY ALL) GROUP BY clip_id
), nr AS (
  SELECT clip_id, sum(len(w)) AS n FROM rs GROUP BY clip_id
), nh AS (
  SELECT clip_id, sum(len(w)) AS n FROM hs GROUP BY clip_id
)"""


@query("cpwer", f"WITH RECURSIVE {CPWER_SQL} SELECT nr.clip_id, (nr.n + coalesce(nh.n, 0) - saved)::BIGINT AS errors, nr.n::BIGINT AS n_ref_words, (nr.n + coalesce(nh.n, 0) - saved)::DOUBLE / nr.n AS cpwer FROM nr JOIN bs ON bs.clip_id = nr.clip_id LEFT JOIN nh ON nh.clip_id = nr.clip_id")
def cpwer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.cpwer(*_sides(spark, sf_dir))


@query("tcpwer")
def tcpwer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.tcpwer(*_sides(spark, sf_dir), 0.5)


# The hypothesis that only replaces first words has an alignment of word for word: its errors are the replaced words.
@query(
    "word_errors",
    f"""WITH {H_SQL}, g AS (SELECT u.clip_id, u.ord, u.text AS a, CASE WHEN h.ord IS NULL THEN u.text ELSE h.text END AS b FROM u LEFT JOIN h ON u.clip_id = h.clip_id AND u.ord = h.ord)
SELECT clip_id, sum(CASE WHEN a <> b AND a NOT LIKE 'zzz%' THEN 1 ELSE 0 END)::BIGINT AS errors, sum(len(list_filter(string_split(a, ' '), lambda x: x <> '')))::BIGINT AS n_ref_words FROM g GROUP BY clip_id""",
)
def word_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, h = _sides(spark, sf_dir)
    same = u.join(h.select("clip_id", "ord", F.col("text").alias("_t")), ["clip_id", "ord"], "left").withColumn("text", F.coalesce("_t", "text")).drop("_t")
    return cp.cpwer(u, same).select("clip_id", "errors", "n_ref_words")


@query("macro_mean_score", f"WITH {DER_SQL} SELECT round(avg(rate), 4) AS mean_rate FROM dr")
def macro_mean_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = der.diarization_error_rate(*_sides(spark, sf_dir)).select("clip_id", F.round("rate", 5).alias("rate"))
    return cp.macro_mean(rates, "rate").withColumn("mean_rate", F.round("mean_rate", 4))
