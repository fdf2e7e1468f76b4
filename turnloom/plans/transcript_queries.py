"""Queries over utterances: counts, splits, transcripts, sentences, alignment, truncation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.operators import align, counts, sot, split, truncate
from turnloom.plans.catalog import query
from turnloom.plans.fixtures import H_SQL, U_SQL, hypothesis, sql_fraction, table, utterances

PEAK_SQL = """e AS (
  SELECT clip_id, start_s AS t, 1 AS d FROM u UNION ALL SELECT clip_id, end_s, -1 FROM u
), a AS (
  SELECT clip_id, sum(d) OVER (PARTITION BY clip_id ORDER BY t, d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM e
), peak AS (
  SELECT clip_id, greatest(0, max(n))::INT AS peak FROM a GROUP BY clip_id
)"""
SPLIT_SQL = f"CASE WHEN {sql_fraction('clip_id')} < 0.8 THEN 'train' WHEN {sql_fraction('clip_id')} < 0.9 THEN 'val' ELSE 'test' END"
SOT_SQL = """s AS (
  SELECT clip_id, string_agg('<' || speaker_id || '> ' || start_s::VARCHAR || '->' || end_s::VARCHAR || ': ' || text, chr(10) ORDER BY start_s, end_s, speaker_id, text) AS sot FROM u GROUP BY clip_id
)"""


@query(
    "clip_manifest",
    f"""WITH {U_SQL}, {PEAK_SQL}, {SOT_SQL}
SELECT u.clip_id, {SPLIT_SQL.replace("clip_id", "u.clip_id")} AS split, any_value(s.sot) AS transcript, max(end_s) AS duration_s,
       count(DISTINCT speaker_id)::INT AS speaker_count_total, any_value(peak)::INT AS speaker_count_max_simultaneous
FROM u JOIN peak ON u.clip_id = peak.clip_id JOIN s ON u.clip_id = s.clip_id GROUP BY u.clip_id""",
)
def clip_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = utterances(spark, sf_dir)
    n = counts.speaker_counts(u)
    length = u.groupBy("clip_id").agg(F.max("end_s").alias("duration_s"))
    out = sot.serialize(u).join(n, "clip_id").join(length, "clip_id")
    return out.select("clip_id", split.assign_split(F.col("clip_id")).alias("split"), F.col("sot").alias("transcript"), "duration_s", F.col("total").alias("speaker_count_total"), F.col("max_simultaneous").alias("speaker_count_max_simultaneous"))


SENTENCES_SQL = r"""s AS (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '^[ \t\n\r\x0B\f]+|[ \t\n\r\x0B\f]+$', '', 'g'), '([.!?])[ \t\n\r\x0B\f]+', '\1' || chr(1), 'g'), chr(1)),
         lambda x: regexp_replace(x, '^[ \t\n\r\x0B\f]+|[ \t\n\r\x0B\f]+$', '', 'g')), lambda x: x <> '') AS l FROM documents
)"""


@query("sentence_split", f"WITH {SENTENCES_SQL} SELECT doc_id, unnest(range(0, len(l)))::INT AS pos, unnest(l) AS sentence FROM s")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.coalesce("text", F.lit("")))).alias("pos", "sentence"))


@query("sentence_stats", f"WITH {SENTENCES_SQL}, n AS (SELECT lang, len(l) AS n FROM s JOIN documents USING (doc_id)) SELECT lang, count(*) AS docs, sum(n)::BIGINT AS sentences, max(n)::INT AS longest FROM n GROUP BY lang")
def sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").select("lang", F.size(T.sentences(F.coalesce("text", F.lit("")))).alias("n"))
    return n.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n").alias("sentences"), F.max("n").alias("longest"))


@query(
    "markup_clean",
    r"""WITH m AS (SELECT item_id, '== Part ' || item_id || ' ==' || chr(10) || coalesce(text, '') || '[' || item_id || '] end' AS raw FROM benchmark)
SELECT item_id, regexp_replace(regexp_replace(raw, '(?m)^[ \t\n\r\x0B\f]*=+.*?=+[ \t\n\r\x0B\f]*$', '', 'g'), '\[[0-9]+\]', '', 'g') AS clean FROM m""",
)
def markup_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("== Part "), "item_id", F.lit(" ==\n"), F.coalesce("text", F.lit("")), F.lit("["), "item_id", F.lit("] end"))
    return table(spark, sf_dir, "benchmark").select("item_id", T.clean_markup(raw).alias("clean"))


@query("split_assign", f"SELECT doc_id, {SPLIT_SQL.replace('clip_id', 'doc_id::VARCHAR')} AS split FROM documents")
def split_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", split.assign_split(F.col("doc_id").cast("string")).alias("split"))


@query("split_counts", f"WITH c AS (SELECT DISTINCT 'clip' || lpad(conv_id::VARCHAR, 6, '0') AS clip_id FROM conversations) SELECT {SPLIT_SQL} AS split, count(*) AS clips FROM c GROUP BY 1")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = table(spark, sf_dir, "conversations").select(F.format_string("clip%06d", "conv_id").alias("clip_id")).distinct()
    return split.split_counts(clips)


@query("split_report", f"WITH {U_SQL}, n AS (SELECT clip_id, count(DISTINCT speaker_id)::INT AS total FROM u GROUP BY clip_id) SELECT {SPLIT_SQL} AS split, total, count(*) AS clips FROM n GROUP BY ROLLUP (1, 2)".replace("ROLLUP (1, 2)", "ROLLUP (split, total)").replace("SELECT CASE", "SELECT split, total, count(*) AS clips FROM (SELECT total, CASE").replace(" AS split, total, count(*) AS clips FROM n GROUP", " AS split FROM n) GROUP"))
def split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_report(counts.speaker_counts(utterances(spark, sf_dir)))


@query("speaker_counts", f"WITH {U_SQL}, {PEAK_SQL} SELECT u.clip_id, count(DISTINCT speaker_id)::INT AS total, any_value(peak) AS max_simultaneous FROM u JOIN peak ON u.clip_id = peak.clip_id GROUP BY u.clip_id")
def speaker_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.speaker_counts(utterances(spark, sf_dir))


@query(
    "peak_overlap",
    """WITH u AS (SELECT user_id AS clip_id, epoch_us(ts) / 1e6 AS start_s, epoch_us(ts) / 1e6 + coalesce(value, 0) * 1000 AS end_s FROM events),
"""
    + PEAK_SQL
    + " SELECT clip_id AS user_id, peak FROM peak",
)
def peak_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = table(spark, sf_dir, "events").select("user_id", ts.alias("start_s"), (ts + F.coalesce("value", F.lit(0.0)) * 1000).alias("end_s"))
    return counts.peak_overlap(e, "user_id")


@query("sot_serialize", f"WITH {U_SQL}, {SOT_SQL} SELECT clip_id, sot FROM s")
def sot_serialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sot.serialize(utterances(spark, sf_dir))


@query("sot_roundtrip", f"WITH {U_SQL} SELECT clip_id, (row_number() OVER (PARTITION BY clip_id ORDER BY start_s, end_s, speaker_id, text) - 1)::INT AS ord, speaker_id, start_s, end_s, text, (text = '-' OR text LIKE '% -') AS truncated FROM u")
def sot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sot.parse(sot.serialize(utterances(spark, sf_dir))).drop("words")


@query(
    "sot_invalid",
    r"""SELECT 'conv' || conv_id AS clip_id, turn::INT AS ord, CASE WHEN regexp_matches(text, '[\n\x0B\f\r\x1c-\x1e]') THEN 'line break' WHEN turn % 5 = 0 THEN '> in speaker' ELSE 'negative time' END AS reason
FROM conversations WHERE regexp_matches(text, '[\n\x0B\f\r\x1c-\x1e]') OR turn % 5 = 0 OR turn % 3 = 0""",
)
def sot_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    u = c.select(F.concat(F.lit("conv"), "conv_id").alias("clip_id"), F.col("turn").cast("int").alias("ord"), F.concat("role", F.when(F.col("turn") % 5 == 0, ">x").otherwise("")).alias("speaker_id"), F.when(F.col("turn") % 3 == 0, -1.0).otherwise(0.0).alias("start_s"), F.lit(1.0).alias("end_s"), "text")
    return sot.invalid(u).select("clip_id", "ord", "reason")


TOKENS_SQL = "t AS (SELECT clip_id, ord, text, start_s, dur_s, end_s, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM u)"


@query(
    "align_proportional",
    f"""WITH {U_SQL}, {TOKENS_SQL}, x AS (SELECT clip_id, ord, dur_s, len(w) AS n, list_sum(list_transform(w, lambda x: length(x)))::DOUBLE AS total, unnest(w) AS word, unnest(range(0, len(w)))::INT AS pos FROM t WHERE len(w) > 0),
c AS (SELECT *, sum(length(word)) OVER (PARTITION BY clip_id, ord ORDER BY pos) AS upto FROM x)
SELECT clip_id, ord, pos, word, round(dur_s * (upto - length(word)) / total + 1e-9, 6) AS start_s, round(CASE WHEN pos = n - 1 THEN dur_s ELSE dur_s * upto / total END + 1e-9, 6) AS end_s FROM c""",
)
def align_proportional(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = utterances(spark, sf_dir).where("text <> ''")
    rows = u.select("clip_id", "ord", F.posexplode(align.proportional(F.col("text"), F.col("dur_s"))).alias("pos", "x"))
    return rows.select("clip_id", "ord", "pos", F.col("x.text").alias("word"), F.round(F.col("x.start_s") + 1e-9, 6).alias("start_s"), F.round(F.col("x.end_s") + 1e-9, 6).alias("end_s"))


@query(
    "align_even",
    f"""WITH {U_SQL}, {TOKENS_SQL}, x AS (SELECT clip_id, ord, start_s AS s, (end_s - start_s) / len(w) AS span, unnest(w) AS word, unnest(range(0, len(w)))::INT AS pos FROM t WHERE len(w) > 0)
SELECT clip_id, ord, pos, word, round(s + pos * span, 8) AS start_s, round(s + (pos + 1) * span, 8) AS end_s FROM x""",
)
def align_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = utterances(spark, sf_dir).select("clip_id", "ord", F.posexplode(align.even(F.col("text"), F.col("start_s"), F.col("end_s"))).alias("pos", "x"))
    return rows.select("clip_id", "ord", "pos", F.col("x.text").alias("word"), F.round("x.start_s", 8).alias("start_s"), F.round("x.end_s", 8).alias("end_s"))


@query("ctc_normalize", f"WITH {U_SQL}, x AS (SELECT clip_id, ord, unnest(string_split(text, ' ')) AS word FROM u) SELECT clip_id, ord, word, nullif(upper(regexp_replace(word, '[^A-Za-z'']', '', 'g')), '') AS token FROM x WHERE word <> ''")
def ctc_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return utterances(spark, sf_dir).select("clip_id", "ord", F.explode(T.words(F.col("text"))).alias("word")).withColumn("token", T.vocabulary_form(F.col("word")))


@query(
    "ctc_clamp",
    f"""WITH {U_SQL}, s AS (SELECT clip_id, ord, start_s - 1.0 AS s, end_s AS e, (SELECT max(end_s) * 0.9::DOUBLE FROM u v WHERE v.clip_id = u.clip_id) AS d FROM u),
c AS (SELECT *, least(greatest(0, max(least(greatest(s, e), d)) OVER (PARTITION BY clip_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), d) AS cur FROM s)
SELECT clip_id, ord, round(least(greatest(s, coalesce(cur, 0)), d), 6) AS start_s, round(least(greatest(e, least(greatest(s, coalesce(cur, 0)), d)), d), 6) AS end_s FROM c""",
)
def ctc_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = utterances(spark, sf_dir)
    rows = u.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("ord", (F.col("start_s") - 1.0).alias("start_s"), "end_s"))).alias("s"), (F.max("end_s") * 0.9).alias("d"))
    out = align.clamped(F.transform("s", lambda x: x["ord"].cast("string")), F.transform("s", lambda x: F.struct(x["start_s"].alias("start_s"), x["end_s"].alias("end_s"))), F.col("d"))
    return rows.select("clip_id", F.explode(out).alias("x")).select("clip_id", F.col("x.text").cast("int").alias("ord"), F.round("x.start_s", 6).alias("start_s"), F.round("x.end_s", 6).alias("end_s"))


@query("textgrid_words", f"WITH {U_SQL} SELECT clip_id, ord, speaker_id AS word, start_s, end_s FROM u")
def textgrid_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = utterances(spark, sf_dir)
    cell = lambda n, a, b, t: F.concat(F.lit(f"intervals [{n}]:\n xmin = "), a, F.lit("\n xmax = "), b, F.lit('\n text = "'), t, F.lit('"\n'))
    words = F.concat(cell(1, F.lit("0"), T.float_text(F.col("start_s")), F.lit("sil")), cell(2, T.float_text(F.col("start_s")), T.float_text(F.col("end_s")), F.col("speaker_id")))
    raw = F.concat(F.lit('item [1]:\n name = "phones"\n'), cell(1, F.lit("0"), F.lit("1"), F.lit("AH")), F.lit('item [2]:\n name = "words"\n'), words)
    return u.select("clip_id", "ord", F.explode(align.textgrid_words(raw)).alias("x")).select("clip_id", "ord", F.col("x.text").alias("word"), "x.start_s", "x.end_s")


@query(
    "truncate_words",
    f"""WITH {U_SQL}, {TOKENS_SQL}, x AS (SELECT clip_id, ord, start_s AS offs, dur_s, dur_s * 0.6::DOUBLE AS cut, dur_s / len(w) AS span, unnest(w) AS word, unnest(range(0, len(w)))::INT AS pos FROM t WHERE len(w) > 0),
y AS (SELECT *, 0.0 + pos * span AS s, 0.0 + (pos + 1) * span AS e FROM x),
z AS (SELECT clip_id, ord, any_value(offs) AS start_s, any_value(offs + least(dur_s, cut)) AS end_s, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE e <= cut + 1e-6) AS kept, count(*) FILTER (WHERE e <= cut + 1e-6) AS n_kept, count(*) AS n, bool_or(s < cut AND cut < e) AS mid FROM y GROUP BY clip_id, ord)
SELECT clip_id, ord, start_s, end_s, CASE WHEN mid THEN CASE WHEN n_kept > 0 THEN kept || ' -' ELSE '-' END ELSE coalesce(kept, '') END AS text, n_kept::INT AS n_kept, n_kept < n AS truncated FROM z""",
)
def truncate_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = utterances(spark, sf_dir).where("text <> ''")
    w = align.even(F.col("text"), F.lit(0.0), F.col("dur_s"))
    p = truncate.placed(F.col("dur_s"), w, F.col("text"), F.col("start_s"), F.col("dur_s") * 0.6)
    return u.select("clip_id", "ord", p.alias("p")).select("clip_id", "ord", "p.start_s", "p.end_s", "p.text", F.size("p.words").alias("n_kept"), "p.truncated")


@query("word_streams", f"WITH {H_SQL}, x AS (SELECT clip_id, speaker_id, start_s, end_s, ord, unnest(string_split(text, ' ')) AS w, unnest(range(0, len(string_split(text, ' ')))) AS p FROM h) SELECT clip_id, speaker_id, string_agg(w, ' ' ORDER BY start_s, end_s, ord, p) AS stream, count(*)::INT AS n FROM x WHERE w <> '' GROUP BY ALL")
def word_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnloom.operators.cpwer import word_streams as streams

    s = streams(hypothesis(utterances(spark, sf_dir))).where(F.size("words") > 0)
    return s.select("clip_id", "speaker_id", F.array_join(F.transform("words", lambda w: w["text"]), " ").alias("stream"), F.size("words").alias("n"))


