"""Queries that plan: balance, budgets, voices, schedules, mixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.config import BalancingConfig, MixingConfig
from turnloom.operators import audio, balance, budget, counts, schedule, truncate, voices
from turnloom.plans.catalog import query
from turnloom.plans.fixtures import U_SQL, sql_fraction, table, utterances

WEIGHTS = {1: 1.0, 2: 3.0, 3: 6.0, 4: 10.0}
CONFIG = BalancingConfig({1: 1.0, 2: 1.0, 3: 2.0, 5: 4.0}, WEIGHTS)


def _draw(text: str) -> str:
    return sql_fraction(text)


PLAN_SQL = f"""p0 AS (
  SELECT DISTINCT 'clip' || lpad(o_orderkey::VARCHAR, 6, '0') AS clip_id FROM orders
), p1 AS (
  SELECT clip_id, {_draw("'0:' || clip_id || ':total'")} AS a, {_draw("'0:' || clip_id || ':simultaneous'")} AS b FROM p0
), p2 AS (
  SELECT clip_id, b, CASE WHEN a < 0.125 THEN 1 WHEN a < 0.25 THEN 2 WHEN a < 0.5 THEN 3 ELSE 5 END AS total FROM p1
), plan AS (
  SELECT clip_id, total, CASE WHEN total >= 4 THEN CASE WHEN b * 20 < 1 THEN 1 WHEN b * 20 < 4 THEN 2 WHEN b * 20 < 10 THEN 3 ELSE 4 END
    WHEN total = 3 THEN CASE WHEN b * 10 < 1 THEN 1 WHEN b * 10 < 4 THEN 2 ELSE 3 END WHEN total = 2 THEN CASE WHEN b * 4 < 1 THEN 1 ELSE 2 END ELSE 1 END AS max_simultaneous FROM p2
)"""


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "orders").select(F.format_string("clip%06d", "o_orderkey").alias("clip_id")).distinct()
    return balance.with_counts(ids, CONFIG)


@query("balance_plan", f"WITH {PLAN_SQL} SELECT clip_id, total::INT AS total, max_simultaneous::INT AS max_simultaneous FROM plan")
def balance_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)


@query(
    "balance_report",
    f"""WITH {PLAN_SQL}, r AS (SELECT 'total' AS dimension, total AS count, count(*) / sum(count(*)) OVER () AS realized FROM plan GROUP BY total
UNION ALL SELECT 'simultaneous', max_simultaneous, count(*) / sum(count(*)) OVER () FROM plan GROUP BY max_simultaneous),
t AS (SELECT * FROM (VALUES ('total', 1, 0.125::DOUBLE), ('total', 2, 0.125), ('total', 3, 0.25), ('total', 5, 0.5), ('simultaneous', 1, 0.05), ('simultaneous', 2, 0.15), ('simultaneous', 3, 0.3), ('simultaneous', 4, 0.5)) v(dimension, count, target))
SELECT coalesce(t.dimension, r.dimension) AS dimension, coalesce(t.count, r.count)::INT AS count, round(coalesce(target, 0), 9) AS target, round(coalesce(realized, 0), 9) AS realized FROM t FULL JOIN r ON t.dimension = r.dimension AND t.count = r.count""",
)
def balance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.realized_vs_target(_plan(spark, sf_dir), CONFIG).select("dimension", "count", F.round("target", 9).alias("target"), F.round("realized", 9).alias("realized"))


DEFAULT_PLAN_SQL = f"""w (k, w) AS (
  VALUES (1, 1.0::DOUBLE), (2, 3.0), (3, 6.0), (4, 10.0), (5, 8.0), (6, 6.0), (7, 4.0), (8, 3.0), (9, 2.0), (10, 2.0), (11, 1.0), (12, 1.0), (13, 1.0), (14, 1.0), (15, 1.0), (16, 1.0), (17, 1.0), (18, 1.0), (19, 1.0), (20, 1.0)
), s (k, w) AS (
  VALUES (1, 1.0::DOUBLE), (2, 3.0), (3, 6.0), (4, 10.0), (5, 6.0), (6, 3.0)
), d AS (
  SELECT clip_id, {_draw("'0:' || clip_id || ':total'")} AS a, {_draw("'0:' || clip_id || ':simultaneous'")} AS b FROM (SELECT DISTINCT 'clip' || lpad(o_orderkey::VARCHAR, 6, '0') AS clip_id FROM orders)
), t AS (
  SELECT clip_id, b, min(k) AS total FROM d, (SELECT k, sum(w) OVER (ORDER BY k) / sum(w) OVER () AS hi FROM w) WHERE a < hi GROUP BY ALL
), plan AS (
  SELECT clip_id, total, min(x.k) AS max_simultaneous FROM t, (SELECT k, sum(w) OVER (ORDER BY k) AS hi FROM s) x
  WHERE x.k <= total AND b * (SELECT sum(w) FROM s WHERE s.k <= total) < x.hi GROUP BY ALL
)"""


@query("balance_defaults", f"WITH {DEFAULT_PLAN_SQL} SELECT clip_id, total::INT AS total, max_simultaneous::INT AS max_simultaneous FROM plan")
def balance_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "orders").select(F.format_string("clip%06d", "o_orderkey").alias("clip_id")).distinct()
    return balance.with_counts(ids, BalancingConfig())


BUDGET_SQL = """tg AS (
  SELECT n_name AS name, CASE WHEN n_nationkey % 5 = 0 THEN 0.0 WHEN n_nationkey % 3 = 0 THEN n_nationkey / 100.0 ELSE 0.5 END::DOUBLE AS target_hours FROM nation
), b AS (
  SELECT * FROM tg WHERE target_hours > 0
)"""


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    hours = F.when(F.col("n_nationkey") % 5 == 0, 0.0).otherwise(F.col("n_nationkey") / 100)
    over = n.where((F.col("n_nationkey") % 5 == 0) | (F.col("n_nationkey") % 3 == 0)).select(F.col("n_name").alias("name"), hours.alias("hours"))
    return budget.resolve_budgets(n.select(F.col("n_name").alias("name")), over, 0.5)


@query("engine_budgets", f"WITH {BUDGET_SQL} SELECT * FROM b")
def engine_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _targets(spark, sf_dir)


CLIPS_SQL = """cl AS (
  SELECT c_custkey, n_name AS engine, 'k' || lpad(c_custkey::VARCHAR, 9, '0') AS clip_id, 5.0 + (c_custkey % 50)::DOUBLE AS duration_s FROM customer JOIN nation ON c_nationkey = n_nationkey
)"""


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("engine"), F.format_string("k%09d", "c_custkey").alias("clip_id"), (F.lit(5.0) + F.col("c_custkey") % 50).alias("duration_s"))


@query("budget_remaining", f"WITH {BUDGET_SQL}, {CLIPS_SQL}, d AS (SELECT engine, sum(duration_s) / 3600.0::DOUBLE AS hours FROM cl GROUP BY engine) SELECT name, round(target_hours, 9) AS target_hours, round(coalesce(hours, 0), 9) AS hours, round(greatest(0, target_hours - coalesce(hours, 0)), 9) AS remaining_hours FROM b LEFT JOIN d ON name = engine")
def budget_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = budget.remaining(_targets(spark, sf_dir), budget.generated_hours(_clips(spark, sf_dir)))
    return out.select("name", *[F.round(c, 9).alias(c) for c in ("target_hours", "hours", "remaining_hours")])


@query("budget_complete", f"WITH {BUDGET_SQL}, {CLIPS_SQL}, d AS (SELECT engine, sum(duration_s) / 3600.0::DOUBLE AS hours FROM cl GROUP BY engine) SELECT coalesce(bool_and(coalesce(hours, 0) >= target_hours), true) AS complete FROM b LEFT JOIN d ON name = engine")
def budget_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.is_complete(_targets(spark, sf_dir), budget.generated_hours(_clips(spark, sf_dir)))


@query(
    "budget_stop",
    f"""WITH {BUDGET_SQL}, {CLIPS_SQL}, w AS (SELECT *, coalesce(sum(duration_s) OVER (PARTITION BY engine ORDER BY clip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 3600.0::DOUBLE AS before_hours FROM cl)
SELECT engine, clip_id, duration_s, round(before_hours, 9) AS before_hours FROM w JOIN b ON engine = name WHERE before_hours < target_hours""",
)
def budget_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.within_budget(_clips(spark, sf_dir), _targets(spark, sf_dir)).withColumn("before_hours", F.round("before_hours", 9))


@query("engine_assign", f"SELECT 'c' || c_custkey AS clip_id, CASE WHEN {_draw(chr(39) + '0:c' + chr(39) + ' || c_custkey || ' + chr(39) + ':0:engine' + chr(39))} < 0.25 THEN 'sine' ELSE 'bark' END AS engine FROM customer")
def engine_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("clip_id"), F.lit(0).alias("ord"))
    return budget.assign_engines(c, {"sine": 1.0, "none": 0.0, "bark": 3.0}).drop("ord")


@query("voice_pick", f"WITH v AS (SELECT s_nationkey::VARCHAR AS speaker, list(s_name ORDER BY s_name) AS p FROM supplier GROUP BY ALL) SELECT speaker AS speaker_id, p[floor({_draw(chr(39) + '7:' + chr(39) + ' || speaker')} * len(p))::INT + 1] AS reference_path FROM v")
def voice_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("speaker"), F.col("s_name").alias("path"))
    return voices.references(bank.select(F.col("speaker").alias("speaker_id")).distinct(), bank, True, seed=7).drop("preset")


@query("voice_sample", f"WITH {PLAN_SQL} SELECT clip_id, total::INT AS speakers, total::INT AS distinct_speakers FROM plan")
def voice_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("speaker"))
    out = voices.sample_speakers(_plan(spark, sf_dir), bank)
    return out.groupBy("clip_id").agg(F.count("*").cast("int").alias("speakers"), F.count_distinct("speaker_id").cast("int").alias("distinct_speakers"))


def _scheduled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    u = utterances(spark, sf_dir).select("clip_id", "ord", "speaker_id", "text", F.col("dur_s").alias("duration_s"))
    peaks = u.select("clip_id").distinct().withColumn("peak", F.lit(2))
    return u, schedule.schedule(u, peaks, MixingConfig(max_simultaneous_speakers=2))


def _slot_draw(what: str) -> str:
    return _draw(f"'0:' || clip_id || ':' || ord || ':{what}'")


# one slot more a step, as in a sequential run: where the latest slot is, whether this clip falls into it, and whether it cuts it
SLOT_SQL = f"""q AS (
  SELECT clip_id, ord, dur_s, row_number() OVER (PARTITION BY clip_id ORDER BY ord) AS k, {_slot_draw("overlap")} AS r_overlap, {_slot_draw("start")} AS r_start, {_slot_draw("uncut")} AS r_uncut, {_slot_draw("cut")} AS r_cut FROM u
), st AS (
  SELECT DISTINCT clip_id, 0::BIGINT AS k, []::STRUCT(o DOUBLE, d DOUBLE, c DOUBLE)[] AS slots FROM u
  UNION ALL
  SELECT clip_id, k, list_append(list_transform(slots, lambda x, i: CASE WHEN cuts AND i = v THEN {{'o': x.o, 'd': x.d, 'c': cut}} ELSE x END), {{'o': CASE WHEN falls THEN start ELSE after END, 'd': dur_s, 'c': NULL::DOUBLE}}) FROM (
    SELECT *, falls AND r_uncut >= 0.5 AND (victim.c IS NULL OR cut < victim.c) AS cuts FROM (
      SELECT *, coalesce(victim IS NOT NULL AND r_overlap < 0.8 AND len(list_filter(slots, lambda x: x.o <= start AND start < x.o + coalesce(x.c, x.d))) < 2, false) AS falls,
             least(victim.d, (start - victim.o) + 0.01::DOUBLE + r_cut * 2.99::DOUBLE) AS cut FROM (
        SELECT *, victim.o + r_start * (victim.o + coalesce(victim.c, victim.d) - victim.o) AS start FROM (
          SELECT *, slots[v] AS victim FROM (
            SELECT q.*, slots, list_position(list_transform(slots, lambda x: x.o), list_max(list_transform(slots, lambda x: x.o))) AS v, coalesce(list_max(list_transform(slots, lambda x: x.o + coalesce(x.c, x.d))), 0::DOUBLE) AS after
            FROM st JOIN q ON q.clip_id = st.clip_id AND q.k = st.k + 1))))
  )
), s AS (
  SELECT q.clip_id, q.ord, slots[q.k].o AS offset_s, slots[q.k].d AS duration_s, slots[q.k].c AS cut_at_s
  FROM q JOIN (SELECT clip_id, arg_max(slots, k) AS slots FROM st GROUP BY clip_id) f ON q.clip_id = f.clip_id
)"""


@query("schedule_clips", f"WITH RECURSIVE {U_SQL}, {SLOT_SQL} SELECT clip_id, ord, round(offset_s, 6) AS offset_s, round(duration_s, 6) AS duration_s, round(cut_at_s, 6) AS cut_at_s FROM s")
def schedule_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scheduled(spark, sf_dir)[1].select("clip_id", "ord", *[F.round(c, 6).alias(c) for c in ("offset_s", "duration_s", "cut_at_s")])


@query(
    "schedule_peak_check",
    f"""WITH RECURSIVE {U_SQL}, {SLOT_SQL}, k AS (SELECT clip_id, offset_s AS a, offset_s + least(duration_s, coalesce(cut_at_s, duration_s)) AS b FROM s)
SELECT x.clip_id, max((SELECT count(*) FROM k y WHERE y.clip_id = x.clip_id AND y.a <= x.a AND x.a < y.b))::INT AS peak, max((SELECT count(*) FROM k y WHERE y.clip_id = x.clip_id AND y.a <= x.a AND x.a < y.b)) <= 2 AS within FROM k x GROUP BY x.clip_id""",
)
def schedule_peak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scheduled(spark, sf_dir)[1]
    placed = s.withColumn("end_s", F.col("offset_s") + truncate.kept_seconds(F.col("duration_s"), F.col("cut_at_s")))
    return counts.peak_overlap(placed, "clip_id", "offset_s").select("clip_id", F.col("peak").cast("int").alias("peak"), (F.col("peak") <= 2).alias("within"))


@query(
    "mix_render_stats",
    f"""WITH RECURSIVE {U_SQL}, {SLOT_SQL} SELECT clip_id, 16000::INT AS sample_rate, max(round_even(offset_s * 16000, 0) + round_even(least(duration_s, coalesce(cut_at_s, duration_s)) * 16000, 0))::BIGINT AS num_samples, true AS whole FROM s GROUP BY clip_id""",
)
def mix_render_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, s = _scheduled(spark, sf_dir)
    placed = s.withColumn("kept_s", truncate.kept_seconds(F.col("duration_s"), F.col("cut_at_s"))).join(u.select("clip_id", "ord", "text", F.col("speaker_id").alias("preset")), ["clip_id", "ord"])
    return audio.rendered(placed).select("clip_id", "sample_rate", "num_samples", (F.octet_length("pcm") == 4 * F.col("num_samples")).alias("whole"))
