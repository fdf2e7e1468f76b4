"""Queries of sources, sinks and sample arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions import dsp
from turnloom.functions.text import preset_pitch, squeezed
from turnloom.operators import audio, counts, sot
from turnloom.plans.catalog import query
from turnloom.plans.fixtures import U_SQL, table, utterances
from turnloom.schemas import MANIFEST
from turnloom.sources import kaldi, manifest, mixlist

HZ = 8_000


def _kaldi(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The four files as tables of lines: one utterance in seven has no text, one in eleven no speaker, one recording in nine no audio."""
    u = utterances(spark, sf_dir).withColumn("utt", F.concat_ws("-", "clip_id", "ord")).withColumn("n", F.substring("clip_id", 5, 6).cast("int"))
    lines = lambda d, c: d.select(c.alias("value"), F.lit(0).alias("line_no"))
    seg = lines(u, F.concat_ws(" ", "utt", "clip_id", F.col("start_s").cast("string"), F.col("end_s").cast("string")))
    text = lines(u.where("ord % 7 <> 0"), F.concat_ws(" ", "utt", "text"))
    spk = lines(u.where("(ord + n) % 11 <> 0"), F.concat_ws("\t", "utt", "speaker_id"))
    wav = lines(u.where("n % 9 <> 0").select("clip_id").distinct(), F.concat_ws(" ", F.col("clip_id"), F.concat(F.lit("/a/"), "clip_id", F.lit(".wav"))))
    return kaldi.segments(seg), kaldi.pairs(text, "text"), kaldi.pairs(spk, "speaker_id"), kaldi.pairs(wav, "wav")


N_SQL = "n AS (SELECT *, substr(clip_id, 5, 6)::INT AS n FROM u)"


@query(
    "kaldi_join",
    f"""WITH {U_SQL}, {N_SQL} SELECT clip_id, start_s, end_s, CASE WHEN ord % 7 <> 0 THEN text ELSE '' END AS text, CASE WHEN (ord + n) % 11 <> 0 THEN speaker_id END AS speaker_id,
CASE WHEN n % 9 <> 0 THEN '/a/' || clip_id || '.wav' END AS wav FROM n""",
)
def kaldi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kaldi.joined(*_kaldi(spark, sf_dir), strict=False).select("clip_id", "start_s", "end_s", "text", "speaker_id", "wav")


@query("kaldi_missing", f"WITH {U_SQL}, {N_SQL} SELECT 'speaker' AS kind, clip_id || '-' || ord AS key FROM n WHERE (ord + n) % 11 = 0 UNION SELECT 'recording', clip_id FROM n WHERE n % 9 = 0")
def kaldi_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg, _, spk, wav = _kaldi(spark, sf_dir)
    return kaldi.missing(seg, spk, wav)


@query("mixlist_explode", f"WITH {U_SQL} SELECT clip_id, (row_number() OVER (PARTITION BY clip_id ORDER BY ord) - 1)::INT AS ord, speaker_id, ord || '.wav' AS wav, text, start_s FROM u")
def mixlist_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct("speaker_id", F.concat(F.col("ord").cast("string"), F.lit(".wav")).alias("wav"), "text", "start_s")
    rows = utterances(spark, sf_dir).groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("ord", item.alias("u")))).alias("x"))
    return mixlist.exploded(rows.select("clip_id", F.to_json(F.struct(F.transform("x", lambda x: x["u"]).alias("utterances"))).alias("value")))


@query(
    "manifest_json_roundtrip",
    f"""WITH {U_SQL}, s AS (SELECT clip_id, string_agg('<' || speaker_id || '> ' || start_s::VARCHAR || '->' || end_s::VARCHAR || ': ' || text, chr(10) ORDER BY start_s, end_s, speaker_id, text) AS transcript, max(end_s) AS duration_s, count(DISTINCT speaker_id)::INT AS speaker_count_total FROM u GROUP BY clip_id)
SELECT clip_id, transcript, duration_s, speaker_count_total, 'turns' AS source FROM s""",
)
def manifest_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = utterances(spark, sf_dir)
    clips = sot.serialize(u).withColumnRenamed("sot", "transcript").join(counts.speaker_counts(u), "clip_id").join(u.groupBy("clip_id").agg(F.max("end_s").alias("duration_s")), "clip_id")
    rows = manifest.manifest_rows(clips.withColumn("metadata", F.create_map(F.lit("source"), F.lit("turns"))))
    back = rows.select(F.from_json(F.to_json(F.struct(*rows.columns)), MANIFEST).alias("r")).select("r.*")
    return back.select("clip_id", "transcript", "duration_s", "speaker_count_total", F.element_at("metadata", "source").alias("source"))


@query("gain_db", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: greatest(-1.0::FLOAT, least(1.0::FLOAT, (x * (10.0 ** (6.0 / 20.0))::FLOAT)::FLOAT))::DOUBLE)), 4) AS total FROM embeddings")
def gain_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(F.aggregate(audio.gained(F.col("embedding"), 6.0), F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@query("rms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)), 7) AS rms FROM embeddings")
def rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(audio.rms_of(F.col("embedding")), 7).alias("rms"))


@query("snr_scale", "WITH r AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)) AS r FROM embeddings) SELECT vec_id, round(r / 10.0::DOUBLE ** (15.0::DOUBLE / 20) / 0.25, 7) AS scale FROM r")
def snr_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = audio.rms_of(F.col("embedding")) / F.lit(10.0 ** (15.0 / 20.0))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(level / 0.25, 7).alias("scale"))


def _stats(t: DataFrame, digits: int = 4) -> DataFrame:
    return t.select("vec_id", F.size("embedding").alias("n"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), digits).alias("energy"))


def _energy(samples: str, digits: int = 4) -> str:
    return f"SELECT vec_id, len(y)::INT AS n, round(list_sum(list_transform(y, lambda v: v::DOUBLE * v::DOUBLE)), {digits}) AS energy FROM (SELECT vec_id, {samples} AS y FROM e)"


E_SQL = "WITH e AS (SELECT vec_id, embedding AS x, len(embedding) AS m FROM embeddings)"


# twice the rate: every other sample lies halfway between its neighbours, the last one holds
@query("resample_linear", f"{E_SQL} {_energy('list_transform(range(2 * m), lambda i: ((x[i // 2 + 1]::DOUBLE + x[least(m, (i + 1) // 2 + 1)]::DOUBLE) / 2)::FLOAT)')}")
def resample_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(audio.array_chain(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", lambda k, x: dsp.resample(x, HZ, 2 * HZ)))


# the table's vectors are shorter than 100 samples: they are repeated
@query("fit_length", f"{E_SQL} {_energy('list_transform(range(100), lambda i: x[i % m + 1])')}")
def fit_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(audio.array_chain(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", lambda k, x: dsp.fit_length(x, 100, dsp.generator(0, k))))


@query(
    "reverb",
    f"""WITH r AS (SELECT list_transform(range(48), lambda k: exp(-k / 8.0::DOUBLE)) AS h), e AS (SELECT vec_id, embedding AS x, len(embedding) AS m, list_transform(h, lambda v: v / list_sum(h)) AS h FROM embeddings, r)
{_energy("list_transform(range(m), lambda i: greatest(-1, least(1, 0.7::DOUBLE * x[i + 1] + 0.3::DOUBLE * list_sum(list_transform(range(least(i, 47) + 1), lambda k: x[i - k + 1] * h[k + 1])))))", 3)}""",
)
def reverb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(audio.array_chain(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", lambda k, x: dsp.reverb(x, dsp.decaying_response(0.001, HZ), 0.3)), 3)


@query("white_noise")
def white_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(audio.array_chain(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", lambda k, x: dsp.white_noise(x, 20.0, dsp.generator(0, k))))


# samples come back as whole steps: cut towards zero at 32767 a unit, read at 32768
@query("pcm16_roundtrip", f"{E_SQL} {_energy('list_transform(x, lambda v: trunc(greatest(-1.0::FLOAT, least(1.0::FLOAT, v)) * 32767::FLOAT)::DOUBLE / 32768)')}")
def pcm16_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnloom.sources.wav import decode, encode

    return _stats(audio.array_chain(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", lambda k, x: decode(encode(x, HZ))[0]))


@query("sine_duration", f"WITH {U_SQL} SELECT clip_id, ord, dur_s FROM u")
def sine_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.format_string("clip%06d", "conv_id").alias("clip_id"), F.col("turn").cast("int").alias("ord"), audio.sine_duration(squeezed(F.col("text"))).alias("dur_s"))


@query("preset_pitch", "SELECT c_custkey, 110.0::DOUBLE + list_sum(list_transform(string_split(c_name, ''), lambda x: unicode(x))) % 200 AS hz FROM customer")
def pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", preset_pitch(F.col("c_name")).alias("hz"))
