"""The engine's operators on small cases with known results."""

import json
import math
import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.config import AugmentSpec, BalancingConfig, GenerationConfig, MixingConfig, SplitRatios, from_mapping, load_config
from turnloom.functions import dsp, keyed
from turnloom.functions import text as T
from turnloom.operators import align, audio, balance, budget, counts, cpwer, der, schedule, sot, split, truncate, voices
from turnloom.operators.assignment import assign, best_mapping
from turnloom.plans.registry import ALIGNERS, AUGMENTERS, ENGINES, TEXT_SOURCES, Registry
from turnloom.schemas import WORDS

U = f"clip_id string, speaker_id string, start_s double, end_s double, text string, words {WORDS}, truncated boolean"


@pytest.fixture(scope="module")
def utt(spark):
    def make(*rows):
        return spark.createDataFrame([("c", s, float(a), float(b), t, [], False) for s, a, b, t in [(*r, "")[:4] for r in rows]], U)

    return make


@pytest.fixture(scope="module")
def value(spark):
    """The value of an expression over literals."""

    def get(column):
        return spark.range(1).select(column.alias("x")).first()[0]

    return get


def test_float_text_is_pythons(spark):
    r = random.Random(1)
    xs = [0.0, 1.0, -2.5, 1e-4, 1e-5, 123456789.0, 1e7, 1.5e15, 1e16, 1.25e17, 0.001, 1e22, float("inf"), float("nan")]
    xs += [r.uniform(-1, 1) * 10 ** r.randint(-8, 14) for _ in range(500)]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", T.float_text(F.col("x")).alias("t"))
    assert {row["i"]: row["t"] for row in got.collect()} == {i: repr(x) for i, x in enumerate(xs)}


def test_sentences(value):
    get = lambda s: value(T.sentences(F.lit(s)))
    assert get("Wait... really?! Yes.") == ["Wait...", "really?!", "Yes."]
    assert get("First.\n\nSecond.\t\tThird.") == ["First.", "Second.", "Third."]
    assert get(" \n ") == [] and get("no end") == ["no end"]
    assert get("A. B. C") == ["A.", "B.", "C"]


def test_markup(value):
    clean = value(T.clean_markup(F.lit("Intro[1] text.\n\n== Head ==\nMore[23]. End.")))
    assert "==" not in clean and "[" not in clean
    assert clean.split() == "Intro text. More. End.".split()


def test_tokens_and_prompts(value):
    assert value(T.vocabulary_form(F.lit("Don't!"))) == "DON'T" and value(T.vocabulary_form(F.lit("12"))) is None
    assert value(T.speaker_prompt(F.lit("hi"), F.lit("[S2]"))) == "[S2] hi" and value(T.speaker_prompt(F.lit("hi"))) == "[S1] hi"
    assert value(T.preset_pitch(F.lit("é"))) == 110 + 233 % 200 and value(T.preset_pitch(F.lit(None).cast("string"))) == 110


@pytest.mark.parametrize(("rows", "want"), [([("a", 0, 2), ("b", 1, 3), ("a", 4, 5)], (2, 2)), ([("a", 0, 1), ("b", 1, 2)], (2, 1)), ([("a", 1, 1)], (1, 0)), ([("a", 0, 5), ("a", 1, 2)], (1, 2))])
def test_counts(utt, rows, want):
    assert tuple(counts.speaker_counts(utt(*rows)).first())[1:] == want


def test_counts_of_silent_clips(spark, utt):
    out = counts.speaker_counts(utt(("a", 0, 1)), spark.createDataFrame([("c",), ("d",)], "clip_id string"))
    assert {r[0]: tuple(r)[1:] for r in out.collect()} == {"c": (1, 1), "d": (0, 0)}


def test_transcripts_round_trip(utt):
    u = utt(("B", 0.5, 2, "two"), ("A", 0, 1.5, "one -"), ("C", 0, 1, "x: <y> 1->2"), ("D", 0.123456789, 12.3456789, ""))
    s = sot.serialize(u)
    assert [x[1] for x in s.first()["sot"].split("\n") and [x for x in s.first()["sot"].split("\n")]] == ["C", "A", "D", "B"]
    back = sot.parse(s).orderBy("ord").collect()
    assert [(r["speaker_id"], r["start_s"], r["end_s"], r["text"], r["truncated"]) for r in back] == [("C", 0.0, 1.0, "x: <y> 1->2", False), ("A", 0.0, 1.5, "one -", True), ("D", 0.123456789, 12.3456789, "", False), ("B", 0.5, 2.0, "two", False)]


@pytest.mark.parametrize("row", [("A", -1, 2), ("A>B", 0, 1), ("A", 0, 1, "a\nb"), ("A", 0, 1, "a\u2028b")])
def test_invalid_utterances(utt, row):
    assert sot.invalid(utt(row)).count() == 1
    assert sot.serialize(utt(row, ("ok", 0, 1)), strict=False).first()["sot"] == "<ok> 0.0->1.0: "
    with pytest.raises(Exception, match="invalid utterance"):
        sot.serialize(utt(row)).collect()


def test_malformed_lines(spark):
    bad = spark.createDataFrame([("c", "not a valid line")], "clip_id string, sot string")
    with pytest.raises(Exception, match="malformed"):
        sot.parse(bad).collect()
    assert sot.parse(bad, strict=False).first()["speaker_id"] is None
    assert sot.parse(spark.createDataFrame([("c", "")], "clip_id string, sot string")).count() == 0


def lions():
    return F.array(*[F.struct(F.lit(t).alias("text"), F.lit(a).alias("start_s"), F.lit(b).alias("end_s")) for t, a, b in [("the", 0.0, 0.4), ("lions", 0.4, 0.9), ("are", 0.9, 1.2), ("hungry", 1.2, 1.8)]])


@pytest.mark.parametrize(("cut", "text", "dropped", "mid"), [(5.0, "the lions are hungry", False, False), (0.9, "the lions", True, False), (0.6, "the -", True, True), (0.2, "-", True, True)])
def test_truncation(value, cut, text, dropped, mid):
    r = value(truncate.truncated(lions(), F.lit(cut)))
    assert (r["text"], r["truncated"], r["mid_word"]) == (text, dropped, mid)


def test_placing(value):
    r = value(truncate.placed(F.lit(1.8), lions(), F.lit("t"), F.lit(10.0), F.lit(0.6)))
    assert (r["start_s"], r["end_s"], r["text"], r["truncated"]) == (10.0, 10.6, "the -", True)
    assert r["words"][0]["start_s"] == 10.0
    bare = value(truncate.placed(F.lit(2.0), F.array().cast(WORDS), F.lit("t"), F.lit(0.0), F.lit(2.0)))
    assert bare["text"] == "t" and bare["truncated"]


def test_alignment(value):
    w = value(align.proportional(F.lit("a bbb"), F.lit(2.0)))
    assert [(x["text"], x["start_s"], x["end_s"]) for x in w] == [("a", 0.0, 0.5), ("bbb", 0.5, 2.0)]
    with pytest.raises(Exception, match="blank"):
        value(align.proportional(F.lit("  "), F.lit(2.0)))
    seg = F.array(*[F.struct(F.lit(a).alias("start_s"), F.lit(b).alias("end_s")) for a, b in [(0.0, 0.6), (0.4, 5.0)]])
    c = value(align.clamped(F.array(F.lit("x"), F.lit("y")), seg, F.lit(1.0)))
    assert [(x["start_s"], x["end_s"]) for x in c] == [(0.0, 0.6), (0.6, 1.0)]
    assert value(align.even(F.lit(""), F.lit(0.0), F.lit(1.0))) == []


GRID = """File type = "ooTextFile"
item [1]:
    class = "IntervalTier"
    name = "words"
    intervals [1]:
        xmin = 0
        xmax = 0.2
        text = "sil"
    intervals [2]:
        xmin = 0.2
        xmax = 0.7
        text = "hello"
    intervals [3]:
        xmin = 0.7
        xmax = 1.2
        text = "world"
item [2]:
    name = "phones"
    intervals [1]:
        xmin = 0
        xmax = 1
        text = "HH"
"""


def test_textgrid(value):
    assert [(w["text"], w["start_s"], w["end_s"]) for w in value(align.textgrid_words(F.lit(GRID)))] == [("hello", 0.2, 0.7), ("world", 0.7, 1.2)]
    with pytest.raises(Exception, match="no words"):
        value(align.textgrid_words(F.lit(GRID), "missing"))


def test_splits_partition_ids(spark):
    ids = spark.range(500).select(F.concat(F.lit("id"), "id").alias("clip_id"))
    assert sum(r["clips"] for r in split.split_counts(ids).collect()) == 500
    assert split.split_counts(ids, SplitRatios(1.0, 0.0, 0.0)).collect()[0]["split"] == "train"
    with pytest.raises(ValueError, match="sum to 1"):
        SplitRatios(0.5, 0.5, 0.5)
    assert {r["part"] for r in split.held_out(ids).select("part").distinct().collect()} == {"train", "held_out"}


DER = [
    ([("A", 0, 5), ("B", 3, 8)], [("A", 0, 5), ("B", 3, 8)], (0, 0, 0, 10, 0)),
    ([("A", 0, 10)], [], (10, 0, 0, 10, 1)),
    ([("A", 0, 10)], [("A", 0, 10), ("B", 2, 5)], (0, 3, 0, 10, 0.3)),
    ([("A", 0, 5), ("C", 5, 10)], [("X", 0, 5), ("X", 5, 10)], (0, 0, 5, 10, 0.5)),
    ([], [("A", 0, 1)], (0, 1, 0, 0, math.inf)),
    ([("A", 1, 1)], [("B", 2, 2)], (0, 0, 0, 0, 0)),
]


@pytest.mark.parametrize(("ref", "hyp", "want"), DER)
def test_der(utt, ref, hyp, want):
    r = der.diarization_error_rate(utt(*ref), utt(*hyp)).first()
    assert tuple(r)[1:] == pytest.approx(want)


def test_der_against_brute_force(spark):
    from itertools import permutations

    r = random.Random(5)
    tables, want = ([], []), {}
    for c in range(25):
        sides = []
        for names in ("ABC", "WXYZ"):
            sides.append([(n := r.choice(names), s := r.randint(0, 20) / 2, s + r.randint(0, 8) / 2) for _ in range(r.randint(0, 7))])
        for t, s in zip(tables, sides, strict=True):
            t += [(f"c{c}", n, a, b, "", [], False) for n, a, b in s]
        ref, hyp = ([x for x in s if x[2] > x[1]] for s in sides)
        rs, hs = sorted({x[0] for x in ref}), sorted({x[0] for x in hyp})
        over = {(a, b): sum(max(0, min(x[2], y[2]) - max(x[1], y[1])) for x in ref if x[0] == a for y in hyp if y[0] == b) for a in rs for b in hs}
        keep = {k: v for k, v in over.items() if v > 0}
        best = max((sum(keep.get(p, 0) for p in zip(q, hs, strict=True)) for q in permutations(rs + [None] * len(hs), len(hs))), default=0)
        assert sum(keep.get((a, b), 0) for b, a in best_mapping(keep).items()) == pytest.approx(best)
        points = sorted({t for x in (*ref, *hyp) for t in x[1:]})
        miss = fa = 0.0
        for a, b in zip(points, points[1:], strict=False):
            n, m = ({x[0] for x in s if x[1] <= a and x[2] >= b} for s in (ref, hyp))
            miss, fa = miss + max(0, len(n) - len(m)) * (b - a), fa + max(0, len(m) - len(n)) * (b - a)
        if any(sides):
            want[f"c{c}"] = (miss, fa)
    a, b = (spark.createDataFrame(t, U) for t in tables)
    got = {x["clip_id"]: (x["miss_s"], x["false_alarm_s"]) for x in der.components(a, b).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_assignment_is_optimal_and_first():
    from itertools import permutations

    r = np.random.default_rng(3)
    for _ in range(60):
        n, m = r.integers(1, 5), r.integers(5, 7)
        cost = r.integers(0, 6, (n, m)).astype(float)
        want = min(permutations(range(m), int(n)), key=lambda p: (sum(cost[i, c] for i, c in enumerate(p)), p))
        assert assign(cost) == list(want)
    big = r.random((20, 20))
    assert sorted(assign(big)) == list(range(20))


A, B = ("A", 0, 3, "the cat sat"), ("B", 3, 5, "hello there")


@pytest.mark.parametrize(
    ("ref", "hyp", "want"),
    [
        ([A, B], [("X", 3, 5, "hello there"), ("Y", 0, 3, "the cat sat")], 0),
        ([A], [("X", 0, 3, "the dog sat")], 1 / 3),
        ([B], [B, ("Z", 0, 1, "a b c")], 3 / 2),
        ([A, B], [("X", 3, 5, "hello there")], 3 / 5),
        ([B], [B, ("P", 0, 1, "a"), ("Q", 0, 1, "b c"), ("R", 0, 1, "d e f")], 3),
        ([("A", 0, 1, "")], [("A", 0, 1, "")], 0),
        ([("A", 0, 1, "")], [("A", 0, 1, "x")], 1),
    ],
)
def test_cpwer(utt, ref, hyp, want):
    assert cpwer.cpwer(utt(*ref), utt(*hyp)).first()["cpwer"] == pytest.approx(want)


def test_tcpwer_needs_time(utt):
    late = utt(("A", 10, 13, "the cat sat"))
    assert cpwer.cpwer(utt(A), late).first()["cpwer"] == 0
    assert cpwer.tcpwer(utt(A), late).first()["tcpwer"] > 0
    assert cpwer.tcpwer(utt(A), utt(("A", 0.2, 3.2, "the cat sat")), 0.5).first()["tcpwer"] == 0


def test_edit_distance_against_plain_rows():
    r = random.Random(2)
    for _ in range(200):
        a, b = ([{"text": r.choice("abc"), "start_s": (s := r.random() * 3), "end_s": s + 0.5} for _ in range(r.randint(0, 8))] for _ in range(2))
        for collar in (None, 0.2):
            ok = lambda x, y, collar=collar: x["text"] == y["text"] and (collar is None or y["start_s"] <= x["end_s"] + collar and y["end_s"] >= x["start_s"] - collar)
            d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
            for i in range(1, len(a) + 1):
                for j in range(1, len(b) + 1):
                    d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (not ok(a[i - 1], b[j - 1])))
            assert cpwer.edit_distance(a, b, collar) == d[-1][-1]


@pytest.mark.parametrize(("collar", "want"), [(None, 20), (0.5, 180)])
def test_scoring_holds_no_words_as_python_objects(utt, monkeypatch, collar, want):
    """A batch's words take many times their bytes as dicts; one clip at a time stays near them."""
    import tracemalloc

    import pyarrow as pa

    both = utt(A)
    monkeypatch.setattr(type(both), "mapInArrow", lambda self, run, schema: run)
    run = cpwer.score(both, both, collar)
    # a fifteenth word of the first stream is another, and the second stream is too late for any of its 160 words to be met in time
    words = lambda late, odd: [{"text": "zzz" if odd and i % 15 == 0 else f"w{i}", "start_s": i + late, "end_s": i + late + 0.5} for i in range(300)]
    ref = [{"speaker_id": "A", "words": words(0.0, False)}, {"speaker_id": "B", "words": words(1000.0, False)[:160]}]
    hyp = [{"speaker_id": "X", "words": words(2000.0, False)[:160]}, {"speaker_id": "Y", "words": words(0.0, True)}]
    side = pa.list_(pa.struct([("speaker_id", pa.string()), ("words", pa.list_(pa.struct([("text", pa.string()), ("start_s", pa.float64()), ("end_s", pa.float64())])))]))
    one = pa.record_batch({"clip_id": ["c"], "r": pa.array([ref], side), "h": pa.array([hyp], side)})
    batch = pa.Table.from_batches([one] * 50).combine_chunks().to_batches()[0]
    tracemalloc.start()
    try:
        got = [x for b in run(iter([batch])) for x in b.to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [(x["errors"], x["n_ref_words"]) for x in got] == [(want, 460)] * 50
    assert peak < batch.nbytes, (peak, batch.nbytes)


def test_scoring_of_clips_one_side_lacks(spark, utt):
    other = utt(("X", 0, 1, "a b")).withColumn("clip_id", F.lit("d"))
    got = {r["clip_id"]: (r["errors"], r["n_ref_words"]) for r in cpwer.cpwer(utt(A, B), other).collect()}
    assert got == {"c": (5, 5), "d": (2, 0)}


def test_balance(spark):
    plan = balance.plan_clip_counts(spark, 5000, BalancingConfig({1: 1.0, 3: 1.0, 6: 2.0, 9: 0.0}))
    assert plan.where("max_simultaneous > total or total = 9").count() == 0
    rows = balance.realized_vs_target(plan, BalancingConfig({1: 1.0, 3: 1.0, 6: 2.0, 9: 0.0})).where("dimension = 'total'").collect()
    assert len(rows) == 4 and all(abs(r["target"] - r["realized"]) < 0.05 for r in rows)
    assert keyed.capped({2: 1.0}, 1) == {1: 1.0}
    with pytest.raises(ValueError):
        keyed.positive({1: 0.0})


def test_budgets(spark):
    b = budget.budgets(spark, ["light", "heavy", "off"], GenerationConfig(default_hours_per_engine=100.0, hours_per_engine={"heavy": 900.0, "off": 0.0}))
    assert {r["name"]: r["target_hours"] for r in b.collect()} == {"heavy": 900.0, "light": 100.0}
    state = spark.createDataFrame([("heavy", 900.0)], "name string, hours double")
    assert budget.pick_engine(b, state).first()["name"] == "light"
    assert not budget.is_complete(b, state).first()["complete"]
    done = spark.createDataFrame([("heavy", 900.0), ("light", 200.0)], "name string, hours double")
    assert budget.pick_engine(b, done).count() == 0 and budget.is_complete(b, done).first()["complete"]
    clips = spark.range(50).select(F.lit("e").alias("engine"), F.format_string("k%03d", "id").alias("clip_id"), F.lit(360.0).alias("duration_s"))
    t = spark.createDataFrame([("e", 1.0)], "name string, target_hours double")
    assert budget.within_budget(clips, t).count() == 10
    assert budget.within_budget(clips, t, spark.createDataFrame([("e", 0.45)], "name string, hours double"), stretch=F.substring("clip_id", 1, 3)).count() == 6


def fold(durations, draws, peak, c):
    slots = []
    end = lambda s: s[0] + (s[1] if s[2] is None else s[2])
    for d, u in zip(durations, draws, strict=True):
        if slots and peak > 1 and u[0] < c.overlap_probability:
            v = max(slots, key=lambda s: s[0])
            start = v[0] + u[1] * (end(v) - v[0])
            if sum(s[0] <= start < end(s) for s in slots) < peak:
                if u[2] >= c.uncut_probability:
                    cut = min(v[1], start - v[0] + c.min_truncation_s + u[3] * (c.max_truncation_s - c.min_truncation_s))
                    if v[2] is None or cut < v[2]:
                        v[2] = cut
                slots.append([start, d, None])
                continue
        slots.append([max(map(end, slots), default=0.0), d, None])
    return slots


def test_schedule_is_the_fold(spark):
    r = random.Random(8)
    rows = [(f"c{c}", i, r.uniform(0.3, 6)) for c in range(40) for i in range(r.randint(1, 12))]
    clips = spark.createDataFrame(rows, "clip_id string, ord int, duration_s double")
    peaks = spark.createDataFrame([(f"c{c}", 1 + c % 4) for c in range(40)], "clip_id string, peak int")
    got = schedule.schedule(clips, peaks, MixingConfig(), seed=3)
    draws = {(x["clip_id"], x["ord"]): tuple(x)[2:] for x in clips.select("clip_id", "ord", *[keyed.uniform(3, F.col("clip_id"), F.col("ord"), F.lit(k)) for k in schedule.DRAWS]).collect()}
    want = {}
    for c in range(40):
        own = [x for x in rows if x[0] == f"c{c}"]
        for (k, i, _), s in zip(own, fold([x[2] for x in own], [draws[x[:2]] for x in own], 1 + c % 4, MixingConfig()), strict=True):
            want[k, i] = tuple(s)
    assert {(x["clip_id"], x["ord"]): (x["offset_s"], x["duration_s"], x["cut_at_s"]) for x in got.collect()} == want
    ends = got.withColumn("end_s", F.col("offset_s") + truncate.kept_seconds(F.col("duration_s"), F.col("cut_at_s")))
    assert counts.peak_overlap(ends, "clip_id", "offset_s").join(peaks.withColumnRenamed("peak", "cap"), "clip_id").where("peak > cap").count() == 0


def test_voices(spark):
    bank = spark.createDataFrame([(f"s{i}", f"/v/s{i}/{j}.wav") for i in range(7) for j in range(3)], "speaker string, path string")
    clips = spark.createDataFrame([(f"c{i}", 1 + i % 7) for i in range(30)], "clip_id string, total int")
    out = voices.sample_speakers(clips, bank).groupBy("clip_id").agg(F.count("*").alias("n"), F.count_distinct("speaker_id").alias("d")).join(clips, "clip_id")
    assert out.where("n <> d or n <> total").count() == 0
    with pytest.raises(Exception, match="more speakers"):
        voices.sample_speakers(clips.withColumn("total", F.lit(8)), bank).collect()
    with pytest.raises(Exception, match="no reference clips"):
        voices.references(spark.createDataFrame([("zz",)], "speaker_id string"), bank, True).collect()
    with pytest.raises(ValueError, match="presets"):
        voices.references(bank, bank, False)


def test_every_choice_of_speakers_can_be_drawn(spark):
    clips = spark.createDataFrame([(f"c{i}", 3) for i in range(2_000)], "clip_id string, total int")

    def drawn(n):
        bank = spark.range(n).select(F.format_string("s%05d", "id").alias("speaker"))
        rows = voices.sample_speakers(clips, bank).groupBy("clip_id").agg(F.sort_array(F.collect_list(F.struct("ord", "speaker_id"))).alias("x")).collect()
        return [[int(x["speaker_id"][1:]) for x in r["x"]] for r in rows]

    small = [tuple(x) for x in drawn(7)]
    assert len(set(small)) == 7 * 6 * 5 and all(200 < sum(x[0] == k for x in small) < 380 for k in range(7))
    for n in (101, 521, 2_456):
        found = drawn(n)
        assert len(found) == 2_000 and all(len({*x}) == 3 for x in found)
        far = sum(min((a - b) % n, (b - a) % n) > n // 8 for a, b, _ in found)
        assert 1_400 < far < 1_600
        steps = sum((b - a) % n == (c - b) % n for a, b, c in found)
        assert steps < 60


def test_dsp():
    x = np.sin(np.arange(1600) / 7).astype(np.float32) * 0.5
    assert np.allclose(dsp.gain(x, 0.0), x) and dsp.gain(x, 40.0).max() == 1.0
    y = dsp.mix_at_snr(x * 0.1, dsp.generator(0, "k").standard_normal(1600).astype(np.float32), 10.0)
    assert 20 * math.log10(dsp.rms(x * 0.1) / dsp.rms(y - x * 0.1)) == pytest.approx(10.0, abs=0.1)
    assert np.array_equal(dsp.mix_at_snr(x, np.zeros(1600, np.float32), 10.0), x)
    h = dsp.decaying_response(0.01, 16_000)
    assert h.sum() == pytest.approx(1.0, abs=1e-4)
    assert np.allclose(dsp.reverb(x, h, 0.0), x) and np.allclose(dsp.convolve(x, h), np.convolve(x, h)[:1600], atol=1e-6)
    assert len(dsp.resample(x, 8000, 16000)) == 3200 and dsp.resample(x, 8000, 8000) is x
    assert len(dsp.fit_length(x, 5000, dsp.generator(0, "a"))) == 5000 and not dsp.fit_length(x[:0], 5, dsp.generator(0, "a")).any()
    with pytest.raises(ValueError):
        dsp.decaying_response(0.0, 16_000)
    with pytest.raises(ValueError):
        dsp.reverb(x, h, 1.5)


def test_chain_and_rendering(spark):
    rows = [("c", i, o, k, np.full(n, v, "<f4").tobytes(), 10) for i, (o, k, n, v) in enumerate([(0.0, 1.0, 10, 0.7), (0.5, 0.5, 10, 0.7)])]
    placed = spark.createDataFrame(rows, "clip_id string, ord int, offset_s double, kept_s double, pcm binary, sample_rate int")
    r = audio.rendered(placed).first()
    assert np.allclose(audio.samples(r["pcm"]), [0.7] * 5 + [1.0] * 5)
    with pytest.raises(Exception, match="sample rates"):
        audio.rendered(placed.withColumn("sample_rate", F.col("ord") + 10)).collect()
    chain = [AugmentSpec("gain", {"gain_db": -6.0}), AugmentSpec("white_noise", {"snr_db": 20.0})]
    one, two = (audio.augmented(placed, chain, 5).orderBy("ord").collect() for _ in range(2))
    assert [x["pcm"] for x in one] == [x["pcm"] for x in two] != [x["pcm"] for x in placed.orderBy("ord").collect()]
    assert audio.augmented(placed, []) is placed


def test_rendering_is_not_merged_into_one_task(spark):
    """Rows that were grouped by clip before are dealt anew: their exchange would be merged, as texts are small where audio is not."""
    turns = spark.range(60).select(F.concat(F.lit("c"), (F.col("id") % 20).cast("string")).alias("clip_id"), F.col("id").cast("int").alias("ord"))
    grouped = turns.groupBy("clip_id").agg(F.collect_list("ord").alias("o")).select("clip_id", F.explode("o").alias("ord"))
    placed = grouped.select("clip_id", "ord", (F.col("ord") / 60).alias("offset_s"), F.lit(0.25).alias("kept_s"), F.lit("hm").alias("text"), F.lit("S1").alias("preset"))
    rows = audio.rendered(placed).select("clip_id", F.spark_partition_id().alias("p")).collect()
    assert len(rows) == 20 and len({r["p"] for r in rows}) > 1


def test_spoken_pieces_are_the_whole_sine():
    """A sine in pieces, kept for texts at one pitch, is the sine made at once, bit for bit."""
    dsp._tone.cache_clear()
    for hz, k in ((110, 1), (233, 68), (233, 69), (150, 200), (233, 300)):
        n, step, turn = dsp.sine_length("x" * k), 256, 2 * np.pi * hz / 16_000
        a, b = turn * step * np.arange(-(-n // step))[:, None], turn * np.arange(step)
        assert np.array_equal(dsp.sine("x" * k, hz), (0.3 * (np.sin(a) * np.cos(b) + np.cos(a) * np.sin(b))).astype(np.float32).ravel()[:n])
    assert dsp._tone.cache_info().misses == 1 + 3 + 5


def test_rendered_sines_against_plain_sums(spark):
    rows = [("c", 0, 0.0, 0.2, "short", "S1"), ("c", 1, 0.1, 5.0, "x" * 70, "S2"), ("d", 0, 0.5, 9.0, "y" * 100, "S1")]
    placed = spark.createDataFrame(rows, "clip_id string, ord int, offset_s double, kept_s double, text string, preset string")
    hz = {r["preset"]: r["hz"] for r in placed.select("preset", T.preset_pitch(F.col("preset")).alias("hz")).collect()}
    want = {}
    for clip, _, o, k, text, preset in rows:
        x = dsp.sine(text, hz[preset])[: round(k * 16_000)]
        s, room = round(o * 16_000), max(round(k * 16_000), len(x))
        old = want.get(clip, np.zeros(0, np.float32))
        new = np.zeros(max(len(old), s + room), np.float32)
        new[: len(old)] += old
        new[s : s + len(x)] += x
        want[clip] = new
    got = {r["clip_id"]: (audio.samples(r["pcm"]), r["num_samples"]) for r in audio.rendered(placed).collect()}
    assert got.keys() == want.keys()
    assert all(n == len(want[c]) and np.array_equal(x, dsp.clip(want[c])) for c, (x, n) in got.items())


def write_wav(path, x, rate=16_000, channels=1, width=2):
    path.parent.mkdir(parents=True, exist_ok=True)
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes((np.asarray(x) * 32767).astype("<i2").tobytes() if width == 2 else bytes(len(x)))


def test_wavs(spark, tmp_path):
    from turnloom.sources import wav

    x = np.linspace(-1, 1, 800)
    write_wav(tmp_path / "a" / "x.wav", x)
    write_wav(tmp_path / "b" / "y.wav", np.repeat(x, 2), 8000, 2)
    (tmp_path / "c").mkdir()
    assert {r["speaker"] for r in wav.voice_bank(spark, str(tmp_path)).collect()} == {"a", "b"}
    got = {r["path"][-5:]: r for r in wav.read_wavs(spark, str(tmp_path), recursive=True).collect()}
    assert got["x.wav"]["sample_rate"] == 16_000 and got["y.wav"]["num_samples"] == 800
    assert np.abs(audio.samples(got["x.wav"]["pcm"]) - x).max() < 1e-3
    assert {r["num_samples"] for r in wav.reference_audio(spark, str(tmp_path)).collect()} == {800, 1600}
    write_wav(tmp_path / "d" / "z.wav", [0] * 10, width=1)
    with pytest.raises(Exception, match="16-bit"):
        wav.read_wavs(spark, str(tmp_path / "d")).collect()
    noise = AUGMENTERS.create("musan", corpus_dir=str(tmp_path / "a"), snr_db=10.0)
    assert len(noise(np.ones(50, np.float32), 16_000, dsp.generator(0, "k"))) == 50
    with pytest.raises(ValueError):
        AUGMENTERS.create("musan", corpus_dir=str(tmp_path / "c"))
    with pytest.raises(FileNotFoundError):
        AUGMENTERS.create("rir_file", corpus_dir=str(tmp_path / "c"))


def test_kaldi(spark, tmp_path):
    from turnloom.sources import kaldi

    (tmp_path / "wav.scp").write_text("rec /a/rec.wav\nunused /a/u.wav\n")
    (tmp_path / "segments").write_text("utt1 rec 0.0 2.0\n\nutt2 rec 1.0 3.0\n")
    (tmp_path / "text").write_text("utt1 hello world\nutt2\nutt1 hello again\n")
    (tmp_path / "utt2spk").write_text("utt1 A\nutt2 B\n")
    u = kaldi.load_libricss(spark, str(tmp_path))
    assert {(r["speaker_id"], r["text"], r["source"]) for r in u.collect()} == {("A", "hello again", "libricss"), ("B", "", "libricss")}
    assert tuple(counts.speaker_counts(u).first())[1:] == (2, 2)
    with pytest.warns(UserWarning, match="licence"):
        kaldi.load_ami(spark, str(tmp_path))
    (tmp_path / "utt2spk").write_text("utt1 A\n")
    with pytest.raises(Exception, match="no speaker"):
        kaldi.load_libricss(spark, str(tmp_path)).collect()
    (tmp_path / "segments").write_text("utt1 rec 0.0\n")
    with pytest.raises(Exception, match="four fields"):
        kaldi.load_libricss(spark, str(tmp_path)).collect()


def test_mixture_list(spark, tmp_path):
    from turnloom.sources import mixlist

    for n in ("a", "b"):
        write_wav(tmp_path / f"{n}.wav", np.full(32_000, 0.25))
    items = [{"speaker_id": n, "wav": f"{n}.wav", "text": n, "start_s": s} for n, s in (("a", 0.0), ("b", 1.0))]
    (tmp_path / "mix.jsonl").write_text(json.dumps({"utterances": items}) + "\n\n")
    u, sound = mixlist.load(spark, str(tmp_path / "mix.jsonl"))
    assert tuple(counts.speaker_counts(u).first())[1:] == (2, 2)
    r = sound.first()
    assert r["num_samples"] == 48_000 and np.allclose(audio.samples(r["pcm"])[20_000], 0.5, atol=1e-3)


def test_manifest(spark, tmp_path):
    from turnloom.sources import manifest

    clips = spark.range(40).select(F.format_string("clip%06d", "id").alias("clip_id"), F.lit("<A> 0.0->1.0: x").alias("transcript"), F.lit(1.0).alias("duration_s"), F.lit(1).alias("total"), F.lit(1).alias("max_simultaneous"), F.create_map(F.lit("source"), F.lit("t")).alias("metadata"))
    rows = manifest.manifest_rows(clips)
    for _ in range(2):
        manifest.write_manifest(rows, str(tmp_path))
    back = manifest.read_manifest(spark, str(tmp_path))
    assert back.count() == 40 and back.orderBy("clip_id").first() == rows.orderBy("clip_id").first()
    assert "PartitionFilters: [isnotnull(split" in split.training_rows(back)[0]._jdf.queryExecution().toString()
    assert manifest.read_manifest(spark, str(tmp_path / "none")).count() == 0


def test_text_sources(spark, tmp_path):
    from turnloom.sources import texts

    (tmp_path / "t.txt").write_text("One. Two!\nThree", encoding="utf-8")
    assert [r["sentence"] for r in texts.plain_file(spark, str(tmp_path / "t.txt")).orderBy("ord").collect()] == ["One.", "Two!", "Three"]
    answers = {"X": json.dumps({"query": {"pages": {"1": {"extract": "== H ==\nFact[1]. More."}}}}), "Y": "[]"}
    wiki = texts.wikipedia(spark, ["X", "Y"], lambda t: answers[t])
    assert [r["sentence"] for r in wiki.orderBy("ord").collect()] == ["Fact.", "More."]
    assert [r["sentence"] for r in texts.llm(spark, ["p"], lambda p: f"{p} a. b").orderBy("ord").collect()] == ["p a.", "b"]
    feed = texts.static(spark, ["a", "b", "c"])
    assert [r["sentence"] for r in texts.endless(spark.range(7).withColumnRenamed("id", "i"), feed).orderBy("i").collect()] == list("abcabca")
    assert texts.endless(spark.range(3).withColumnRenamed("id", "i"), feed.where("false")).count() == 0
    assert TEXT_SOURCES.available() == ["llm", "plain_file", "static", "wikipedia"]


def test_registry_and_engines(spark):
    from turnloom.plans import aligners, engines

    r = Registry("thing")
    r.register("a")(lambda n=1: n)
    with pytest.raises(ValueError):
        r.register("a")(lambda: 0)
    with pytest.raises(KeyError, match="there are a"):
        r.create("b")
    assert r.create("a", n=3) == 3
    assert len(ENGINES.available()) == 26 and AUGMENTERS.available() == ["gain", "musan", "reverb", "rir_file", "white_noise"]
    assert ALIGNERS.available() == ["ctc_segmentation", "mfa", "proportional"]
    assert len(ENGINES.create("sine").speak("a" * 10, preset="S1")) == 9600
    for name, args, error in [("sine", ("", None, "x"), ValueError), ("sine", ("x",), ValueError), ("bark", ("x", None, "p"), RuntimeError), ("xtts_v2", ("x", None, "p"), ValueError), ("kokoro", ("x", None, "nobody"), ValueError)]:
        with pytest.raises(error):
            ENGINES.create(name).speak(*args)
    own = ENGINES.create("bark", load=lambda: lambda t, r, p: (np.ones(240), 24_000))
    assert len(own.speak("x", preset="p")) == 160
    clips = spark.createDataFrame([("c", "one two", "S1")], "clip_id string, text string, preset string")
    spoken = engines.synthesized(clips, "sine").withColumn("duration_s", F.octet_length("pcm") / 4 / F.col("sample_rate"))
    ctc = ALIGNERS.create("ctc_segmentation", load=lambda: lambda x, rate, tokens: [(0.1 * i, 0.1 * i + 0.1) for i in range(len(tokens))])(spoken)
    assert [w["text"] for w in ctc.first()["words"]] == ["one", "two"]
    with pytest.raises(Exception, match="not installed"):
        ALIGNERS.create("mfa", binary="no-such-aligner")(spoken).collect()
    assert aligners


def config(tmp_path, **more):
    return {"seed": 1, "dataset": {"output_dir": str(tmp_path), "num_examples": 8, "unknown": 1, "text_options": {"sentences": ["Hello there.", "And who are you?", "Nobody."]}, "augment": [{"name": "gain", "options": {"gain_db": -3.0}}]}, "mixing": {"max_simultaneous_speakers": 3}} | more


def test_build(spark, tmp_path):
    from turnloom.plans.build import PipelineError, dataset, run_pipeline
    from turnloom.sources.manifest import read_manifest

    c = from_mapping(config(tmp_path))
    out = run_pipeline(spark, c)["build_dataset"]
    assert out["clips"] == 8
    rows = read_manifest(spark, str(tmp_path)).collect()
    assert len(rows) == 8 and all((tmp_path / r["audio_path"]).exists() for r in rows)
    assert all(r["speaker_count_max_simultaneous"] <= min(3, r["speaker_count_total"]) for r in rows)
    again = {r["clip_id"]: r["transcript"] for r in dataset(spark, c).manifest.collect()}
    assert again == {r["clip_id"]: r["transcript"] for r in rows}
    assert run_pipeline(None, c, dry_run=True) == {"build_dataset": "planned"}
    with pytest.raises(PipelineError):
        run_pipeline(spark, from_mapping({"stages": ["nope"]}))
    with pytest.raises(PipelineError):
        run_pipeline(spark, from_mapping({"stages": ["phase1"]}))


def test_build_speaks_every_sentence_in_turn(spark, tmp_path):
    from turnloom.plans.build import dataset, turns_before

    said = [f"Sentence{i} of many." for i in range(62)]
    c = config(tmp_path, mixing={"max_simultaneous_speakers": 1})
    c["dataset"] |= {"num_examples": 12, "text_options": {"sentences": said}}
    rows = dataset(spark, from_mapping(c)).utterances.orderBy("clip_id", "ord").collect()
    assert len(rows) > len(said)
    assert [r["text"] for r in rows] == [said[i % len(said)] for i in range(len(rows))]
    clips = spark.range(9_000).select(F.format_string("clip%06d", "id").alias("clip_id"), (1 + F.col("id") % 5).cast("int").alias("total"))
    assert turns_before(clips).where("before <> 3 * 5 * (bigint(substr(clip_id, 5)) div 5) + element_at(array(0, 1, 3, 6, 10), int(bigint(substr(clip_id, 5)) % 5) + 1)").count() == 0


def test_command_line(tmp_path, capsys):
    from turnloom.cli import main

    (tmp_path / "c.toml").write_text('seed = 3\nstages = ["build_dataset"]\n[dataset]\nnum_examples = 5\n[evaluate]\nmetrics = ["der"]\n')
    assert load_config(str(tmp_path / "c.toml")).evaluate.metrics == ("der",)
    assert main(["run", "--config", str(tmp_path / "c.toml"), "--dry-run"]) == 0
    assert json.loads(capsys.readouterr().out) == {"build_dataset": "planned"}
    assert main(["run", "--config", str(tmp_path / "none.toml")]) == 1


def test_training_stops_early(spark):
    from turnloom.plans.training import best_epoch, evaluate_test_split, run_phase1, run_phase2

    rows = spark.createDataFrame([(f"c{i}", s, "<A> 0.0->1.0: a b") for i, s in enumerate(["train", "val", "test"])], "clip_id string, split string, transcript string")
    texts = iter(["x y", "a b", "a b", "a b", "a b"])

    class Fake:
        saved: list[str] = []

        def predict(self, rows):
            return rows.select("clip_id", F.lit(0).alias("ord"), F.lit("A").alias("speaker_id"), F.lit(0.0).alias("start_s"), F.lit(1.0).alias("end_s"), F.lit(next(texts, "a b")).alias("text"))

        def save(self, name):
            self.saved.append(name)

    m = Fake()
    done = run_phase1(m, lambda rows: 0.5, m, rows, epochs=9, patience=2)
    assert [e.score for e in done.history] == [1.0, 0.0, 0.0, 0.0] and best_epoch(done.history).number == 2 and m.saved == ["epoch1", "epoch2"]
    assert (done.best_checkpoint, done.best_score, done.stopped_early) == ("epoch2", 0.0, True)
    assert not run_phase1(m, lambda rows: 0.5, m, rows, epochs=2).stopped_early
    assert evaluate_test_split(m, rows) == 0.0
    with pytest.raises(ValueError):
        run_phase1(m, lambda rows: 0.5, m, rows.where("split = 'train'"), epochs=1)
    real = spark.createDataFrame([(f"r{i}", "<A> 0.0->1.0: a b") for i in range(60)], "clip_id string, transcript string")
    m.saved.clear()
    done = run_phase2(m, lambda rows: 0.1, m, real, rows, epochs=2)
    assert (done.loss, done.held_out, done.synthetic, done.train_clips + done.held_out_clips, m.saved) == (0.1, 0.0, 0.0, 60, ["adapter"])


def test_streams(spark, tmp_path):
    from turnloom.streaming.budgets import admitted, hourly, sessions

    clips = spark.range(20).select(F.lit("e").alias("engine"), F.format_string("k%03d", "id").alias("clip_id"), F.lit(360.0).alias("duration_s"))
    clips.coalesce(1).write.parquet(str(tmp_path / "in"))

    def drain(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    stream = spark.readStream.schema(clips.schema).parquet(str(tmp_path / "in"))
    assert drain(admitted(stream, {"e": 1.0}), "admitted").count() == 10
    e = spark.createDataFrame([(1, "2024-01-01 00:00:00", "a", 1.0), (1, "2024-01-01 00:10:00", "a", 2.0), (1, "2024-01-01 05:00:00", "a", 4.0), (2, "2024-01-02 00:00:00", "a", 1.0)], "user_id long, t string, event_type string, value double").select("user_id", F.to_timestamp("t").alias("ts"), "event_type", "value")
    e.coalesce(1).write.parquet(str(tmp_path / "ev"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "ev"))
    assert {(r["user_id"], r["events"], r["value"]) for r in drain(sessions(s), "sess").collect()} == {(1, 2, 3.0), (1, 1, 4.0)}
    assert drain(hourly(s), "hours").count() == 2


def test_plans_have_no_cross_joins(spark, utt):
    plan = der.overlap_matrix(utt(A), utt(B))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_entry_points(spark):
    import __spark_entry__ as entry

    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 50
    assert entry.entry(spark).count() > 0


def test_arrow_batches_are_cut_by_rows_and_bytes():
    import pyarrow as pa

    from turnloom.functions.arrow import grown, short

    b = pa.RecordBatch.from_pydict({"t": ["x" * n for n in (3, 900, 0, 50, 50, 2000, 1)] + [None], "v": list(range(8)), "a": [[1.0]] * 8})
    parts = list(short([b, b.slice(0, 0)], rows=3, most=1000))
    assert [v for p in parts for v in p.column("v").to_pylist()] == list(range(8))
    assert [p.num_rows for p in parts] == [3, 2, 1, 2]
    made = []
    for p, out in grown(b, (made.append(n) or b"y" * n for n in (10, 10, 90, 5, 200, 0, 0, 1)), most=100):
        assert len(p) == len(out) and sum(map(len, out[:-1])) < 100
        assert len(made) <= p.column("v")[-1].as_py() + 2
    assert len(made) == 8


def test_default_weights_taper_after_four_speakers(spark):
    shares = {r["count"]: r["target"] for r in balance.realized_vs_target(balance.plan_clip_counts(spark, 50)).where("dimension = 'total'").collect()}
    assert max(shares, key=shares.get) == 4 and abs(shares[4] - 10 / 55) < 1e-12 and abs(shares[20] - 1 / 55) < 1e-12
    assert all(shares[k] >= shares[k + 1] for k in range(4, 20))


def test_stages_around_a_model(spark, tmp_path):
    from turnloom.plans.build import run_pipeline
    from turnloom.plans.models import ExampleStep, TranscriptModel, Trainable, always_target
    from turnloom.plans.registry import ENGINES, MODELS
    from turnloom.plans.engines import Engine

    def noisy():  # an engine that never says the same twice: what was kept is what everything is made of
        return lambda text, reference, preset: (np.random.default_rng().uniform(-0.1, 0.1, np.random.default_rng().integers(4000, 9000)).astype(np.float32), 16_000)

    ENGINES.register("noisy")(lambda: Engine("noisy", False, 16_000, noisy))
    seen, saved = [], []

    @MODELS.register("echo")
    def echo():
        step = ExampleStep(lambda x, rate, text: seen.append((len(x) / rate, text)) or 0.25, saved.append)
        return Trainable(TranscriptModel(lambda: lambda x, rate, mask: f"<S1> 0.0->{len(mask) * 0.02}: a b"), step, step)

    root = str(tmp_path / "set")
    own = {"model": "echo", "dataset_root": root, "synthetic_root": root, "epochs": 1}
    data = {"seed": 3, "stages": ["build_dataset", "phase1", "phase2", "evaluate"], "dataset": {"output_dir": root, "num_examples": 30, "text_options": {"sentences": ["One two.", "Three."]}, "engine_weights": {"noisy": 1.0}}, "phase1": own, "phase2": own, "evaluate": {"model": "echo", "dataset_root": root, "metrics": ["der", "cpwer", "tcpwer"]}}
    out = run_pipeline(spark, from_mapping(data))
    assert out["build_dataset"]["clips"] == 30 and out["phase1"]["history"][0]["loss"] == 0.25 and saved == ["epoch1", "adapter"]
    assert out["phase2"]["train_clips"] + out["phase2"]["held_out_clips"] == 30 and set(out["evaluate"]) == {"der", "cpwer", "tcpwer"}
    for seconds, text in seen:  # transcripts end where the audio ends
        ends = [float(line.split("->")[1].split(":")[0]) for line in text.split("\n")]
        assert abs(max(ends) - seconds) < 1e-3
    assert always_target(3).tolist() == [[0, 1, 0, 0]] * 3
    with pytest.raises(RuntimeError):
        TranscriptModel().predict(spark.createDataFrame([], "clip_id string, pcm binary, sample_rate int"))
