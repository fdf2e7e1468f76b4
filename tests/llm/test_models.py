"""Toxicity, quality scores, quality rules, BPE, GIF and packing."""

import hashlib
import itertools
import os
import random
import struct
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from turnloom.llm import docstats, rff, rules, toxicity
from turnloom.llm.bpe import Bpe, IdTable, decode, digests, encode, split_words
from turnloom.llm.common import held_out
from turnloom.llm.gif import Frame, GifError, digests as gif_digests, encode as gif_encode, encode_frames, frames_table, histogram, lzw_decode, lzw_encode, media_table, padded, parse, render
from turnloom.llm.packing import bucket_bounds, packed

LABELS = "doc_id long, quality int, toxic int"


# --- statistics and rules


def brute_stats(text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    lines = [x for x in text.split("\n") if any(c not in " \t\n\x0b\x0c\r" for c in x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)


def test_statistics_match_brute_force():
    r = random.Random(1)
    for _ in range(300):
        t = "".join(r.choice("ab é#$\n\t ") for _ in range(r.randint(0, 80)))
        assert docstats.doc_stats(t.encode())[:5] == brute_stats(t), t
    assert docstats.doc_stats(b"a b a b a b")[:5] == (6, 6, 0, 0, 6)


def labelled(n=400, seed=2):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(400)]
    rows, marks = [], []
    for d in range(n):
        w = [r.choice(words) for _ in range(r.randint(60, 160))]
        bad, toxic = r.random() < 0.25, r.random() < 0.2
        if bad:
            w = [x + r.choice(["###", "%%%"]) for x in w]
        if toxic:
            for _ in range(r.randint(2, 5)):
                w[r.randrange(len(w))] = r.choice(["grumbo", "grumbel", "grumbix", "idiot"])
        rows.append((d, " ".join(w) + "."))
        marks.append((d, int(not bad), int(toxic)))
    return rows, marks


@pytest.fixture(scope="module")
def learned(spark, table):
    rows, marks = labelled()
    return table(rows), spark.createDataFrame(marks, LABELS), {m[0]: m[1:] for m in marks}


def test_decision_list_rejects_what_labels_reject(spark, learned):
    docs, marks, truth = learned
    found = rules.fit_decision_list(docs, marks)
    assert found.rules
    out = {r["doc_id"]: r["kept"] for r in rules.judged(docs, found).collect()}
    wrong = sum(out[d] != bool(q) for d, (q, _) in truth.items())
    assert wrong < 0.03 * len(truth)
    x = {k: np.array([r[k] for r in rules.judged(docs, found).orderBy("doc_id").collect()], float) for k in (*docstats.BASE, *docstats.RATIOS)}
    assert [not b for b in found.rejects(x)] == [out[d] for d in sorted(out)]
    kept = rules.accepted(docs.withColumn("n_words", F.lit("clash")), found)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, k in out.items() if k)
    assert kept.columns[-1] == "n_words"


def test_covering_grows_and_prunes():
    r = np.random.default_rng(1)
    x = {"a": r.random(3000), "b": r.random(3000), "noise": r.random(3000)}
    bad = (x["a"] > 0.8) & (x["b"] < 0.3) | (x["a"] < 0.05)
    found = rules.learn(x, bad)
    assert (found.rejects(x) != bad).mean() < 0.02
    assert all(len(rule) <= 4 for rule in found.rules)
    assert rules.learn(x, np.zeros(3000, bool)).rules == ()


def test_base_rules_and_empty_lists(spark, table):
    none = rules.DecisionList(())
    out = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in rules.judged(table([(1, None), (2, "w " * 49), (3, " ".join(map(str, range(60)))), (4, "a b " * 40)]), none).collect()}
    assert out == {1: (True, False), 2: (True, False), 3: (False, True), 4: (True, False)}
    assert rules.fit_decision_list(table([]), spark.createDataFrame([], LABELS)) == none


# --- scores


def held(docs, modulus, rest):
    return {r[0] for r in docs.select("doc_id", held_out(F.col("doc_id"), modulus, rest).alias("h")).where("h").collect()}


def test_held_out_is_crc32_of_the_id(table):
    ids = range(200)
    assert held(table([(i, "x") for i in ids]), 4, 2) == {i for i in ids if zlib.crc32(str(i).encode()) % 4 == 2}


def test_toxicity_on_held_out_documents(learned):
    docs, marks, truth = learned
    model = toxicity.fit(docs, marks, ~held_out(F.col("doc_id"), 4, 2))
    out = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, model).collect()}
    test = held(docs, 4, 2)
    assert all(0 <= s <= 1 for s in out.values())
    assert sum((out[d] >= 0.3) != bool(truth[d][1]) for d in test) <= 0.05 * len(test)


def test_toxicity_arcs_come_from_training_rows_only(spark, table, learned):
    docs, marks, _ = learned
    out = held_out(F.col("doc_id"), 4, 2)
    other = marks.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, marks, ~out), toxicity.fit(docs, other, ~out)
    assert a.arcs == b.arcs and np.allclose(a.weights, b.weights)


def marked(text, table=toxicity.TABLE):
    """Marks of the clauses' insults and threats, what finds them aside."""
    g = toxicity.Grammar({"idiot ": 3.0, "grumb": 2.0}, table)
    return [m & ~(toxicity.MATCHED | toxicity.AIMED) for c in g.clauses(text) for _, m, _ in c]


def test_grammar_marks_insults_and_threats():
    n, r, t, again, threat = toxicity.NEGATED, toxicity.REPORTED, toxicity.TARGETED, toxicity.REPEATED, toxicity.THREATENED
    for text, want in {
        "an idiot here": [0],
        "not an idiot": [n],
        "not one two three idiot": [0],
        "the man said idiot": [r],
        "you are an idiot": [t],
        "you are a very big and fat idiot": [0],
        "an idiot is what you are": [t],
        "an idiot grumbles": [0, again],
        "they will kill you": [threat],
        "you will kill": [threat],
        "kill the old tree over there with you": [],
        "he told them kill you": [threat | r],
        "do not kill you": [threat | n],
        "idiotic plans. nothing else": [],
        "idiot. fine\nidiot! end": [0, 0],
    }.items():
        assert marked(text) == want, text
    g = toxicity.Grammar({"idiot ": 3.0, "grumb": 2.0})
    assert sum(x for c in g.clauses("grumbles and IDIOT. fine") for x, _, _ in c) == 5.0
    [[(_, _, y)]] = list(g.clauses("the man said you are not an idiot"))
    assert abs(y - 3.0 * 0.5 * 0.7 * 1.3) < 1e-12


@pytest.mark.parametrize("name, text", [("insult", "an idiot"), ("threat", "they will kill you"), ("target", "you idiot"), ("negation", "not an idiot"), ("reported", "she says idiot")])
def test_each_transducer_changes_the_score(name, text):
    silent = toxicity.compose(*(toxicity.Transducer({}) if k == name else p for k, p in toxicity.PARTS.items()))
    g, other = toxicity.Grammar({"idiot ": 3.0}), toxicity.Grammar({"idiot ": 3.0}, silent)
    assert g.features(text) != other.features(text)


def test_composed_table_is_the_transducers_side_by_side():
    r = random.Random(12)
    for _ in range(200):
        state, apart = 0, [0] * 5
        for _ in range(12):
            c = r.randrange(6)
            state, marks, weight = toxicity.TABLE[state][c]
            read = [p.read(s, c) for p, s in zip(toxicity.PARTS.values(), apart, strict=True)]
            apart = [s for s, _ in read]
            assert marks == sum(m for _, m in read)
            assert abs(weight - np.prod([w for m, w in toxicity.WEIGHTS.items() if marks & m])) < 1e-12


def test_models_without_labels(spark, table):
    docs, none = table([(1, "a b"), (2, None)]), spark.createDataFrame([], LABELS)
    assert len({r["score"] for r in toxicity.scored(docs, toxicity.fit(docs, none, F.lit(True))).collect()}) == 1
    assert {r["score"] for r in rff.scored(docs, rff.fit(docs, none, F.lit(True))).collect()} == {0.5}


def test_quality_on_held_out_documents(learned):
    docs, marks, truth = learned
    model = rff.fit(docs, marks, ~held_out(F.col("doc_id"), 3, 1))
    out = {r["doc_id"]: r["score"] for r in rff.scored(docs, model).collect()}
    test = held(docs, 3, 1)
    assert sum((out[d] >= 0.5) != bool(truth[d][0]) for d in test) <= 0.05 * len(test)


def test_features_approximate_the_kernel_and_sums_are_whole(spark):
    r = np.random.default_rng(4)
    z = r.standard_normal((40, 6))
    w, b = r.standard_normal((6, 20_000)), r.uniform(0, 2 * np.pi, 20_000)
    f = rff.fourier(z, w, b)[:, :-1]
    want = np.exp(-((z[:, None] - z[None]) ** 2).sum(-1) / 2)
    assert np.abs(f @ f.T - want).max() < 0.06


def test_isotonic_is_monotone():
    r = np.random.default_rng(5)
    raw = r.random(2000)
    y = (r.random(2000) < raw).astype(float)
    knots, shares = rff.isotonic(raw, y)
    assert (np.diff(knots) > 0).all() and (np.diff(shares) >= 0).all()
    assert np.abs(np.interp(raw, knots, shares) - raw).mean() < 0.06


# --- BPE


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return Bpe.load(path), Tokenizer.from_file(path)


ODD = ["", None, " \n", "Hello, wörld!! it's 12,5 é 😀 <|endoftext|> x<|startoftext|>y", "a\x1cb\x1d c", "é ́x İΣ ς　z​ w", "x" * 3000, "don't we've 'S 'LL", "tab\tnl\r\n\x0b\x85end", "ＡＢ １２ ² Ⅷ"]


@pytest.mark.parametrize("hot", [1 << 19, 2, 0])
def test_bpe_matches_the_library(table, tokenizer, hot):
    bpe, t = tokenizer
    r = random.Random(6)
    rows = [*enumerate(ODD), (90, "one two, three " * 9000), (91, None), (92, " ")]  # the first goes on over several batches + [(100 + i, " ".join("".join(r.choice("abcdé'.,19") for _ in range(r.randint(1, 9))) for _ in range(60))) for i in range(30)]
    rows += rows[3:5]
    want = {}
    for d, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[d] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    out = digests(table(rows), bpe, hot).collect()
    assert len(out) == len(rows) and all(tuple(x)[1:] == want[x["doc_id"]] for x in out)


def test_ids_decode_through_the_piece_table(table, tokenizer):
    bpe, t = tokenizer
    ids = encode(table(list(enumerate(ODD))), bpe)
    assert {r["doc_id"]: r["text"] for r in decode(ids, bpe).collect()} == {d: t.decode(t.encode(x or "", add_special_tokens=False).ids, skip_special_tokens=False) for d, x in enumerate(ODD)}


def test_decoded_digests_come_from_the_piece_table(table, tokenizer, monkeypatch):
    bpe, _ = tokenizer
    rows = [(1, "hello there"), (2, "")]
    before = {r["doc_id"]: r["decoded_sha256"] for r in digests(table(rows), bpe).collect()}
    pieces = bpe.pieces()
    monkeypatch.setattr(Bpe, "pieces", lambda self: [p + "?" for p in pieces])
    after = {r["doc_id"]: r["decoded_sha256"] for r in digests(table(rows), bpe).collect()}
    assert before[1] != after[1] and before[2] == after[2]


LEFT = """
import re
from pathlib import Path
from unittest import mock

import pyarrow as pa

from turnloom.llm import bpe


def mb():
    return sum(map(int, re.findall(r"Pss_(?:Anon|Shmem):\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


def batches(n):
    for i in range(n):
        own = [" ".join(f"word{i}x{j}x{k}" for k in range(20)) for j in range(5000)]
        yield pa.RecordBatch.from_arrays([pa.array([f"{t} {t}" for t in own])], ["text"])


with mock.patch.object(bpe, "F"):
    bpe.frequent_words(docs := mock.MagicMock())
run = docs.select().mapInArrow.call_args[0][0]
sum(b.num_rows for b in run(batches(1)))
before = mb()
assert sum(b.num_rows for b in run(batches(8))) == 800_000
print(mb() - before)
"""


def test_a_pass_gives_its_memory_back():
    """All of an executor's workers come to hold what a pass leaves. Measured in a process of its own."""
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", LEFT], cwd=top, capture_output=True, text=True, check=True, timeout=120).stdout
    assert float(out) < 25


def test_the_table_of_ids_is_that_of_its_words():
    """A column of ids read as it lies, slices and empty ones too, gives what its values do."""
    words = [np.arange(n, dtype="<u2").tobytes() for n in (2, 0, 1, 3)]
    for column, ids in ((pa.array(words), words), (pa.array(words)[1:3], words[1:3]), (pa.array([], pa.binary()), [])):
        got, want = IdTable.of_column(column, "<u2"), IdTable.of(ids, "<u2")
        at = np.arange(len(ids), dtype="<u4")
        assert got.size.tolist() == want.size.tolist() and got.ids(at).tolist() == want.ids(at).tolist()


def test_rare_and_frequent_words_match_the_library(table, tokenizer):
    """Texts of random words, of which few or none are given to all tasks."""
    bpe, t = tokenizer
    r = random.Random(6)
    rows = [(i, " ".join("".join(r.choice("abcdé'.,19\x1c\x1f") for _ in range(r.randint(1, 9))) for _ in range(60))) for i in range(30)]
    want = {d: t.encode(x, add_special_tokens=False).ids for d, x in rows}
    for hot in (1 << 19, 3, 0):
        assert {x["doc_id"]: x["ids"] for x in encode(table(rows), bpe, hot).collect()} == want


def test_a_tokenizer_with_a_decoder_is_refused(tmp_path):
    path = tmp_path / "t.json"
    path.write_text('{"decoder": {"type": "ByteLevel"}}')
    with pytest.raises(ValueError):
        Bpe.load(str(path))


def test_words_split_like_the_pattern():
    assert split_words("a\x1cb c d") == ["a\x1cb", "c", "d"] and split_words(" a  b ") == ["a", "b"]


# --- GIF


def test_code_streams_round_trip():
    r = random.Random(7)
    for size in (2, 4, 8):
        for n in (0, 1, 100, 20_000):
            x = bytes(r.randrange(1 << size) for _ in range(n))
            assert lzw_decode(lzw_encode(x, size), size, n) == x
    assert lzw_decode(lzw_encode(b"a" * 300_000), 8, 300_000) == b"a" * 300_000
    text = b"the theory of the thing " * 4000
    assert lzw_decode(lzw_encode(text), 8, len(text)) == text and len(lzw_encode(text)) < len(text) / 8
    with pytest.raises(GifError):
        lzw_decode(b"\xff\xff\xff", 8, 10)
    with pytest.raises(GifError):
        parse(b"PNG...........")


def test_known_stream():
    # a 10 x 10 picture in two colours, its stream written out by hand in the format's common examples
    data = bytes.fromhex("8C2D99872A1CDC33A00275EC95FAA8DE608C049101")
    assert lzw_decode(data, 2, 100)[:10] == bytes([1, 1, 1, 1, 1, 2, 2, 2, 2, 2])


def test_media_reads_back(table):
    rows = [(1, None), (2, "x"), (3, "é" * 40_000), (4, "abc" * 70_000)]
    out = {r["doc_id"]: r for r in gif_digests(media_table(table(rows))).collect()}
    for d, t in rows:
        p = padded((t or "").encode())
        assert len(p) % 64 == 0 and p
        r = out[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r["media_sha256"] == hashlib.sha256(gif_encode(p)).hexdigest()
    assert len(out[4]["frames"]) == 4
    for d, t in rows:
        p, canvas, seen = np.frombuffer(padded((t or "").encode()), np.uint8), None, []
        for i in range(0, len(p), 65_536):  # a short last frame leaves what was shown below it
            canvas = np.concatenate([p[i : i + 65_536], canvas[len(p) - i :] if canvas is not None else p[:0]])
            seen.append(np.bincount(canvas >> 4, minlength=16).tolist())
        assert all([f[c] for f in out[d]["frames"]] == seen for c in ("red", "green", "blue"))
        assert [f["start_ms"] for f in out[d]["frames"]] == [40 * i for i in range(len(out[d]["frames"]))]
        told = ";".join(f"{f['width']}x{f['height']}@{f['start_ms']}+{f['delay_ms']}:" + "/".join(",".join(map(str, f[c])) for c in ("red", "green", "blue")) for f in out[d]["frames"])
        assert out[d]["feature"] == told


def test_disposal_transparency_interlace(spark):
    pal = np.zeros((256, 3), np.uint8)
    pal[1], pal[2] = (255, 0, 0), (0, 0, 255)
    full = Frame(0, 0, 4, 4, b"\1" * 16, pal, 5, 1)
    dot = lambda disposal, clear=None: Frame(1, 1, 2, 2, b"\2\0\0\2", pal, 5, disposal, clear)
    for disposal, clear in itertools.product((1, 2, 3), (None, 0)):
        data = encode_frames(4, 4, [full, dot(disposal, clear), Frame(0, 0, 1, 1, b"\1", pal, 5)])
        w, h, _, frames = parse(data)
        a, b, c = (x.copy() for x in render(w, h, frames))
        assert (a[..., 0] == 255).all()
        assert tuple(b[1, 1]) == (0, 0, 255, 255) and tuple(b[1, 2]) == ((255, 0, 0, 255) if clear == 0 else (0, 0, 0, 255))
        assert tuple(c[1, 1]) == {1: (0, 0, 255, 255), 2: (0, 0, 0, 0), 3: (255, 0, 0, 255)}[disposal]
    rows = frames_table(spark.createDataFrame([(7, bytearray(data)), (8, None)], "doc_id long, media binary")).orderBy("frame").collect()
    assert [(r["frame"], r["start_ms"], r["delay_ms"]) for r in rows] == [(0, 0, 50), (1, 50, 50), (2, 100, 50)] and [sum(rows[0][c]) for c in ("red", "green", "blue")] == [16] * 3 and rows[0]["red"][15] == 16
    lines = bytes(range(8))
    order = [0, 4, 2, 6, 1, 3, 5, 7]
    stream = lzw_encode(bytes(lines[i] for i in order))
    inter = b"GIF87a" + struct.pack("<HHBBB", 1, 8, 0xF7, 0, 0) + bytes(768) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 8, 0x40) + b"\x08" + bytes([len(stream)]) + stream + b"\0\x3b"
    assert parse(inter)[3][0].indices == lines


# --- packing


def test_histograms_tell_colours_of_equal_brightness_apart():
    red, green = (np.array([[[r, g, 0, 255]] * 2], np.uint8) for r, g in ((200, 0), (0, 102)))
    assert (299 * 200) // 1000 // 16 == (587 * 102) // 1000 // 16
    assert histogram(red).sum() == histogram(green).sum() == 6 and (histogram(red) != histogram(green)).any()
    grey = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(16, 16, 4)
    grey[..., 3] = 255
    assert histogram(grey).tolist() == [[16] * 16] * 3
    grey[0, :, 3] = 0
    assert histogram(grey).sum() == 720


def test_bounds_have_the_least_padding():
    r = random.Random(8)
    for _ in range(40):
        n = r.randint(1, 9)
        lengths = np.array(sorted(r.sample(range(0, 200), n)), np.int64)
        counts = np.array([r.randint(1, 20) for _ in range(n)], np.int64)
        k = r.randint(1, 4)

        def cost(bounds):
            return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts, strict=True))

        got = bucket_bounds(lengths, counts, k)
        best = min(cost([*some, lengths[-1]]) for m in range(min(k, n)) for some in itertools.combinations(lengths[:-1].tolist(), m))
        assert len(got) <= k and got == sorted(got) and cost(got) == best


def test_batches_keep_the_budget(table):
    r = random.Random(9)
    rows = [(i, " ".join("w" * r.choice([3, 50, 400]))) for i in range(300)] + [(900, None), (901, ""), (None, "a b"), (5, "a")]
    out = packed(table(rows), buckets=3, budget=1000).collect()
    assert len(out) == len(rows)
    groups = {}
    for x in out:
        assert x["n_tokens"] <= x["padded"] or x["padded"] == 0
        groups.setdefault((x["bucket"], x["batch"]), []).append(x)
    for g in groups.values():
        assert sorted(x["slot"] for x in g) == list(range(len(g)))
        assert len(g) == 1 or len(g) * g[0]["padded"] <= 1000 or g[0]["padded"] == 0
    for b in {x["bucket"] for x in out}:
        sizes = [len(groups[k]) for k in sorted(groups) if k[0] == b]
        assert len(set(sizes[:-1])) <= 1
    assert packed(table([])).collect() == []


def test_numbers_run_through_all_parts(table, monkeypatch):
    from turnloom.llm import packing

    monkeypatch.setattr(packing, "PART", 3)
    rows = [(i if i % 4 else None, "w " * 5) for i in range(200)]
    out = packed(table(rows), budget=80).collect()
    assert sorted(x["batch"] * 10 + x["slot"] for x in out) == list(range(200))


@pytest.mark.parametrize("op", ["toxicity", "quality", "rules", "bpe", "gif", "packing"])
def test_awkward_rows(awkward, learned, tokenizer, op):
    docs, marks, _ = learned
    run = {
        "toxicity": lambda d: toxicity.scored(d, toxicity.fit(docs, marks, F.lit(True))),
        "quality": lambda d: rff.scored(d, rff.fit(docs, marks, F.lit(True))),
        "rules": lambda d: rules.judged(d, rules.fit_decision_list(docs, marks)),
        "bpe": lambda d: digests(d, tokenizer[0]),
        "gif": lambda d: gif_digests(media_table(d)),
        "packing": packed,
    }[op]
    out = run(awkward).collect()
    assert sorted(r["doc_id"] or 0 for r in out) == [0, 0, 1, 2, 3, 4, 4, 5, 6, 7, 8]
    twice = [tuple(r) for r in out if r["doc_id"] == 4]
    assert op == "packing" or twice[0] == twice[1]
    assert run(awkward.limit(0)).collect() == []
