"""The corpus pipeline, stage by stage, against brute force."""

import importlib
import random
import re

import numpy as np
import pytest

from tests.llm.test_dedup import brute_near, windows_gone
from tests.llm.test_models import LABELS
from turnloom.llm.packing import bucket_bounds
from turnloom.llm.rules import DecisionList

pipeline = importlib.import_module("corpus_pipeline")


@pytest.fixture(scope="module")
def sf(spark, table, tmp_path_factory):
    r = random.Random(21)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(2000)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    common, passage = say(8), say(40)
    rows = []
    for d in range(60):
        t = "\n".join([say(40), common if d % 3 == 0 else say(9), say(30), (say(20) + " " + passage + " " + say(20)) if d % 4 == 0 else say(30)])
        rows.append((d, t))
    rows += [(100, rows[3][1]), (101, rows[5][1] + " extra"), (102, "too short"), (103, "same same " * 60), (104, None)]
    d = tmp_path_factory.mktemp("tables")
    table(rows).write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([], LABELS).write.parquet(str(d / "labels.parquet"))
    return str(d), rows


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def brute(rows):
    kept = [(d, t) for d, t in rows if t and len(tokens(t)) >= 50 and d != 103]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    first = {}
    for d, t in kept:
        for x in t.split("\n"):
            first[key(x)] = min(d, first.get(key(x), d))
    kept = [(d, "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or first[key(x)] == d)) for d, t in kept]
    near = brute_near(kept)
    kept = [(d, t) for d, t in kept if near[d][0] == d]
    units = {d: tuple(tokens(t)) for d, t in kept}
    gone = windows_gone(units, 20)
    return {d: len(u) - sum(gone[d]) for d, u in units.items()}


def test_pipeline_matches_brute_force(spark, sf):
    path, rows = sf
    out = {r["doc_id"]: r for r in pipeline.run(spark, path).collect()}
    want = brute(rows)
    assert {d: r["n_tokens"] for d, r in out.items()} == want
    lengths, counts = np.unique([-(-n // 8) * 8 for n in want.values()], return_counts=True)
    bounds = bucket_bounds(lengths, counts)
    assert all(r["padded"] == min(b for b in bounds if b >= r["n_tokens"]) for r in out.values())
    assert any(want[d] < len(tokens(t)) for d, t in rows if d in want)


def test_stages_return_the_documents_columns(spark, sf):
    path, _ = sf
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "substring_dedup", "length_packing"]
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        for r in out.collect():
            assert r["text"] is None or r["n_chars"] == len(r["text"])


def test_awkward_documents_pass_all_stages(spark, sf, awkward):
    path, _ = sf
    docs = awkward
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, path)
        assert name == "length_packing" or docs.columns == awkward.columns
    assert {r["doc_id"] for r in docs.collect()} <= {3, 4, None}
    empty = awkward.limit(0)
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, path)
    assert empty.collect() == []
    assert DecisionList(()).rules == ()
