"""Line dedup that can be undone: sharded cuckoo filters in front of exact reference-count tables.

A line's key is the line with ``[ \\t-\\r]`` stripped at both ends and A-Z lower-cased. An index is a log of written tables; a change appends to
it and rewrites nothing that it does not touch:

* postings (k1, k2, doc_id, gen): who holds which key, keys being 128-bit digests, gen the change that brought them;
* deletions (doc_id, gone): up to which change a document's postings are void;
* references (k1, k2, gen, n_docs, first_doc, last_doc): a key's newest row is its exact state, n_docs counting postings;
* filters (shard, gen, filter): a shard's newest row is a cuckoo filter that holds each of its keys that has postings exactly once.

``insert`` counts a batch's keys before anything meets in one place and asks each shard's filter which of them may be known. Only those
meet the references; all others are new for certain. Every new key goes into its filter, those that the filter mistook for others too,
so that taking a key out never takes out another's fingerprint. ``delete`` lowers the counts of what it touches.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions.arrow import short
from turnloom.llm.common import Scratch, arrow_types, record, rewritten, text_bytes
from turnloom.llm.cuckoo import CuckooFilter

SPACE = b" \t\n\x0b\x0c\r"
#: Keys of fewer code points are never dropped.
LEAST_POINTS = 10
#: Keys that one shard's filter is meant for.
SHARD_KEYS = 20_000
#: Batches in which ``indexed`` inserts a table.
BATCHES = 2
KEY = ["k1", "k2"]


def line_keys(text: bytes) -> list[bytes]:
    return [x.strip(SPACE) for x in text.lower().split(b"\n")]


def counts(key: bytes, least: int = LEAST_POINTS) -> bool:
    """Whether the key has at least ``least`` code points."""
    n = len(key)
    return n >= least and (n >= 4 * least or key.isascii() or len(key.decode("utf-8", "replace")) >= least)


def digest(key: bytes) -> bytes:
    return hashlib.md5(key, usedforsecurity=False).digest()


def postings(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2): each row's distinct keys that count. Rows without an id take no part."""
    schema = "doc_id long, k1 long, k2 long"
    types = arrow_types(schema)

    def run(batches):
        for b in short(batches):
            ids, sizes, keys = [], [], []
            for d, t in zip(b.column("doc_id").to_pylist(), text_bytes(b), strict=True):
                if d is not None and (own := {digest(k) for k in set(line_keys(t)) if counts(k)}):
                    ids.append(d)
                    sizes.append(len(own))
                    keys += own
            if keys:
                k = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
                yield record({"doc_id": pa.array(np.repeat(np.array(ids, np.int64), sizes)), "k1": pa.array(k[:, 0].copy()), "k2": pa.array(k[:, 1].copy())}, types)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, schema)


ASKED = "k1 long, k2 long, n_docs long, first_doc long, last_doc long, maybe boolean, shard long, filter binary"


def _asked(batch: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """For one shard: which of a batch's keys its filter may know, then a row with the filter that has the others too (empty: no room)."""
    if not len(batch):
        return pd.DataFrame(columns=["k1", "k2", "n_docs", "first_doc", "last_doc", "maybe", "shard", "filter"])
    filt = CuckooFilter.from_bytes(known["filter"].iloc[0]) if len(known) else None
    keys = batch["k1"].tolist()
    maybe = np.array([filt is not None and k in filt for k in keys], bool)
    fresh = [k for k, m in zip(keys, maybe, strict=True) if not m]
    if filt is None:
        filt = CuckooFilter.of(fresh)
    elif not all([filt.insert(k) for k in fresh]):
        filt = None
    shard = int(batch["shard"].iloc[0])
    last = {"k1": 0, "k2": 0, "n_docs": 0, "first_doc": 0, "last_doc": 0, "maybe": False, "shard": shard, "filter": filt.to_bytes() if filt is not None else b""}
    own = batch[["k1", "k2", "n_docs", "first_doc", "last_doc"]].assign(maybe=maybe, shard=shard, filter=None)
    return pd.concat([own, pd.DataFrame([last])], ignore_index=True)


def _newest(parts: tuple[DataFrame, ...], keys: list[str]) -> DataFrame:
    """Of each key the row with the highest ``gen``; rows of one part have different keys."""
    if len(parts) == 1:
        return parts[0]
    rows = reduce(DataFrame.unionByName, parts)
    rest = ["gen", *(c for c in rows.columns if c not in ("gen", *keys))]
    return rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_r")).select(*keys, "_r.*")


@dataclass(frozen=True)
class LineIndex:
    """The state after some insertions and deletions; every method returns a new one and leaves this one as it is."""

    spark: SparkSession
    #: 2 ** bits shards. They are doubled as keys grow; -1: the first insertion chooses.
    bits: int = -1
    gen: int = 0
    keys: int = 0
    postings: tuple[DataFrame, ...] = ()
    deletions: tuple[DataFrame, ...] = ()
    references: tuple[DataFrame, ...] = ()
    filters: tuple[DataFrame, ...] = ()

    @classmethod
    def empty(cls, spark: SparkSession, bits: int = -1) -> LineIndex:
        return cls(spark, bits)

    def _shard(self, k2: str = "k2"):
        return F.shiftrightunsigned(k2, 7).bitwiseAND(F.lit((1 << max(self.bits, 0)) - 1)).cast("long")

    def held(self) -> DataFrame:
        """(k1, k2, doc_id): postings that are not void."""
        rows = reduce(DataFrame.unionByName, self.postings)
        if not self.deletions:
            return rows.select(*KEY, "doc_id")
        void = reduce(DataFrame.unionByName, self.deletions).groupBy("doc_id").agg(F.max("gone").alias("gone"))
        return rows.join(void, "doc_id", "left").where("gone is null or gen > gone").select(*KEY, "doc_id")

    def state(self) -> DataFrame:
        """(k1, k2, n_docs, first_doc, last_doc) of each key that has postings."""
        return _newest(self.references, KEY).where("n_docs > 0").select(*KEY, "n_docs", "first_doc", "last_doc")

    def shard_filters(self) -> DataFrame:
        """(shard, filter) of each shard that has had keys."""
        if not self.filters:
            return self.spark.createDataFrame([], "shard long, filter binary")
        return _newest(self.filters, ["shard"]).select("shard", "filter")

    def insert(self, docs: DataFrame) -> LineIndex:
        """With the documents' lines. An id that is there already gets these lines beside those it has."""
        scratch = Scratch(self.spark)
        return self._inserted(scratch, scratch.keep(postings(docs).withColumn("gen", F.lit(self.gen + 1))))

    def _inserted(self, scratch: Scratch, new: DataFrame) -> LineIndex:
        """With the postings of the next change, which are written already."""
        gen = self.gen + 1
        out = replace(self, gen=gen, keys=self.keys + new.count(), postings=(*self.postings, new))._roomy(scratch)
        batch = new.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).withColumn("shard", out._shard())
        asked = scratch.keep(batch.groupBy("shard").cogroup(out.shard_filters().groupBy("shard")).applyInPandas(_asked, ASKED))
        row = [*KEY, F.lit(gen).alias("gen"), "n_docs", "first_doc", "last_doc"]
        fresh = asked.where("filter is null and not maybe").select(*row)
        got = asked.where("filter is not null").select("shard", "filter")
        if not self.references:
            return replace(out, references=(fresh,))._with_filters(scratch, got)  # rows of a written table, not written again
        a, o = asked.where("filter is null and maybe").alias("a"), self.state().alias("o")
        met = a.join(o, KEY, "left").select(*KEY, F.lit(gen).alias("gen"), (F.col("a.n_docs") + F.coalesce("o.n_docs", F.lit(0))).alias("n_docs"), F.least("a.first_doc", "o.first_doc").alias("first_doc"), F.greatest("a.last_doc", "o.last_doc").alias("last_doc"), F.col("o.n_docs").isNull().alias("mistaken"))
        met = scratch.keep(met)
        more = got.groupBy("shard").cogroup(met.where("mistaken").select(out._shard().alias("shard"), "k1").groupBy("shard")).applyInPandas(_with, "shard long, filter binary")
        return replace(out, references=(*self.references, fresh.unionByName(met.drop("mistaken"))))._with_filters(scratch, scratch.keep(more))

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Without the documents in ``doc_ids`` (doc_id): their keys' counts go down, first holders move on, unheld keys leave the filters."""
        if not self.postings:
            return self
        scratch, gen = Scratch(self.spark), self.gen + 1
        gone = scratch.keep(doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct())
        fewer = scratch.keep(self.held().join(gone, "doc_id", "left_semi").groupBy(*KEY).agg(F.count("*").alias("fewer")))
        rest = self.held().join(gone, "doc_id", "left_anti").join(fewer, KEY, "left_semi").groupBy(*KEY).agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
        old = self.state().select(*KEY, "n_docs")
        rows = scratch.keep(fewer.join(old, KEY).join(rest, KEY, "left").select(*KEY, F.lit(gen).alias("gen"), (F.col("n_docs") - F.col("fewer")).alias("n_docs"), "first_doc", "last_doc"))
        lost = rows.where("n_docs = 0").select(self._shard().alias("shard"), "k1")
        smaller = self.shard_filters().groupBy("shard").cogroup(lost.groupBy("shard")).applyInPandas(_without, "shard long, filter binary")
        out = replace(self, gen=gen, deletions=(*self.deletions, gone.withColumn("gone", F.lit(gen))), references=(*self.references, rows))
        return out._with_filters(scratch, scratch.keep(smaller))

    def _roomy(self, scratch: Scratch) -> LineIndex:
        """With as many shards as its keys need; filters of another number of shards are built again from the exact table."""
        bits = max(4, (self.keys // SHARD_KEYS).bit_length())
        if self.bits < 0 or not self.filters:
            return replace(self, bits=bits if self.bits < 0 else self.bits)
        if bits < self.bits + 2:
            return self
        out = replace(self, bits=bits)
        rebuilt = out.state().select(out._shard().alias("shard"), "k1").groupBy("shard").applyInPandas(_rebuilt, "shard long, filter binary")
        return replace(out, filters=(scratch.keep(rebuilt.withColumn("gen", F.lit(self.gen))),))

    def _with_filters(self, scratch: Scratch, got: DataFrame) -> LineIndex:
        """With the shards' filters in ``got``, written already; those that had no room are built again from the exact table."""
        full = got.where(F.length("filter") == 0).select("shard")
        rebuilt = self.state().select(self._shard().alias("shard"), "k1").join(full, "shard", "left_semi").groupBy("shard").applyInPandas(_rebuilt, "shard long, filter binary")
        part = got.where(F.length("filter") > 0) if full.isEmpty() else scratch.keep(got.where(F.length("filter") > 0).unionByName(rebuilt))
        return replace(self, filters=(*self.filters, part.withColumn("gen", F.lit(self.gen))))

    def drops(self) -> DataFrame:
        """(doc_id, keys): the repeated keys that each document loses, all but its first holder's. A document's keys are bounded by its lines."""
        none = self.spark.createDataFrame([], "doc_id long, k1 long, k2 long, first_doc long")
        repeated = self.state().where("first_doc < last_doc").select(*KEY, "first_doc") if self.references else none.drop("doc_id")
        # nothing between the join and the exchange by document needs a key's rows together, so a frequent key's partition can be split
        held = self.held() if self.postings else none.drop("first_doc")
        lost = held.join(repeated, KEY).where("doc_id > first_doc").groupBy("doc_id").agg(F.collect_set(F.struct("k1", "k2")).alias("k"))
        return lost.select("doc_id", F.col("k.k1").alias("_tl_k1"), F.col("k.k2").alias("_tl_k2"))


def indexed(docs: DataFrame, batches: int = BATCHES) -> LineIndex:
    """An index of all rows of ``docs``, inserted in so many batches dealt by id, the later ones asking the filters that the earlier ones left.

    The texts are read once; one table holds the postings of all batches.
    """
    scratch, out = Scratch(docs.sparkSession), LineIndex.empty(docs.sparkSession)
    dealt = (F.pmod(F.xxhash64("doc_id"), F.lit(batches)) + 1).cast("int")
    new = scratch.keep(postings(docs).withColumn("gen", dealt))
    for i in range(batches):
        out = out._inserted(scratch, new.where(F.col("gen") == i + 1))
    return replace(out, postings=(new,))


def _rebuilt(batch: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([{"shard": int(batch["shard"].iloc[0]), "filter": CuckooFilter.of(batch["k1"].tolist()).to_bytes()}])


def _with(known: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter with further keys; empty if it has no room or had none."""
    if not len(known):
        return pd.DataFrame(columns=["shard", "filter"])
    data = known["filter"].iloc[0]
    if len(data) and len(more):
        f = CuckooFilter.from_bytes(data)
        data = f.to_bytes() if all([f.insert(k) for k in more["k1"].tolist()]) else b""
    return pd.DataFrame([{"shard": int(known["shard"].iloc[0]), "filter": data}])


def _without(known: pd.DataFrame, lost: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter without the lost keys; no row for a shard that lost none."""
    if not len(known) or not len(lost):
        return pd.DataFrame(columns=["shard", "filter"])
    f = CuckooFilter.from_bytes(known["filter"].iloc[0])
    for k in lost["k1"].tolist():
        f.delete(k)
    return pd.DataFrame([{"shard": int(known["shard"].iloc[0]), "filter": f.to_bytes()}])


def without_lines(text: bytes, keys: set[bytes]) -> tuple[int, int, bytes]:
    """Lines before, lines dropped, and what stays."""
    lines = text.split(b"\n")
    if not keys:
        return len(lines), 0, text
    kept = [x for x, k in zip(lines, line_keys(text), strict=True) if not (counts(k) and digest(k) in keys)]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def dropped(docs: DataFrame, index: LineIndex, extra: str = "kept string") -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept text (or its digest, with ``extra`` = "kept_sha256 string").

    Null and empty texts have one empty line. Rows without an id lose nothing. Repeated rows of one id count as one document and keep
    what it keeps. Other columns are not read; an empty table gives an empty one.
    """
    name = extra.split()[0]
    schema = f"doc_id long, n_lines long, n_dropped long, {extra}"
    types = arrow_types(schema)

    def run(batches):
        for b in short(batches):
            out = []
            for t, k1, k2 in zip(text_bytes(b), b.column("_tl_k1").to_pylist(), b.column("_tl_k2").to_pylist(), strict=True):
                own = {x.to_bytes(8, "little", signed=True) + y.to_bytes(8, "little", signed=True) for x, y in zip(k1 or (), k2 or (), strict=True)}
                n, m, kept = without_lines(t, own)
                out.append((n, m, hashlib.sha256(kept).hexdigest() if name == "kept_sha256" else kept.decode("utf-8", "replace")))
            n, m, kept = zip(*out, strict=True)
            yield record({"doc_id": b.column("doc_id"), "n_lines": n, "n_dropped": m, name: kept}, types)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").join(index.drops(), "doc_id", "left").mapInArrow(run, schema)


def lines_removed(docs: DataFrame, index: LineIndex) -> DataFrame:
    """``docs`` with all its columns, the texts without the lines that ``dropped`` counts."""
    def change(text: bytes, k1: list[int], k2: list[int]) -> bytes:
        return without_lines(text, {x.to_bytes(8, "little", signed=True) + y.to_bytes(8, "little", signed=True) for x, y in zip(k1, k2, strict=True)})[2]

    return rewritten(docs, index.drops(), change)
