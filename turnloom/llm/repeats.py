"""Keys that occur more than once, found without gathering a frequent key's rows in one task.

Every task first settles what it can see alone: of the rows with one key it passes on a single one, so that a key which a third of all
rows hold reaches the shuffle once for each task. What is passed on is sorted by Spark, which spills, and read as a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions.arrow import short
from turnloom.llm.common import arrow_types, mix, record, text_bytes

#: Rows that a task holds before it settles them.
HELD_ROWS = 1_500_000

#: ``place`` is twice the start, and one more if it is sure that the key occurs again.
ANCHORS = "h long, doc_id long, place long"
PLACES = "doc_id long, at int"
#: ``place`` is the start in the upper half, and in the lower how many windows from there on are gone; none: one window waits to be compared.
WINDOWS = "h long, g int, doc_id long, place long"
RANGES = "doc_id long, at int, n int"


def _column(x, kind) -> pa.Array:
    return pa.array(np.ascontiguousarray(x), type=kind)


def _spread(d: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Keys for rows that are settled, so that they go to all tasks alike."""
    return mix(d.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64)).view(np.int64)


def merged(d: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges sorted by document and place, those that follow one another joined."""
    order = np.lexsort((at, d))
    d, at, n = d[order], at[order].astype(np.int64), n[order].astype(np.int64)
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (at[1:] != at[:-1] + n[:-1])]) if len(d) else np.empty(0, bool)
    first = np.flatnonzero(new)
    return d[first], at[first].astype(np.int32), (np.add.reduceat(n, first) if len(first) else n).astype(np.int32)


def settled_windows(d: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """WINDOWS of ranges that are gone, keyed by document, so that a document's ranges meet and are joined further."""
    d, at, n = merged(d, at, n)
    return record({"h": _column(_spread(d, np.zeros(len(d), np.int32)), pa.int64()), "g": _column(np.zeros(len(d), np.int32), pa.int32()), "doc_id": _column(d, pa.int64()), "place": _column((at.astype(np.int64) << 32) + n, pa.int64())}, arrow_types(WINDOWS))


def local_anchors(rows: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """ANCHORS from (doc_id, hashes, places): of each key seen twice here all places are sure, and one row of place -1 tells the others."""
    types = arrow_types(ANCHORS)

    def settled(docs, sizes, hs, ats):
        h, at = np.concatenate(hs).view(np.int64), np.concatenate(ats).astype(np.int32)
        d = np.repeat(np.array(docs, np.int64), sizes)
        order = np.argsort(h, kind="stable")
        key = h[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        single, told = np.empty(len(h), bool), np.empty(len(h), bool)
        single[order] = new & np.concatenate([new[1:], [True]])
        told[order] = new
        told &= ~single
        sure = ~single
        # rows stay in the order of documents and places, which packs better than that of hashes
        h = np.concatenate([h[single], h[told], _spread(d[sure], at[sure])])
        place = 2 * np.concatenate([at[single], np.full(told.sum(), -1, np.int32), at[sure]]).astype(np.int64)
        place[len(h) - sure.sum() :] += 1
        return record({"h": _column(h, pa.int64()), "doc_id": _column(np.concatenate([d[single], d[told], d[sure]]), pa.int64()), "place": _column(place, pa.int64())}, types)

    docs, sizes, hs, ats, held = [], [], [], [], 0
    for d, h, at in rows:
        docs.append(d)
        sizes.append(len(h))
        hs.append(h)
        ats.append(at)
        held += len(h)
        if held >= HELD_ROWS:
            yield settled(docs, sizes, hs, ats)
            docs, sizes, hs, ats, held = [], [], [], [], 0
    if held:
        yield settled(docs, sizes, hs, ats)


def repeated_places(anchors: DataFrame) -> DataFrame:
    """PLACES of all anchors whose key occurs at least twice."""
    types = arrow_types(PLACES)

    def run(batches):
        key, waits = None, None  # of the row before this batch: its key, and its place if it has found no partner yet
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            h, d, place = (b.column(k).to_numpy() for k in ("h", "doc_id", "place"))
            at, sure = (place >> 1).astype(np.int32), (place & 1).astype(bool)
            new = np.concatenate([[key is None or h[0] != key], h[1:] != h[:-1]])
            partner = ~new
            partner[:-1] |= ~new[1:]
            tells = at < 0
            keep = (partner | sure) & ~tells
            if waits is not None and not new[0]:
                yield record({"doc_id": [waits[0]], "at": [waits[1]]}, types)
            if keep.any():
                yield record({"doc_id": _column(d[keep], pa.int64()), "at": _column(at[keep], pa.int32())}, types)
            key, waits = h[-1], None if keep[-1] or tells[-1] else (int(d[-1]), int(at[-1]))

    # places of -1 come first in their key, so that whatever follows one finds a partner in it
    return anchors.repartition("h").sortWithinPartitions("h", "place").mapInArrow(run, PLACES)


def local_windows(rows: Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """WINDOWS from (doc_id, two hashes, places): of each key only the earliest place seen here goes on; the others are gone already."""
    types = arrow_types(WINDOWS)

    def settled(docs, sizes, hs, gs, ats):
        h, g, at = np.concatenate(hs).view(np.int64), (np.concatenate(gs) >> np.uint64(32)).astype(np.uint32).view(np.int32), np.concatenate(ats)
        d = np.repeat(np.array(docs, np.int64), sizes)
        order = np.lexsort((at, d, g, h))
        new = np.concatenate([[True], (h[order[1:]] != h[order[:-1]]) | (g[order[1:]] != g[order[:-1]])])
        start = np.flatnonzero(new)
        first = np.repeat(order[start], np.diff([*start, len(h)]))
        # repeated rows of one document stand for each other
        gone = order[(d[order] != d[first]) | (at[order] != at[first])]
        gone.sort()
        # rows stay in the order of documents and places here too
        waits = np.sort(order[start])
        yield record({"h": _column(h[waits], pa.int64()), "g": _column(g[waits], pa.int32()), "doc_id": _column(d[waits], pa.int64()), "place": _column(at[waits].astype(np.int64) << 32, pa.int64())}, types)
        if len(gone):
            yield settled_windows(d[gone], at[gone], np.ones(len(gone), np.int32))

    docs, sizes, hs, gs, ats, held = [], [], [], [], [], 0
    for d, h, g, at in rows:
        docs.append(d)
        sizes.append(len(h))
        hs.append(h)
        gs.append(g)
        ats.append(at)
        held += len(h)
        if held >= HELD_ROWS:
            yield from settled(docs, sizes, hs, gs, ats)
            docs, sizes, hs, gs, ats, held = [], [], [], [], [], 0
    if held:
        yield from settled(docs, sizes, hs, gs, ats)


def later_windows(windows: DataFrame) -> DataFrame:
    """RANGES of the windows whose key has an earlier place (smaller doc_id, or same document and earlier start)."""
    types = arrow_types(RANGES)

    def run(batches):
        first: tuple | None = None  # hashes and place of the first row of the key at hand
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            h, g, d, place = (b.column(k).to_numpy() for k in ("h", "g", "doc_id", "place"))
            at, length = (place >> 32).astype(np.int32), place & 0xFFFFFFFF
            gone = length > 0
            new = np.concatenate([[first is None or (h[0], g[0]) != first[:2]], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
            start = np.flatnonzero(new)
            lead = n if not len(start) else int(start[0])
            size = np.diff([*start, n]) if len(start) else np.zeros(0, np.int64)
            fd = np.concatenate([np.full(lead, first[2] if first else 0, np.int64), np.repeat(d[start], size)])
            fa = np.concatenate([np.full(lead, first[3] if first else 0, np.int64), np.repeat(at[start], size)])
            if len(start):
                k = start[-1]
                first = (h[k], g[k], d[k], at[k])
            out = gone | (d != fd) | (at != fa)
            if out.any():
                yield record(dict(zip(types, map(pa.array, merged(d[out], at[out], np.maximum(length[out], 1))), strict=True)), types)

    return windows.repartition("h", "g").sortWithinPartitions("h", "g", "doc_id", "place").mapInArrow(run, RANGES)


def by_document(places: DataFrame) -> DataFrame:
    """(doc_id, _tl_at): each document's places, or its ranges in one number each (see ``covered``); they are bounded by its length."""
    one = F.col("at").cast("long") + F.shiftleft(F.col("n").cast("long"), 32) if "n" in places.columns else F.col("at")
    return places.groupBy("doc_id").agg(F.collect_list(one).alias("_tl_at"))


def covered(size: int, ranges: list[int], width: int) -> np.ndarray:
    """Which of ``size`` units lie in one of the windows of ``width``; a range is its first window, and in the upper half how many there are."""
    ranges = np.array(ranges, np.int64)
    starts = ranges & 0xFFFFFFFF
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, np.minimum(starts, size), 1)
    np.add.at(edge, np.minimum(starts + (ranges >> 32) - 1 + width, size), -1)
    return np.cumsum(edge[:size]) > 0


def packed_texts(docs: DataFrame, named: bool = True) -> DataFrame:
    """(doc_id, text), with ids where ``named``, texts compressed: they go through an exchange whole.

    The last filter drops nothing; an inner join adds it to its side, and with it here both joins' sides are alike and share the exchange.
    """
    types = arrow_types("doc_id long, text binary")

    def run(batches):
        pack = zstandard.ZstdCompressor(3)
        for b in short(batches):
            yield record({"doc_id": b.column("doc_id"), "text": [pack.compress(t) for t in text_bytes(b)]}, types)

    out = docs.mapInArrow(run, "doc_id long, text binary")
    return out.where("doc_id is not null") if named else out


def unpacked(b: pa.RecordBatch) -> list[bytes]:
    return list(map(zstandard.decompress, b.column("text").to_pylist()))


def with_gone(known: DataFrame, other: DataFrame, gone: DataFrame) -> DataFrame:
    """(doc_id, text) of ``known`` with each document's ranges, and of ``other`` (rows without an id) with none.

    Joined as ``gone_windows`` joins them, ``known`` texts are dealt out once for both.
    """
    none = F.lit(None).cast("array<long>").alias("_tl_at")
    return known.join(by_document(gone), "doc_id", "left").select("doc_id", "text", "_tl_at").unionByName(other.select("doc_id", "text", none))
