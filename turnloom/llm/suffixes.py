"""Byte-level substring dedup by sorting suffixes, deep-shallow.

A corpus-wide suffix array would move every byte's suffix; but only windows of WIDTH bytes that occur twice matter, and equal windows
have the same minimizer: the place in them whose short hash is lowest. So:

1. each document's windows fall into runs with one minimizer; minimizers whose hash occurs once in the corpus are left out;
2. the remaining runs meet by their minimizer, equal ones from one task as a single row;
3. where runs meet, their windows' suffixes are sorted to WIDTH bytes: multikey quicksort, eight bytes a key, to a shallow depth,
   then blind tries order the groups that have a long common prefix. Windows that end in one leaf are copies; all but the earliest go.

Where more than LARGE runs share a minimizer they are split by the bytes around it: each run falls into parts of a few windows, which meet
again by all the bytes that these windows have in common, and are sorted there. The last split is into single windows, which meet by
all their bytes, so that however many there are, one of each is held.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from turnloom.functions.arrow import short
from turnloom.llm.common import arrow_types, only_texts, record, text_bytes
from turnloom.llm.repeats import ANCHORS, _spread, by_document, covered, local_anchors, merged, packed_texts, repeated_places, unpacked, with_gone

WIDTH = 100
#: Bytes of a minimizer's short window.
SHORT = 32
#: Depth at which the multikey sort hands over to blind tries.
SHALLOW = 32
#: Bytes of a document that are hashed at once.
PIECE = 1 << 22
#: Bytes of runs that a task holds before it settles them; windows that are sorted at once.
HELD_BYTES, BLOCK = 32 << 20, 200_000
#: Runs that are sorted together; where more meet they are split, into parts of so many windows.
LARGE, PARTS = 20_000, (8, 1)

RUNS = "h long, doc_id long, at int, n int, run binary"

_rng = np.random.default_rng(20_240_229)
_BYTE = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _rng.integers(0, 1 << 63, 8, np.uint64) * np.uint64(2) + np.uint64(1)


def short_hashes(data: np.ndarray, width: int = SHORT) -> np.ndarray:
    """A hash of each ``width`` (a power of two) bytes, by doubling."""
    h, k, i = _BYTE[data], 1, 0
    while k < width:
        left = h[:-k] * _STEP[i]
        left ^= left >> np.uint64(29)
        left += h[k:]
        h, k, i = left, 2 * k, i + 1
    h = h * _STEP[7]
    return h ^ (h >> np.uint64(32))


def runs(data: bytes, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run of windows with one minimizer: its hash, its place, the first window and how many there are."""
    parts = []
    for begin in range(0, max(0, len(data) - width + 1), PIECE):
        x = np.frombuffer(data, np.uint8, min(PIECE + width - 1, len(data) - begin), begin)
        h = short_hashes(x)
        # the lowest of the hash's upper 40 bits; of equal ones the last in the window, so that equal windows choose alike
        low = (h & np.uint64(0xFFFFFFFFFF000000)) | (np.uint64(0xFFFFFF) - np.arange(len(h), dtype=np.uint64))
        reach, k = width - SHORT + 1, 1
        while 2 * k <= reach:
            low = np.minimum(low[:-k], low[k:])
            k *= 2
        if k < reach:
            low = np.minimum(low[: len(low) - (reach - k)], low[reach - k :])
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        place = (np.uint64(0xFFFFFF) - (low[first] & np.uint64(0xFFFFFF))).astype(np.int64)
        parts.append((h[place], place + begin, first + begin, np.diff([*first, len(low)])))
    if not parts:
        return np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def blind_trie(strings: list[bytes]) -> list[list[int]]:
    """The order of strings of one length, equal ones together, by a trie that keeps branching bytes only.

    A string goes down by its bytes at the branching depths, blind to those between; the leaf it reaches shares the longest prefix that
    any string in the trie shares with it, and one comparison there tells whether it is equal or where it branches off.
    """
    root: list | tuple = [0]  # a leaf is a list of equal strings' numbers, an inner node a pair of depth and children by byte
    for i in range(1, len(strings)):
        s, node = strings[i], root
        while type(node) is tuple:
            depth, kids = node
            node = kids.get(s[depth]) or next(iter(kids.values()))
        t = strings[node[0]]
        if s == t:
            node.append(i)
            continue
        depth = _shared(s, t)
        parent, node = None, root
        while type(node) is tuple and node[0] < depth:
            parent, node = node, node[1][s[node[0]]]
        if type(node) is tuple and node[0] == depth:
            node[1][s[depth]] = [i]
        else:
            new = (depth, {s[depth]: [i], t[depth]: node})
            if parent is None:
                root = new
            else:
                parent[1][s[parent[0]]] = new
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if type(node) is list:
            out.append(node)
        else:
            todo += [node[1][k] for k in sorted(node[1], reverse=True)]
    return out


def _shared(s: bytes, t: bytes) -> int:
    """Length of the common prefix of two different strings of one length."""
    return len(s) - ((int.from_bytes(s) ^ int.from_bytes(t)).bit_length() + 7) // 8


def multikey(words, starts: np.ndarray, groups: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multikey quicksort of the suffixes at ``starts`` within their groups, eight bytes a key (``words(places)``), to ``depth`` bytes.

    All open segments are partitioned at once: by the median of three of a segment's keys into those below it, equal to it and above it; the
    equal ones go on eight bytes deeper, the others with another pivot. Returns the order, and where along it segments that are equal
    to ``depth`` begin, and their sizes.
    """
    order = np.argsort(groups, kind="stable")
    g = groups[order]
    edge = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.empty(0, np.int64)
    size = np.diff([*edge, len(g)])
    at, level = edge, np.zeros(len(edge), np.int64)
    done_at, done_size = [], []
    while len(at):
        many = size > 1
        deep = many & (level >= depth)
        done_at.append(at[deep])
        done_size.append(size[deep])
        live = many & ~deep
        at, size, level = at[live], size[live], level[live]
        if not len(at):
            break
        begin = np.cumsum(size) - size
        segment = np.repeat(np.arange(len(at)), size)
        place = np.arange(len(segment)) - begin[segment] + at[segment]
        key = words(starts[order[place]] + level[segment])
        three = np.sort(np.stack([key[begin], key[begin + size // 2], key[begin + size - 1]]), axis=0)
        pivot = three[1][segment]
        below, above = key < pivot, key > pivot
        moved = order[place]
        to, counts = np.empty(len(place), np.int64), []
        offset = at
        for part in (below, ~(below | above), above):
            run = np.cumsum(part)
            before = run[begin] - part[begin]
            n = run[begin + size - 1] - before
            to[part] = (run - 1 - before[segment])[part] + offset[segment][part]
            counts.append((offset, n))
            offset = offset + n
        order[to] = moved
        at, size = (np.concatenate(x) for x in zip(*counts, strict=True))
        level = np.concatenate([level, level + 8, level])
    return order, np.concatenate([*done_at, np.empty(0, np.int64)]).astype(np.int64), np.concatenate([*done_size, np.empty(0, np.int64)]).astype(np.int64)


def deep_shallow(data: bytes, starts: np.ndarray, groups: np.ndarray, width: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Within each group, the suffixes at ``starts`` sorted by their first ``width`` bytes (all inside ``data``).

    Returns the order and, along it, numbers that are equal exactly for neighbours with equal bytes in one group.
    """
    whole = np.frombuffer(data + bytes(8), np.uint8)
    eight = np.ndarray((len(data),), ">u8", whole.data, strides=(1,))
    order, first, size = multikey(lambda at: eight[at].astype(np.uint64), starts, groups, min(shallow, width) // 8 * 8)
    same = np.arange(len(starts))
    for f, k in zip(first.tolist(), size.tolist(), strict=True):
        moved = order[f : f + k].copy()
        p = f
        for leaf in blind_trie([data[a : a + width] for a in starts[moved].tolist()]):
            order[p : p + len(leaf)] = moved[leaf]
            same[p : p + len(leaf)] = p
            p += len(leaf)
    return order, same


def _settled_runs(held: list[tuple]):
    """RUNS of (key, two hashes of the run, document, place, windows, run): of equal ones the earliest goes on with its bytes, the others are gone."""
    types = arrow_types(RUNS)
    h, g1, g2, d, at, n, run = zip(*held, strict=True)
    h, g1, g2, d, at, n = np.array(h, np.uint64).view(np.int64), np.array(g1, np.uint64), np.array(g2, np.uint64), np.array(d, np.int64), np.array(at, np.int32), np.array(n, np.int32)
    order = np.lexsort((at, d, g2, g1, h))
    h, g1, g2, d, at, n = h[order], g1[order], g2[order], d[order], at[order], n[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1])])
    start = np.flatnonzero(new)
    size = np.diff([*start, len(h)])
    gone = (d != np.repeat(d[start], size)) | (at != np.repeat(at[start], size))
    run = [run[i] for i in order[new].tolist()]
    yield record({"h": pa.array(h[new]), "doc_id": pa.array(d[new]), "at": pa.array(at[new]), "n": pa.array(n[new]), "run": run}, types)
    if gone.any():
        yield _gone_runs(d[gone], at[gone], n[gone])


def _gone_runs(d: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """RUNS without bytes: ranges that are gone, keyed by document, so that a document's ranges meet and are joined further."""
    d, at, n = merged(np.asarray(d, np.int64), np.asarray(at, np.int32), np.asarray(n, np.int32))
    return record({"h": pa.array(_spread(d, np.zeros(len(d), np.int32))), "doc_id": pa.array(d), "at": pa.array(at), "n": pa.array(n), "run": pa.nulls(len(d), pa.binary())}, arrow_types(RUNS))


def _hashed(key: int, d: int, at: int, n: int, run: bytes) -> tuple:
    g = xxhash.xxh3_128_intdigest(run)
    return key, g & 0xFFFFFFFFFFFFFFFF, g >> 64, d, at, n, run


def _held_runs(rows, width: int):
    """RUNS from (doc_id, data, runs), those of this task settled as far as it holds them."""
    held, size = [], 0
    for d, data, (h, _, first, count) in rows:
        for x, f, c in zip(h.tolist(), first.tolist(), count.tolist(), strict=True):
            run = data[f : f + c - 1 + width]
            held.append(_hashed(x, d, f, c, run))
            size += len(run) + 100
            if size >= HELD_BYTES:
                yield from _settled_runs(held)
                held, size = [], 0
    if held:
        yield from _settled_runs(held)


def parts(run: bytes, n: int, width: int, windows: int):
    """The run's ``n`` windows in parts of ``windows``, cut by how far before the minimizer they start: (key, first window, how many).

    Equal windows start equally far before it and are in parts with one key, that of the bytes which all windows of a whole part have.
    """
    place = int(runs(run, width)[1][0])
    k = 0
    while k < n:
        part = (place - k) // windows
        last = min(n - 1, place - part * windows)
        begin = place - part * windows
        core = run[begin : begin + width - windows + 1] if begin < len(run) else b""
        yield xxhash.xxh3_64_intdigest(core, part), k, last - k + 1
        k = last + 1


def _sorted_runs(block: list[list[tuple]], width: int):
    """(doc_id, at, n) of the windows in the block's groups of runs (doc_id, at, n, run) that are equal to an earlier one."""
    pieces, docs, ats, counts, groups = [], [], [], [], []
    for i, g in enumerate(block):
        for d, at, n, run in g:
            pieces.append(run)
            docs.append(d)
            ats.append(at)
            counts.append(n)
            groups.append(i)
    counts = np.array(counts)
    data = b"".join(pieces)
    base = np.concatenate([[0], np.cumsum([len(x) for x in pieces])])[:-1]
    run = np.repeat(np.arange(len(pieces)), counts)
    inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    order, same = deep_shallow(data, base[run] + inner, np.array(groups)[run], width)
    doc, at = np.array(docs, np.int64)[run], np.array(ats, np.int64)[run] + inner
    by = np.lexsort((at[order], doc[order], same))
    member, label = order[by], same[by]
    new = np.concatenate([[True], label[1:] != label[:-1]])
    lead = np.repeat(member[new], np.diff([*np.flatnonzero(new), len(member)]))
    gone = np.zeros(len(run), bool)
    gone[member] = (doc[member] != doc[lead]) | (at[member] != at[lead])
    begin = gone & ~np.concatenate([[False], gone[:-1] & (run[1:] == run[:-1])])
    end = gone & ~np.concatenate([gone[1:] & (run[1:] == run[:-1]), [False]])
    b, e = np.flatnonzero(begin), np.flatnonzero(end)
    return doc[b], at[b], e - b + 1


def _met_runs(width: int, large: int | None, windows: int):
    """From RUNS sorted by key to RUNS: ranges that are gone, and of more than ``large`` runs with one key their parts, to meet again."""

    def run(batches):
        key, group, texts, over = None, [], {}, False
        block, size = [], 0
        gone: tuple[list, list, list] = ([], [], [])
        held: list[tuple] = []

        def split():
            nonlocal held
            for d, at, n, r in group:
                held += [_hashed(k, d, at + f, m, r[f : f + m - 1 + width]) for k, f, m in parts(r, n, width, windows)]

        for b in short(batches):
            for h, d, at, n, r in zip(*(b.column(k).to_pylist() for k in ("h", "doc_id", "at", "n", "run")), strict=True):
                if r is None:
                    for x, v in zip(gone, (d, at, n), strict=True):
                        x.append(v)
                    continue
                if h != key:
                    if over:
                        split()
                    elif len(group) > 1:
                        block.append(group)
                        size += sum(x[2] for x in group)
                    key, group, texts, over = h, [], {}, False
                    if size > BLOCK:
                        got = _sorted_runs(block, width)
                        block, size = [], 0
                        if len(got[0]):
                            yield _gone_runs(*got)
                first = texts.setdefault(r, (d, at))
                if first != (d, at):  # rows come in order of document and place, so the first of equal runs stays
                    for x, v in zip(gone, (d, at, n), strict=True):
                        x.append(v)
                    continue
                group.append((d, at, n, r))
                if large is not None and len(group) > large:
                    split()
                    group, texts, over = [], {}, True
            if len(gone[0]) > 10_000:
                yield _gone_runs(*gone)
                gone = ([], [], [])
            if len(held) > 100_000:
                yield from _settled_runs(held)
                held = []
        if over:
            split()
        elif len(group) > 1:
            block.append(group)
        if block and len((got := _sorted_runs(block, width))[0]):
            yield _gone_runs(*got)
        if gone[0]:
            yield _gone_runs(*gone)
        if held:
            yield from _settled_runs(held)

    return run


def gone_windows(docs: DataFrame, packed: DataFrame, width: int = WIDTH, large: int = LARGE) -> DataFrame:
    """(doc_id, at, n): ranges of window starts whose ``width`` bytes also start earlier. ``docs`` has doc_id (long, not null) and text, ``packed`` the same packed."""
    if width < 2 * SHORT:
        raise ValueError(f"windows need at least {2 * SHORT} bytes")

    def first(batches):
        def rows():
            for b in short(batches):
                for d, t in zip(b.column("doc_id").to_pylist(), text_bytes(b), strict=True):
                    if len(t) >= width:
                        h, place, _, _ = runs(t, width)
                        keep = np.concatenate([[True], place[1:] != place[:-1]])
                        yield d, h[keep], place[keep]

        yield from local_anchors(rows())

    def second(batches):
        def rows():
            for b in short(batches):
                for d, t, at in zip(b.column("doc_id").to_pylist(), unpacked(b), b.column("_tl_at").to_pylist(), strict=True):
                    if len(t) >= width:
                        got = runs(t, width)
                        keep = np.isin(got[1], np.array(at))
                        yield d, t, tuple(x[keep] for x in got)

        yield from _held_runs(rows(), width)

    places = by_document(repeated_places(docs.mapInArrow(first, ANCHORS)))
    met = packed.join(places, "doc_id").mapInArrow(second, RUNS)
    for many, windows in ((large, PARTS[0]), (large, PARTS[1]), (None, 0)):
        met = met.repartition("h").sortWithinPartitions("h", "doc_id", "at").mapInArrow(_met_runs(width, many, windows), RUNS)
    return met.where("run is null").select("doc_id", "at", "n")


def without_repeats(docs: DataFrame, extra: str = "kept binary", width: int = WIDTH, large: int = LARGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes (or their digest, with ``extra`` = "kept_sha256 string").

    Bytes are kept as they are: what stays of a text need not be whole characters. Null and empty texts have no bytes. Rows without an
    id lose nothing. doc_id names a text: repeated rows of one stand for one document and lose the same bytes. Other columns are not
    read; an empty table gives an empty one.
    """
    docs = only_texts(docs)
    known, other = docs.where("doc_id is not null"), packed_texts(docs.where("doc_id is null"), False)
    packed = packed_texts(known)
    gone = gone_windows(known, packed, width, large)
    name = extra.split()[0]
    schema = f"doc_id long, n_bytes long, n_removed long, n_spans long, {extra}"
    types = arrow_types(schema)

    def run(batches):
        for b in short(batches):
            out = []
            for t, at in zip(unpacked(b), b.column("_tl_at").to_pylist(), strict=True):
                removed, spans, kept = 0, 0, t
                if at:
                    mask = covered(len(t), at, width)
                    removed = int(mask.sum())
                    spans = int((mask & ~np.concatenate([[False], mask[:-1]])).sum())
                    kept = np.frombuffer(t, np.uint8)[~mask].tobytes()
                out.append((len(t), removed, spans, hashlib.sha256(kept).hexdigest() if name == "kept_sha256" else kept))
            n, m, s, kept = zip(*out, strict=True)
            yield record({"doc_id": b.column("doc_id"), "n_bytes": n, "n_removed": m, "n_spans": s, name: kept}, types)

    return with_gone(packed, other, gone).mapInArrow(run, schema)
