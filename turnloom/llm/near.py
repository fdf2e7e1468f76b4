"""Near-duplicate join on word n-grams: a MinHash LSH forest finds candidates, exact Jaccard similarity decides.

Texts are sets of shingles of GRAM words (a text with fewer words is one shingle; one with none has no set). Documents with equal sets are
one node in all this, with their number as its weight.

The forest has TREES prefix tries. A text's label in a tree is a sequence of DEPTH minimum hashes (one-permutation hashing, empty bins filled
from others); a trie is the sorted sequence of its labels, and a subtrie is what shares a prefix. The matched prefix starts as long as
the label and is shortened until the measured recall reaches RECALL: of the links seen so far whose similarity is next to the threshold,
those that share a prefix in one tree alone and those that do so in two tell how many share none (capture and recapture). Lengths
are chosen by size of set. FLOOR, where links at the threshold itself have that recall whatever is measured, is the shortest.

Texts that share a prefix are tied to a component; inside it all pairs of similar size are compared exactly, in blocks of shingle sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions.arrow import short
from turnloom.llm.common import Scratch, arrow_types, mix, record, text_bytes, window_hash
from turnloom.llm.components import components
from turnloom.llm.substrings import WordHashes

GRAM, THRESHOLD = 5, 0.8
TREES, DEPTH = 24, 8
#: Least share of the links that are to meet.
RECALL = 0.9999
#: How far above the threshold links count as next to it.
NEXT = 0.1
#: Texts, and shingles, of one side of a block.
BLOCK, BLOCK_GRAMS = 1024, 1 << 21
#: Texts whose prefixes a task settles at once.
HELD = 50_000


def floor_length(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The longest prefix at which two texts at the threshold share one in some tree with the wanted chance."""
    d = DEPTH
    while d > 1 and 1 - (1 - threshold**d) ** TREES < recall:
        d -= 1
    return d


def shingles(hashes: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """The sorted set of n-gram hashes of a text's words."""
    if not len(hashes):
        return hashes
    return np.unique(window_hash(hashes, min(gram, len(hashes)), 0xC2B2AE3D27D4EB4F))


_BINS = TREES * DEPTH
#: Where an empty bin looks, in order: a walk of its own for each bin.
_WALK = np.argsort(mix(np.arange(_BINS * _BINS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)).reshape(_BINS, _BINS), axis=1)


def signature(grams: np.ndarray) -> np.ndarray:
    """TREES labels of DEPTH values: each bin's lowest hash, an empty bin's from the first full one on its walk."""
    h = np.sort(mix(grams))
    at = ((h >> np.uint64(32)) * np.uint64(_BINS) >> np.uint64(32)).astype(np.int64)  # rises with the hash, so a bin's first is its lowest
    first = np.concatenate([[True], at[1:] != at[:-1]])
    low, empty = np.zeros(_BINS, np.uint64), np.ones(_BINS, bool)
    low[at[first]] = mix(h[first])
    empty[at[first]] = False
    wants = np.flatnonzero(empty)
    for step in range(8):
        if not len(wants):
            break
        source = _WALK[wants, step]
        found = ~empty[source]
        low[wants[found]] = low[source[found]]
        wants = wants[~found]
    if len(wants):
        walk = _WALK[wants]
        low[wants] = low[walk[np.arange(len(wants)), (~empty[walk]).argmax(1)]]
    return (low >> np.uint64(48)).astype(np.uint16).reshape(TREES, DEPTH)


def prefix_keys(labels: np.ndarray, length: int) -> np.ndarray:
    """One key for each tree's prefix of ``length``, of labels (..., TREES, DEPTH)."""
    key = np.arange(TREES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(length)
    for k in range(length):
        key = mix(key ^ labels[..., k].astype(np.uint64)) + np.uint64(k)
    return key


def matched(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of two texts' labels in each tree; the last axis is dropped."""
    same = a == b
    return np.where(same.all(-1), DEPTH, same.argmin(-1))


def size_class(n: np.ndarray, threshold: float) -> np.ndarray:
    """Sets of one class, or of neighbouring ones, are the only ones that can be similar."""
    return np.floor(np.log(n) / -math.log(threshold)).astype(np.int64)


def chosen_lengths(seen: dict[int, dict[int, tuple[int, int, int]]], floor: int, recall: float = RECALL) -> dict[int, int]:
    """For each size class the longest prefix whose measured recall is enough, else ``floor``.

    ``seen[class][length]`` has the links next to the threshold that share such a prefix in any tree, in one alone, and in two. The number
    that share none is taken as (one + 1)^2 / (2 (two + 1)): few links never vouch for a long prefix.
    """
    out = {}
    for c, by in seen.items():
        out[c] = floor
        for d in range(DEPTH, floor, -1):
            any_, one, two = by.get(d, (0, 0, 0))
            if any_ and 1 - (one + 1) ** 2 / (2 * (two + 1)) / any_ >= recall:
                out[c] = d
                break
    return out


SHAPES = "doc_id long, mark binary, shape binary, n_grams int, labels binary"
NODES = "key long, node long, partner long"


def _shapes(gram: int):
    """From (doc_id, mark, text): each row's set in 128 bits; its size and labels with the first of equal ones in the task's stretch."""
    types = arrow_types(SHAPES)

    def run(batches):
        words, seen = WordHashes(), {}
        for b in short(batches):
            out = []
            for m, t in zip(b.column("mark").to_pylist(), text_bytes(b), strict=True):
                if m in seen:
                    out.append((seen[m], None, None))
                    continue
                g = shingles(words.of(t.split())[0], gram)
                shape = xxhash.xxh3_128_digest(g.tobytes() if len(g) else t, 1 if len(g) else 2)
                seen[m] = shape
                out.append((shape, len(g), signature(g).tobytes() if len(g) else None))
            if len(seen) > HELD:
                seen.clear()
            shape, n, labels = zip(*out, strict=True)
            yield record({"doc_id": b.column("doc_id"), "mark": b.column("mark"), "shape": shape, "n_grams": n, "labels": labels}, types)

    return run


def rooted(key: np.ndarray, at: np.ndarray, node: np.ndarray) -> np.ndarray:
    """For each of the nodes the place of the lowest one that it is connected to, where row i says that the node at ``at[i]`` has ``key[i]``."""
    order = np.argsort(node, kind="stable")
    rank = np.empty(len(node), np.int64)
    rank[order] = np.arange(len(node))
    shared = (np.bincount(key) > 1)[key]
    key, at, root = key[shared], at[shared], rank.copy()
    while True:
        low = np.full(key.max(initial=0) + 1, len(node))
        np.minimum.at(low, key, root[at])
        after = root.copy()
        np.minimum.at(after, at, low[key])
        after = np.minimum(after, after[order][after])
        if np.array_equal(after, root):
            return order[root]
        root = after


def _nodes(lengths: dict[int, int], floor: int, threshold: float):
    """From (node, n_grams, labels): each prefix in this task with one node, and for nodes that share prefixes here the one they go by.

    What a task holds of a large group goes on as a single node for each prefix, and each of its members with a single tie.
    A text has a key for the length of its own class and of the neighbouring ones, so that any two that can be similar share one.
    """
    types = arrow_types(NODES)

    def settled(nodes, sizes, labels):
        node = np.array(nodes, np.int64)
        trie = np.frombuffer(b"".join(labels), np.uint16).reshape(-1, TREES, DEPTH)
        own = size_class(np.array(sizes), threshold)
        wants = np.array([[lengths.get(c + k, floor) for k in (-1, 0, 1)] for c in own.tolist()])
        hs, ns = [], []
        for d in np.unique(wants):
            has = (wants == d).any(1)
            hs.append(prefix_keys(trie[has], int(d)).ravel())
            ns.append(np.repeat(np.flatnonzero(has), TREES))
        h, at = np.concatenate(hs).view(np.int64), np.concatenate(ns)
        order = np.argsort(h, kind="stable")
        h, at = h[order], at[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        root = rooted(np.cumsum(new) - 1, at, node)
        first = np.flatnonzero(new)
        lead = node[root[at[first]]]
        tied = np.flatnonzero(node != node[root])
        spread = mix(node[tied].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
        none = np.arange(len(lead) + len(tied)) < len(lead)
        return record({"key": pa.array(np.concatenate([h[first], spread])), "node": pa.array(np.concatenate([lead, node[tied]])), "partner": pa.array(np.concatenate([lead, node[root[tied]]]), mask=none)}, types)

    def run(batches):
        nodes, sizes, labels = [], [], []
        for b in batches:
            nodes += b.column("node").to_pylist()
            sizes += b.column("n_grams").to_pylist()
            labels += b.column("labels").to_pylist()
            if len(nodes) > HELD:
                yield settled(nodes, sizes, labels)
                nodes, sizes, labels = [], [], []
        if nodes:
            yield settled(nodes, sizes, labels)

    return run


def _ties(batches):
    """From NODES sorted by key and node: (a, b), each node with the first of its prefix."""
    types = arrow_types("a long, b long")
    key = lead = None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        h, d = b.column("key").to_numpy(), b.column("node").to_numpy()
        p = b.column("partner")
        known = p.is_valid().to_numpy(zero_copy_only=False)
        p = p.fill_null(0).to_numpy()
        new = np.concatenate([[key is None or h[0] != key], h[1:] != h[:-1]])
        start = np.flatnonzero(new)
        first = np.concatenate([np.full(n if not len(start) else start[0], lead if lead is not None else 0, np.int64), np.repeat(d[start], np.diff([*start, n]) if len(start) else [])])
        key = h[-1]
        if len(start):
            lead = d[start[-1]]
        to = np.where(known, p, first)
        out = to != d
        if out.any():
            pairs = np.unique(np.stack([d[out], to[out]]), axis=1)
            yield record({"a": pa.array(pairs[0]), "b": pa.array(pairs[1])}, types)


def _tied(reps: DataFrame, lengths: dict[int, int], floor: int, threshold: float) -> DataFrame:
    """(a, b): nodes that share a prefix, each with the lowest that does."""
    nodes = reps.select("node", "n_grams", "labels").mapInArrow(_nodes(lengths, floor, threshold), NODES)
    return nodes.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_ties, "a long, b long").distinct()


SEEN = "class int, length int, links long, one long, two long"


def _seen(floor: int, threshold: float):
    """From (n_grams, x, y), the labels of tied nodes: of the pairs next to the threshold, those that share a prefix anywhere, once and twice.

    How alike two texts are is taken from their labels here; that only steers the prefix, links themselves are compared exactly.
    """
    types = arrow_types(SEEN)

    def run(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, TREES, DEPTH) for c in "xy")
            alike = (x == y).mean((1, 2))
            near = (alike >= threshold) & (alike < threshold + NEXT)
            own, long = size_class(b.column("n_grams").to_numpy(), threshold)[near], matched(x[near], y[near])
            for d in range(floor, DEPTH + 1):
                n = (long >= d).sum(1)
                for c in np.unique(own):
                    k = n[own == c]
                    total[int(c), d] = total.get((int(c), d), np.zeros(3, np.int64)) + np.array([(k > 0).sum(), (k == 1).sum(), (k == 2).sum()])
        if total:
            yield record({"class": [c for c, _ in total], "length": [d for _, d in total], **{name: [int(v[i]) for v in total.values()] for i, name in enumerate(("links", "one", "two"))}}, types)

    return run


def _candidates(reps: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(a, b): ties in the forest after its prefixes were shortened as far as the links in it ask for."""
    floor = floor_length(threshold)
    ties = scratch.keep(_tied(reps, {}, floor, threshold))
    side = lambda c, as_: reps.select(F.col("node").alias(c), F.col("labels").alias(as_), *([F.col("n_grams")] if c == "a" else []))
    pairs = ties.join(side("a", "x"), "a").join(side("b", "y"), "b").select("n_grams", "x", "y")
    seen: dict[int, dict[int, tuple[int, int, int]]] = {}
    for r in pairs.mapInArrow(_seen(floor, threshold), SEEN).groupBy("class", "length").agg(*[F.sum(c).alias(c) for c in ("links", "one", "two")]).collect():  # classes by lengths, not links
        seen.setdefault(r["class"], {})[r["length"]] = (r["links"], r["one"], r["two"])
    lengths = {c: d for c, d in chosen_lengths(seen, floor).items() if d > floor}
    if not lengths:
        return ties
    some = reps.join(ties.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
    return scratch.keep(_tied(some, lengths, floor, threshold))


SETS = "node long, component long, copies long, n_grams int, grams binary"


def _sets(gram: int):
    """From (node, component, copies, text) to SETS."""
    types = arrow_types(SETS)

    def run(batches):
        words = WordHashes()
        for b in short(batches):
            grams = [shingles(words.of(t.split())[0], gram) for t in text_bytes(b)]
            yield record({k: b.column(k) for k in ("node", "component", "copies")} | {"n_grams": list(map(len, grams)), "grams": [g.tobytes() for g in grams]}, types)

    return run


def _compared(threshold: float):
    """From (block, side, node, copies, grams) sorted by block: each node's links in the block, and the lowest node they tie it to."""
    types = arrow_types("node long, root long, links long")

    def closed(nodes, sides, copies, sets):
        n = len(nodes)
        size = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(n), size)
        every = np.concatenate(sets)
        by = np.argsort(every, kind="stable")
        every, owner = every[by], owner[by]
        new = np.concatenate([[True], every[1:] != every[:-1]])
        column = np.cumsum(new) - 1
        shared = np.bincount(column) > 1
        m = shared[column]
        owner, column = owner[m], (np.cumsum(shared) - 1)[column[m]]
        common = np.zeros((n, n), np.float32)
        step = max(64, 4_000_000 // n)
        for c in range(0, int(shared.sum()), step):
            i, j = np.searchsorted(column, (c, c + step))
            a = np.zeros((n, step), np.float32)
            a[owner[i:j], column[i:j] - c] = 1
            common += a @ a.T
        side = np.array(sides)
        across = bool((side >= 0).any())  # a block of two sides compares across them only
        ids, weight = np.array(nodes, np.int64), np.array(copies, np.int64)
        number = np.argsort(np.argsort(ids, kind="stable"))
        link = np.empty((n, n), bool)
        for i in range(0, n, 256):
            own = common[i : i + 256]
            link[i : i + 256] = own >= threshold * (size[i : i + 256, None] + size[None, :] - own) - 1e-9
            if across:
                link[i : i + 256] &= side[i : i + 256, None] != side[None, :]
        del common
        np.fill_diagonal(link, False)
        links = np.concatenate([link[i : i + 256] @ weight for i in range(0, n, 256)])
        root = number.copy()
        while True:
            low = np.minimum(root, np.concatenate([np.where(link[i : i + 256], root[None, :], n).min(1) for i in range(0, n, 256)]))
            low = np.minimum(low, low[np.argsort(number)][low])
            if np.array_equal(low, root):
                break
            root = low
        return record({"node": pa.array(ids), "root": pa.array(np.sort(ids)[root]), "links": pa.array(links)}, types)

    def run(batches):
        key, nodes, sides, copies, sets = None, [], [], [], []
        for b in short(batches):
            for k, s, d, c, g in zip(*(b.column(x).to_pylist() for x in ("block", "side", "node", "copies", "grams")), strict=True):
                if k != key:
                    if len(nodes) > 1:
                        yield closed(nodes, sides, copies, sets)
                    key, nodes, sides, copies, sets = k, [], [], [], []
                nodes.append(d)
                sides.append(s)
                copies.append(c)
                sets.append(np.frombuffer(g, np.uint64))
        if len(nodes) > 1:
            yield closed(nodes, sides, copies, sets)

    return run


def _blocks(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """(node, copies, block, side): where each candidate is compared. ``members`` has component, node, copies, n_grams.

    A component of at most ``block`` texts and BLOCK_GRAMS shingles is one block. A larger one is dealt by the size of its sets into classes
    that differ by the threshold, so that only texts of one or of neighbouring classes can be similar; each class is salted into parts,
    and every two parts of one class or of neighbouring ones are a block.
    """
    step = -math.log(threshold)
    members = members.withColumn("level", F.floor(F.log(F.col("n_grams").cast("double")) / step).cast("int"))
    over = lambda n, grams: F.greatest(F.ceil(n / block), F.ceil(grams / BLOCK_GRAMS)).cast("int")
    total = members.groupBy("component").agg(over(F.count("*"), F.sum("n_grams")).alias("total"))
    parts = members.groupBy("component", "level").agg(over(F.count("*"), F.sum("n_grams")).alias("parts"))
    near = parts.select("component", (F.col("level") - 1).alias("level"), F.col("parts").alias("parts_up")), parts.select("component", (F.col("level") + 1).alias("level"), F.col("parts").alias("parts_down"))
    plan = parts.join(total, "component").join(near[0], ["component", "level"], "left").join(near[1], ["component", "level"], "left")
    own = members.join(plan, ["component", "level"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int"))

    def upto(n):
        return F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    within = F.transform(upto(F.col("parts")), lambda q: F.struct(F.concat_ws(":", F.col("component"), F.col("level"), F.least("part", q), F.col("level"), F.greatest("part", q)).alias("block"), F.when(q == F.col("part"), F.lit(-1)).when(q > F.col("part"), F.lit(0)).otherwise(F.lit(1)).alias("side")))
    up = F.transform(upto(F.col("parts_up")), lambda q: F.struct(F.concat_ws(":", F.col("component"), F.col("level"), "part", F.col("level") + 1, q).alias("block"), F.lit(0).alias("side")))
    down = F.transform(upto(F.col("parts_down")), lambda q: F.struct(F.concat_ws(":", F.col("component"), F.col("level") - 1, q, "level", "part").alias("block"), F.lit(1).alias("side")))
    small = F.array(F.struct(F.col("component").cast("string").alias("block"), F.lit(-1).alias("side")))
    places = F.when(F.col("total") <= 1, small).otherwise(F.concat(within, up, down))
    return own.select("node", "copies", F.explode(places).alias("x")).select("node", "copies", "x.block", "x.side")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, n_links) for each distinct (doc_id, text): the lowest document it is connected to, and its number of links.

    A link joins two documents with equal texts (null is empty), or whose shingle sets have a Jaccard similarity of at least
    ``threshold``. Texts without words are linked to equal texts only. Documents without an id have no class and no links. An empty table
    gives an empty one; other columns are not read.
    """
    out = _classes(docs, threshold, gram, block).select("doc_id", "class_id", "n_links")
    return out.unionByName(docs.where("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def _mark():
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def _classes(docs: DataFrame, threshold: float, gram: int, block: int) -> DataFrame:
    """(doc_id, mark, class_id, first, n_links) for each distinct (doc_id, text) with an id; one row of a class is its first.

    Where some id has several texts, each (doc_id, text) goes by a number instead of its id, in order of the ids.
    """
    scratch = Scratch(docs.sparkSession)
    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), _mark().alias("mark"), F.coalesce("text", F.lit("")).alias("text"))
    shapes = scratch.keep(known.mapInArrow(_shapes(gram), SHAPES))
    keyed = shapes.select("doc_id", "mark", "shape").distinct()
    names = None
    if not keyed.groupBy("doc_id").agg(F.count("*").alias("texts")).where("texts > 1").isEmpty():
        names = scratch.keep(keyed.orderBy("doc_id", "mark").withColumn("number", F.monotonically_increasing_id()))
        keyed = names
    members = keyed.select("doc_id", "mark", "shape", (F.col("doc_id") if names is None else F.col("number")).alias("number"))
    first = members.groupBy("shape").agg(F.min(F.struct("number", "doc_id", "mark")).alias("x"), F.count("*").alias("copies"))
    labels = shapes.where("labels is not null").groupBy("shape").agg(F.first("n_grams").alias("n_grams"), F.first("labels").alias("labels"))
    reps = scratch.keep(first.join(labels, "shape", "left").select("shape", F.col("x.number").alias("node"), F.col("x.doc_id").alias("doc_id"), F.col("x.mark").alias("mark"), "copies", "n_grams", "labels"))

    ties = _candidates(reps.where("labels is not null"), threshold, scratch)
    tied = components(ties).join(reps.select("node", "doc_id", "mark", "copies"), "node")
    texts = known.join(tied, ["doc_id", "mark"]).dropDuplicates(["node"]).select("node", "component", "copies", "text")
    sets = scratch.keep(texts.mapInArrow(_sets(gram), SETS))
    where = _blocks(sets.select("node", "component", "copies", "n_grams"), threshold, block)
    met = where.join(sets.select("node", "grams"), "node").repartition("block").sortWithinPartitions("block", "node")
    found = scratch.keep(met.select("block", "side", "node", "copies", "grams").mapInArrow(_compared(threshold), "node long, root long, links long"))
    classes = components(found.where("root <> node").select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    whole = reps.select("shape", "node", "copies").join(links, "node", "left").join(classes, "node", "left").select("shape", F.coalesce("component", "node").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = members.join(whole, "shape").select("doc_id", "mark", "class_id", (F.col("class_id") == F.col("number")).alias("first"), "n_links")
    if names is not None:
        head = names.select(F.col("number").alias("class_id"), F.col("doc_id").alias("head"))
        out = out.join(head, "class_id").select("doc_id", "mark", F.col("head").alias("class_id"), "first", "n_links")
    return out


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, gram: int = GRAM) -> DataFrame:
    """``docs`` with all its columns, of each class the document with the lowest id, once; documents without an id all stay.

    Texts that share an id are judged each for itself; of those in one class under its lowest id, one stays.
    """
    others = _classes(docs, threshold, gram, BLOCK).where("not first").select(F.col("doc_id").alias("_tl_doc"), F.col("mark").alias("_tl_other"))
    docs = docs.withColumn("_tl_mark", _mark())
    kept = docs.join(others, (docs["doc_id"] == others["_tl_doc"]) & (docs["_tl_mark"] == others["_tl_other"]), "left_anti")
    return kept.where("doc_id is not null").dropDuplicates(["doc_id", "_tl_mark"]).unionByName(kept.where("doc_id is null")).drop("_tl_mark")
