"""BPE encoding over a table of distinct words, and decoding through an id-to-piece join.

A word here is a run between white space, which no pre-token of the tokenizer crosses. Every distinct word is encoded once. The table
of words has two parts: the most frequent ones, a bounded number of bounded length, whose ids are given to all tasks; and all others,
which meet by word with the places that want them. Their ids are joined back by document and position.

Texts are decoded from these ids. A stretch of encoded texts goes on as one row with its texts' ids by position, numbered within the stretch,
and one row for each distinct id. Those meet their pieces in the id-to-piece table, which has a row for each id of the vocabulary and is
broadcast; rows stay side by side, so that the stretch's texts are put together by position as its pieces stream by.
"""

from __future__ import annotations

import ctypes
import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import filterfalse, repeat
from operator import itemgetter
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions.arrow import short
from turnloom.llm.common import Scratch, arrow_types, record

#: Words given to all tasks, and the bytes that one of them may have.
HOT_WORDS, HOT_BYTES = 1 << 19, 32
#: Distinct words that a task holds before it passes its counts on.
HELD_WORDS = 1 << 19
#: Places of words that a task holds before it passes them on.
HELD_PLACES = 1 << 17
#: Bytes of ids that are decoded at once.
STRETCH_BYTES = 8 << 20
#: White space of str.split() that the tokenizer's pattern takes for symbols.
_ODD = "\x1c\x1d\x1e\x1f"
_SPACE = re.compile("[\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def split_words(text: str) -> list[str]:
    """The text's runs between what the tokenizer's pattern takes for white space."""
    if any(c in text for c in _ODD):
        return [x for x in _SPACE.split(text) if x]
    return text.split()


@lru_cache(1)
def _trim() -> Callable[[int], int]:
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda keep: 0)


def give_back() -> None:
    """Returns memory that is free in this process to the system: what Arrow's pool and the C library keep for later."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


Pass = Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _lean(run: Pass) -> Pass:
    """The pass, leaving nothing behind: Spark takes its idle workers in turn, so that all of an executor's come to hold what the largest pass left."""

    def own(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return own


@lru_cache(2)
def _tokenizer(model: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(model)
    t.no_truncation()
    t.no_padding()
    return t


@dataclass(frozen=True)
class Bpe:
    """A tokenizer file's content. It goes to the tasks as it is; its size is that of the vocabulary."""

    model: str
    #: Integers that hold any id.
    kind: str = "<u4"

    @classmethod
    def load(cls, path: str) -> Bpe:
        with open(path, encoding="utf-8") as f:
            model = f.read()
        if json.loads(model).get("decoder") is not None:
            raise ValueError("pieces are joined by spaces, which is what a tokenizer without a decoder does; this one has a decoder")
        return cls(model, "<u2" if max(_tokenizer(model).get_vocab(with_added_tokens=True).values(), default=0) < 1 << 16 else "<u4")

    def pieces(self) -> list[str]:
        """The piece of each id; ids without one have an empty piece."""
        t = _tokenizer(self.model)
        names = {i: p for p, i in t.get_vocab(with_added_tokens=True).items()}
        return [names.get(i, "") for i in range(max(names, default=-1) + 1)]


def frequent_words(docs: DataFrame, least: int = 2) -> DataFrame:
    """(word, n): words that some task met ``least`` times, by how often such tasks met them. It only tells which words to give to all tasks."""
    types = arrow_types("word string, n long")

    def flushed(seen: Counter):
        words = sorted(w for w, n in seen.items() if n >= least and len(w.encode()) <= HOT_BYTES)
        return record({"word": words, "n": [seen[w] for w in words]}, types)

    def run(batches):
        seen: Counter = Counter()
        for b in short(batches):
            for t in b.column("text").to_pylist():
                if t:
                    seen.update(split_words(t))
                if len(seen) > HELD_WORDS:
                    yield flushed(seen)
                    seen.clear()
                    give_back()
        if seen:
            yield flushed(seen)

    return docs.select("text").mapInArrow(_lean(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """At most ``most`` words, those above a count; the counts' histogram has few rows, whatever the words are."""
    seen, floor = 0, None
    for r in counts.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        seen += r["count"]
        if seen > most:
            break
        floor = r["n"]
    return counts.where(F.col("n") >= floor) if floor is not None else counts.where("false")


def _ids(t, words: list[str], kind: str) -> list[bytes]:
    """Each word's ids as little-endian integers."""
    return [np.array(e.ids, kind).tobytes() for e in t.encode_batch_fast(words, add_special_tokens=False)]


def encoded_words(words: DataFrame, bpe: Bpe) -> DataFrame:
    """(word, n, ids) of distinct words, each encoded once; ids as little-endian integers of the vocabulary's width."""
    types = arrow_types("word string, n long, ids binary")

    def run(batches):
        t = _tokenizer(bpe.model)
        for b in batches:
            yield record({"word": b.column("word"), "n": b.column("n"), "ids": _ids(t, b.column("word").to_pylist(), bpe.kind)}, types)

    return words.select("word", "n").mapInArrow(_lean(run), "word string, n long, ids binary")


class _Shared:
    """A table of one column for all tasks, with a name of its own."""

    def __init__(self, spark: SparkSession, column: pa.Array):
        sink = pa.BufferOutputStream()
        batch = pa.RecordBatch.from_arrays([column], ["x"])
        with pa.ipc.new_stream(sink, batch.schema) as w:
            w.write_batch(batch)
        data = zstandard.compress(sink.getvalue())
        self.id, self.b = hash(hashlib.sha256(data).digest()), spark.sparkContext.broadcast(data)

    def loaded(self, unpack: Callable[[pa.Array], Any]) -> Any:
        """The column unpacked, once in each worker, which holds a single one: passes that need different ones do not add up."""
        if self.id not in _loaded:
            _loaded.clear()
            _loaded[self.id] = unpack(pa.ipc.open_stream(zstandard.decompress(self.b.value)).read_all().column("x").combine_chunks())
            give_back()
        return _loaded[self.id]


_loaded: dict[int, Any] = {}


def _ranks(words: pa.Array) -> dict[str, int]:
    return {w: i for i, w in enumerate(words.to_pylist())}


@dataclass(frozen=True)
class IdTable:
    """Ids of words one after another, and where each word's begin and how many they are."""

    flat: np.ndarray
    first: np.ndarray
    size: np.ndarray

    @classmethod
    def of_column(cls, ids: pa.Array, kind: str) -> IdTable:
        if not len(ids):
            return cls.of([], kind)
        _, ends, data = ids.cast(pa.binary()).buffers()
        ends = np.frombuffer(ends, np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64) // np.dtype(kind).itemsize
        return cls(np.frombuffer(data, kind), ends[:-1], np.diff(ends))

    @classmethod
    def of(cls, ids: list[bytes], kind: str) -> IdTable:
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // np.dtype(kind).itemsize
        return cls(np.frombuffer(b"".join(ids), kind), np.cumsum(size) - size, size)

    def ids(self, at: np.ndarray, own: IdTable | None = None) -> np.ndarray:
        """The ids of the words at the places, in order; places from the table's end on are those of ``own``."""
        at = at.astype(np.int64)
        if own is None:
            first, size = self.first[at], self.size[at]
        else:
            hot = at < len(self.size)
            first, size = np.empty_like(at), np.empty_like(at)
            first[hot], size[hot] = self.first[at[hot]], self.size[at[hot]]
            rest = at[~hot] - len(self.size)
            first[~hot], size[~hot] = own.first[rest], own.size[rest]
        ends = np.cumsum(size)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)
        if own is None:
            return self.flat[place]
        hot = np.repeat(hot, size)
        out = np.empty(len(place), self.flat.dtype)
        out[hot], out[~hot] = self.flat[place[hot]], own.flat[place[~hot]]
        return out


#: A place that wants a word: document, its text's mark, and the word's number among those the document asks for.
PLACE = np.dtype([("doc", "<i8"), ("mark", "<i4"), ("k", "<i4")])


def _mark(doc_id: int | None, text: str) -> int:
    """Tells apart different texts of one id."""
    return xxhash.xxh32_intdigest(text.encode(), 0 if doc_id is None else 1) - (1 << 31)


def _rare(text: str, ranks: dict[str, int]) -> list[str]:
    """The text's words that are not frequent, each once."""
    return list(dict.fromkeys(filterfalse(ranks.__contains__, split_words(text))))


def _places(text: str, ranks: dict[str, int]) -> np.ndarray:
    """Each word's rank, or the number of ranks plus the word's place in ``_rare``."""
    words = split_words(text)
    hot = len(ranks)
    at = np.fromiter(map(ranks.get, words, repeat(hot)), "<u4", len(words))
    cold: dict[str, int] = {}
    for i in np.flatnonzero(at == hot).tolist():
        at[i] = hot + cold.setdefault(words[i], len(cold))
    return at


@lru_cache(1)
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def _pack(at: np.ndarray) -> bytes:
    """Byte planes, compressed."""
    return _zstd()[0].compress(at.view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(np.frombuffer(_zstd()[1].decompress(data), np.uint8).reshape(4, -1).T.tobytes(), "<u4")


def _encoded(docs: DataFrame, bpe: Bpe, finish: Callable[[Iterator[tuple[pa.Array, list[np.ndarray]]]], Iterator[pa.RecordBatch]], schema: str, hot_words: int) -> DataFrame:
    """What ``finish`` makes, by ``schema``, of batches of document ids with the ids (an array of unsigned integers) of each whole text."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    top = encoded_words(most_frequent(scratch.keep(frequent_words(docs)), hot_words), bpe).toArrow()
    top = top.take(np.lexsort((top.column("word").to_numpy(), -top.column("n").to_numpy()))).combine_chunks()
    words, hot = (_Shared(spark, top.column(c).combine_chunks()) for c in ("word", "ids"))
    del top

    wanted = arrow_types("word string, places binary")

    def rest(batches):
        ranks = words.loaded(_ranks)
        numbers: dict[str, int] = {}  # of the words held
        held: list[np.ndarray] = []  # for each text its words' numbers, and its places
        size = 0

        def flushed():
            order = pc.array_sort_indices(pa.array(list(numbers), pa.string())).to_numpy().astype(np.int64)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            word, places = rank[np.concatenate(held[::2])], np.concatenate(held[1::2])
            ends = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(order)))]) * PLACE.itemsize
            data = places[np.argsort(word, kind="stable")].tobytes()
            binaries = pa.Array.from_buffers(pa.binary(), len(order), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
            return record({"word": pa.array(list(numbers), pa.string()).take(pa.array(order)), "places": binaries}, wanted)

        for b in short(batches):
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if t and (cold := _rare(t, ranks)):
                    n = len(cold)
                    own = np.empty(n, PLACE)
                    own["doc"], own["mark"], own["k"] = d or 0, _mark(d, t), np.arange(n)
                    held += np.fromiter((numbers.setdefault(w, len(numbers)) for w in cold), np.int64, n), own
                    size += n
                if size > HELD_PLACES:
                    yield flushed()
                    numbers, held, size = {}, [], 0
        if held:
            yield flushed()

    got = arrow_types("key long, mark int, answer binary")

    def answered(batches):
        t = _tokenizer(bpe.model)
        last: tuple[str, bytes] | None = None  # the word before this batch, with its ids
        for b in short(batches):
            asked, places = b.column("word").to_pylist(), b.column("places").to_pylist()
            new = [w for w in dict.fromkeys(asked) if last is None or w != last[0]]
            ids = dict(zip(new, _ids(t, new, bpe.kind), strict=True))
            if last is not None:
                ids[last[0]] = last[1]
            at = np.frombuffer(b"".join(places), PLACE)
            sizes = [len(p) // PLACE.itemsize for p in places]
            each = [ids[w] for w, n in zip(asked, sizes, strict=True) for _ in range(n)]
            yield record({"key": pa.array(at["doc"]), "mark": pa.array(at["mark"]), "answer": [k.to_bytes(4, "little") + x for k, x in zip(at["k"].tolist(), each, strict=True)]}, got)
            if asked:
                last = (asked[-1], ids[asked[-1]])

    found = docs.mapInArrow(_lean(rest), "word string, places binary").repartition("word").sortWithinPartitions("word").mapInArrow(_lean(answered), "key long, mark int, answer binary")
    found = found.groupBy("key", "mark").agg(F.collect_set("answer").alias("found"))

    part = arrow_types("doc_id long, key long, mark int, packed binary")

    def packed(batches):
        ranks = words.loaded(_ranks)
        for b in short(batches):
            if b.num_rows:
                ids, texts = b.column("doc_id").to_pylist(), [t or "" for t in b.column("text").to_pylist()]
                yield record({"doc_id": ids, "key": [d or 0 for d in ids], "mark": [_mark(d, t) for d, t in zip(ids, texts, strict=True)], "packed": [_pack(_places(t, ranks)) for t in texts]}, part)

    both = docs.mapInArrow(_lean(packed), "doc_id long, key long, mark int, packed binary").join(found, ["key", "mark"], "left").select("doc_id", "packed", "found")

    def joined(batches):
        table = hot.loaded(lambda x: IdTable.of_column(x, bpe.kind))

        def ids(packed: bytes, found: list[bytes] | None) -> np.ndarray:
            own = None
            if found:
                numbered = sorted((int.from_bytes(x[:4], "little"), x[4:]) for x in found)
                own = IdTable.of([x for _, x in numbered], bpe.kind)
            return table.ids(_unpack(packed), own)

        for b in short(batches):
            yield b.column("doc_id"), list(map(ids, b.column("packed").to_pylist(), b.column("found").to_pylist()))

    return both.mapInArrow(_lean(lambda batches: finish(joined(batches))), schema)


def encode(docs: DataFrame, bpe: Bpe, hot_words: int = HOT_WORDS) -> DataFrame:
    """(doc_id, ids): the ids of each whole text, as ``digests`` takes them."""
    types = arrow_types("doc_id long, ids array<long>")

    def finish(rows):
        for docs, ids in rows:
            yield record({"doc_id": docs, "ids": [x.astype(np.int64) for x in ids]}, types)

    return _encoded(docs, bpe, finish, "doc_id long, ids array<long>", hot_words)


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, bpe: Bpe, hot_words: int = HOT_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each whole text: of its ids in decimal, and of what they decode to.

    Null and empty texts have no ids. Null ids of documents stay null; repeated rows give one row each; an empty table gives an empty
    one; other columns are not read.
    """
    numbers = [str(i) for i in range(len(bpe.pieces()))]

    def finish(rows):
        yield from _stretches((docs.to_pylist(), [sha256(taken(numbers, x)) for x in ids], [x.astype("<i4") for x in ids]) for docs, ids in rows)

    def done(docs: list, notes: list, sizes: list[int], texts: Iterator[str]) -> dict:
        return {"doc_id": docs, "n_tokens": sizes, "ids_sha256": notes, "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in texts]}

    return _decoded(_encoded(docs, bpe, finish, STRETCH, hot_words), bpe, done, DIGESTS)


def taken(table: list, at: np.ndarray) -> tuple:
    """The table's values at the places."""
    return itemgetter(*at.tolist())(table) if len(at) > 1 else tuple(table[i] for i in at.tolist())


def sha256(parts: tuple[str, ...]) -> str:
    return hashlib.sha256(" ".join(parts).encode()).hexdigest()


def piece_table(spark: SparkSession, bpe: Bpe) -> DataFrame:
    """(id, piece) of the whole vocabulary."""
    return spark.createDataFrame(list(enumerate(bpe.pieces())), "id int, piece string")


STRETCH = "pos int, id int, docs array<long>, notes array<string>, sizes array<int>, places binary"


def _stretches(rows: Iterable[tuple[list, list, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    """From documents, notes and ids to STRETCH: a row with a stretch's texts, their ids as places among its distinct ids, then these ids in order."""
    types = arrow_types(STRETCH)

    def closed(docs, notes, ids):
        every = np.concatenate(ids)
        if every.min(initial=0) < 0:
            raise ValueError("ids are not negative")
        seen = np.zeros(every.max(initial=-1) + 1, bool)  # as long as the vocabulary at most
        seen[every] = True
        distinct, places = np.flatnonzero(seen).astype(np.int32), (np.cumsum(seen, dtype=np.int32) - 1)[every]
        n = len(distinct)
        first = {"docs": docs, "notes": notes, "sizes": list(map(len, ids)), "places": places.astype("<i4").tobytes()}
        columns = {k: pa.concat_arrays([pa.array([v], types[k]), pa.nulls(n, types[k])]) for k, v in first.items()}
        return record({"pos": pa.array(np.arange(-1, n, dtype=np.int32)), "id": pa.concat_arrays([pa.nulls(1, pa.int32()), pa.array(distinct, pa.int32())])} | columns, types)

    docs, notes, ids, size = [], [], [], 0
    for d, n, x in rows:
        docs += d
        notes += n
        ids += x
        size += sum(i.nbytes for i in x)
        if size >= STRETCH_BYTES:
            yield closed(docs, notes, ids)
            docs, notes, ids, size = [], [], [], 0
    if docs:
        yield closed(docs, notes, ids)


def _decoded(rows: DataFrame, bpe: Bpe, done: Callable[[list, list, list[int], Iterator[str]], dict], schema: str) -> DataFrame:
    """The columns that ``done(doc ids, notes, numbers of ids, texts)`` gives for each stretch (STRETCH)."""
    met = rows.join(F.broadcast(piece_table(rows.sparkSession, bpe)), "id", "left")  # as many rows as the vocabulary has
    types = arrow_types(schema)

    def closed(held: dict, pieces: list[str]) -> pa.RecordBatch:
        places, sizes = np.frombuffer(held["places"], "<i4"), held["sizes"]
        ends = np.cumsum(sizes)
        texts = (" ".join(taken(pieces, places[e - n : e])) for n, e in zip(sizes, ends.tolist(), strict=True))
        return record(done(held["docs"], held["notes"], sizes, texts), types)

    def run(batches):
        held, pieces = None, []
        for b in batches:
            pos, found = b.column("pos").to_numpy(), b.column("piece").to_pylist()
            begin = np.flatnonzero(pos < 0).tolist()
            for i, j in zip([0, *begin], [*begin, len(pos)], strict=True):
                if i == j:
                    continue
                if pos[i] < 0:
                    if held is not None:
                        yield closed(held, pieces)
                    held, pieces = {c: b.column(c)[i].as_py() for c in ("docs", "notes", "sizes", "places")}, []
                    i += 1
                if (pos[i:j] != np.arange(len(pieces), len(pieces) + j - i)).any():
                    raise ValueError("pieces came out of order")
                pieces += found[i:j]
        if held is not None:
            yield closed(held, pieces)

    return met.select("pos", "piece", "docs", "notes", "sizes", "places").mapInArrow(_lean(run), schema)


def decode(encoded: DataFrame, bpe: Bpe) -> DataFrame:
    """(doc_id, text) from (doc_id, ids), each id joined with its piece. Null or empty ids give an empty text."""

    def stretches(batches):
        def rows():
            for b in short(batches):
                yield b.column("doc_id").to_pylist(), [None] * b.num_rows, [np.array(x or [], "<i4") for x in b.column("ids").to_pylist()]

        return _stretches(rows())

    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(_lean(stretches), STRETCH)
    return _decoded(rows, bpe, lambda docs, notes, sizes, texts: {"doc_id": docs, "text": list(texts)}, "doc_id long, text string")
