"""Substring dedup of word windows, by anchors on a difference cover.

Residues D modulo a period v are a difference cover if every difference modulo v is one of two of them. Of any two equal windows of
WIDTH words some place t < v lies on a residue of D in both documents, so the short windows hashed at such places alone, of
WIDTH - v + 1 words, meet. Places whose anchor occurs twice are then extended: the full windows around them are compared by
96-bit hashes, and all but the earliest of equal ones are removed.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from turnloom.functions.arrow import short
from turnloom.llm.common import arrow_types, only_texts, record, rewritten, text_bytes, window_hash
from turnloom.llm.repeats import ANCHORS, WINDOWS, by_document, covered, later_windows, local_anchors, local_windows, packed_texts, repeated_places, unpacked, with_gone

WIDTH = 20
#: A perfect difference cover: fixed values of the period-13 set.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Words whose hashes a worker remembers.
HELD_WORDS = 1_000_000


class WordHashes(dict):
    """Numbers of words, and two hashes of each."""

    def __init__(self):
        super().__init__()
        self.table = np.zeros((2, 1024), np.uint64)

    def __missing__(self, word: bytes) -> int:
        i = len(self)
        if i == self.table.shape[1]:
            self.table = np.concatenate([self.table, np.zeros_like(self.table)], axis=1)
        x = xxhash.xxh3_128_intdigest(word)
        self.table[:, i] = x & 0xFFFFFFFFFFFFFFFF, x >> 64
        self[word] = i
        return i

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > HELD_WORDS:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.table[0][at], self.table[1][at]


def anchors(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the short windows on the cover, in a document of at least ``width`` words."""
    short = width - PERIOD + 1
    if len(hashes) < width:
        return np.empty(0, np.uint64), np.empty(0, np.int32)
    n = len(hashes) - short + 1
    at = np.flatnonzero(np.isin(np.arange(PERIOD), COVER))
    at = (np.arange(0, n, PERIOD)[:, None] + at).ravel()
    at = at[at < n].astype(np.int32)
    return window_hash(hashes, short, 0x9E3779B97F4A7C15)[at], at


def extended(places: np.ndarray, n: int, width: int) -> np.ndarray:
    """Starts of the windows of ``width`` that hold a repeated anchor within reach."""
    last = n - width
    edge = np.zeros(last + 2, np.int64)
    places = places[places < n]
    np.add.at(edge, np.clip(places - PERIOD + 1, 0, last + 1), 1)
    np.add.at(edge, np.minimum(places, last) + 1, -1)
    return np.flatnonzero(np.cumsum(edge[:-1]) > 0)


def gone_windows(docs: DataFrame, packed: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, at, n): starts of the windows of ``width`` words whose sequence also starts earlier. ``docs`` has doc_id (long, not null) and text, ``packed`` the same packed."""
    if width < PERIOD:
        raise ValueError(f"windows need at least {PERIOD} words")
    def first(batches):
        words = WordHashes()

        def rows():
            for b in short(batches):
                for d, t in zip(b.column("doc_id").to_pylist(), text_bytes(b), strict=True):
                    h, at = anchors(words.of(t.split())[0], width)
                    if len(h):
                        yield d, h, at

        yield from local_anchors(rows())

    def second(batches):
        words = WordHashes()

        def rows():
            for b in short(batches):
                for d, t, at in zip(b.column("doc_id").to_pylist(), unpacked(b), b.column("_tl_at").to_pylist(), strict=True):
                    h, g = words.of(t.split())
                    if len(h) >= width:
                        starts = extended(np.array(at), len(h), width)
                        yield d, window_hash(h, width, 0xD6E8FEB86659FD93)[starts], window_hash(g, width, 0xA0761D6478BD642F)[starts], starts.astype(np.int32)

        yield from local_windows(rows())

    places = by_document(repeated_places(docs.mapInArrow(first, ANCHORS)))
    return later_windows(packed.join(places, "doc_id").mapInArrow(second, WINDOWS))


def without_repeats(docs: DataFrame, extra: str = "kept string", width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by spaces (or their digest, with ``extra`` = "kept_sha256 string").

    Null and empty texts have no words. Rows without an id lose nothing. doc_id names a text: repeated rows of one stand for one
    document and lose the same words. Other columns are not read; an empty table gives an empty one.
    """
    docs = only_texts(docs)
    known, other = docs.where("doc_id is not null"), packed_texts(docs.where("doc_id is null"), False)
    packed = packed_texts(known)
    gone = gone_windows(known, packed, width)
    name = extra.split()[0]
    schema = f"doc_id long, n_words long, n_removed long, {extra}"
    types = arrow_types(schema)

    def run(batches):
        for b in short(batches):
            out = []
            for t, at in zip(unpacked(b), b.column("_tl_at").to_pylist(), strict=True):
                words = t.split()
                n = len(words)
                if at:
                    mask = covered(n, at, width)
                    words = [w for w, x in zip(words, mask.tolist(), strict=True) if not x]
                kept = b" ".join(words)
                out.append((n, n - len(words), hashlib.sha256(kept).hexdigest() if name == "kept_sha256" else kept.decode("utf-8", "replace")))
            n, m, kept = zip(*out, strict=True)
            yield record({"doc_id": b.column("doc_id"), "n_words": n, "n_removed": m, name: kept}, types)

    return with_gone(packed, other, gone).mapInArrow(run, schema)


_PIECE = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def repeats_removed(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with all its columns, the texts without repeated windows' words; white space between words that stay stays."""
    known = only_texts(docs).where("doc_id is not null")
    gone = by_document(gone_windows(known, packed_texts(known), width))

    def change(text: bytes, at: list[int]) -> bytes:
        pieces = _PIECE.findall(text)
        mask = covered(len(pieces), at, width)
        return text[: len(text) - sum(map(len, pieces))] + b"".join([p for p, x in zip(pieces, mask.tolist(), strict=True) if not x])

    return rewritten(docs, gone, change)
