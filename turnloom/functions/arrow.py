"""Arrow passes in small steps: batches are cut by rows and bytes before work on them, and again where results outgrow what they come from."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sized
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows, and bytes of variable length, that a pass holds at once.
ROWS, BYTES = 500, 16 << 20


def row_bytes(b: pa.RecordBatch) -> np.ndarray:
    """Bytes of variable length in each row: strings, binaries, and eight for each item of an array."""
    out = np.zeros(b.num_rows, np.int64)
    for c in b.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            out += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        elif pa.types.is_list(c.type):
            out += 8 * pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False)
    return out


def short(batches: Iterable[pa.RecordBatch], rows: int = ROWS, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in batches of at most ``rows`` rows and ``most`` bytes; a row that is longer comes alone. Empty ones are left out."""
    for b in batches:
        size = np.concatenate([[0], np.cumsum(row_bytes(b))])
        i = 0
        while i < b.num_rows:
            j = min(i + rows, int(np.searchsorted(size, size[i] + most, "right")) - 1)
            j = max(j, i + 1)
            yield b.slice(i, j - i)
            i = j


def grown(b: pa.RecordBatch, results: Iterable[Any], size: Callable[[Any], int] = len, most: int = BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of ``b`` with the results of their rows, which are drawn as they are needed and cut when they reach ``most`` bytes."""
    start, held, n = 0, [], 0
    for x in results:
        held.append(x)
        n += size(x)
        if n >= most:
            yield b.slice(start, len(held)), held
            start, held, n = start + len(held), [], 0
    if held:
        yield b.slice(start, len(held)), held


def first_size(x: tuple[Sized, ...]) -> int:
    return len(x[0])
