"""Texts of Arrow batches as arrays of letters, and counts of numbered things per key of a batch."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa

# Cells of a table of counts that is made whole; beyond, the numbers that occur are sorted.
TABLE_CELLS = 1 << 22


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text begins and ends; null reads as empty."""
    if not (pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type)):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    return np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a string column and where each text begins and ends; null reads as empty."""
    data, offsets = text_bytes(texts)
    if not len(data) or data.max() < 0x80:
        return data, offsets
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32), heads[offsets]


def walled(codes: np.ndarray, offsets: np.ndarray, wall: int) -> np.ndarray:
    """The texts in a row with a wall before each and one at the end."""
    out = np.full(len(codes) + len(offsets), wall, dtype=codes.dtype)
    inside = np.ones(len(out), dtype=bool)
    inside[offsets + np.arange(len(offsets))] = False
    out[inside] = codes
    return out


def key_numbers(batch: pa.RecordBatch, keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row, equal where the keys are, and a row of each number."""
    number, rows = np.zeros(batch.num_rows, dtype=np.int64), np.arange(min(batch.num_rows, 1))
    for key in keys:
        if pa.types.is_nested(batch.schema.field(key).type):
            return np.arange(batch.num_rows), np.arange(batch.num_rows)
        coded = batch.column(key).dictionary_encode(null_encoding="encode")
        both = number * (len(coded.dictionary) + 1) + coded.indices.to_numpy(zero_copy_only=False)
        _, rows, number = np.unique(both, return_index=True, return_inverse=True)
    return number, rows


def tally(groups: np.ndarray, numbers: np.ndarray, n_groups: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, number, count) of the pairs that occur; numbers lie below ``size``."""
    cells = groups * np.int64(size) + numbers
    if n_groups * size <= TABLE_CELLS:
        table = np.bincount(cells, minlength=1)
        found = np.flatnonzero(table)
        counts = table[found]
    else:
        found, counts = np.unique(cells, return_counts=True)
    return found // size, found % size, counts
