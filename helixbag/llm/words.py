"""Whole-batch NumPy helpers over Arrow text: words, rolling hashes and row slices of bounded size.

Words are runs of bytes other than 0x20 and 0x09-0x0D. A distinct word of a slice is hashed once, and spans of words from the
hashes of their halves, so a whole batch is hashed without a Python loop over its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# An odd multiplier that tells the left half of a span from the right one.
LEFT = np.uint64(0x9E3779B97F4A7C15)
# Bytes of text worked on at once, which take about 60 MB; a longer single text makes a slice of its own.
SLICE_BYTES = 1_000_000

# Bytes of one Arrow batch between Spark and Python. Rows alone would not bound it, as texts may be very long.
BATCH_BYTES = 4 << 20

def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes; operators with Python stages call this before they plan."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(setting)
    if not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(setting, str(BATCH_BYTES))


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over their whole range (a bijection)."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for every pair; equal spans hash alike wherever they stand.

    Runs of 1, 2, 4, ... values are hashed from their halves, and a span from the two longest such runs that cover it, with
    its length. Each step mixes its result, so no sum or product of values is left that chosen repetitions could cancel.
    """
    length = ends - starts
    out = np.zeros(len(length), dtype=np.uint64)
    runs, size = mix(values.astype(np.uint64)), 1
    while len(length) and size <= length.max():
        here = np.flatnonzero((length >= size) & (length < 2 * size))
        out[here] = mix(runs[starts[here]] * LEFT + runs[ends[here] - size])
        if 2 * size <= len(values):
            runs = mix(runs[:-size] * LEFT + runs[size:])
        size *= 2
    return mix(out + length.astype(np.uint64))


class Words:
    """Words of some texts: byte limits, the text of each word, and the first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        blank = SPACE[data]
        inside = ~blank
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= blank[:-1]
        closes[:-1] &= blank[1:]
        # A text that begins or ends with a word has a limit there, whatever stands next to it.
        filled = offsets[:-1][offsets[1:] > offsets[:-1]]
        opens[filled[inside[filled]]] = True
        last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
        closes[last[inside[last]]] = True
        self.starts = np.flatnonzero(opens)
        self.ends = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """64-bit hash of each word, A-Z lower-cased on request: BLAKE2b of each distinct word of the slice."""
        inside = ~SPACE[self.data]
        held = self.data[inside]
        if lower:
            held = np.where((held >= 0x41) & (held <= 0x5A), held | 0x20, held)
        limits = np.concatenate([[0], np.cumsum(self.ends - self.starts)]).astype(np.int64)
        coded = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(self), [None, pa.py_buffer(limits), pa.py_buffer(held)]).dictionary_encode()
        drawn = b"".join([hashlib.blake2b(word, digest_size=8).digest() for word in coded.dictionary.to_pylist()])
        return np.frombuffer(drawn, dtype=np.uint64)[coded.indices.to_numpy()] if len(self) else np.zeros(0, dtype=np.uint64)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null reads as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if len(texts) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    # A view, not a copy, of the batch.
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of the batches in slices of about SLICE_BYTES of text, with the bytes and offsets of the text column."""
    for batch in batches:
        data, offsets = flat(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + SLICE_BYTES, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            part = offsets[start : stop + 1]
            yield batch.slice(start, stop - start), data[part[0] : part[-1]], part - part[0]
            start = stop
