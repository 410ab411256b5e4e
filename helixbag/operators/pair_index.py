"""Blocks of tokenised sentences that carry an index of their neighbouring pairs, for learning merges.

A block holds whole sentences as one array of token ids with a wall after each, and how often each sentence occurs. Beside
it stand the pairs of neighbours that the block holds, with their counts. A merge changes tokens at its places alone and hands out
how the counts of pairs changed there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from numpy.typing import DTypeLike
from pyspark.sql import DataFrame, SparkSession, functions as F

from helixbag.session import small_batches

# Letters of a block; a longer sentence makes a block of its own.
BLOCK_LETTERS = 1 << 15
WALL = -1
BLOCK = "tokens binary, weights binary, pairs array<bigint>, counts array<bigint>"


# Blocks that a reader of stored or cached tables holds at once: with Spark's thousands of rows that is a gigabyte a task.
BLOCKS_AT_ONCE = "32"
ROWS_AT_ONCE = ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.inMemoryColumnarStorage.batchSize")


@contextmanager
def few_blocks_at_once(spark: SparkSession) -> Iterator[None]:
    """Read and cache tables by BLOCKS_AT_ONCE rows meanwhile."""
    past = {name: spark.conf.get(name) for name in ROWS_AT_ONCE}
    try:
        for name in ROWS_AT_ONCE:
            spark.conf.set(name, BLOCKS_AT_ONCE)
        yield
    finally:
        for name, value in past.items():
            spark.conf.set(name, value)


def pair_key(left: int, right: int) -> int:
    return left << 32 | right


def pair_of(key: int) -> tuple[int, int]:
    return key >> 32, key & 0xFFFFFFFF


def _keys(tokens: np.ndarray) -> np.ndarray:
    """Key of each token with the next; negative where one of them is a wall."""
    wide = tokens.astype(np.int64)
    return wide[:-1] << 32 | wide[1:]


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their values, without those that sum to 0."""
    found, inverse = np.unique(keys, return_inverse=True)
    sums = np.zeros(len(found), dtype=np.int64)
    np.add.at(sums, inverse, values)
    return found[sums != 0], sums[sums != 0]


def _weighed(tokens: np.ndarray, weights: np.ndarray, places: np.ndarray, walls: np.ndarray):
    """Keys of the pairs that start at the places, with the weights of their sentences; pairs over a wall are left out."""
    places = places[(places >= 0) & (places < len(tokens) - 1)]
    wide = tokens.astype(np.int64)
    keys = wide[places] << 32 | wide[places + 1]
    real = keys >= 0
    return keys[real], weights[np.searchsorted(walls, places[real])]


def count_all(tokens: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    walls = np.flatnonzero(tokens == WALL)
    return summed(*_weighed(tokens, weights, np.arange(len(tokens) - 1), walls))


def merge(tokens: np.ndarray, weights: np.ndarray, olds: np.ndarray, news: np.ndarray):
    """Replace every pair of ``olds`` (keys in order) by its new token, leftmost first, all at once.

    No two of the pairs may overlap, except a pair of equal tokens with itself. Returns the tokens and the changes of pair
    counts, as keys and numbers.
    """
    keys = _keys(tokens)
    rank = np.minimum(np.searchsorted(olds, keys), len(olds) - 1)
    hits = np.flatnonzero(olds[rank] == keys)
    # Places beside each other belong to a run of one token, in which every second pair is merged.
    opens = np.concatenate([[True], np.diff(hits) != 1])[: len(hits)]
    begin = hits[opens][np.cumsum(opens) - 1] if len(hits) else hits
    hits = hits[(hits - begin) % 2 == 0]
    walls = np.flatnonzero(tokens == WALL)
    gone = _weighed(tokens, weights, np.unique(np.concatenate([hits - 1, hits, hits + 1])), walls)
    merged = tokens.copy()
    merged[hits] = news[rank[hits]]
    stays = np.ones(len(tokens), dtype=bool)
    stays[hits + 1] = False
    merged = merged[stays]
    now = hits - np.arange(len(hits))
    come = _weighed(merged, weights, np.unique(np.concatenate([now - 1, now])), np.flatnonzero(merged == WALL))
    return merged, summed(np.concatenate([gone[0], come[0]]), np.concatenate([-gone[1], come[1]]))


def _lists(rows, kind: pa.DataType) -> pa.Array:
    """A list column; None gives a null."""
    limits = np.concatenate([[0], np.cumsum([0 if row is None else len(row) for row in rows])]).astype(np.int32)
    filled = [row for row in rows if row is not None]
    values = pa.array(np.concatenate(filled) if filled else np.zeros(0, dtype=np.int64), kind)
    return pa.ListArray.from_arrays(pa.array(limits), values, mask=pa.array([row is None for row in rows], pa.bool_()))


def cell_type(tokens: int) -> DTypeLike:
    """The smallest kind of number that holds so many token ids and a wall."""
    return np.int16 if tokens < 1 << 15 else np.int32


def build_blocks(sentences: DataFrame, ids: dict[str, int], kind: DTypeLike = np.int32) -> DataFrame:
    """Blocks of (sentence, n) rows, with every letter as its id."""
    letters = np.array(sorted(map(ord, ids)), dtype=np.uint32)
    codes = np.array([ids[chr(c)] for c in letters], dtype=kind)
    none = np.zeros(0, dtype=np.int64)

    def block(texts: list[np.ndarray], ns: list[int]) -> pa.RecordBatch:
        tokens, weights = np.concatenate(texts), np.array(ns, dtype=np.int64)
        pairs, counts = count_all(tokens, weights)
        return pa.RecordBatch.from_arrays([
            pa.array([tokens.tobytes()], pa.binary()), pa.array([weights.tobytes()], pa.binary()),
            _lists([pairs], pa.int64()), _lists([counts], pa.int64())], names=["tokens", "weights", "pairs", "counts"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, ns, size = [], [], 0
        for batch in batches:
            for text, n in zip(batch.column(0), batch.column(1)):
                points = np.frombuffer(text.as_py().encode("utf-32-le"), dtype=np.uint32)
                texts.append(np.append(codes[np.searchsorted(letters, points)], np.array([WALL], dtype=kind)))
                ns.append(n.as_py())
                size += len(points)
                if size >= BLOCK_LETTERS:
                    yield block(texts, ns)
                    texts, ns, size = [], [], 0
        if texts:
            yield block(texts, ns)

    small_batches(sentences.sparkSession)
    return sentences.select("sentence", "n").mapInArrow(blocks, BLOCK)


def apply_merges(blocks: DataFrame, merges: list[tuple[int, int, int]], past: Sequence[list[tuple[int, int, int]]] = (),
                 kind: DTypeLike = np.int32) -> DataFrame:
    """The blocks after some merges (left, right, made), none of which overlaps another, and after the ``past`` batches before.

    ``moved`` and ``moves`` of a block are the pairs whose counts these merges changed, and by how much. A task works its blocks
    through one by one, so rounds need no table of their own that is held in memory.
    """
    steps = [(np.array([pair_key(a, b) for a, b, _ in sorted(batch)], dtype=np.int64),
              np.array([made for *_, made in sorted(batch)], dtype=kind)) for batch in [*past, merges]]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for text, weight, keys, ns in zip(*batch.columns):
                tokens, weights = np.frombuffer(text.as_py(), dtype=kind), np.frombuffer(weight.as_py(), dtype=np.int64)
                found, sums = [keys.values.to_numpy()], [ns.values.to_numpy()]
                for olds, news in steps:
                    tokens, (moved, moves) = merge(tokens, weights, olds, news)
                    found.append(moved)
                    sums.append(moves)
                index = summed(np.concatenate(found), np.concatenate(sums))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tokens.tobytes()], pa.binary()), pa.array([weights.tobytes()], pa.binary()),
                     *[_lists([part], pa.int64()) for part in (*index, moved, moves)]],
                    names=["tokens", "weights", "pairs", "counts", "moved", "moves"])

    small_batches(blocks.sparkSession)
    kept = blocks.select("tokens", "weights", "pairs", "counts")
    return kept.mapInArrow(run, f"{BLOCK}, moved array<bigint>, moves array<bigint>")


def pair_totals(blocks: DataFrame) -> DataFrame:
    """(pair, n) over all blocks, from their indexes."""
    return blocks.selectExpr("inline(arrays_zip(pairs, counts)) as (pair, n)").groupBy("pair").agg(F.sum("n").alias("n"))


def changes(blocks: DataFrame) -> DataFrame:
    """(pair, n) of what the last merges changed."""
    rows = blocks.selectExpr("inline(arrays_zip(moved, moves)) as (pair, n)")
    return rows.groupBy("pair").agg(F.sum("n").alias("n")).where("n <> 0")
