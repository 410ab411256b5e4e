"""Repeated passages by compaction of a de Bruijn graph of word windows.

Edges are windows of WINDOW consecutive words. Each window has an anchor, the run of ANCHOR words in it with the least hash,
and equal windows have equal anchors at equal places, so the anchors are the graph's nodes. A piece is a stretch of
neighbouring windows of one document with one anchor: a path of edges without a branch inside that document.

1. Pieces are cut in one pass over the texts. Anchors that occur in a single document are dropped by a grouped minimum and
   maximum, and the rest are joined back: only repeated pieces go on, wherever they stand.
2. Pieces with equal words form a class with its first document. An anchor with one class does not branch: the class is a
   compacted path, settled as a whole. At a branching anchor the windows of each class are read once, from the source
   coordinates of its first occurrence, and joined by their hashes to find the first document of every single window.
3. Joined to all occurrences, windows with an earlier document mark the words that they cover, and those words go.

Anchors and pieces (or windows) are compared by two 64-bit hashes together, made from BLAKE2b hashes of the words. A class, an anchor or a passage may
fill most of the corpus: counts are pre-aggregated, and joins have one row per class on the other side, which Spark splits.

Defined results: a null text has no words; rows with a null key neither lose words nor count as earlier; rows of one key
never remove each other's words, and each keeps its own result; texts of any length are read whole; an empty table gives an
empty table; extra columns are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from helixbag.llm.words import SPACE, Words, slices, small_batches, span_hashes
from helixbag.session import materialize

WINDOW, ANCHOR = 50, 12


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbouring keys."""
    span = 1
    while span * 2 <= width:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    rest = width - span
    return np.minimum(keys[:-rest], keys[rest:]) if rest else keys


def cut(found: Words, hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Pieces as (text, first window, windows, anchor hash, piece hash), windows being counted over the whole slice."""
    none = np.zeros(0, dtype=np.int64)
    if len(hashes) < window:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    at = np.arange(len(hashes) - anchor + 1)
    marks = span_hashes(hashes, at, at + anchor)
    # The place in the low half makes the leftmost of equal anchors the least.
    order = (marks >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    place = (_least(order, window - anchor + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.flatnonzero(found.text[: len(hashes) - window + 1] == found.text[window - 1 :])
    if not len(start):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    place = place[start]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(start)))
    first, place = start[head], place[head]
    words = span_hashes(hashes, first, first + count + window - 1)
    piece = words ^ ((place - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return found.text[first], first, count, marks[place], piece


def pieces(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(anchor, piece, n, doc, text_hash, start) of (doc, text_hash, text) rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            found = Words(data, offsets)
            owner, first, count, mark, piece = cut(found, found.hashes(), window, anchor)
            rows = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [pa.array(mark.view(np.int64)), pa.array(piece.view(np.int64)), pa.array(count.astype(np.int32)),
                 batch.column("doc").take(rows), batch.column("text_hash").take(rows),
                 pa.array((first - found.first[owner]).astype(np.int32))],
                names=["anchor", "piece", "n", "doc", "text_hash", "start"])

    return docs.mapInArrow(run, "anchor bigint, piece bigint, n int, doc bigint, text_hash bigint, start int")


def kept_text(found: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the kept words of each text, joined by one space."""
    data = np.where(SPACE[found.data], np.uint8(0x20), found.data)
    step = np.zeros(len(data) + 1, dtype=np.int8)
    step[found.starts[keep]] += 1
    step[found.ends[keep]] -= 1
    mask = np.cumsum(step[:-1], dtype=np.int8) > 0
    kept = np.flatnonzero(keep)
    followed = kept[:-1][found.text[kept[:-1]] == found.text[kept[1:]]]
    mask[found.ends[followed]] = True
    sizes = np.concatenate([[0], np.cumsum(mask)])
    return data[mask], sizes[found.offsets]


def _finish(found: Words, keep: np.ndarray, with_text: bool) -> list[pa.Array]:
    data, offsets = kept_text(found, keep)
    raw = data.tobytes()
    texts = [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
    gone = np.bincount(found.text[~keep], minlength=len(found.offsets) - 1)
    out = [pa.array(np.diff(found.first)), pa.array(gone), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
    return [*out, pa.array([t.decode() for t in texts] if with_text else [None] * len(texts), type=pa.string())]


def _window_hashes(firsts: DataFrame, texts: DataFrame, window: int) -> DataFrame:
    """(anchor, piece, n, first, j, window) for every window of the classes, read at their source coordinates."""
    held = firsts.groupBy("first", "text_hash").agg(F.collect_list(F.struct("anchor", "piece", "n", "start")).alias("held"))
    rows = texts.join(held, (texts.doc == held["first"]) & (texts.text_hash == held.text_hash)).select("doc", "text", "held")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            found = Words(data, offsets)
            hashes = found.hashes()
            held = batch.column("held")
            owner = np.repeat(np.arange(batch.num_rows), np.diff(held.offsets.to_numpy()))
            flat = held.flatten()
            n = flat.field("n").to_numpy().astype(np.int64)
            start = flat.field("start").to_numpy().astype(np.int64) + found.first[owner]
            row = np.repeat(np.arange(len(n)), n)
            j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            at = start[row] + j
            each = span_hashes(hashes, at, at + window)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [flat.field("anchor").take(take), flat.field("piece").take(take), flat.field("n").take(take),
                 batch.column("doc").take(pa.array(owner[row])), pa.array(j.astype(np.int32)), pa.array(each.view(np.int64))],
                names=["anchor", "piece", "n", "first", "j", "window"])

    return rows.mapInArrow(run, "anchor bigint, piece bigint, n int, first bigint, j int, window bigint")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR,
                   with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, on request, the kept text."""
    if not 0 < window - anchor < 62:
        raise ValueError("a piece must have fewer than 63 windows: raise anchor or lower window")
    small_batches(docs.sparkSession)
    source = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    every = pieces(source.where("doc is not null"), window, anchor)
    repeated = every.groupBy("anchor").agg(F.min("doc").alias("_low"), F.max("doc").alias("_high")).where("_low < _high").select("anchor")
    # Written first, so that both sides of the join are plain exchanges, of which Spark splits a hot anchor.
    held = materialize(every.join(materialize(repeated, "anchors"), "anchor"), "pieces")

    path = ["anchor", "piece", "n"]
    classes = materialize(
        held.groupBy(*path).agg(F.min(F.struct("doc", "text_hash", "start")).alias("_at"))
        .select(*path, F.col("_at.doc").alias("first"), "_at.text_hash", "_at.start"), "paths")
    nodes = materialize(classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("_classes")), "nodes")
    plain = classes.join(nodes.where("_classes = 1"), "anchor").select(
        *path, "first", F.expr("shiftleft(1L, n) - 1").alias("mask"))
    branching = classes.join(nodes.where("_classes > 1"), "anchor").drop("_classes")

    # Every text is dealt out once: those without a repeated piece are finished here, the others are kept for two reads.
    wanted = held.select(F.col("doc").alias("_doc"), F.col("text_hash").alias("_hash")).distinct()
    split = source.join(wanted, (source.doc == wanted._doc) & (source.text_hash == wanted._hash), "left").select(
        "doc", "text_hash", F.col("_doc").isNotNull().alias("wanted"), "text")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            found = Words(data, offsets)
            columns = _finish(found, np.ones(len(found), dtype=bool), with_text)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc", "text_hash", "wanted", "text")], *columns],
                names=["doc", "text_hash", "wanted", "text", "n_words", "n_removed", "kept_sha256", "kept_text"])

    results = "n_words bigint, n_removed bigint, kept_sha256 string, kept_text string"
    done = split.mapInArrow(finish, f"doc bigint, text_hash bigint, wanted boolean, text string, {results}")
    texts = materialize(done.withColumn("text", F.when(F.col("wanted"), F.col("text"))), "texts")
    open_texts = texts.where("wanted").select("doc", "text_hash", "text")

    edges = materialize(_window_hashes(branching, open_texts, window), "edges")
    earliest = materialize(edges.groupBy("anchor", "window").agg(F.min("first").alias("_first")), "earliest")
    bit = F.expr("shiftleft(1L, j)")
    settled = edges.join(earliest, ["anchor", "window"]).groupBy(*path, F.col("_first").alias("first")).agg(F.bit_or(bit).alias("mask"))
    marks = materialize(plain.union(settled.select(*path, "first", "mask")), "marks")
    gone = held.join(marks, path).where("doc > first").groupBy("doc", "text_hash").agg(
        F.collect_list(F.struct("start", "mask")).alias("gone"))

    left = open_texts.join(gone, ["doc", "text_hash"], "left").select("doc", "text", "gone")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            found = Words(data, offsets)
            lists = batch.column("gone")
            owner = np.repeat(np.arange(batch.num_rows), pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy())
            flat = lists.flatten()
            mask = flat.field("mask").to_numpy()
            start = flat.field("start").to_numpy().astype(np.int64) + found.first[owner]
            row, j = np.nonzero((mask[:, None] >> np.arange(window)) & 1)
            step = np.zeros(len(found) + 1, dtype=np.int64)
            np.add.at(step, start[row] + j, 1)
            np.add.at(step, start[row] + j + window, -1)
            keep = np.cumsum(step[:-1]) == 0
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *_finish(found, keep, with_text)],
                                             names=["doc", "n_words", "n_removed", "kept_sha256", "kept_text"])

    cleaned = left.mapInArrow(remove, f"doc bigint, {results}")
    out = cleaned.union(texts.where("not wanted").select("doc", "n_words", "n_removed", "kept_sha256", "kept_text"))
    out = out.withColumnRenamed("doc", "doc_id")
    return out if with_text else out.drop("kept_text")
