"""All jobs of a genome beside its counts: one row per genome, whose batches are worked on as arrays.

A genome has one count per term and one job per target, so a row is bounded by the vocabulary and the number of targets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, functions as F, types as T

from helixbag.session import bounded_broadcast, small_batches

# Entries of feature vectors that are put together at once, about 100 bytes each.
BLOCK_ENTRIES = 1 << 19


def genome_rows(base_tf: DataFrame, changes: DataFrame, jobs: DataFrame, model) -> DataFrame:
    """(genome, jobs, counts, changes): ``jobs`` an array of structs of the other job columns, ``counts`` of (idx, n, idf) and
    ``changes`` of (target, idx, n, idf) structs, of known terms. Changes come as rows (genome, target, term, tf), or as lists
    (genome, target, idx, n, idf) that one target and contig bring; these stay lists, and may name a term again."""
    vocab = bounded_broadcast(model.vocab.select("term", "idx", "idf"), model.size)
    base = base_tf.join(jobs.select("genome").distinct(), "genome", "left_semi").join(vocab, "term")
    entry = [F.col("idx").cast("bigint").alias("idx"), F.col("tf").cast("bigint").alias("n"), "idf"]
    counts = base.groupBy("genome").agg(F.collect_list(F.struct(*entry)).alias("counts"))
    found = F.struct("target", "idx", "n", "idf") if "term" not in changes.columns else F.struct("target", *entry)
    known = changes.join(vocab, "term") if "term" in changes.columns else changes
    moved = known.groupBy("genome").agg(F.collect_list(found).alias("changes"))
    each = jobs.groupBy("genome").agg(F.collect_list(F.struct(*[c for c in jobs.columns if c != "genome"])).alias("jobs"))
    joined = each.join(counts, "genome", "left").join(moved, "genome", "left")
    return joined.select("genome", "jobs", *[
        F.coalesce(c, F.array().cast(joined.schema[c].dataType)).alias(c) for c in ("counts", "changes")])


def _listed(column: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    """The row of each struct of a list column, and the fields of the structs."""
    return pc.list_parent_indices(column).to_numpy(), column.flatten().flatten()


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of the ranges that begin at ``starts``, one after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _added(job: np.ndarray, idx: np.ndarray, n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, ...]:
    """Changes with one entry per job and term, in their order, those that cancel left out."""
    cells, firsts, where = np.unique(job * (idx.max(initial=0) + 1) + idx, return_index=True, return_inverse=True)
    total = np.bincount(where, n, len(cells)).astype(np.int64)
    held = firsts[total != 0]
    return job[held], idx[held], total[total != 0], idf[held]


@dataclass
class GenomeJobs:
    """A batch of genome rows: ``of`` is the row of each job, ``counts`` are (row, idx, n, idf), and ``changes`` are
    (job, idx, n, idf), in order of jobs."""

    genome: pa.Array
    of: np.ndarray
    fields: dict[str, pa.Array]
    counts: tuple[np.ndarray, ...]
    changes: tuple[np.ndarray, ...]

    @staticmethod
    def read(batch: pa.RecordBatch) -> GenomeJobs:
        of, found = _listed(batch.column("jobs"))
        fields = dict(zip([f.name for f in batch.schema.field("jobs").type.value_type], found))
        row, counts = _listed(batch.column("counts"))
        at, (target, *change) = _listed(batch.column("changes"))
        # A change belongs to every job of its genome and target.
        named = pa.concat_arrays([fields["target"], target]).dictionary_encode()
        codes = named.indices.fill_null(-1).to_numpy()
        width = len(named.dictionary) + 2
        wanted = of * width + np.where(codes[: len(of)] < 0, width - 2, codes[: len(of)])
        given = at * width + np.where(codes[len(of) :] < 0, width - 1, codes[len(of) :])
        if pa.types.is_list(change[0].type):
            given = given[pc.list_parent_indices(change[0]).to_numpy()]
            change = [c.flatten() for c in change]
        order = np.argsort(given, kind="stable")
        given = given[order]
        starts = np.searchsorted(given, wanted)
        sizes = np.searchsorted(given, wanted, side="right") - starts
        places = order[_ranges(starts, sizes)]
        changes = (np.repeat(np.arange(len(of)), sizes), *[c.to_numpy()[places] for c in change])
        return GenomeJobs(
            batch.column("genome"), of, fields, (row, *[c.to_numpy() for c in counts]), _added(*changes))

    def norms2(self) -> tuple[np.ndarray, np.ndarray]:
        """The squared norm of each genome, and how each job shifts it: by its changed terms alone."""
        row, idx, n, idf = self.counts
        job, moved, by, weight = self.changes
        size = max(idx.max(initial=0), moved.max(initial=0)) + 1
        keys = row * size + idx
        order = np.argsort(keys, kind="stable")
        keys, held = np.append(keys[order], -1), np.append(n[order], 0)
        at = np.searchsorted(keys[:-1], self.of[job] * size + moved)
        old = np.where(keys[at] == self.of[job] * size + moved, held[at], 0)
        shift = ((old + by) ** 2 - old**2) * weight * weight
        return (np.bincount(row, (n * idf) ** 2, len(self.genome)), np.bincount(job, shift, len(self.of)))

    def vectors(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """Feature vectors of jobs from, to: where each begins, and the indices and weights of all. Whole vectors are put
        together, so the norm is that of what remains."""
        row, idx, n, idf = self.counts
        job, moved, by, weight = self.changes
        sizes, changed = np.bincount(row, minlength=len(self.genome)), np.bincount(job, minlength=len(self.of))
        heads, firsts = np.cumsum(sizes) - sizes, np.append(0, np.cumsum(changed))
        size = max(idx.max(initial=0), moved.max(initial=0)) + 1
        ends = np.cumsum(sizes[self.of] + changed)
        begin = 0
        while begin < len(self.of):
            done = ends[begin - 1] if begin else 0
            end = max(int(np.searchsorted(ends, done + BLOCK_ENTRIES, side="right")), begin + 1)
            mine, its = self.of[begin:end], slice(firsts[begin], firsts[end])
            places = _ranges(heads[mine], sizes[mine])
            owner = np.concatenate([np.repeat(np.arange(end - begin), sizes[mine]), job[its] - begin])
            keys = owner * size + np.concatenate([idx[places], moved[its]])
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else order
            total = np.add.reduceat(np.concatenate([n[places], by[its]])[order], starts) if len(keys) else keys
            present = total > 0
            keys, total = keys[starts][present], total[present]
            amount = total * np.concatenate([idf[places], weight[its]])[order][starts][present]
            owner = keys // size
            norm = np.sqrt(np.bincount(owner, amount * amount, end - begin))
            offsets = np.append(0, np.cumsum(np.bincount(owner, minlength=end - begin)))
            yield begin, end, offsets, keys % size, amount / norm[owner]
            begin = end


def job_vectors(rows: DataFrame, jobs: DataFrame, size: int) -> DataFrame:
    """The jobs of genome rows with their feature vectors."""
    names = jobs.columns
    schema = T.StructType([*jobs.schema.fields, T.StructField("features", VectorUDT())])

    def batches(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrived:
            held = GenomeJobs.read(batch)
            for begin, end, offsets, indices, values in held.vectors():
                starts, n = pa.array(offsets, pa.int32()), end - begin
                features = pa.StructArray.from_arrays(
                    [pa.array(np.zeros(n, dtype=np.int8)), pa.array(np.full(n, size, dtype=np.int32)),
                     pa.ListArray.from_arrays(starts, pa.array(indices, pa.int32())),
                     pa.ListArray.from_arrays(starts, pa.array(values, pa.float64()))], names=["type", "size", "indices", "values"])
                columns = [held.genome.take(pa.array(held.of[begin:end])) if c == "genome" else held.fields[c].slice(begin, n) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, features], names=[*names, "features"])

    small_batches(rows.sparkSession)
    return rows.mapInArrow(batches, schema)
