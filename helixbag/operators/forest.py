"""Boosted trees scored again only where a knockout changes them.

All jobs of a genome meet its features once. The trees are walked on the whole genome, and for each the range of norms is kept
within which its walk stays the same, because a knockout rescales every weight through the norm. A job then walks only the
trees that split on one of its changed features, found by an index, and those whose range its norm has left.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F, types as T

from helixbag.operators.genome_jobs import GenomeJobs
from helixbag.session import scratch_path, small_batches

# Norms this close to the end of a range, relatively, count as outside it, so that rounding decides nothing.
NEAR = 1e-9
LEAF = -1
# Jobs scored at once hold about so many features, and walk about so many trees.
BLOCK_CELLS = 1 << 18


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees as arrays; ``feature`` is a place in ``used``, the vocabulary indices that any tree splits on."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    used: np.ndarray
    idf: np.ndarray
    trees_of: tuple[np.ndarray, ...]

    @staticmethod
    def from_nodes(nodes: Sequence[tuple[int, int, int, int, int, float, float]], idf: dict[int, float]) -> Forest:
        """From (tree, node, left, right, index, threshold, value) rows; node 0 is a root, a leaf has index LEAF. A weight of at
        most the threshold goes left. ``idf`` is by index; one without it never has weight."""
        rows = sorted(nodes)
        place = {(r[0], r[1]): i for i, r in enumerate(rows)}
        used = sorted({r[4] for r in rows if r[4] != LEAF})
        at = {index: i for i, index in enumerate(used)}
        trees = sorted({r[0] for r in rows})
        number = {tree: i for i, tree in enumerate(trees)}
        splits: list[set[int]] = [set() for _ in used]
        for r in rows:
            if r[4] != LEAF:
                splits[at[r[4]]].add(number[r[0]])
        # A leaf leads to itself, so that trees of any depth can be walked together.
        return Forest(
            np.array([place[t, 0] for t in trees], dtype=np.int64),
            np.array([at.get(r[4], LEAF) for r in rows], dtype=np.int64),
            np.array([r[5] for r in rows], dtype=float),
            np.array([place[r[0], r[2]] if r[4] != LEAF else i for i, r in enumerate(rows)], dtype=np.int64),
            np.array([place[r[0], r[3]] if r[4] != LEAF else i for i, r in enumerate(rows)], dtype=np.int64),
            np.array([r[6] for r in rows], dtype=float),
            np.array(used, dtype=np.int64), np.array([idf.get(i, 0.0) for i in used], dtype=float),
            tuple(np.array(sorted(s), dtype=np.int64) for s in splits),
        )

    @staticmethod
    def from_model(classifier: PipelineModel, vocab: DataFrame) -> Forest:
        """The trees of a fitted classifier. The number of nodes is bounded by the model's parameters."""
        spark = vocab.sparkSession
        selector, boosted = classifier.stages
        path = scratch_path(spark, "forest")
        boosted.write().save(path)
        kept, weights = selector.selectedFeatures, boosted.treeWeights
        split = F.col("nodeData.split")
        rows = spark.read.parquet(f"{path}/data").select(
            "treeID", "nodeData.id", "nodeData.leftChild", "nodeData.rightChild", "nodeData.prediction",
            split["featureIndex"].alias("feature"), F.get(split["leftCategoriesOrThreshold"], 0).alias("threshold")).collect()
        nodes = []
        for r in rows:
            inner = r["leftChild"] >= 0
            nodes.append((r["treeID"], r["id"], r["leftChild"], r["rightChild"], int(kept[r["feature"]]) if inner else LEAF,
                          r["threshold"] if inner else 0.0, r["prediction"] * weights[r["treeID"]]))
        used = spark.createDataFrame([(i,) for i in sorted({n[4] for n in nodes if n[4] != LEAF})], "idx long")
        # At most one row per node.
        idf = {r["idx"]: r["idf"] for r in vocab.join(F.broadcast(used), "idx").select("idx", "idf").collect()}
        return Forest.from_nodes(nodes, idf)

    @cached_property
    def splits(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the trees of each used feature begin in one list of all, and the list."""
        sizes = [len(t) for t in self.trees_of]
        return np.cumsum([0, *sizes]), np.concatenate([np.zeros(0, dtype=np.int64), *self.trees_of])

    def walk(self, trees: np.ndarray, rows: np.ndarray, amounts: np.ndarray, norms: np.ndarray):
        """Values of trees, each for the weights amounts[row] / norm, and the ends of the range of norms with the same walk."""
        node = self.roots[trees]
        low, high = np.zeros(len(trees)), np.full(len(trees), np.inf)
        scale = np.where(norms > 0, norms, 1.0)
        while len(self.used):
            feature = self.feature[node]
            inner = feature != LEAF
            if not inner.any():
                break
            amount = np.where(inner, amounts[rows, feature], 0.0)
            threshold = self.threshold[node]
            goes_left = amount / scale <= threshold
            # Without the feature, or at a threshold that no weight reaches from above, the norm changes nothing.
            bound = inner & (amount > 0) & (threshold > 0)
            edge = np.divide(amount, threshold, out=np.zeros(len(trees)), where=bound)
            low = np.where(bound & goes_left, np.maximum(low, edge), low)
            high = np.where(bound & ~goes_left, np.minimum(high, edge), high)
            node = np.where(inner, np.where(goes_left, self.left[node], self.right[node]), node)
        return self.value[node], low, high

    def touched(self, jobs: np.ndarray, changed: np.ndarray, norms: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Marks the trees that each job must walk: those that split on a feature it changes, and those whose range its norm has
        left. ``changed`` are places of features, ``jobs`` the rows that change them."""
        marks = (norms[:, None] < low * (1 + NEAR)) | (norms[:, None] > high * (1 - NEAR))
        starts, listed = self.splits
        sizes = starts[changed + 1] - starts[changed]
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        marks[np.repeat(jobs, sizes), listed[np.repeat(starts[changed], sizes) + within]] = True
        return marks

    def score(self, norm2: float, counts: Sequence[tuple[int, int]],
              jobs: Sequence[tuple[float, Sequence[tuple[int, int]]]]) -> Iterator[float]:
        """Margin of each job of a genome. ``counts`` are its (index, count) pairs of used features; a job has the shift of
        the squared norm and the changes of such counts."""
        held = [(0, *pair) for pair in counts]
        changes = [(j, *pair) for j, (_, pairs) in enumerate(jobs) for pair in pairs]

        def columns(rows):
            return tuple(np.array([r[i] for r in rows], dtype=np.int64) for i in range(3))

        shifts = np.array([shift for shift, _ in jobs], dtype=float)
        yield from self.score_many(np.array([norm2], dtype=float), columns(held), np.zeros(len(jobs), dtype=np.int64), shifts,
                                   columns(changes)).tolist()

    def score_many(self, norm2: np.ndarray, counts: tuple[np.ndarray, ...], of: np.ndarray, shifts: np.ndarray,
                   changes: tuple[np.ndarray, ...]) -> np.ndarray:
        """Margins of the jobs of many genomes. ``counts`` are (genome, index, count), ``of`` is the genome of each job, in order,
        and ``changes`` are (job, index, change), in order of jobs."""
        out, step = np.zeros(len(of)), max(1, BLOCK_CELLS // max(len(self.used), len(self.roots), 1))
        for begin in range(0, len(of), step):
            end = min(begin + step, len(of))
            first, last = int(of[begin]), int(of[end - 1]) + 1
            mine = slice(*np.searchsorted(counts[0], [first, last]))
            its = slice(*np.searchsorted(changes[0], [begin, end]))
            out[begin:end] = self._block(
                norm2[first:last], (counts[0][mine] - first, counts[1][mine], counts[2][mine]), of[begin:end] - first,
                shifts[begin:end], (changes[0][its] - begin, changes[1][its], changes[2][its]))
        return out

    def _block(self, norm2, counts, of, shifts, changes) -> np.ndarray:
        n, trees = len(norm2), len(self.roots)
        held = np.zeros((n, len(self.used)))
        held[counts[0], np.searchsorted(self.used, counts[1])] = counts[2]
        norms = np.sqrt(norm2)
        values, low, high = self.walk(
            np.tile(np.arange(trees), n), np.repeat(np.arange(n), trees), held * self.idf, np.repeat(norms, trees))
        values, low, high = values.reshape(n, trees), low.reshape(n, trees), high.reshape(n, trees)
        after = np.sqrt(np.maximum(norm2[of] + shifts, 0.0))
        at, amounts = np.searchsorted(self.used, changes[1]), held[of]
        amounts[changes[0], at] = np.maximum(amounts[changes[0], at] + changes[2], 0)
        amounts *= self.idf
        marks = self.touched(changes[0], at, after, low[of], high[of])
        marks[~((after > 0) & (norms[of] > 0))] = True
        job, tree = np.nonzero(marks)
        scored = values[of]
        scored[job, tree] = self.walk(tree, job, amounts, after[job])[0]
        return scored.sum(axis=1)


def score_jobs(genomes: DataFrame, forest: Forest) -> DataFrame:
    """(genome, target, probability) of the jobs of ``genome_rows``."""
    # At most a few numbers per node of the model.
    shared = genomes.sparkSession.sparkContext.broadcast(forest)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = shared.value.used
        for batch in rows:
            held = GenomeJobs.read(batch)
            norm2, shift = held.norms2()
            counts, changes = [
                tuple(c[np.isin(columns[1], used)] for c in columns[:3]) for columns in (held.counts, held.changes)]
            margins = shared.value.score_many(norm2, counts, held.of, shift, changes)
            # Two margins are the log odds of Spark's boosted trees.
            yield pa.RecordBatch.from_arrays(
                [held.genome.take(pa.array(held.of)), held.fields["target"], pa.array(1 / (1 + np.exp(-2 * margins)), pa.float64())],
                schema=pa.schema([batch.schema.field("genome"), pa.field("target", pa.string()), pa.field("probability", pa.float64())]))

    schema = T.StructType([T.StructField("genome", genomes.schema["genome"].dataType), T.StructField("target", T.StringType()),
                           T.StructField("probability", T.DoubleType())])
    small_batches(genomes.sparkSession)
    return genomes.mapInArrow(batches, schema)
