"""Near-duplicate documents by bottom-k sketches from one hash function, confirmed by exact Jaccard.

A document's set holds its distinct shingles of SHINGLE words. Documents with equal sets form a class, and only a class's
first document goes on. Its sketch holds the K smallest shingle hashes. Inverted lists over runs of RUN neighbouring
retained values (over the whole circle of values where the sketch is the set) bring together documents that overlap: a pair
at similarity 0.8 misses all lists with a chance of about 1e-11, and never where both sets fit their sketches. Short lists
give all their pairs. Long lists give pairs with three hubs (fewest shingles, smallest id, smallest hash). Pairs are
filtered by the similarity of the union sketch, each document's best pair is confirmed on whole sets first, and then all
pairs whose ends are still apart.

Long lists may still hold linked documents apart. All their documents that are not yet in one component meet once more in
a prefix join: rarest shingles first, two sets of the wanted similarity share one of their first n - ceil(0.8 n) + 1. Its pairs
pass the union sketches too, which a linked pair fails with a chance of about 1e-9. Shingles are compared by 64-bit hashes that
are made from BLAKE2b hashes of their words.

Defined results: a null or blank text has an empty set, is linked with nothing and kept; a null key is linked with nothing,
has no component and is kept; rows of one key are one document whose texts are all linked; an empty table gives an empty
table; extra columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from helixbag.llm.components import components
from helixbag.llm.words import Words, flat, mix, slices, small_batches, span_hashes
from helixbag.session import materialize

K, RUN = 64, 3
# Lists up to this length give all pairs; longer ones go through hubs and the exact join.
SHORT = 8
# Kinds of third hubs of long lists.
HUBS = 4
# Sketch similarity from which a pair is confirmed; six standard deviations below 0.8.
LIKELY = 0.5


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes (63 bits) of each text, flat, and where each text's begin."""
    found = Words(data, offsets)
    hashes = found.hashes(lower=True)
    texts = len(offsets) - 1
    count = np.diff(found.first)
    starts = np.arange(max(0, len(hashes) - size + 1))
    starts = starts[found.text[starts] == found.text[starts + size - 1]] if len(starts) else starts
    short = np.flatnonzero((count > 0) & (count < size))
    starts = np.concatenate([starts, found.first[short]])
    owner = np.concatenate([found.text[starts[: len(starts) - len(short)]], short]).astype(np.int64)
    ends = np.concatenate([starts[: len(starts) - len(short)] + size, found.first[short] + count[short]])
    values = span_hashes(hashes, starts, ends) >> np.uint64(1)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(texts + 1))


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc, n (set size), d1 and d2 (digests of the set) and the bottom-K sketch of (doc_id, text) rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            values, first = shingle_sets(data, offsets, shingle)
            n = np.diff(first)

            def summed(of: np.ndarray) -> np.ndarray:
                sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(of, dtype=np.uint64)])
                return (sums[first[1:]] - sums[first[:-1]]).view(np.int64)

            kept = np.arange(len(values)) - np.repeat(first[:-1], n) < K
            ends = np.concatenate([[0], np.cumsum(np.minimum(n, K))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(n), pa.array(summed(mix(values + np.uint64(1)))),
                 pa.array(summed(mix(values ^ np.uint64(0x5851F42D4C957F2D)))),
                 pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(values[kept].view(np.int64)))],
                names=["doc", "n", "d1", "d2", "sketch"])

    return docs.mapInArrow(run, "doc bigint, n bigint, d1 bigint, d2 bigint, sketch array<bigint>")


def list_keys(firsts: DataFrame) -> DataFrame:
    """(key, doc, n) for every run of retained values; sets below four shingles are only like their equals."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketch = batch.column("sketch")
            ends = sketch.offsets.to_numpy().astype(np.int64)
            values = sketch.values.to_numpy(zero_copy_only=False).view(np.uint64)
            n = batch.column("n").to_numpy()
            size = np.diff(ends)
            # A set that fits its sketch closes to a circle.
            runs = np.where(size < 4, 0, np.where(n <= K, size, size - RUN + 1))
            owner = np.repeat(np.arange(len(n)), runs)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
            key = np.zeros(len(owner), dtype=np.uint64)
            for step in range(RUN):
                key = mix(key + values[ends[:-1][owner] + (at + step) % size[owner]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), batch.column("doc").take(pa.array(owner)), pa.array(n[owner])],
                names=["key", "doc", "n"])

    return firsts.mapInArrow(run, "key bigint, doc bigint, n bigint")


def likely(pairs: DataFrame, firsts: DataFrame) -> DataFrame:
    """Pairs (a, b) with the similarity ``estimate`` of their union sketch, from LIKELY on."""
    left = firsts.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = firsts.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").where("least(na, nb) * 100 >= greatest(na, nb) * 80")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            sizes = zip(batch.column("na").to_pylist(), batch.column("nb").to_pylist())
            lists = [batch.column(c) for c in ("sa", "sb")]
            limits = [c.offsets.to_numpy() for c in lists]
            flats = [c.values.to_numpy(zero_copy_only=False) for c in lists]
            for i, (na, nb) in enumerate(sizes):
                x, y = (flats[k][limits[k][i] : limits[k][i + 1]] for k in (0, 1))
                top = min([s[-1] for s, n in ((x, na), (y, nb)) if n > K], default=None)
                if top is not None:
                    x, y = x[: np.searchsorted(x, top, "right")], y[: np.searchsorted(y, top, "right")]
                common = len(np.intersect1d(x, y, assume_unique=True))
                out[i] = common / (len(x) + len(y) - common)
            good = pa.array(out >= LIKELY)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(good), batch.column("b").filter(good), pa.array(out).filter(good)],
                names=["a", "b", "estimate"])

    return joined.mapInArrow(run, "a bigint, b bigint, estimate double")


def confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs whose whole sets reach the similarity."""
    left, right = (texts.select(F.col("doc").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
    joined = pairs.select("a", "b").join(left, "a").join(right, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "ta"):
            x, fx = shingle_sets(data, offsets, shingle)
            y, fy = shingle_sets(*flat(batch.column("tb")), shingle)
            good = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                one, two = x[fx[i] : fx[i + 1]], y[fy[i] : fy[i + 1]]
                common = len(np.intersect1d(one, two, assume_unique=True))
                good[i] = common > 0 and 100 * common >= percent * (len(one) + len(two) - common)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return joined.mapInArrow(run, "a bigint, b bigint")


def _pairs(shared: DataFrame) -> DataFrame:
    """Distinct pairs a < b: all of short lists, and those with the hubs of long ones."""
    short = shared.where(F.col("docs") <= SHORT).groupBy("key").agg(F.collect_set("doc").alias("_docs"))
    ordered = short.select(F.array_sort("_docs").alias("_docs"))
    each = ordered.select(F.posexplode("_docs").alias("_i", "a"), "_docs")
    few = each.select("a", F.explode(F.slice("_docs", F.col("_i") + 2, F.lit(SHORT))).alias("b"))
    many = shared.where(F.col("docs") > SHORT).select("doc", F.explode(F.array("hub_n", "hub_id", "hub_hash")).alias("hub"))
    many = many.where("doc <> hub").select(F.least("doc", "hub").alias("a"), F.greatest("doc", "hub").alias("b"))
    return few.union(many).distinct()


def _prefix_pairs(members: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs of documents of different components that share a shingle of both prefixes: exact, whatever the lists."""
    rows = texts.join(members, "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            values, first = shingle_sets(data, offsets, shingle)
            owner = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(first)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(owner), batch.column("component").take(owner), pa.array(values.view(np.int64))],
                names=["doc", "component", "shingle"])

    held = materialize(rows.mapInArrow(run, "doc bigint, component bigint, shingle bigint"), "dedup-rest")
    seen = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("seen"))
    ordered = held.join(seen, "shingle").groupBy("doc", "component").agg(
        F.array_sort(F.collect_list(F.struct("seen", "shingle"))).alias("_all"))
    n = F.size("_all")
    length = n - F.ceil(n * F.lit(percent) / 100).cast("int") + 1
    first = materialize(ordered.select("doc", "component", n.alias("n"), F.posexplode(
        F.slice("_all", 1, length)["shingle"]).alias("at", "shingle")), "dedup-prefixes")
    mixed = first.groupBy("shingle").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low < _high").select("shingle")
    left = first.join(mixed, "shingle")
    right = left.select("shingle", *[F.col(c).alias(f"_{c}") for c in ("doc", "component", "n", "at")])
    # If this is the first shingle they share, no more than what is left of either set can be common.
    reach = F.least(F.col("n") - F.col("at"), F.col("_n") - F.col("_at")) * (100 + percent) >= (F.col("n") + F.col("_n")) * percent
    met = left.join(right, "shingle").where((F.col("doc") < F.col("_doc")) & (F.col("component") != F.col("_component")) & reach)
    return met.select(F.col("doc").alias("a"), F.col("_doc").alias("b")).distinct()


def _joined(nodes: DataFrame, links: DataFrame, label: str) -> DataFrame:
    """(node, component) after more links, given the components ``_a`` and ``_b`` of their ends.

    Only distinct pairs of components are followed, so the many links between two parts of a large group are one.
    """
    found = components(links.select(F.col("_a").alias("a"), F.col("_b").alias("b")).where("a <> b").distinct(), label)
    further = found.select(F.col("node").alias("component"), F.col("component").alias("_further"))
    moved = nodes.join(further, "component", "left").select("node", F.coalesce("_further", "component").alias("component"))
    return materialize(moved.union(found.join(nodes, "node", "left_anti")), label)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and kept (whether it is the component's first)."""
    if percent < 80:
        # The size filter, LIKELY and the runs are made for 80: they would lose pairs of less likeness.
        raise ValueError("percent must be 80 or more")
    small_batches(docs.sparkSession)
    source = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text"))
    found = materialize(sketches(source, shingle), "sketches")
    sets = found.where("n > 0 and doc is not null").groupBy("d1", "d2", "n").agg(F.min("doc").alias("first"))
    classes = sets.select("d1", "d2", F.col("n").alias("_n"), "first")
    match = (found.d1 == classes.d1) & (found.d2 == classes.d2) & (found.n == F.col("_n"))
    firsts = materialize(found.join(classes, match & (found.doc == F.col("first"))).select("doc", "n", "sketch").distinct(), "firsts")

    keys = list_keys(firsts)
    # The hash of the third hub changes with the key, so a group's lists have several hubs.
    drawn = F.xxhash64("doc", F.pmod("key", F.lit(HUBS)))
    lists = keys.groupBy("key").agg(
        F.count(F.lit(1)).alias("docs"), F.min(F.col("n")).alias("_least"), F.min("doc").alias("hub_id"),
        F.min(drawn).alias("_hash")).where("docs > 1")
    shared = keys.join(lists, "key")
    hubs = shared.groupBy("key").agg(F.min(F.when(F.col("n") == F.col("_least"), F.col("doc"))).alias("hub_n"),
                                     F.min(F.when(drawn == F.col("_hash"), F.col("doc"))).alias("hub_hash"))
    shared = materialize(shared.select("key", "doc", "docs", "hub_id").join(hubs, "key"), "lists")
    pairs = materialize(likely(_pairs(shared), firsts), "pairs")

    # Texts of the documents that may be confirmed: the one time that texts are dealt out.
    long = shared.where(F.col("docs") > SHORT).select("doc")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc")).union(long).distinct()
    texts = materialize(source.join(wanted, "doc", "left_semi"), "texts")

    best = pairs.select("a", "b", "estimate").union(pairs.select(F.col("b"), F.col("a"), "estimate")).groupBy("a").agg(
        F.max_by("b", F.struct("estimate", -F.col("b"))).alias("b"))
    best = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = materialize(confirm(best, texts, shingle, percent), "links")
    # A key with several texts holds their classes together.
    several = found.join(classes, match).groupBy("doc").agg(F.min("first").alias("a"), F.max("first").alias("_high")).where("a < _high")
    held = found.join(classes, match).join(several.select("doc"), "doc").select(F.col("doc").alias("a"), F.col("first").alias("b"))
    nodes = components(links.union(held), "components-1")

    def placed(rows: DataFrame, column: str) -> DataFrame:
        at = nodes.select(F.col("node").alias(column), F.col("component").alias(f"_{column}"))
        return rows.join(at, column, "left").withColumn(f"_{column}", F.coalesce(f"_{column}", column))

    apart = placed(placed(pairs.select("a", "b"), "a"), "b").where("_a <> _b").select("a", "b")
    apart = apart.join(best.withColumn("_tried", F.lit(1)), ["a", "b"], "left").where("_tried is null").select("a", "b")
    nodes = _joined(nodes, placed(placed(materialize(confirm(apart, texts, shingle, percent), "links-2"), "a"), "b"), "components-2")

    members = materialize(placed(shared.where(F.col("docs") > SHORT).select("key", "doc"), "doc"), "long-lists")
    mixed = members.groupBy("key").agg(F.min("_doc").alias("_low"), F.max("_doc").alias("_high")).where("_low < _high").select("key")
    rest = members.join(mixed, "key", "left_semi").select("doc", F.col("_doc").alias("component")).distinct()
    more = materialize(confirm(likely(_prefix_pairs(rest, texts, shingle, percent), firsts), texts, shingle, percent), "links-3")
    nodes = _joined(nodes, placed(placed(more, "a"), "b"), "components-3")

    whole = found.join(classes.withColumnRenamed("n", "_n"), (found.d1.eqNullSafe(classes.d1)) & (found.d2 == classes.d2) & (found.n == F.col("_n")), "left")
    out = whole.select("doc", found.n.alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("first", "doc")).alias("_first"))
    at = nodes.select(F.col("node").alias("_first"), F.col("component"))
    out = out.join(at, "_first", "left").withColumn("component_id", F.coalesce("component", "_first"))
    return out.select(F.col("doc").alias("doc_id"), "n_shingles", "component_id",
                      F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True)).alias("kept"))
