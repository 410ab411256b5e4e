"""k-mers, token streams, term counts and TF-IDF as long (genome, term) tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from helixbag.functions.letters import key_numbers, tally, text_bytes, walled
from helixbag.functions.ranks import alphabetical_index
from helixbag.functions.sequence import clean_seq, keep_tokens, reverse_complement
from helixbag.session import bounded_broadcast, small_batches

# Vocabulary size of each k-mer model and its smallest and largest k, both included.
KMER_VOCABULARIES = {
    64: (3, 3),
    320: (3, 4),
    1344: (3, 5),
    5440: (3, 6),
    21824: (3, 7),
    87360: (3, 8),
}

# Spark walks a string from its start to reach a position, so windows are cut from short pieces: each level
# costs about (size of the level above) / (2 * own size) steps per base.
PIECES = (32_768, 1_024, 32)

CONTIG_KEYS = ("genome", "contig_idx")

# Letters that a task cuts into k-mers where texts are dealt out; its groups then fit its memory.
LETTERS_PER_TASK = 1 << 20
# From this k on a genome has hardly fewer distinct windows than letters, so texts are dealt out and not windows.
DEALT_FROM = 6
# Letters whose windows a task numbers at once, about 40 bytes each.
WINDOW_LETTERS = 1 << 20
# Letters whose k-mers of all lengths a task counts at once, up to 200 bytes each.
KMER_LETTERS = 1 << 18
# Most words that a task lists to number them; beyond, windows stay texts.
LISTED_WORDS = 1 << 17
# Rows of counts that a task hands over at once.
ROWS_AT_ONCE = 1 << 16
# Types whose equal values are the same Arrow value, so that a task can tell where the next key begins.
PLAIN_KEYS = (T.StringType(), T.LongType(), T.IntegerType(), T.ShortType(), T.ByteType(), T.BooleanType(), T.DateType())


def kmer_bound(k_min: int, k_max: int) -> int:
    return sum(4 ** k for k in range(k_min, k_max + 1))


def kmer_universe(spark, k_min: int, k_max: int) -> DataFrame:
    """All words over A, C, G, T of k_min to k_max letters: base-4 digits of a number range."""
    words = None
    for k in range(k_min, k_max + 1):
        digits = F.lpad(F.conv(F.col("id").cast("string"), 10, 4), k, "0")
        part = spark.range(4 ** k).select(F.translate(digits, "0123", "ACGT").alias("term"))
        words = part if words is None else words.unionByName(part)
    return words


def _pieces(rows: DataFrame, size: int, overlap: int) -> DataFrame:
    """Cut ``text`` into pieces whose own range is ``size`` letters plus ``overlap`` letters of the next one.

    ``own`` is the number of window starts that belong to a row; it is cut along.
    """
    starts = F.sequence(F.lit(0), F.col("own") - 1, F.lit(size))
    cut = rows.withColumn("_at", F.explode(starts))
    return (
        cut.withColumn("text", F.substring("text", F.col("_at") + 1, F.lit(size + overlap)))
        .withColumn("own", F.least(F.col("own") - F.col("_at"), F.lit(size)))
        .drop("_at")
    )


def _windows(contigs: DataFrame, k_min: int, k_max: int, keys: Sequence[str]) -> DataFrame:
    """One row per start position of each run of bases: the window of k_max letters, shorter near the end of the run.

    Windows with another letter hold no k-mer, so splitting at other letters first leaves only bases to cut.
    """
    runs = contigs.select(*keys, F.explode(F.split("seq", "[^ACGT]+")).alias("text"))
    pieces = runs.withColumn("own", F.length("text") - (k_min - 1)).where("own > 0")
    for size in PIECES:
        pieces = _pieces(pieces, size, k_max - 1)
    starts = pieces.withColumn("_p", F.explode(F.sequence(F.lit(1), F.col("own"))))
    return starts.select(*keys, F.substring("text", F.col("_p"), F.lit(k_max)).alias("window"))


def _prefixes(windows: DataFrame, k_min: int, k_max: int) -> DataFrame:
    """Every k-mer that starts where a window starts: the prefixes of the window."""
    if k_min == k_max:
        return windows.withColumnRenamed("window", "term")
    sized = windows.withColumn("_k", F.explode(F.sequence(F.lit(k_min), F.length("window"))))
    return sized.withColumn("term", F.substring("window", F.lit(1), F.col("_k"))).drop("window", "_k")


def deal_out(contigs: DataFrame, keys: Sequence[str] = CONTIG_KEYS) -> DataFrame:
    """Contigs dealt out by their keys over as many tasks as their letters need.

    Counting k-mers per key then needs no further shuffle: a letter is moved once, instead of a row per k-mer. One pass over
    the lengths sets the number of tasks.
    """
    letters = contigs.agg(F.sum(F.length("seq").cast("bigint"))).first()[0] or 0
    tasks = max(contigs.sparkSession.sparkContext.defaultParallelism, letters // LETTERS_PER_TASK + 1)
    return contigs.repartition(tasks, *keys)


def kmer_extract(contigs: DataFrame, k_min: int, k_max: int, keys: Sequence[str] = CONTIG_KEYS) -> DataFrame:
    """One row per k-mer occurrence over A, C, G, T inside each contig, for every k from k_min to k_max."""
    return _prefixes(_windows(contigs, k_min, k_max, keys), k_min, k_max)


def _text_slices(batch: pa.RecordBatch, overlap: int, letters: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The texts of a batch, about ``letters`` or WINDOW_LETTERS letters at a time: the first row, bytes, and offsets. A longer
    text comes in parts, each but the last with ``overlap`` letters of the next one."""
    data, offsets = text_bytes(batch.column("seq"))
    row, letters = 0, letters or WINDOW_LETTERS
    while row < batch.num_rows:
        stop = max(int(np.searchsorted(offsets, offsets[row] + letters, side="right")) - 1, row + 1)
        low, high = int(offsets[row]), int(offsets[stop])
        if stop == row + 1:
            for at in range(low, high, letters):
                part = data[at : min(at + letters + overlap, high)]
                yield row, part, np.array([0, len(part)])
        else:
            yield row, data[low:high], offsets[row : stop + 1] - low
        row = stop


def kmer_words(k_min: int, k_max: int) -> list[str]:
    """The words of each length in order, so that a word is numbered by its length and its letters as base-4 digits."""
    return ["".join(w) for k in range(k_min, k_max + 1) for w in product("ACGT", repeat=k)]


def tally_windows(batch: pa.RecordBatch, number: np.ndarray, n_groups: int, k_min: int, k_max: int) -> tuple[np.ndarray, ...]:
    """(group, window, count) of the texts of a batch whose groups are ``number``; a window is numbered as in ``kmer_words``."""
    first = {k: kmer_bound(k_min, k - 1) for k in range(k_min, k_max + 1)}
    digit = np.full(256, 4, dtype=np.uint8)
    digit[[65, 67, 71, 84]] = range(4)
    found = [(np.zeros(0, dtype=np.int64),) * 3]
    for row, data, offsets in _text_slices(batch, k_max - 1):
        own = np.full(len(data), True)
        if len(offsets) == 2 and len(data) > WINDOW_LETTERS:
            own[WINDOW_LETTERS:] = False
        digits = walled(digit[data], offsets, 4)
        whole = walled(own, offsets, False)
        group = np.repeat(number[row : row + len(offsets) - 1], np.diff(offsets) + 1)
        fits, value, window = whole[:-1] & True, np.zeros(len(digits) - 1, dtype=np.int64), None
        for k in range(1, k_max + 1):
            fits, value = fits[: len(digits) - k], value[: len(digits) - k]
            next_digit = digits[k - 1 : len(digits) - 1]
            fits = fits & (next_digit < 4)
            value = value * 4 + next_digit
            if k == k_min:
                window, kept = np.where(fits, value, -1), fits
            elif k > k_min:
                window[: len(fits)][fits] = first[k] + value[fits]
        if window is None or not len(window):
            continue
        held = np.flatnonzero(kept)
        found.append(tally(group[held], window[held], n_groups, kmer_bound(k_min, k_max)))
    return tuple(np.concatenate(c) for c in zip(*found))


def _counted_windows(contigs: DataFrame, k_min: int, k_max: int, keys: Sequence[str]) -> DataFrame:
    """(keys, window, n): the rows of ``_windows`` counted per key of a batch, which Spark then adds up."""
    schema = T.StructType([*[contigs.schema[k] for k in keys], T.StructField("window", T.StringType()), T.StructField("n", T.LongType())])

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(kmer_words(k_min, k_max), pa.string())
        for batch in rows:
            number, some = key_numbers(batch, keys)
            groups, found, counts = tally_windows(batch, number, len(some), k_min, k_max)
            if len(groups):
                taken = pa.array(some[groups])
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).take(taken) for k in keys], words.take(pa.array(found)), pa.array(counts, pa.int64())],
                    schema=pa.schema(
                        [*[batch.schema.field(k) for k in keys], pa.field("window", pa.string()), pa.field("n", pa.int64())]))

    small_batches(contigs.sparkSession)
    return contigs.select(*keys, "seq").mapInArrow(batches, schema)


def tally_kmers(data: np.ndarray, offsets: np.ndarray, own: int, groups: np.ndarray, k_min: int,
                k_max: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, word, count) of the k-mers of some texts that start in their first ``own`` letters; a word is numbered as in
    ``kmer_words``. Windows are sorted once, as the k-mers of every length then stand in order."""
    digit = np.full(256, 4, dtype=np.uint8)
    digit[[65, 67, 71, 84]] = range(4)
    digits = walled(digit[data], offsets, 4)
    fits, window, size = np.arange(len(digits)) <= own, np.zeros(len(digits), dtype=np.int64), np.zeros(len(digits), dtype=np.int64)
    for k in range(k_max):
        following = digits[k:]
        fits[: len(following)] &= following < 4
        fits[len(following) :] = False
        window <<= 2
        window[: len(following)] |= following * fits[: len(following)]
        size += fits
    held = np.flatnonzero(size >= k_min)
    owner = np.repeat(groups, np.diff(offsets) + 1)
    # Group, window filled up with zeros, and its length in one number.
    keys = (owner[held] << 2 * k_max | window[held]) << 6 | size[held]
    keys.sort()
    found = []
    for k in range(k_min, k_max + 1):
        starts = keys[(keys & 63) >= k] >> 6 + 2 * (k_max - k)
        first = np.flatnonzero(np.append(True, starts[1:] != starts[:-1]))[: len(starts)]
        words = starts[first]
        found.append((words >> 2 * k, (words & (1 << 2 * k) - 1) + kmer_bound(k_min, k - 1), np.diff(first, append=len(starts))))
    return tuple(np.concatenate(c) for c in zip(*found))


def _counted_kmers(contigs: DataFrame, k_min: int, k_max: int, keys: Sequence[str]) -> DataFrame:
    """(keys, term, tf), one row for each k-mer of a key. All rows of a key stand in one partition, one after the other.

    A key that goes on is kept as one number for each word, so a key may be larger than what a task looks at.
    """
    schema = T.StructType([*[contigs.schema[k] for k in keys], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(kmer_words(k_min, k_max), pa.string())
        sums, last = np.zeros(len(words), dtype=np.int64), None

        def out(owners: pa.RecordBatch, places: np.ndarray, found: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(found), ROWS_AT_ONCE):
                some = slice(at, at + ROWS_AT_ONCE)
                taken = owners.take(pa.array(places[some]))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, words.take(pa.array(found[some])), pa.array(counts[some], pa.int64())],
                    names=[*keys, "term", "tf"])

        def close() -> Iterator[pa.RecordBatch]:
            found = np.flatnonzero(sums)
            yield from out(last, np.zeros(len(found), dtype=np.int64), found, sums[found])
            sums[:] = 0

        for batch in rows:
            if not batch.num_rows:
                continue
            owners = batch.select(list(keys))
            both = owners if last is None else pa.Table.from_batches([last, owners]).combine_chunks().to_batches()[0]
            number, _ = key_numbers(both, keys)
            begins = np.append(True, number[1:] != number[:-1])[-batch.num_rows :]
            # The key of the batch before is group 0, those that begin here follow.
            group = np.cumsum(begins)
            firsts = np.append(0, np.flatnonzero(begins))
            now = 0
            for row, data, offsets in _text_slices(batch, k_max - 1, KMER_LETTERS):
                own = KMER_LETTERS if len(offsets) == 2 else len(data) + len(offsets)
                groups, found, counts = tally_kmers(data, offsets, own, group[row : row + len(offsets) - 1], k_min, k_max)
                end = int(group[row + len(offsets) - 2])
                again = groups == now
                sums[found[again]] += counts[again]
                if end > now:
                    if last is not None:
                        yield from close()
                    whole = (groups > now) & (groups < end)
                    yield from out(owners, firsts[groups[whole]], found[whole], counts[whole])
                    opened = groups == end
                    sums[found[opened]] += counts[opened]
                    now, last = end, owners.slice(int(firsts[end]), 1)
        if last is not None:
            yield from close()

    small_batches(contigs.sparkSession)
    return contigs.select(*keys, "seq").mapInArrow(batches, schema)


def window_prefixes(windows: np.ndarray, k_min: int, k_max: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-mers that start where numbered windows start: the place of the window, and the number of the k-mer."""
    ends = np.array([kmer_bound(k_min, k) for k in range(k_min, k_max + 1)])
    length = k_min + np.searchsorted(ends, windows, side="right")
    value = windows - np.append(0, ends)[length - k_min]
    places, words = [], []
    for k in range(k_min, k_max + 1):
        held = np.flatnonzero(length >= k)
        places.append(held)
        words.append(kmer_bound(k_min, k - 1) + value[held] // 4 ** (length[held] - k))
    return np.concatenate(places), np.concatenate(words)


def kmer_counts(contigs: DataFrame, k_min: int, k_max: int, keys: Sequence[str] = ("genome",),
                sign: Column | None = None) -> DataFrame:
    """Term counts of all k-mers without making one row per k.

    Windows of the largest k are counted first, per batch of texts and then before the shuffle; shorter k-mers are prefixes of
    the few distinct windows that remain. The second step is partitioned by the keys alone, so a later
    per-genome step needs no further shuffle; a genome brings one row per distinct window there, which the
    vocabulary bounds. For a large k, where combining saves little, the contigs themselves are dealt out by the keys, and a task
    counts all k-mers of a key at once.
    """
    listed = kmer_bound(k_min, k_max) <= LISTED_WORDS and all(
        k in contigs.columns and contigs.schema[k].dataType in PLAIN_KEYS for k in keys)
    if sign is None and k_max >= DEALT_FROM and listed:
        return _counted_kmers(deal_out(contigs, keys).sortWithinPartitions(*keys), k_min, k_max, keys)
    carried = contigs if sign is None else contigs.withColumn("_sign", sign)
    if k_max >= DEALT_FROM:
        carried = deal_out(carried, keys)
    extra = [] if sign is None else ["_sign"]
    if k_max >= DEALT_FROM:
        windows = _windows(carried, k_min, k_max, [*keys, *extra])
        amount = F.count(F.lit(1)) if sign is None else F.sum("_sign")
    else:
        windows = _counted_windows(carried, k_min, k_max, [*keys, *extra])
        amount = F.sum("n") if sign is None else F.sum(F.col("n") * F.col("_sign"))
    counted = windows.groupBy(*keys, "window").agg(amount.alias("n"))
    if k_min == k_max:
        return counted.select(*keys, F.col("window").alias("term"), F.col("n").alias("tf"))
    terms = _prefixes(counted if k_max >= DEALT_FROM else counted.repartition(*keys), k_min, k_max)
    return terms.groupBy(*keys, "term").agg(F.sum("n").alias("tf"))


def token_rows(contigs: DataFrame, tokenize: Callable[[Column], Column],
               keys: Sequence[str] = CONTIG_KEYS) -> DataFrame:
    """Tokens of each cleaned contig and of its reverse complement, filtered, one row each.

    ``tokenize`` maps a sequence column to an array of strings. Strands are split first, so a row never holds
    the tokens of both.
    """
    cleaned = contigs.select(*keys, clean_seq(F.col("seq")).alias("_forward"))
    strands = cleaned.select(*keys, F.explode(F.array("_forward", reverse_complement(F.col("_forward")))).alias("_s"))
    return strands.select(*keys, F.explode(keep_tokens(tokenize(F.col("_s")))).alias("term"))


def token_filter(tokens: DataFrame, col: str = "term") -> DataFrame:
    return tokens.where((F.length(col) > 2) & ~F.contains(F.col(col), F.lit("X")))


def term_counts(tokens: DataFrame, keys: Sequence[str] = ("genome",)) -> DataFrame:
    """Occurrences of each term per key, combined before the shuffle."""
    return tokens.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def binary_tf(tf: DataFrame) -> DataFrame:
    return tf.withColumn("tf", F.least(F.col("tf"), F.lit(1)))


def document_frequency(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def min_max_df_filter(df: DataFrame, n_docs: Column, min_df: int | float = 1, max_df: int | float = 1.0) -> DataFrame:
    """Terms whose document frequency lies in a range. An int is a count of documents, a float a share of them."""
    def bound(limit):
        return F.lit(limit) if isinstance(limit, int) else F.lit(limit) * n_docs

    return df.where((F.col("df") >= bound(min_df)) & (F.col("df") <= bound(max_df)))


def idf_fit(tf: DataFrame, documents: DataFrame | None = None, min_df: int | float = 1,
            max_df: int | float = 1.0, bound: int | None = None) -> DataFrame:
    """Vocabulary (term, idx, df, idf) of training counts; idf = ln((1 + n) / (1 + df)) + 1.

    ``documents`` lists the training genomes in column ``genome``; without it, genomes that have a term are
    counted. ``idx`` is the alphabetical position; ``bound`` is the proven size of the vocabulary.
    """
    listed = tf if documents is None else documents
    n = listed.agg(F.count_distinct("genome")).scalar()
    kept = document_frequency(tf)
    if (min_df, max_df) != (1, 1.0):
        kept = min_max_df_filter(kept, n, min_df, max_df)
    idf = F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1.0
    return alphabetical_index(kept, "term", bound=bound).select(
        "term", F.col("idx").cast("bigint").alias("idx"), "df", idf.alias("idf")
    )


def vocab_lookup(tf: DataFrame, vocab: DataFrame, bound: int | None = None) -> DataFrame:
    """Keep terms of the vocabulary and attach their index and idf.

    ``bound`` is the proven size of the vocabulary; within the broadcast limit the counts are not shuffled.
    """
    return tf.join(bounded_broadcast(vocab.select("term", "idx", "idf"), bound), "term")


def tfidf_transform(tf: DataFrame, vocab: DataFrame, bound: int | None = None,
                    keys: Sequence[str] = ("genome",)) -> DataFrame:
    """Weights tf * idf scaled to unit length per genome, as (genome, idx, term, tfidf).

    The norm is a window over the genome's rows, one per vocabulary term, so a group is never larger than
    the vocabulary and counts that are already partitioned by genome are not shuffled again.
    """
    weighted = vocab_lookup(tf, vocab, bound).withColumn("_w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(*keys)))
    return weighted.select(*keys, "idx", "term", (F.col("_w") / norm).alias("tfidf"))


def variance_threshold(tfidf: DataFrame, n_docs: Column, threshold: float = 0.0) -> DataFrame:
    """Features whose population variance over all documents, absent ones being zero, exceeds the threshold."""
    # Squares around the mean of the present values, plus the part between them and the absent zeros: a constant
    # feature gives exactly 0.
    held, mean = F.count(F.lit(1)), F.avg("tfidf")
    variance = (F.var_pop("tfidf") * held + mean * mean * held * (n_docs - held) / n_docs) / n_docs
    return tfidf.groupBy("idx").agg(variance.alias("variance")).where(F.col("variance") > threshold)


def zip_importances(vocab: DataFrame, importances: DataFrame) -> DataFrame:
    """Words with their feature importance, joined on index, greatest first."""
    return (
        vocab.select("idx", F.col("term").alias("word")).join(importances, "idx")
        .select("word", "importance").orderBy(F.desc("importance"), "word")
    )
