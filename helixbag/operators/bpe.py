"""Subword vocabularies: pair counts, learning merges, encoding and vocabulary statistics."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from helixbag.functions.letters import key_numbers, tally, text_bytes, text_codes
from helixbag.functions.sequence import IUPAC, IUPAC_COMPLEMENT, clean_seq, keep_tokens, reverse_complement
from helixbag.operators.joint_learning import MOST_AHEAD, JointRounds, Sentences, slots
from helixbag.operators.merge_kernel import SLICE_LETTERS, MergeKernel, in_order, text_slices
from helixbag.operators.pair_index import apply_merges, build_blocks, cell_type, changes, few_blocks_at_once, pair_of, pair_totals
from helixbag.session import discard, materialize, small_batches

# The special token, the start alphabet, and the least pair count worth a merge.
SPECIAL = "X"
ALPHABET = ("A", "C", "G", "T")
MIN_FREQUENCY = 5

# Most candidate pairs looked at per learning round and most merges applied in one.
ROUND_CANDIDATES = 1_000
ROUND_MERGES = 200
# Most pairs whose counts are known between rounds.
KNOWN_PAIRS = 100_000
# Merges that are learned by one job a round.
FEW_MERGES = 32
MAX_KEY = (1 << 63) - 1
# Batches of merges that a round repeats at most; then the blocks are written anew.
CUT_EVERY = 10
# Longest merge list that is applied as a fold of string replacements.
FOLD_MERGES = 300


@dataclass(frozen=True)
class BpeModel:
    """Token strings by id, and the merges in rank order as (left, right) token strings."""

    tokens: tuple[str, ...]
    merges: tuple[tuple[str, str], ...]

    def vocabulary(self, spark) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.tokens)), "idx long, term string")

    def to_json(self) -> dict:
        """The ``model`` part of a tokenizer file: token to id map and merges."""
        return {"model": {"type": "BPE", "vocab": {t: i for i, t in enumerate(self.tokens)},
                          "merges": [list(m) for m in self.merges]}}

    @staticmethod
    def from_json(data: dict) -> BpeModel:
        vocab = data["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
        return BpeModel(tuple(sorted(vocab, key=vocab.get)), tuple(merges))


def _symbols(wrapped: Column) -> Column:
    """The symbols of a wrapped string."""
    return F.filter(F.split(wrapped, r"\|"), lambda s: s != "")


def _letters(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)(.)", r"|$1|")


def bpe_pair_counts(corpus: DataFrame, text: str = "sentence", weight: str | None = None) -> DataFrame:
    """Occurrences of each pair of neighbouring letters over a corpus."""
    return _count_pairs(corpus.select(_letters(F.col(text)).alias("state"),
                                      (F.col(weight) if weight else F.lit(1)).alias("n")))


def _count_pairs(state: DataFrame) -> DataFrame:
    """Counts of neighbouring symbols, combined before the shuffle."""
    # SQL text keeps the many small round trips of expression building out of the learning loop.
    return (
        state.selectExpr("n", "split(substr(state, 2, length(state) - 2), '[|][|]') as t")
        .selectExpr("n", "t", "greatest(size(t) - 1, 0) as m")
        .selectExpr("n", "inline(arrays_zip(slice(t, 1, m), slice(t, 2, m))) as (left, right)")
        .groupBy("left", "right").agg(F.expr("cast(sum(n) as bigint) as n"))
    )


def _exact_batch(ranked: list[tuple[int, int, int]], tokens: list[str], complete: bool) -> list[tuple[int, int]]:
    """The longest run of top pairs whose one-by-one merging would pick exactly these pairs.

    ``ranked`` holds (left, right, count), greatest count first and lower ids first on ties. Merging (a, b)
    changes only counts of pairs that end in a or start with b, and every new pair occurs at most as often as
    such a neighbour did. So the next pair stays the greatest while it overlaps no chosen pair and outnumbers
    every neighbour of a chosen pair.
    """
    known = set(tokens)
    chosen: list[tuple[int, int]] = []
    lefts: set[int] = set()
    rights: set[int] = set()
    for i, (a, b, count) in enumerate(ranked):
        if chosen:
            if a in rights or b in lefts:
                break
            # The list is sorted, so a neighbour as frequent as this pair can only follow it on equal count.
            level, neighbour = i, False
            while level < len(ranked) and ranked[level][2] == count:
                x, y, _ = ranked[level]
                neighbour = neighbour or y in lefts or x in rights
                level += 1
            if neighbour or (level == len(ranked) and not complete):
                break
        chosen.append((a, b))
        lefts.add(a)
        rights.add(b)
        merged = tokens[a] + tokens[b]
        # A pair of equal symbols can meet itself, and a token made before gains counts: recount after both.
        if a == b or merged in known or len(chosen) == ROUND_MERGES:
            break
        known.add(merged)
    return chosen


class BlockRounds:
    """What learning asks of the corpus, answered by one Spark job a round over indexed blocks (``pair_index``).

    Blocks are read from files and never cached: a round repeats the batches since the blocks were written last.
    """

    def __init__(self, sentences: DataFrame, ids: dict[str, int], vocab_size: int):
        self.kind = cell_type(max(vocab_size, len(ids)))
        self.stored = materialize(build_blocks(sentences, ids, self.kind), "bpe")
        self.past: list[list[tuple[int, int, int]]] = []

    def _write(self) -> None:
        if self.past:
            now = apply_merges(self.stored, self.past[-1], self.past[:-1], self.kind).select(self.stored.columns)
            before, self.stored, self.past = self.stored, materialize(now, "bpe"), []
            discard(before)

    def frequent(self, least: int, most: int) -> Iterator[tuple[int, int]]:
        """The ``most`` most frequent pairs of at least ``least`` occurrences, in order."""
        self._write()
        rows = pair_totals(self.stored).where(f"n >= {int(least)}").orderBy(F.desc("n"), "pair").limit(most).collect()
        return ((r["pair"], r["n"]) for r in rows)

    def apply(self, batch: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
        """Merge the pairs of a batch, none of which overlaps another; gives the changes of pair counts."""
        if len(self.past) == CUT_EVERY:
            self._write()
        now = apply_merges(self.stored, batch, self.past, self.kind)
        self.past = [*self.past, batch]
        # At most the pairs beside a merged token: four vocabularies for each merge.
        return iter(changes(now).collect())


def bpe_train(corpus: DataFrame, vocab_size: int, min_frequency: int = MIN_FREQUENCY,
              text: str = "sentence") -> BpeModel:
    """Learn merges: join the most frequent pair until the vocabulary is full or no pair is frequent enough.

    Equal counts go to the pair of lower token ids; ids are the special token, the letters in order, then
    merges as they come. Sentences stay distributed. A round applies every merge that strict order is certain to take next
    and learns how pair counts changed. Where many merges are wanted, all rounds are one barrier stage whose tasks keep their
    sentences (``joint_learning``); for few, or where the session does not tell how many tasks run at once, each round is one
    job over blocks with an index of their pairs (``pair_index``).

    Only the KNOWN_PAIRS most frequent pairs are known. A pair beyond them can only lose occurrences, as only pairs with
    a new token gain some, so the list stays right until its pairs fall behind the place where it ended; then, or after
    a merge spelled an older token, it is counted again.
    """
    sentences = corpus.groupBy(F.col(text).alias("sentence")).agg(F.count(F.lit(1)).alias("n")).where("sentence <> ''")
    # The distinct letters of a corpus are few by nature: after cleaning, the bases and X.
    letters = [r[0] for r in sentences.select(F.explode(F.array_distinct(F.split("sentence", ""))).alias("c"))
               .where("c <> ''").distinct().collect()]
    tokens = [SPECIAL] + sorted((set(letters) | set(ALPHABET)) - {SPECIAL})
    ids = {token: i for i, token in enumerate(tokens)}
    spark, merges = corpus.sparkSession, []
    tasks = slots(spark) if vocab_size - len(tokens) > FEW_MERGES else 0
    if tasks:
        found = _learn_jointly(sentences, tokens, ids, vocab_size, min_frequency, tasks)
        for a, b, made in found:
            merges.append((tokens[a], tokens[b]))
            if made == len(tokens):
                tokens.append(tokens[a] + tokens[b])
    else:
        with few_blocks_at_once(spark):
            rounds = BlockRounds(sentences, ids, vocab_size)
            merges = [(tokens[a], tokens[b]) for a, b, _ in _learn(rounds, tokens, ids, vocab_size, min_frequency, KNOWN_PAIRS)]
            discard(rounds.stored)
    return BpeModel(tuple(tokens), tuple(merges))


def _learn_jointly(sentences: DataFrame, tokens: list[str], ids: dict[str, int], vocab_size: int, min_frequency: int,
                   tasks: int) -> list[tuple[int, int, int]]:
    """The merges as (left, right, made) ids, learned in one barrier stage of so many tasks; the first one reports them."""
    most = KNOWN_PAIRS

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Sentences(batches, ids, vocab_size)
        merges = _learn_ahead(JointRounds(held, ids, vocab_size), list(tokens), dict(ids), vocab_size, min_frequency, most)
        if BarrierTaskContext.get().partitionId() == 0:
            columns = list(zip(*merges)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "made"])

    small_batches(sentences.sparkSession)
    rows = sentences.select("sentence", "n").repartition(tasks).mapInArrow(learn, "a long, b long, made long", barrier=True)
    # One row per merge, a parameter.
    return [tuple(r) for r in rows.collect()]


def _top(known: dict[int, int], end: tuple[int, int], most: int) -> list[tuple[int, int]]:
    """The most frequent pairs up to a place in the order, as (pair, count)."""
    pairs, ns = np.fromiter(known, np.int64, len(known)), np.fromiter(known.values(), np.int64, len(known))
    inside = (ns > -end[0]) | ((ns == -end[0]) & (pairs <= end[1]))
    if len(ns) > most:
        inside &= ns >= np.partition(ns, -most)[-most]
    pairs, ns = pairs[inside], ns[inside]
    order = np.lexsort((pairs, -ns))[:most]
    return list(zip(pairs[order].tolist(), ns[order].tolist()))


def _known_pairs(rounds, least: int, most: int) -> tuple[dict[int, int], tuple[int, int], bool]:
    """The most frequent pairs with their counts, the place in the order where they end, and whether they are all."""
    found = list(rounds.frequent(least, most + 1))
    if len(found) <= most:
        return dict(found), (-least, MAX_KEY), True
    return dict(found[:most]), (-found[most - 1][1], found[most - 1][0]), False


def _follow(known: dict[int, int], end: tuple[int, int], first: int, moved: Iterable[tuple[int, int]]) -> None:
    """Bring the known counts up to date; pairs with a token from ``first`` on are new."""
    for pair, n in moved:
        if pair in known or max(pair_of(pair)) >= first:
            known[pair] = known.get(pair, 0) + n
            if (-known[pair], pair) > end:
                del known[pair]


def _learn(rounds: BlockRounds, tokens: list[str], ids: dict[str, int], vocab_size: int, min_frequency: int,
           most: int) -> list[tuple[int, int, int]]:
    """The merges as (left, right, made) ids, by batches that are certain; ``tokens`` and ``ids`` grow with them."""
    merges: list[tuple[int, int, int]] = []
    known, end, whole = _known_pairs(rounds, min_frequency, most)
    while len(tokens) < vocab_size:
        top = _top(known, end, ROUND_CANDIDATES)
        if not top and not whole:
            known, end, whole = _known_pairs(rounds, min_frequency, most)
            continue
        if not top:
            break
        ranked = [(*pair_of(pair), n) for pair, n in top]
        batch, first, again = [], len(tokens), False
        for a, b in _exact_batch(ranked, tokens, complete=whole and len(ranked) < ROUND_CANDIDATES):
            if len(tokens) >= vocab_size:
                break
            merged = tokens[a] + tokens[b]
            again = again or merged in ids
            if merged not in ids:
                ids[merged] = len(tokens)
                tokens.append(merged)
            batch.append((a, b, ids[merged]))
        merges += batch
        if len(tokens) >= vocab_size:
            break
        _follow(known, end, first, rounds.apply(batch))
        if again:
            known, end, whole = _known_pairs(rounds, min_frequency, most)
    return merges


def _learn_ahead(rounds: JointRounds, tokens: list[str], ids: dict[str, int], vocab_size: int, min_frequency: int,
                 most: int) -> list[tuple[int, int, int]]:
    """The merges as (left, right, made) ids, by guesses that are checked one by one; ``tokens`` and ``ids`` grow with them."""
    merges: list[tuple[int, int, int]] = []
    known, end, whole = _known_pairs(rounds, min_frequency, most)
    ahead = 8
    while len(tokens) < vocab_size:
        top = _top(known, end, ROUND_CANDIDATES)
        if not top and not whole:
            known, end, whole = _known_pairs(rounds, min_frequency, most)
            continue
        if not top:
            break
        # Pairs outside the list come after this place and can only lose, unless they are new and so join the list.
        floor = (-top[-1][1], top[-1][0]) if len(top) == ROUND_CANDIDATES else end
        near, first, taken, again = dict(top), len(tokens), [], False
        guesses = rounds.guess(near, floor, min(ahead, vocab_size - len(tokens)), tokens, ids)
        for (a, b, made), moved in zip(guesses, rounds.apply(guesses)):
            best = min(((-n, pair) for pair, n in near.items()), default=None)
            if best is None or best > floor or pair_of(best[1]) != (a, b):
                break
            again = made < len(tokens)
            if not again:
                ids[tokens[a] + tokens[b]] = made
                tokens.append(tokens[a] + tokens[b])
            taken.append((a, b, made))
            for pair, n in moved:
                if pair in near or max(pair_of(pair)) >= first:
                    near[pair] = near.get(pair, 0) + n
            _follow(known, end, first, moved)
        merges += taken
        rounds.keep(taken, len(tokens))
        ahead = min(2 * len(taken) + 4, MOST_AHEAD)
        if again:
            known, end, whole = _known_pairs(rounds, min_frequency, most)
        elif len(known) > 2 * most:
            kept = _top(known, end, most)
            known, end, whole = dict(kept), (-kept[-1][1], kept[-1][0]), False
    return merges


def fold_encode(text: Column, merges: list[tuple[str, str]] | tuple[tuple[str, str], ...]) -> Column:
    """Tokens of a text by applying each merge to the whole text in rank order, as string replacements."""
    made = [a + b for a, b in merges]
    if len(set(made)) != len(made):
        # A token that two merges make may appear after a merge that uses it has been applied.
        raise ValueError("the fold is exact only when every merge makes a token of its own")
    steps = F.array(*[
        F.struct(F.lit(f"|{a}||{b}|").alias("old"), F.lit(f"|{a}{b}|").alias("new")) for a, b in merges
    ])
    # The mask symbol is a special token: it never joins a merge.
    if any(SPECIAL in a + b for a, b in merges):
        raise ValueError("merges with the special token never apply; drop them first")
    return _symbols(F.aggregate(steps, _letters(text), lambda s, m: F.replace(s, m["old"], m["new"])))


def _segment_tokens(segment: str, rank: dict[tuple[str, str], int]) -> list[str]:
    """Merge the pair of least rank, leftmost first, until none is left (a linked list and a heap)."""
    sym: list[str | None] = list(segment)
    n = len(sym)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = [(rank[p], i) for i in range(n - 1) if (p := (sym[i], sym[i + 1])) in rank]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        j = after[i] if sym[i] is not None else n
        if j >= n or rank.get((sym[i], sym[j])) != r:
            continue
        sym[i], sym[j] = sym[i] + sym[j], None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            if (q := (sym[i], sym[after[i]])) in rank:
                heapq.heappush(heap, (rank[q], i))
        if before[i] >= 0 and (q := (sym[before[i]], sym[i])) in rank:
            heapq.heappush(heap, (rank[q], before[i]))
    return [s for s in sym if s is not None]


def heap_encode(text: Column, model: BpeModel, spark) -> Column:
    """Tokens of a text for long merge lists: an Arrow UDF that merges each segment between mask symbols by a heap of
    ranks."""
    # At most the vocabulary size, a parameter of the model.
    shared = spark.sparkContext.broadcast({m: i for i, m in reversed(list(enumerate(model.merges)))})

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rank = shared.value
        for texts in batches:
            yield texts.map(lambda s: None if s is None else [
                t for part in s.split(SPECIAL) for t in _segment_tokens(part, rank)])

    return encode(text)


def kernel_encode(text: Column, model: BpeModel, spark) -> Column:
    """Tokens of a text for long merge lists whose ranks rise: an Arrow function that merges whole batches at once."""
    # At most the vocabulary size, a parameter of the model.
    shared = spark.sparkContext.broadcast(model.merges)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from MergeKernel(shared.value, SPECIAL).encode_batches(batches)

    return encode(text)


# What a letter becomes by cleaning, and on the other strand. A run of other capitals is one mask symbol after cleaning; here
# it stays a run, which no token holds either.
CLEANED = np.arange(128, dtype=np.uint32)
CLEANED[[c for c in range(ord("A"), ord("Z") + 1) if chr(c) not in ALPHABET]] = ord(SPECIAL)
OTHER_STRAND = np.arange(128, dtype=np.uint32)
OTHER_STRAND[[ord(c) for c in IUPAC]] = [ord(c) for c in IUPAC_COMPLEMENT]


def _changed(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    if codes.dtype == np.uint8:
        return table.astype(np.uint8)[codes]
    return np.where(codes < 128, table[np.minimum(codes, 127)], codes)


def _strands(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code points of the cleaned texts and then of their other strands, where each begins and ends, and the row of each."""
    codes, offsets = text_codes(texts)
    cleaned, rows = _changed(codes, CLEANED), np.arange(len(texts))
    yield cleaned, offsets, rows
    yield _changed(cleaned, OTHER_STRAND)[::-1], offsets[-1] - offsets[::-1], rows[::-1]


def _split_long(texts: pa.Array) -> tuple[pa.Array, np.ndarray | None]:
    """The texts of a slice, a long one cut at its mask symbols, and the row of each part."""
    if len(texts) > 1 or not texts[0].is_valid or len(texts[0].as_py()) <= SLICE_LETTERS:
        return texts, None
    parts = texts[0].as_py().split(SPECIAL)
    return pa.array(parts, pa.string()), np.zeros(len(parts), dtype=np.int64)


class ModelTokenizer:
    """Maps a text column to its token array by a merge list whose ranks rise, and contigs to the tokens of both strands."""

    def __init__(self, merges: Sequence[tuple[str, str]], column):
        self.merges, self.column = tuple(merges), column

    def __call__(self, text: Column) -> Column:
        return self.column(text)

    def rows(self, contigs: DataFrame, keys: Sequence[str]) -> DataFrame:
        """(keys, term): a row for each token of both strands that is longer than two letters and has no mask symbol."""
        return self._strand_tokens(contigs, keys, False)

    def counts(self, contigs: DataFrame, keys: Sequence[str]) -> DataFrame:
        """(keys, term, n): these rows counted per batch, to be added up by Spark."""
        return self._strand_tokens(contigs, keys, True)

    def _strand_tokens(self, contigs: DataFrame, keys: Sequence[str], counted: bool) -> DataFrame:
        # At most the vocabulary size, a parameter of the model.
        shared = contigs.sparkSession.sparkContext.broadcast(self.merges)
        fields = [*[contigs.schema[k] for k in keys], T.StructField("term", T.StringType())]
        schema = T.StructType([*fields, T.StructField("n", T.LongType())] if counted else fields)

        def batches(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kernel = MergeKernel(shared.value, SPECIAL)
            long = np.append([len(t) > 2 for t in kernel.tokens], [False, False])
            words = kernel.vocabulary([])
            for batch in arrived:
                number, some = key_numbers(batch, keys)
                texts = batch.column("seq")
                for begin, end in text_slices(text_bytes(texts)[1]):
                    part, at = _split_long(texts.slice(begin, end - begin))
                    for codes, offsets, rows in _strands(part):
                        symbols, counts, _ = kernel.symbols(codes, offsets)
                        # Letters that no merge has are tokens of one letter.
                        kept = long[np.minimum(symbols, len(long) - 1)]
                        row = np.repeat(begin + (rows if at is None else at[rows]), counts)[kept]
                        symbols = symbols[kept]
                        if counted:
                            group, symbols, n = tally(number[row], symbols, len(some), len(long))
                            row = some[group]
                        taken = pa.array(row)
                        columns = [*[batch.column(k).take(taken) for k in keys], words.take(pa.array(symbols))]
                        names = [*[batch.schema.field(k) for k in keys], pa.field("term", pa.string())]
                        if counted:
                            columns.append(pa.array(n, pa.int64()))
                            names.append(pa.field("n", pa.int64()))
                        yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(names))

        small_batches(contigs.sparkSession)
        return contigs.select(*keys, "seq").mapInArrow(batches, schema)


def bpe_tokenizer(model: BpeModel, spark):
    """A function from a text column to its token array; the mask symbol splits the text beforehand."""
    usable = tuple(m for m in model.merges if SPECIAL not in m[0] + m[1])
    unique = len({a + b for a, b in usable}) == len(usable)
    plain = BpeModel(model.tokens, usable)

    def tokenize(text: Column) -> Column:
        if len(usable) <= FOLD_MERGES and unique:
            return fold_encode(text, usable)
        return kernel_encode(text, plain, spark) if in_order(usable) else heap_encode(text, plain, spark)

    return ModelTokenizer(usable, tokenize) if in_order(usable) else tokenize


def bpe_encode(contigs: DataFrame, model: BpeModel, keys: tuple[str, ...] = ("genome", "contig_idx")) -> DataFrame:
    """Filtered tokens of each cleaned contig and its reverse complement, one row each.

    Segments between mask symbols are encoded separately, so the work on a long contig is split there.
    """
    tokenize = bpe_tokenizer(model, contigs.sparkSession)
    if isinstance(tokenize, ModelTokenizer):
        return tokenize.rows(contigs, keys)
    cleaned = contigs.select(*keys, clean_seq(F.col("seq")).alias("_f"))
    strands = cleaned.select(*keys, F.explode(F.array("_f", reverse_complement(F.col("_f")))).alias("_s"))
    segments = strands.select(*keys, F.explode(F.split("_s", SPECIAL)).alias("_s")).where("_s <> ''")
    return segments.select(*keys, F.explode(keep_tokens(tokenize(F.col("_s")))).alias("term"))


def vocabulary_stats(vocab: DataFrame, least: int = 3, long: int = 8) -> DataFrame:
    """Length statistics of the words of at least three letters; of equal modes the smallest is given."""
    lengths = vocab.select(F.length("term").cast("bigint").alias("len")).where(F.col("len") >= least)
    n_long = F.count_if(F.col("len") > long)
    return lengths.agg(
        F.count(F.lit(1)).alias("n_words"), F.min("len").alias("min_len"), F.max("len").alias("max_len"),
        F.avg("len").alias("mean_len"), F.stddev_samp("len").alias("std_len"), F.median("len").alias("median_len"),
        F.mode("len", True).alias("mode_len"), n_long.alias("n_long"),
        (n_long.cast("double") / F.count(F.lit(1)) * 100).alias("pct_long"),
    )
