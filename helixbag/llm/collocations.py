"""Phrase collocations by dynamic itemset counting.

Texts are dealt out into SHARDS shards, which are visited in a cycle. A visit counts phrases of all lengths at once: words in
the first cycle, and longer phrases as soon as both their longest parts (without the last and without the first word) have
reached the threshold in what was counted so far. A phrase that becomes active at some visit is counted from the next one on,
in each shard once, until it has completed a full cycle; the visits end when no shard has an active phrase left to count.

Visits count 64-bit keys of phrases, so only numbers are shuffled, and a shared key can only add to a count. Which keys have
reached the threshold goes to the tasks as bitmaps of a bounded size, which can only have bits too many. So nothing of the
threshold's frequency is lost, and a last pass counts the phrases left by their words, exactly; those below the threshold go.

A visit adds to the running counts in one shuffle, and a phrase leaves these when its cycle is complete. Batches are counted
and added up in the worker before anything is shuffled, so a word of a third of all rows is one row for some batches.

Defined results: a null text is empty, a null language ``und``; rows are counted as they come, so repeated rows and null keys
count; ties are ordered by count and phrase; texts of any length are read whole; an empty table gives an empty table; extra
columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from xxhash import xxh3_64_intdigest

from helixbag.llm.words import flat, mix, small_batches
from helixbag.session import checked_broadcast, discard, materialize, scratch_path

SHARDS = 2
# Bits of a bitmap for each document, and the least and most bits (8 MB) of one.
BITS_PER_DOC, LEAST_BITS, MOST_BITS = 64, 1 << 16, 1 << 26

# Rows of exact counts that a worker adds up at once, about 50 MB.
HELD_ROWS = 600_000
# Counts of keys that a worker adds up at once, 16 bytes each and as much again while they are sorted.
HELD_KEYS = 2_000_000

# Bytes in lower case; and by kind: 0 in words, 1 between words, 2 between pieces.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
KIND = np.zeros(256, dtype=np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
COUNTS = "length int, key bigint, n bigint, until int"


class Phrases:
    """Words of some texts: their places among the distinct words, and which words follow each other in a piece."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        data, offsets = flat(texts)
        data = LOWER[data]
        kind = KIND[data]
        inside = kind == 0
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        filled = offsets[1:] > offsets[:-1]
        first, last = offsets[:-1][filled], offsets[1:][filled] - 1
        opens[first[inside[first]]] = True
        closes[last[inside[last]]] = True
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
        piece = np.cumsum(kind == 2, dtype=np.int32)[starts] if len(starts) else starts
        self.next = (self.text[1:] == self.text[:-1]) & (piece[1:] == piece[:-1])
        limits = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(limits), pa.py_buffer(data[inside])]).dictionary_encode()
        self.words = words.dictionary
        self.word = words.indices.to_numpy().astype(np.int64)
        coded = langs.dictionary_encode()
        self.langs = coded.dictionary
        self.lang = coded.indices.to_numpy().astype(np.int64)[self.text]

    def keys(self, longest: int) -> list[np.ndarray]:
        """For each length the keys of the phrases that begin at each word, and where they stay inside a piece."""
        if not len(self.word):
            return [(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))] * longest
        limits = np.frombuffer(self.words.buffers()[1], dtype=np.int64)[: len(self.words) + 1].tolist()
        raw = self.words.buffers()[2].to_pybytes()
        drawn = np.fromiter((xxh3_64_intdigest(raw[a:b]) for a, b in zip(limits, limits[1:])), dtype=np.uint64, count=len(self.words))
        kinds = np.array([xxh3_64_intdigest(lang) for lang in self.langs.to_pylist()], dtype=np.uint64)
        own = mix(drawn[self.word] + kinds[self.lang])
        at, key = np.arange(len(own)), own
        found = [(key, at)]
        for length in range(2, longest + 1):
            whole = np.flatnonzero(self.next[at[at + length - 2 < len(self.next)] + length - 2])
            key, at = mix(key[whole] * np.uint64(0x9E3779B97F4A7C15) + own[at[whole] + length - 1]), at[whole]
            found.append((key, at))
        return found


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order, and how often each occurs."""
    values = np.sort(values)
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    at = np.flatnonzero(new)
    return values[at], np.diff(np.append(at, len(values)))


def _summed(values: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order, and the sums of their counts."""
    order = np.argsort(values)
    values, n = values[order], n[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    at = np.flatnonzero(new)
    return values[at], np.add.reduceat(n, at)


def _has(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    index = keys & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[(index >> np.uint64(6)).astype(np.int64)] >> (index & np.uint64(63))) & np.uint64(1) > 0


def _active(found: list[tuple[np.ndarray, np.ndarray]], length: int, bitmaps: dict[int, np.ndarray]) -> np.ndarray:
    """Which phrases of a length have both longest parts in the bitmap of their length."""
    shorter, at = found[length - 2]
    reached = np.zeros(int(at[-1]) + 2 if len(at) else 1, dtype=bool)
    if length - 1 in bitmaps:
        reached[at] = _has(bitmaps[length - 1], shorter)
    begins = found[length - 1][1]
    return reached[begins] & reached[begins + 1]


def _visit(shard: DataFrame, turn: int, states: list[dict[int, np.ndarray]], shards: int, longest: int) -> DataFrame:
    """(length, key, n, until) of the phrases of a shard that are active and have not been counted in it before, ``until``
    being the visit that completes their cycle."""
    # The state of this visit, of those before it in the cycle, and of the last visit to this shard.
    shared = shard.sparkSession.sparkContext.broadcast(list(reversed(states[-shards - 1 :])))

    def rows(length: int, time: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        ends = np.full(len(keys), turn + shards - time, dtype=np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(keys), length, dtype=np.int32)), pa.array(keys.view(np.int64)), pa.array(n), pa.array(ends)],
            names=["length", "key", "n", "until"])

    def added(held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        for (length, time), parts in held.items():
            yield rows(length, time, *(parts[0] if len(parts) == 1 else _summed(*map(np.concatenate, zip(*parts)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Counts of some batches are added up before they leave the worker.
        held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0
        for batch in batches:
            found = Phrases(batch.column("text"), batch.column("lang")).keys(longest)
            for length, (keys, _) in enumerate(found, 1):
                # Visits in a row, this one included, at which a phrase has been active; words are from the first one on.
                times = np.full(len(keys), turn + 1, dtype=np.int64)
                if length > 1:
                    times[:] = 0
                    for back, state in enumerate(shared.value):
                        times += (times == back) & _active(found, length, state)
                for time in range(1, shards + 1):
                    each, n = _distinct(keys[times == time])
                    if len(each):
                        held.setdefault((length, time), []).append((each, n.astype(np.int64)))
                        size += len(each)
            if size >= HELD_KEYS:
                yield from added(held)
                held, size = {}, 0
        yield from added(held)

    return shard.mapInArrow(run, COUNTS)


def _bitmaps(reached: DataFrame, bits: int, known: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """By length a bitmap of the keys and those known, of at most MOST_BITS bits however many keys there are."""
    index = F.col("key").bitwiseAND(F.lit(bits - 1))
    blocks = reached.groupBy("length", F.shiftrightunsigned(index, 6).alias("block")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), index.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toPandas()
    out = {length: bitmap.copy() for length, bitmap in known.items()}
    for length, rows in blocks.groupby("length"):
        bitmap = out.setdefault(int(length), np.zeros(bits // 64, dtype=np.uint64))
        bitmap[rows["block"].to_numpy()] |= rows["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def _same(one: dict[int, np.ndarray], two: dict[int, np.ndarray], longest: int) -> bool:
    """Whether two states agree in all lengths that activate longer phrases."""
    return all(np.array_equal(one[k], two[k]) if k in one and k in two else (k in one) == (k in two) for k in range(1, longest))


def reached_keys(shards: list[DataFrame], threshold: int, longest: int, bits: int) -> dict[int, np.ndarray]:
    """Bitmaps, by length, of the keys that reach the threshold once every active phrase has completed its cycle."""
    size = len(shards)
    states: list[dict[int, np.ndarray]] = []
    now: dict[int, np.ndarray] = {}
    running: DataFrame | None = None
    # Phrases of each length need one more cycle at most after the shorter ones.
    for turn in range(longest * size):
        states.append(now)
        if turn >= size and _same(now, states[turn - size], longest):
            # Nothing has become active since the last visit to this shard.
            if all(_same(now, state, longest) for state in states[-size:]):
                break
            continue
        counted = _visit(shards[turn % size], turn, states, size, longest)
        rows = counted if running is None else counted.union(running)
        totals = rows.groupBy("length", "key").agg(F.sum("n").alias("n"), F.max("until").alias("until"))
        # Phrases that have completed their cycle below the threshold are done with.
        past, stored = running, materialize(totals.where((F.col("until") > turn) | (F.col("n") >= threshold)), "phrase-counts")
        if past is not None:
            discard(past)
        now = _bitmaps(stored.where(F.col("n") >= threshold), bits, now)
        running = stored.where(F.col("until") > turn)
        running._scratch = stored._scratch
    if running is not None:
        discard(running)
    return now


def exact_counts(docs: DataFrame, bitmaps: dict[int, np.ndarray], longest: int) -> DataFrame:
    """(lang, length, phrase, n) of all phrases whose keys are in the bitmaps; length 0 has the words of each language."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmaps)

    def counted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(batch.column("text"), batch.column("lang"))
        size = len(phrases.words)

        def rows(lang: np.ndarray, length: int, texts: pa.Array, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [phrases.langs.take(pa.array(lang)), pa.array(np.full(len(n), length, dtype=np.int32)), texts.cast(pa.string()),
                 pa.array(n.astype(np.int64))], names=["lang", "length", "phrase", "n"])

        totals = np.bincount(phrases.lang, minlength=len(phrases.langs))
        yield rows(np.arange(len(totals)), 0, pa.array([""] * len(totals), pa.string()), totals)
        for length, (keys, at) in enumerate(phrases.keys(longest), 1):
            if length not in shared.value or not len(keys):
                continue
            at = at[_has(shared.value[length], keys)]
            # Phrases are told apart by the numbers of their words, never by a hash.
            if len(totals) * size**length < 1 << 63:
                code = phrases.lang[at]
                for step in range(length):
                    code = code * size + phrases.word[at + step]
                code, n = _distinct(code)
                parts = []
                for _ in range(length):
                    code, word = np.divmod(code, size)
                    parts.insert(0, word)
                parts.insert(0, code)
            else:
                numbered = np.stack([phrases.lang[at], *[phrases.word[at + step] for step in range(length)]])
                columns, n = np.unique(numbered, axis=1, return_counts=True)
                parts = list(columns)
            texts = [phrases.words.take(pa.array(word)) for word in parts[1:]]
            joined = texts[0] if length == 1 else pc.binary_join_element_wise(*texts, pa.scalar(b" ", pa.large_binary()))
            yield rows(parts[0], length, joined, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows of some batches are added up before they leave the worker.
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held += counted(batch)
            if sum(rows.num_rows for rows in held) >= HELD_ROWS:
                yield from added(held)
                held = []
        if held:
            yield from added(held)

    def added(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        keys = ["lang", "length", "phrase"]
        sums = pa.Table.from_batches(held).group_by(keys, use_threads=False).aggregate([("n", "sum")])
        return sums.select([*keys, "n_sum"]).rename_columns([*keys, "n"]).combine_chunks().to_batches()

    rows = docs.mapInArrow(run, "lang string, length int, phrase string, n bigint")
    return rows.groupBy("lang", "length", "phrase").agg(F.sum("n").alias("n"))


def _part(words: Column, start: int | Column, size: int | Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def scored(counts: DataFrame, threshold: int, share: int, longest: int) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates that no longer candidate stands for."""
    known = counts.where("length > 0").select("lang", "phrase", "n")
    words = F.split("phrase", " ")
    candidates = counts.where((F.col("length") >= 2) & (F.col("n") >= threshold)).select(
        "lang", "phrase", "length", F.col("n").alias("a"), words.alias("words"))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("length") - 1))).select(
        "lang", "phrase", "length", "a", "k", _part(F.col("words"), 1, F.col("k")).alias("first"),
        _part(F.col("words"), F.col("k") + 1, F.col("length") - F.col("k")).alias("rest"))
    for name, column in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(name), F.col("n").alias(column)), ["lang", name])

    def exact(column: str) -> Column:
        return F.col(column).cast("decimal(16,0)")

    # Products of 38 digits, enough for counts up to 10**15 (beyond that Spark raises an error); scores end at 1,000,000.
    value = F.call_function("div", exact("a") * exact("a") * F.lit(1_000_000).cast("decimal(7,0)"), exact("l") * exact("r"))
    best = cuts.withColumn("score", value).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("a").alias("a"), F.first("length").alias("length"))

    inner = F.array(*[F.struct(F.lit(i).alias("start"), F.lit(size).alias("size")) for size in range(2, longest)
                      for i in range(1, longest - size + 2)] or [F.struct(F.lit(1).alias("start"), F.lit(longest).alias("size"))])
    inside = candidates.select("lang", "words", "length", F.col("a").alias("longer"), F.inline(inner).alias("start", "size")).where(
        "size < length and start + size - 1 <= length").select(
        "lang", _part(F.col("words"), F.col("start"), F.col("size")).alias("phrase"), "longer")
    longer = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    totals = checked_broadcast(counts.where("length = 0").select("lang", F.col("n").alias("total")))
    kept = best.join(longer, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(20,0)") < share * F.col("a").cast("decimal(20,0)")))
    return kept.join(totals, "lang").select(
        "lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("total").alias("n"),
        F.col("cut.score").alias("score"))


def _sharded(docs: DataFrame, shards: int, lang: str, text: str) -> list[DataFrame]:
    """The texts with their languages, written once, by shard."""
    spark = docs.sparkSession
    path = scratch_path(spark, "phrase-shards")
    rows = docs.where(F.col(text).isNotNull()).select(
        F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(shards)))
    dealt.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    whole = spark.read.schema("text string, lang string, shard int").parquet(path)
    return [whole.where(F.col("shard") == i).select("text", "lang") for i in range(shards)]


def mine(docs: DataFrame, threshold: int = 10, longest: int = 3, share: int = 50, top: int = 2000, shards: int = SHARDS,
         lang: str = "lang", text: str = "text") -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``longest`` words: lang, rank, phrase, a, l, r, n, score.

    A phrase counts from ``threshold`` occurrences on; one inside a longer candidate with ``share`` percent of its
    occurrences is dropped.
    """
    if threshold < 1 or longest < 2:
        raise ValueError("threshold must be 1 or more, longest 2 or more")
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    bits = 1 << max(0, BITS_PER_DOC * docs.count() - 1).bit_length()
    dealt = _sharded(docs, shards, lang, text)
    bitmaps = reached_keys(dealt, threshold, longest, min(max(bits, LEAST_BITS), MOST_BITS))
    every = dealt[0]
    for shard in dealt[1:]:
        every = every.union(shard)
    counts = materialize(exact_counts(every, bitmaps, longest), "phrase-counts")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    # Ranks up to a constant are cut before rows of a language meet.
    ranked = scored(counts, threshold, share, longest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
