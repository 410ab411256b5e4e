"""Subword counts of masked sequences from the tokens around the masks alone.

A border of the tokens of a text splits its merging: no merge crosses it, so both sides come out as if they stood alone. A
contig is therefore encoded once for all its masks. What a mask leaves of a segment is encoded from a few tokens before each
cut, beginning at a border of the whole segment. From the first border on that the two encodings share, away from the cut, they
are alike for good, and only the tokens between the cut and that border have changed. Where none is shared, more tokens are
taken in, at last the whole rest. This is exact for every text, and its cost follows the number and width of the masks.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

from helixbag.functions.sequence import IUPAC, IUPAC_COMPLEMENT, MASK
from helixbag.operators.bpe import SPECIAL, BpeModel, bpe_tokenizer
from helixbag.operators.features import TokenCounter
from helixbag.operators.merge_kernel import SLICE_LETTERS, MergeKernel, in_order
from helixbag.session import small_batches

# Tokens encoded beside a cut at first, and how many times more with each further try.
REACH, MORE = 8, 4
# Runs of letters that cleaning turns into the mask symbol lie between segments.
SEGMENT = re.compile("[^BD-FH-SU-Z]+")
COMPLEMENT = str.maketrans(IUPAC, IUPAC_COMPLEMENT)


def masked_spans(seq: str, cuts: Sequence[dict], padding: int, all_copies: bool = True) -> list[tuple[int, int]]:
    """The stretches that ``mask_intervals`` overwrites, in order, those that touch joined."""
    half, spans = padding // 2, []
    for i, cut in enumerate(cuts):
        # A missing end of an interval is that of the text.
        low = 0 if cut["start"] is None else max(cut["start"] - half, 0)
        high = len(seq) if cut["end"] is None else min(cut["end"] + half, len(seq))
        if low >= high:
            continue
        text, width = seq[low:high], high - low
        at = seq.find(text) if all_copies else low
        while at >= 0:
            spans.append((at, at + width))
            at = seq.find(text, at + width) if all_copies else -1
        if i + 1 < len(cuts):
            mask = MASK * width
            seq = seq.replace(text, mask) if all_copies else seq[:low] + mask + seq[high:]
    joined: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if joined and low <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(high, joined[-1][1]))
        else:
            joined.append((low, high))
    return joined


def parts_around(seq: str, spans: Sequence[tuple[int, int]], margin: int) -> Iterator[tuple[str, str]]:
    """The parts of a text around masked spans, before and after: ``margin`` letters on both sides of each span, spans whose
    margins would meet or overlap in one part."""
    groups: list[list[tuple[int, int]]] = []
    for span in spans:
        if groups and span[0] - groups[-1][-1][1] < 2 * margin:
            groups[-1].append(span)
        else:
            groups.append([span])
    for group in groups:
        start, end = max(group[0][0] - margin, 0), min(group[-1][1] + margin, len(seq))
        pieces, at = [], start
        for low, high in group:
            pieces += [seq[at:low], MASK * (high - low)]
            at = high
        yield seq[start:end], "".join(pieces) + seq[at:end]


@dataclass
class _Text:
    """A segment on one strand and the borders of its tokens."""

    letters: str
    borders: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.int64))


@dataclass
class _Rest:
    """What a job leaves of a text between two masks, and what is known to stay: tokens between ``first`` and ``last``."""

    text: _Text
    counts: Counter
    low: int
    high: int
    first: int | None = None
    last: int | None = None


def _borders(kernel: MergeKernel, texts: Sequence[str]) -> Iterator[np.ndarray]:
    """Places of the token borders of each text, ends included."""
    begin = 0
    while begin < len(texts):
        end, letters = begin + 1, len(texts[begin])
        while end < len(texts) and letters + len(texts[end]) <= SLICE_LETTERS:
            letters += len(texts[end])
            end += 1
        found = kernel.encode(texts[begin:end])
        ends = np.cumsum(np.append(0, pc.utf8_length(found.values).to_numpy(zero_copy_only=False)))
        offsets = found.offsets.to_numpy()
        for i in range(end - begin):
            yield ends[offsets[i] : offsets[i + 1] + 1] - ends[offsets[i]]
        begin = end


def _count(counts: Counter, letters: str, places: list[int], by: int) -> None:
    for low, high in zip(places, places[1:]):
        if high - low > 2:
            counts[letters[low:high]] += by


def _common(new: list[int], old: np.ndarray) -> list[int]:
    # A few borders as a rule, where a set is faster than arrays.
    known = set(old.tolist())
    return [border for border in new if border in known]


def _settle(kernel: MergeKernel, rests: list[_Rest]) -> None:
    """Count the new tokens of each rest and find what of it stays."""
    reach = REACH
    while rests:
        tried, windows = [], []
        for rest in rests:
            old, ends = rest.text.borders, (0, len(rest.text.letters))
            # The window behind the left cut ends, and that before the right cut begins, at a border of the whole text.
            right = int(old[min(bisect_left(old, rest.low) + reach, len(old) - 1)]) if rest.low > ends[0] else rest.low
            left = int(old[max(bisect_right(old, rest.high) - 1 - reach, 0)]) if rest.high < ends[1] else rest.high
            if right > left or (right == ends[1] and rest.low > ends[0]) or (left == ends[0] and rest.high < ends[1]):
                tried.append((rest, None, None))
                windows.append(rest.text.letters[rest.low : rest.high])
                continue
            tried.append((rest, right, left))
            windows.append(rest.text.letters[rest.low : right])
            windows.append(rest.text.letters[left : rest.high])
        found, rests = _borders(kernel, windows), []
        for rest, right, left in tried:
            letters, old = rest.text.letters, rest.text.borders
            if right is None:
                _count(rest.counts, letters, (next(found) + rest.low).tolist(), 1)
                continue
            after, before = (next(found) + rest.low).tolist(), (next(found) + left).tolist()
            first, last = rest.low, rest.high
            if rest.low > 0:
                shared = _common(after[: bisect_left(after, right)], old[bisect_left(old, rest.low) : bisect_left(old, right)])
                first = shared[0] if shared else None
            if rest.high < len(letters):
                shared = _common(before[bisect_right(before, left) :], old[bisect_right(old, left) : bisect_right(old, rest.high)])
                last = shared[-1] if shared else None
            if first is None or last is None:
                rests.append(rest)
                continue
            rest.first, rest.last = first, last
            _count(rest.counts, letters, after[: bisect_right(after, first)], 1)
            _count(rest.counts, letters, before[bisect_left(before, last) :], 1)
        reach *= MORE


def _lost(text: _Text, rests: list[_Rest], counts: Counter) -> None:
    """Count off the tokens of the whole text that no rest keeps."""
    at = 0
    for low, high in [*[(r.first, r.last) for r in rests if r.first is not None], (len(text.letters),) * 2]:
        _count(counts, text.letters, text.borders[bisect_left(text.borders, at) : bisect_right(text.borders, low)].tolist(), -1)
        at = high


def token_changes(kernel: MergeKernel, contigs: Sequence[tuple[str, Sequence[list[tuple[int, int]]]]]) -> list[list[Counter]]:
    """Change of the count of each token of three or more letters, for each contig and each of its lists of masked spans."""
    out, texts, jobs = [], [], []
    for seq, lists in contigs:
        segments = [m.span() for m in SEGMENT.finditer(seq)]
        heads = [low for low, _ in segments]
        here: dict[int, tuple[_Text, _Text]] = {}
        out.append([Counter() for _ in lists])
        for spans, counts in zip(lists, out[-1]):
            inside: dict[int, list[tuple[int, int]]] = {}
            for low, high in spans:
                i = max(bisect_right(heads, low) - 1, 0)
                while i < len(segments) and segments[i][0] < high:
                    start, end = segments[i]
                    if end > low:
                        inside.setdefault(i, []).append((max(low, start) - start, min(high, end) - start))
                    i += 1
            for i, cuts in inside.items():
                if i not in here:
                    start, end = segments[i]
                    here[i] = _Text(seq[start:end]), _Text(seq[start:end].translate(COMPLEMENT)[::-1])
                    texts.extend(here[i])
                size = len(here[i][0].letters)
                jobs.append((here[i][0], counts, cuts))
                jobs.append((here[i][1], counts, [(size - high, size - low) for low, high in reversed(cuts)]))
    for text, borders in zip(texts, _borders(kernel, [t.letters for t in texts])):
        text.borders = borders
    rests: list[list[_Rest]] = []
    for text, counts, cuts in jobs:
        between = zip([0, *[high for _, high in cuts]], [*[low for low, _ in cuts], len(text.letters)])
        rests.append([_Rest(text, counts, low, high) for low, high in between if low < high])
    _settle(kernel, [rest for group in rests for rest in group])
    for (text, counts, _), group in zip(jobs, rests):
        _lost(text, group, counts)
    return out


@dataclass(frozen=True)
class SubwordCounter(TokenCounter):
    """Counts tokens of a learned model, and the changes of masked contigs around their masks only."""

    model: BpeModel | None = None

    def changes(self, targeted: DataFrame, padding: int, all_copies: bool = True) -> DataFrame:
        """Change of each term count per (genome, target). ``targeted`` has genome, seq and ``_targets``, an array of
        (target, _cuts) structs of which a contig has one per panel gene at most."""
        merges = tuple(m for m in self.model.merges if SPECIAL not in m[0] + m[1])
        # At most the vocabulary size, a parameter of the model.
        shared = targeted.sparkSession.sparkContext.broadcast(merges)

        def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kernel = MergeKernel(shared.value)
            for batch in rows:
                seqs, targets = batch.column("seq").to_pylist(), batch.column("_targets").to_pylist()
                begin = 0
                while begin < len(batch):
                    end, letters = begin, 0
                    while end < len(batch) and (end == begin or letters < SLICE_LETTERS):
                        letters += len(seqs[end])
                        end += 1
                    spans = [(seqs[i], [masked_spans(seqs[i], t["_cuts"], padding, all_copies) for t in targets[i]])
                             for i in range(begin, end)]
                    # One batch for all contigs of a slice.
                    places, names, terms, ns = [], [], [], []
                    for i, changed in enumerate(token_changes(kernel, spans), begin):
                        for t, counts in zip(targets[i], changed):
                            found = {term: n for term, n in counts.items() if n}
                            places += [i] * len(found)
                            names += [t["target"]] * len(found)
                            terms += found
                            ns += found.values()
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("genome").take(pa.array(places, pa.int64())), pa.array(names, pa.string()), pa.array(terms, pa.string()),
                         pa.array(ns, pa.int64())], names=["genome", "target", "term", "tf"])
                    begin = end

        small_batches(targeted.sparkSession)
        schema = T.StructType([T.StructField("genome", targeted.schema["genome"].dataType), T.StructField("target", T.StringType()),
                               T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
        rows = targeted.select("genome", "seq", "_targets").where("seq is not null").mapInArrow(batches, schema)
        return rows.groupBy("genome", "target", "term").agg({"tf": "sum"}).withColumnRenamed("sum(tf)", "tf").where("tf <> 0")


def subword_counter(model: BpeModel, spark) -> TokenCounter:
    """The counter of a learned model; one whose ranks do not rise counts changed contigs whole."""
    tokenize, size = bpe_tokenizer(model, spark), len(model.tokens)
    usable = tuple(m for m in model.merges if SPECIAL not in m[0] + m[1])
    return SubwordCounter(tokenize, size, None, model) if in_order(usable) else TokenCounter(tokenize, size)
