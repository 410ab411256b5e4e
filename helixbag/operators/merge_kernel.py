"""Subword encoding of whole Arrow batches: merges applied to one integer array, rank by rank.

The texts of a batch become one array of symbol numbers with walls between them. The ranks of neighbouring pairs are looked up
in the sorted pair keys of the model, and the places of each rank are merged together, lowest rank first: where a pair overlaps
itself, from the left. Merging makes pairs of higher ranks only, so going through the ranks once is the strict order. Only the
places of the next ranks are sorted at a time, and merged symbols are squeezed out in between, so the work follows the number
of merges made, not ranks times letters.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

from helixbag.functions.letters import text_bytes, text_codes, walled

# Letters worked on at once, about 25 bytes each; a longer single text makes a slice of its own.
SLICE_LETTERS = 2_000_000
# Share of the symbols whose pairs are sorted at a time.
PART = 8
# Most symbols whose pairs are looked up in a square table; for more, sorted keys are searched.
TABLE_SYMBOLS = 1_000
NEVER = np.int32(2**31 - 1)


def in_order(merges: Sequence[tuple[str, str]]) -> bool:
    """Whether every merge has only letters and tokens of earlier merges, each made by one merge: ranks then only rise."""
    made: set[str] = set()
    used: set[str] = set()
    for a, b in merges:
        used.update((a, b))
        if a + b in made or a + b in used:
            return False
        made.add(a + b)
    return all(len(t) == 1 or t in made for t in used)


def text_slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows from, to of about SLICE_LETTERS letters at a time, by where texts begin and end."""
    begin, n = 0, len(offsets) - 1
    while begin < n:
        end = max(int(np.searchsorted(offsets, offsets[begin] + SLICE_LETTERS, side="right")) - 1, begin + 1)
        yield begin, end
        begin = end


class MergeKernel:
    """Encoder for merges in rank order that are ``in_order``; letters in ``walls`` are borders and give no token."""

    def __init__(self, merges: Sequence[tuple[str, str]], walls: str = ""):
        if not in_order(merges):
            raise ValueError("ranks must rise: a merge uses tokens of later merges, or two merges make one token")
        letters = sorted({t for pair in merges for t in pair if len(t) == 1})
        self.tokens = [*letters, *[a + b for a, b in merges]]
        ids = {t: i for i, t in enumerate(self.tokens)}
        # Two more numbers stand for the ends of texts and for walls inside them; other letters come after these.
        self.end, self.wall = len(ids), len(ids) + 1
        self.base = len(ids) + 2
        self.letters = {ord(c): i for c, i in ids.items() if len(c) == 1}
        self.letters.update({ord(c): self.wall for c in walls})
        left = np.array([ids[a] for a, _ in merges], dtype=np.int64)
        right = np.array([ids[b] for _, b in merges], dtype=np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], dtype=np.int32)
        self.doubled = left == right
        keys = left * self.base + right
        # One key more, so that every search ends inside.
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.ranks = np.append(order.astype(np.int32), NEVER)
        self.table = None
        if self.base <= TABLE_SYMBOLS:
            self.table = np.full((self.base, self.base), NEVER, dtype=np.int32)
            self.table[left, right] = np.arange(len(merges), dtype=np.int32)
            self.table = self.table.ravel()

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NEVER for those that do not merge."""
        if self.table is not None:
            # Letters that no merge has count as an end.
            last = np.int32(self.end)
            return self.table[np.minimum(left, last) * np.int32(self.base) + np.minimum(right, last)]
        keys = np.where((left < self.end) & (right < self.end), left.astype(np.int64) * self.base + right, -1)
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.ranks[at], NEVER)

    def merge(self, symbols: np.ndarray) -> np.ndarray:
        """What is left of an array of symbols when no pair merges; it begins and ends with a wall."""
        while True:
            rank = np.append(self.lookup(symbols[:-1], symbols[1:]), NEVER)
            places = np.flatnonzero(rank != NEVER)
            if not len(places):
                return symbols
            found = np.cumsum(np.bincount(rank[places]))
            high = int(np.searchsorted(found, max(1, len(symbols) // PART))) + 1
            symbols = self._below(symbols, rank, places[rank[places] < high], high)

    def _below(self, symbols: np.ndarray, rank: np.ndarray, places: np.ndarray, high: int) -> np.ndarray:
        """The symbols after all merges of ranks below ``high``; ``places`` are those of such pairs."""
        n = len(symbols)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        alive = np.ones(n, dtype=bool)
        twice = np.zeros(n, dtype=bool)
        # Ranks of 16 bits are sorted by counting.
        kind = np.uint16 if high <= 1 << 16 else np.int32
        waiting: dict[int, list[np.ndarray]] = {}

        def add(at: np.ndarray) -> None:
            ranks = rank[at].astype(kind)
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            heads = np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1])) if len(at) else []
            for r, part in zip(ranks[heads].tolist(), np.split(at, heads[1:])) if len(at) else ():
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(queue, r)
                waiting[r].append(part)

        queue: list[int] = []
        add(places)
        while queue:
            r = heapq.heappop(queue)
            parts = waiting.pop(r)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            # Places whose pair has changed since are listed under its new rank.
            at = at[rank[at] == r]
            if self.doubled[r] and len(at) > 1:
                # In a run of one symbol every second pair, from the left.
                at = np.sort(at)
                index = np.arange(len(at))
                heads = np.append(True, after[at[:-1]] != at[1:])
                at = at[(index - np.maximum.accumulate(np.where(heads, index, 0))) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            follow = after[gone]
            symbols[at] = self.made[r]
            alive[gone] = False
            rank[gone] = NEVER
            after[at], before[follow] = follow, at
            lead = before[at]
            rank[at] = self.lookup(symbols[at], symbols[after[at]])
            rank[lead] = self.lookup(symbols[lead], symbols[after[lead]])
            # Merged places that are also beside one are listed once.
            twice[at] = True
            changed = np.concatenate([at, lead[~twice[lead]]])
            twice[at] = False
            changed = changed[rank[changed] < high]
            if len(changed):
                add(changed)
        return symbols[alive]

    def symbols(self, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """The symbols of texts of code points, how many each text has, and the letters that no merge has."""
        strange: list[int] = []
        if codes.dtype == np.uint8:
            numbers = self.base + np.arange(256, dtype=np.int32)
            for letter, i in self.letters.items():
                if letter < 256:
                    numbers[letter] = i
            strange, numbered = list(range(256)), numbers[codes]
        else:
            known = np.unique(codes) if len(codes) else codes
            numbers = np.array([self.letters.get(c, -1) for c in known.tolist()], dtype=np.int32)
            for i in np.flatnonzero(numbers < 0).tolist():
                numbers[i] = self.base + len(strange)
                strange.append(int(known[i]))
            numbered = numbers[np.searchsorted(known, codes)] if len(codes) else numbers
        # Each text has an end mark before it, and the last one also behind it.
        symbols = self.merge(walled(numbered, offsets, self.end))
        marks = symbols == self.end
        token = ~marks & (symbols != self.wall)
        n = len(offsets) - 1
        counts = np.bincount(np.cumsum(marks)[token] - 1, minlength=n)[:n]
        return symbols[token], counts, strange

    def vocabulary(self, strange: Sequence[int]) -> pa.Array:
        """The text of each symbol."""
        return pa.array([*self.tokens, None, None, *map(chr, strange)], pa.string())

    def encode(self, texts: Sequence[str | None] | pa.Array) -> pa.Array:
        """Lists of tokens; null for null."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        symbols, counts, strange = self.symbols(*text_codes(texts))
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        missing = pa.array(texts.is_null().to_numpy(zero_copy_only=False))
        return pa.ListArray.from_arrays(pa.array(offsets), self.vocabulary(strange).take(pa.array(symbols)), mask=missing)

    def encode_batches(self, batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            done = [self.encode(batch.slice(begin, end - begin)) for begin, end in text_slices(text_bytes(batch)[1])]
            yield pa.concat_arrays(done) if done else self.encode(batch)
