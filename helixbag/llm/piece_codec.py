"""SentencePiece encoding and decoding of merge-type models: exact encoding by backtracking over longest matches.

A list of pieces is what merging gives for a text exactly if every two neighbours are: merging their joined text has to
give these two again. So the encoder walks a text from the left, takes the longest piece that an Aho-Corasick automaton
finds there, and accepts it when it is compatible with the piece before; else it tries the next shorter piece, and when
none is left it marks the position as failed in a bitfield and takes the piece before back. No position fails twice, so
the work is linear. Pieces that merging never gives for their own text are left out of the automaton.

A text is cut where no piece of the model can span, before blanks and between letters and other characters, and its parts
are encoded once and remembered; for a model with pieces across such places the cut is coarser, or the text stays whole. Characters without a piece stand alone and become
byte pieces (or the unknown id). Normalising and decoding are the library's.

Defined results: a null text is empty and gives only the end id; any length is encoded whole; every row is encoded by
itself, so repeated rows, null keys and ties pass through; an empty table gives an empty table; extra columns pass through,
and one named like a new column is replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, types as T

from helixbag.llm.words import small_batches

BLANK = "▁"
LETTER, OTHER = r"[^\W\d_¹²³]", rf"[^\w{BLANK}]|[\d_¹²³]"
# Patterns of the parts of a text, each with the places inside a piece that forbid it: runs of letters and of other
# characters with the blanks before them, or whatever stands between blanks.
CUTS = [
    (rf"{BLANK}*(?:{LETTER}+|(?:{OTHER})+)|{BLANK}+", rf"[^{BLANK}]{BLANK}|{LETTER}(?:{OTHER})|(?:{OTHER}){LETTER}"),
    (rf"{BLANK}+[^{BLANK}]*|[^{BLANK}]+", rf"[^{BLANK}]{BLANK}"),
]
# Parts in each of a worker's two generations (about 60 MB each), the longest part that is kept, neighbour checks that are
# kept, and the rows whose results are held at once.
KEPT_PARTS, KEPT_LENGTH, KEPT_PAIRS, ROWS = 250_000, 48, 1_000_000, 200


class Kept:
    """A table of two generations: when the young one is full it becomes the old one, and what is met again moves back."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key):
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.young, self.old = {}, self.young
        self.young[key] = value

    def forget(self) -> None:
        self.young, self.old = {}, {}


class PieceModel:
    """Encoder of one model file."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        library, size = self.library, self.library.get_piece_size()
        special = {i for i in range(size) if library.is_control(i) or library.is_unknown(i) or library.is_byte(i)}
        if any(library.is_unused(i) for i in range(size)):
            raise ValueError("models with unused pieces are not supported")
        self.text = [library.id_to_piece(i) for i in range(size)]
        self.decimal = [str(i).encode() for i in range(size)]
        self.sizes = [len(piece) for piece in self.text]
        # Lower is merged earlier; equal scores go from left to right.
        self.rank = {self.text[i]: -library.get_score(i) for i in range(size) if i not in special}
        self.ids = {piece: i for i, piece in enumerate(self.text) if i not in special}
        if missing := {c for piece in self.ids for c in piece} - self.ids.keys():
            raise ValueError(f"characters that occur in pieces only: {sorted(missing)[:5]}")
        named = [f"<0x{b:02X}>" for b in range(256)]
        self.bytes = [library.piece_to_id(n) for n in named] if library.is_byte(library.piece_to_id(named[0])) else None
        self.unknown, self.end = library.unk_id(), library.eos_id()

        # A piece that merging gives for its own text has two parts before its last merge.
        parts = {piece: self.merged(piece, 2) for piece in self.ids}
        parts = {piece: both for piece, both in parts.items() if len(both) <= 2}
        made = list(parts)
        # Read backwards, all pieces that begin at a place end there together, the longest first.
        self.automaton = ahocorasick.Automaton()
        for piece in made:
            self.automaton.add_word(piece[::-1], self.ids[piece])
        self.automaton.make_automaton()
        known = set(made)
        # The next shorter piece that a piece begins with.
        self.shorter = {self.ids[p]: next((self.ids[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in known), -1) for p in made}
        # The finest cut that no piece spans.
        self.part = re.compile(next((part for part, spanned in CUTS if not any(map(re.compile(spanned).search, made))), "(?s).+"))
        self.parts = Kept(KEPT_PARTS)
        # Neighbour checks by left piece.
        self.checked: dict[int, dict[int, bool]] = {}
        self.n_checked = 0
        self._edges({piece: both for piece, both in parts.items() if len(both) == 2}, made)

    def _edges(self, parts: dict[str, list[str]], made: list[str]) -> None:
        """For each piece the parts that stood at its right and its left end while it was merged, each with the rank of the
        merge that ended it, where merges come in the order of ranks; pieces of shared ranks are left out."""
        ranks = Counter(self.rank.values())
        self.right, self.left = {}, {}
        if any(self.rank[part] > self.rank[piece] for piece, both in parts.items() for part in both if len(part) > 1):
            return
        for piece in made:
            if any(ranks[self.rank[p]] > 1 for p in (piece, *parts.get(piece, ())) if len(p) > 1):
                continue
            for end, edges in ((1, self.right), (0, self.left)):
                part, found = piece, [(piece, float("inf"))]
                while part in parts:
                    found.append((parts[part][end], self.rank[part]))
                    part = parts[part][end]
                edges[self.ids[piece]] = found

    def merged(self, text: str, least: int = 1) -> list[str]:
        """The pieces of a short text by merging: the best pair first, the leftmost of equal ones. Merging ends early when
        ``least`` pieces are left."""
        rank, never = self.rank, float("inf")
        symbols = list(text)
        scores = [rank.get(a + b, never) for a, b in zip(symbols, symbols[1:])]
        while len(scores) >= least and (best := min(scores)) != never:
            i = scores.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = rank.get(symbols[i - 1] + symbols[i], never)
            if i < len(scores):
                scores[i] = rank.get(symbols[i] + symbols[i + 1], never)
        return symbols

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined text of two pieces gives the two again."""
        if left in self.right and right in self.left:
            return self._undisturbed(left, right)
        a, b = self.text[left], self.text[right]
        return self.merged(a + b) == [a, b]

    def _undisturbed(self, left: int, right: int) -> bool:
        """Merging two neighbours again along their border: no part at the end of the one merges with a part at the start
        of the other before their own next merges (of equal ranks the left one comes first)."""
        rank, last = self.rank, float("inf")
        for a, own in self.right[left]:
            for b, other in self.left[right]:
                across = rank.get(a + b, last)
                if across < own and across <= other and across != last:
                    return False
        return True

    def backtrack(self, part: str) -> list[int]:
        """Piece ids of a text; characters without a piece are given as -1 minus their code point."""
        n = len(part)
        longest = [-1] * n
        seen = -1
        for last, piece in self.automaton.iter(part[::-1]):
            if last != seen:
                longest[n - 1 - last] = piece
                seen = last
        sizes, shorter, compatible, checked = self.sizes, self.shorter, self.compatible, self.checked
        failed = bytearray(n + 1)
        out: list[int] = []
        at, piece, before, row = 0, longest[0], -1, {}
        while at < n:
            if piece < 0:
                # A character without a piece stands beside anything.
                stop, fits = at + 1, not failed[at + 1]
                piece = -1 - ord(part[at])
            else:
                stop = at + sizes[piece]
                fits = not failed[stop]
                if fits and before >= 0:
                    fits = row.get(piece)
                    if fits is None:
                        fits = row[piece] = compatible(before, piece)
                        self.n_checked += 1
            if fits:
                out.append(piece)
                before, at = piece, stop
                row = checked.setdefault(before, {})
                if at < n:
                    piece = longest[at]
                continue
            if piece < 0 or (piece := shorter[piece]) < 0:
                # Nothing fits here: what came before was wrong, and its shorter pieces are next.
                failed[at] = 1
                piece = out.pop()
                at -= sizes[piece] if piece >= 0 else 1
                before = out[-1] if out else -1
                row = checked.setdefault(before, {})
        if self.n_checked > KEPT_PAIRS:
            self.checked, self.n_checked = {}, 0
        return out

    def ids_of(self, found: Sequence[int]) -> list[int]:
        """Ids with characters without a piece as bytes."""
        if not found or min(found) >= 0:
            return list(found)
        out: list[int] = []
        for piece in found:
            if piece >= 0:
                out.append(piece)
            elif self.bytes is None:
                out.append(self.unknown)
            else:
                out += [self.bytes[b] for b in chr(-1 - piece).encode()]
        return out

    def learn(self, part: str) -> tuple[list[int], bytes]:
        """Ids of a part, and these in decimals."""
        known = self.parts.get(part)
        if known is None:
            ids = self.ids_of(self.backtrack(part))
            known = (ids, b" ".join([self.decimal[i] for i in ids]))
            if len(part) <= KEPT_LENGTH:
                self.parts.put(part, known)
        return known

    def encoded(self, text: str) -> list[tuple[list[int], bytes]]:
        """Ids and decimals of each part of a text, the end id last."""
        young, learn = self.parts.young, self.learn
        # A part that is new is learned, in either generation.
        found = [young.get(part) or learn(part) for part in self.part.findall(self.library.normalize(text))]
        if self.bytes is None:
            found = self._one_unknown(found)
        found.append(([self.end], self.decimal[self.end]))
        return found

    def _one_unknown(self, found: list[tuple[list[int], bytes]]) -> list[tuple[list[int], bytes]]:
        """Neighbouring unknown characters share one id."""
        out: list[int] = []
        for ids, _ in found:
            for i in ids:
                if not (i == self.unknown and out and out[-1] == i):
                    out.append(i)
        return [(out, " ".join(map(str, out)).encode())] if out else []

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(ids for ids, _ in self.encoded(text)))

    def decode(self, ids: Sequence[int]) -> str:
        return self.library.decode(list(ids))

    def forget(self) -> None:
        self.parts.forget()
        self.checked, self.n_checked = {}, 0


_models: dict[str, PieceModel] = {}


def model_of(content: bytes) -> PieceModel:
    """The worker's model, built once per model file."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _models:
        _models[key] = PieceModel(content)
    return _models[key]


def _shared(spark: SparkSession, path: str):
    """The model file, read on the driver (a vocabulary has a fixed size of about 0.5 MB)."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def _mapped(docs: DataFrame, new: list[tuple[str, str, pa.DataType]], column: str, path: str, value) -> DataFrame:
    """docs with new columns (name, Spark type, Arrow type), value(model, content) giving those of a row."""
    small_batches(docs.sparkSession)
    shared = _shared(docs.sparkSession, path)
    names = [name for name, _, _ in new]
    fields = docs.drop(*names).schema.fields
    kept = [field.name for field in fields]
    schema = T.StructType([*fields, *[T.StructField(n, T._parse_datatype_string(t)) for n, t, _ in new]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(shared.value)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                rows = [value(model, content.as_py()) for content in batch.column(column)]
                fresh = [pa.array([r[i] for r in rows], type=t) for i, (_, _, t) in enumerate(new)]
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], *fresh], names=[*kept, *names])
        # The worker may go on to other work; it keeps the model, not what it has met.
        model.forget()

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Append ``ids``, the end id last."""
    return _mapped(docs, [("ids", "array<int>", pa.list_(pa.int32()))], text, path,
                   lambda model, content: (np.array(model.encode(content or ""), dtype=np.int32),))


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Append ``decoded_text``; null ids decode to nothing."""
    return _mapped(encoded, [("decoded_text", "string", pa.string())], ids, path,
                   lambda model, content: (model.decode(content or []),))


def encode_and_decode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Append ``n_tokens``, ``ids_sha256`` (decimal ids joined by one space) and ``decoded_sha256`` (the text decoded from
    the ids) in one pass."""
    def value(model: PieceModel, content: str | None) -> tuple:
        found = model.encoded(content or "")
        ids = list(chain.from_iterable([f[0] for f in found]))
        return (len(ids), hashlib.sha256(b" ".join([f[1] for f in found])).hexdigest(),
                hashlib.sha256(model.decode(ids).encode()).hexdigest())

    new = [("n_tokens", "bigint", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]
    return _mapped(docs, new, text, path, value)
