"""Byte-level BPE: encoding with the tokenizers library over Arrow batches, and decoding by the reversed byte table.

The merges are derived from a rank file (every split of a token into two lower-ranked tokens), so ids agree with
rank-based encoders. A text is cut where a non-blank meets a blank: no match of the split pattern spans such a place, so
each piece can be encoded once and reused while the worker lives. Texts with the separators U+001C to U+001F, on whose
kind libraries disagree, are encoded whole.

Defined results: a null text is empty (no ids, empty bytes); any length is encoded whole; rows keep their number, so
repeated rows and null keys pass through; an empty table gives an empty table; an input column named like a new one is
replaced.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

from helixbag.llm.words import small_batches

PIECE = re.compile(r"\s*\S+|\s+")
UNSURE = re.compile("[\x1c-\x1f]")
# Pieces in each of a worker's two generations (about 30 MB each), pieces handed to the library at once, and rows whose
# results are held at once.
KEPT_PIECES = 120_000
ROWS = 500
BATCH = 512


def byte_table() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else letters from U+0100 on, in order."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Codec:
    """Encoder and decoder of one rank file and split pattern."""

    def __init__(self, ranks_file: bytes, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks_file.splitlines())}
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        shown = byte_table()

        def show(token: bytes) -> str:
            return "".join(shown[b] for b in token)

        merges = []
        for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None and left < rank and right < rank:
                    merges.append((show(token[:cut]), show(token[cut:])))
        model = models.BPE(vocab={show(token): rank for token, rank in ranks.items()}, merges=merges)
        self.library = Tokenizer(model)
        self.library.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ])
        # Piece to the number of its ids, the ids in decimals, and the bytes they decode to. When the young generation
        # is full it becomes the old one; pieces met again move back, so frequent pieces are encoded once.
        self.known: dict[str, tuple[int, bytes, bytes]] = {}
        self.old: dict[str, tuple[int, bytes, bytes]] = {}

    def pieces(self, text: str) -> list[str]:
        return [text] if UNSURE.search(text) else PIECE.findall(text)

    def learn(self, pieces: Sequence[str]) -> None:
        """Encode and decode the pieces not met before."""
        if len(self.known) > KEPT_PIECES:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        missing = [p for p in dict.fromkeys(pieces) if p not in known]
        if not missing:
            return
        fresh = []
        for piece in missing:
            if piece in old:
                known[piece] = old[piece]
            else:
                fresh.append(piece)
        for start in range(0, len(fresh), BATCH):
            part = fresh[start : start + BATCH]
            for piece, found in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False)):
                ids = found.ids
                known[piece] = (len(ids), " ".join(map(str, ids)).encode(), self.decode(ids))

    def encode(self, text: str) -> list[int]:
        pieces = self.pieces(text)
        self.learn(pieces)
        known = self.known
        return list(map(int, b" ".join([known[p][1] for p in pieces]).split()))

    def decode(self, ids: Sequence[int]) -> bytes:
        """The bytes of some ids; ids outside the vocabulary raise KeyError."""
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def offsets(self, text: str, ids: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        """Code points covered by each token: from the one holding its first byte to past the one holding its last.

        Tokens that share a character split between them share its position.
        """
        data = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
        at = np.cumsum((data & 0xC0) != 0x80) - 1
        stops = np.cumsum([len(self.bytes_of[i]) for i in ids]).astype(np.int64)
        starts = np.concatenate([[0], stops[:-1]]).astype(np.int64) if len(stops) else stops
        return (at[starts], at[stops - 1] + 1) if len(ids) else (stops, stops)


_codecs: dict[tuple[int, str], Codec] = {}


def codec(ranks_file: bytes, pattern: str) -> Codec:
    """The worker's codec, built once per rank file and pattern."""
    key = (hash(ranks_file), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(ranks_file, pattern)
    return _codecs[key]


def forget_pieces() -> None:
    """Empty the worker's piece tables."""
    for coder in _codecs.values():
        coder.known, coder.old = {}, {}


def _shared_ranks(spark: SparkSession, path: str):
    """The rank file, read on the driver (a vocabulary has a fixed size of about 1 MB)."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def _mapped(docs: DataFrame, new: list[tuple[str, str, pa.DataType]], values) -> DataFrame:
    """docs with new columns (name, Spark type, Arrow type) computed batch by batch."""
    small_batches(docs.sparkSession)
    names = [name for name, _, _ in new]
    fields = docs.drop(*names).schema.fields
    kept = [field.name for field in fields]
    schema = T.StructType([*fields, *[T.StructField(n, T._parse_datatype_string(t)) for n, t, _ in new]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                columns = [batch.column(field) for field in kept]
                fresh = [pa.array(v, type=t) for v, (_, _, t) in zip(values(batch), new)]
                yield pa.RecordBatch.from_arrays([*columns, *fresh], names=[*kept, *names])
        # The worker may go on to other work; it keeps the codec, not the pieces.
        forget_pieces()

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", offsets: bool = False) -> DataFrame:
    """Append ``ids``, and with ``offsets`` the code points each token covers as ``starts`` and ``ends``."""
    shared = _shared_ranks(docs.sparkSession, ranks_path)
    ints = pa.list_(pa.int32())
    new = [("ids", "array<int>", ints)]
    if offsets:
        new += [("starts", "array<int>", ints), ("ends", "array<int>", ints)]

    def values(batch: pa.RecordBatch):
        coder = codec(shared.value, pattern)
        texts = [t or "" for t in batch.column(text).to_pylist()]
        ids = [coder.encode(t) for t in texts]
        if not offsets:
            return (ids,)
        both = [coder.offsets(t, i) for t, i in zip(texts, ids)]
        return ids, [b[0] for b in both], [b[1] for b in both]

    return _mapped(docs, new, values)


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """Append ``decoded``, the bytes of ``ids``, and ``decoded_text``, where a character cut off at either end of the
    ids becomes U+FFFD. Null ids decode to nothing."""
    shared = _shared_ranks(encoded.sparkSession, ranks_path)

    def values(batch: pa.RecordBatch):
        coder = codec(shared.value, r"[\s\S]+")
        raw = [coder.decode(i or ()) for i in batch.column(ids).to_pylist()]
        return raw, [r.decode("utf-8", errors="replace") for r in raw]

    return _mapped(encoded, [("decoded", "binary", pa.binary()), ("decoded_text", "string", pa.string())], values)


def encode_and_decode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text",
                      keep_ids: bool = False) -> DataFrame:
    """Encode, decode the ids again, and append ``n_tokens``, ``ids_sha256`` (decimal ids joined by one space) and
    ``decoded_sha256`` (the decoded bytes) in one pass; ``keep_ids`` adds the ids themselves."""
    shared = _shared_ranks(docs.sparkSession, ranks_path)
    new = [("n_tokens", "bigint", pa.int64()), ("ids_sha256", "string", pa.string()),
           ("decoded_sha256", "string", pa.string())]
    if keep_ids:
        new.append(("ids", "array<int>", pa.list_(pa.int32())))

    def values(batch: pa.RecordBatch):
        coder = codec(shared.value, pattern)
        out = [[] for _ in new]
        for value in batch.column(text):
            pieces = coder.pieces(value.as_py() or "")
            coder.learn(pieces)
            known = coder.known
            found = [known[p] for p in pieces]
            decimals = b" ".join([f[1] for f in found])
            out[0].append(sum([f[0] for f in found]))
            out[1].append(hashlib.sha256(decimals).hexdigest())
            out[2].append(hashlib.sha256(b"".join([f[2] for f in found])).hexdigest())
            if keep_ids:
                out[3].append(np.array(decimals.split(), dtype=np.int32))
        return out

    return _mapped(docs, new, values)
