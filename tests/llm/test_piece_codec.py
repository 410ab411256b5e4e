import hashlib
import random

import pytest
import sentencepiece

from helixbag.llm import piece_codec
from helixbag.llm.queries import PIECES, QUERIES

PARTS = ["a", "b", "th", "in", "er", "on", "the", "ing", " ", "  ", "    ", "\n", "\t", "é", "ß", "Ü", "中", "文", "ﬁ", "　", "́", "\U0001F600",
         "\x00", "1", "2", "²", "▁", "==", "--", "//", ".", ",", "'", "<0x0A>", "<s>", "</s>", "<unk>"]


@pytest.fixture(scope="module")
def model():
    with open(PIECES, "rb") as file:
        return piece_codec.PieceModel(file.read())


def test_ids_equal_the_library_on_drawn_texts(model):
    rng = random.Random(3)
    for _ in range(5000):
        pool = rng.sample(PARTS, rng.randint(1, 8))
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))
        assert model.encode(text) == model.library.encode(text, add_eos=True), text
        assert model.decode(model.encode(text)) == model.library.decode(model.library.encode(text))


def test_neighbouring_pieces_equal_the_library(model):
    rng, pieces = random.Random(4), list(model.ids)
    for _ in range(5000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 6)))
        assert model.encode(text) == model.library.encode(text, add_eos=True), text


def test_border_check_equals_merging_the_joined_text(model):
    rng, ids = random.Random(5), list(model.ids.values())
    for _ in range(20000):
        a, b = rng.choice(ids), rng.choice(ids)
        assert model.compatible(a, b) == (model.merged(model.text[a] + model.text[b]) == [model.text[a], model.text[b]])


def test_backtracking_marks_positions_as_failed(model):
    # The longest first piece of these is not that of the encoding, so the walk goes back.
    rng, back = random.Random(6), 0
    for _ in range(3000):
        text = "▁" + "".join(rng.choice("aeinorst") for _ in range(12))
        found = model.backtrack(text)
        first = max((p for p in model.shorter if text.startswith(model.text[p])), key=lambda p: len(model.text[p]))
        back += found[0] != first
        assert found == model.library.encode(text[1:])
    assert back > 0


def test_long_runs_and_texts(model):
    for text in ("a" * 20_000, " " * 5_001, "ab" * 10_000, "中文" * 3_000, "the quick fox, " * 3_000, "=" * 3_001):
        assert model.encode(text) == model.library.encode(text, add_eos=True)


def test_tables(spark):
    rows = [(1, "The cat sat. The cat sat.", "x"), (1, "The cat sat. The cat sat.", "y"), (None, "é \U0001F600", None), (3, "", "z"),
            (4, None, "z"), (5, "word " * 30_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string")
    got = piece_codec.encode_and_decode(docs, PIECES)
    assert got.columns == ["doc_id", "text", "n_tokens", "ids_sha256", "decoded_sha256"]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = []
    for key, text, _ in rows:
        ids = library.encode(text or "", add_eos=True)
        want.append((key, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    found = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert piece_codec.encode_and_decode(docs.limit(0), PIECES).count() == 0


def test_ids_come_back_as_text(spark):
    docs = spark.createDataFrame([(1, "Two  blanks, é"), (2, None)], "doc_id long, text string")
    there = piece_codec.encode(docs, PIECES)
    back = {r.doc_id: r.decoded_text for r in piece_codec.decode(there, PIECES).collect()}
    assert back == {1: "Two  blanks, é", 2: ""}


def test_query_equals_the_library_on_whole_documents(spark):
    sf_dir = "/root/testdata/sf0.001"
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for row in QUERIES["op12_piece_codec"](spark, sf_dir).collect():
        ids = library.encode(texts[row.doc_id] or "", add_eos=True)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
