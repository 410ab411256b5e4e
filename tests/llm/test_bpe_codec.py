import base64
import hashlib

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

from helixbag.llm import bpe_codec
from helixbag.llm.queries import PATTERN, RANKS

TEXTS = [
    None, "", " ", "  \n\n ", "a", "Don't stop  it's 12345 été\t\tx", "a  b  c　 d", "x\x1c y\x1f\x1e z",
    "tab\t  two\r\n\r\nlines", "🙂🙃 中文字符 ‍ end ", "aaaaaaaaaaaa ababababab", "<|endoftext|> plain", "it''s 'll 's's",
    "#*$%&|<> ;;; =====", "word " * 3000, "é" * 5000, "x" * 20000, "a\x85b \x0b\x0cc",
]


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_ids_equal_the_rank_library(spark):
    own = library()
    got = {r.doc_id: r for r in bpe_codec.encode_and_decode(table(spark, TEXTS), RANKS, PATTERN, keep_ids=True).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        ids = own.encode_ordinary(text or "")
        assert got[i].ids == ids, text
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_offsets_and_split_characters(spark):
    docs = table(spark, TEXTS).withColumn("ids", F.lit(1))
    encoded = bpe_codec.encode(docs, RANKS, PATTERN, offsets=True)
    own = library()
    for row in bpe_codec.decode(encoded, RANKS).collect():
        text = row.text or ""
        assert row.decoded_text == text and bytes(row.decoded) == text.encode()
        for token, start, end in zip(row.ids, row.starts, row.ends):
            assert own.decode_single_token_bytes(token) in text[start:end].encode()
    half = spark.createDataFrame([([own.encode_ordinary("🙂")[0]],), (None,)], "ids array<int>")
    assert [r.decoded_text for r in bpe_codec.decode(half, RANKS).collect()] == ["�", ""]


def test_repeated_rows_null_keys_and_empty_table(spark):
    rows = [(None, "a b"), (1, "a b"), (1, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert bpe_codec.encode_and_decode(docs, RANKS, PATTERN).count() == 3
    assert bpe_codec.encode_and_decode(docs.limit(0), RANKS, PATTERN).count() == 0
