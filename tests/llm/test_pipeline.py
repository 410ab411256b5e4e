import base64
from collections import Counter
from pathlib import Path

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as C
from helixbag.llm import mixing, quality_classifier, secret_scan
from tests.llm.test_minhash_dedup import brute

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The documents before and after every stage."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in C.STAGES:
        out.append(docs)
        path = str(tmp_path_factory.mktemp("stage") / "out")
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
    return [*out, docs]


def test_columns_stay_until_the_last_stage(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    assert all(0 < s.count() for s in steps)


def test_each_stage_takes_effect(spark, steps):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r.doc_id for r in steps[1].collect()}
    judged = quality_classifier.classify(steps[0], spark.read.parquet(f"{FOLDER}/labels.parquet"), C.rejected())
    assert kept == {r.doc_id for r in judged.where("kept").collect()}
    clean = [i for i, r in labels.items() if r.quality == 1 and r.toxic == 0]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)

    rows = [(r.doc_id, r.text) for r in steps[1].collect()]
    firsts = {i for i, _, component, first in brute(rows, 5) if first}
    assert {r.doc_id for r in steps[2].collect()} == firsts

    before, after = ({r.doc_id: r for r in s.collect()} for s in steps[2:4])
    assert before.keys() == after.keys()
    for i, row in after.items():
        assert row.text == secret_scan.redacted(before[i].text, secret_scan.scan_text(before[i].text)[1])
        assert row.n_chars == len(row.text) and not secret_scan.base_spans(row.text)

    aims = {r.doc_id: r for r in mixing.mix(steps[3]).collect()}
    counts = Counter(r.doc_id for r in steps[4].collect())
    assert all(counts.get(i, 0) == int(r.taken / r.size + 0.5) for i, r in aims.items() if r.size)

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in steps[4].collect()}
    assert all(r.ids == own.encode_ordinary(texts[r.doc_id]) for r in steps[5].collect())


def test_odd_rows_pass_all_stages(spark):
    docs = spark.createDataFrame(
        [(None, "a b c d e f g h", None, None, 15), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "x " * 200, "en", "s", 400),
         (3, "x " * 200, "en", "s", 400)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in C.STAGES[1:]:
        docs = stage(spark, docs, FOLDER)
    assert docs.where("doc_id is null").count() == 1 and docs.where(F.col("doc_id") == 3).count() >= 1
    assert C.STAGES[0][1](spark, docs.limit(0).select("doc_id", F.lit("").alias("text"), "lang", "source"), FOLDER).count() == 0
