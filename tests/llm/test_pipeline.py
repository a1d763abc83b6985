import hashlib

import pytest

pytest.importorskip("public_tokenizers")

import public_tokenizers  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from palimpsest.llm import decontam, minhash, quality_lm  # noqa: E402
from tests.llm import test_decontam, test_line_dedup, test_minhash  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage made of all that its predecessor kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        out.append(docs.cache())
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_all_but_the_last_keep_the_columns(stages):
    assert all(s.dtypes == stages[0].dtypes for s in stages[:-1])


def test_quality(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {i for i, _ in rows(stages[1])}
    assert kept == {r.doc_id for r in quality_lm.classify(stages[0], labels).where("accepted").collect()}
    good, bad = ({r.doc_id for r in labels.where(f"quality = {q}").collect()} for q in (1, 0))
    assert len(good & kept) >= 0.97 * len(good) and len(bad & kept) <= 0.2 * len(bad)


def test_lines(stages):
    want = test_line_dedup.brute(rows(stages[1]))
    before = dict(rows(stages[1]))
    want = {i: t for i, t in want.items() if t == before[i] or t.strip(" \t\r\x0b\x0c\n")}
    assert dict(rows(stages[2])) == want
    assert stages[2].where(F.col("n_chars") != F.length("text")).count() == 0


def test_near_duplicates(stages):
    before, left = dict(rows(stages[0])), {i for i, _ in rows(stages[2])}
    found = test_minhash.brute([(i, before[i]) for i in left])
    gone = {d for d, _, c in found if d != c}
    assert gone and {i for i, _ in rows(stages[3])} == left - gone


def test_decontamination(spark, stages):
    items = [decontam.normalise(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = dict(rows(stages[4]))
    for i, text in rows(stages[3]):
        t = f" {decontam.normalise(text)} "
        hit = any(test_decontam.least(f" {x} ", t) <= len(x) // 16 for x in items if any(p in t for _, p in decontam.pieces(f" {x} ", len(x) // 16)))
        assert (i in kept) != hit


def test_encoding(stages):
    tokenizers = pytest.importorskip("tokenizers")
    theirs = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = dict(rows(stages[4]))
    got = stages[5].collect()
    assert len(got) == len(texts)
    for r in got:
        want = theirs.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == want and r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()


def test_run_is_the_stages_in_turn(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    key = lambda df: sorted((r.doc_id, r.ids_sha256) for r in df.collect())
    assert key(got) == key(stages[-1])


def test_odd_rows(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (7, "", "en", "s", 0), (7, "", "en", "s", 0)], base.schema)
    for docs in (odd, base.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF).count()
    assert minhash.keep_one(odd).count() == 2
