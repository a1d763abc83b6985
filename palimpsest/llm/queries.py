"""The registered query of each training-data operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, decontam, line_dedup, minhash, pii, quality_lm, quality_rules, sharding, toxicity, url_filter
from palimpsest.llm.common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text, and the terms near it that reveal it."""
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op2_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every whole text encoded and decoded with the word-level vocabulary."""
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), path or public_tokenizers.path("word_bpe_49k.json"), ids=False, decoded=False)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat an earlier line within one word, as counts and the digest of its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.deduplicate(docs, counts=True)
    return out.select("doc_id", "n_lines", "n_exact", "n_near", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents on sets of two-word shingles."""
    return minhash.groups(table(spark, sf_dir, "documents"), width=2)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes; equal texts stay together."""
    return sharding.shards(table(spark, sf_dir, "documents"), bins=8)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every whole text."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdicts of the threshold table on every whole text."""
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op8_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The perplexity of every whole text under the model of trusted documents, and the verdict of its language's threshold."""
    return quality_lm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and verdict of every page's url."""
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that every document holds, within one edit for 16 characters."""
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_bpe": op2_bpe,
    "op3_line_dedup": op3_line_dedup,
    "op4_minhash": op4_minhash,
    "op5_sharding": op5_sharding,
    "op6_toxicity": op6_toxicity,
    "op7_quality_rules": op7_quality_rules,
    "op8_quality_lm": op8_quality_lm,
    "op9_url_filter": op9_url_filter,
    "op10_decontam": op10_decontam,
}

ORACLES: dict[str, str] = {
    "op3_line_dedup": line_dedup.SQL,
    "op4_minhash": minhash.SQL,
    "op7_quality_rules": quality_rules.sql(),
    "op9_url_filter": url_filter.SQL,
}
