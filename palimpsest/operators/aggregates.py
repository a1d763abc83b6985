"""Sizes, duplicates, digests and profiles of a tree or of contents."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def totals(files: DataFrame, root: Column) -> DataFrame:
    return files.groupBy(root.alias("root")).agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes"))


def prefixes(path: Column) -> Column:
    """Every folder above a path: a/b/c gives a and a/b."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def folder_sizes(files: DataFrame, depth: int | None = None) -> DataFrame:
    """Files and bytes below every folder, or below the folders of one depth (1: homes)."""
    rows = files.where(F.col("path").contains("/")).select(F.explode(prefixes(F.col("path"))).alias("folder"), "size")
    if depth is not None:
        rows = rows.where(F.size(F.split("folder", "/")) == depth)
    return rows.groupBy("folder").agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes"))


def rollup(files: DataFrame, columns: list[str]) -> DataFrame:
    return files.rollup(*columns).agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes"), F.grouping_id().cast("long").alias("level"))


def duplicate_groups(files: DataFrame) -> DataFrame:
    """hash, copies, bytes that go without them and first path of contents that occur twice or more."""
    groups = files.groupBy("hash").agg(F.count("*").alias("copies"), (F.sum("size") - F.min("size")).cast("long").alias("wasted"), F.min("path").alias("first_path"))
    return groups.where("copies > 1")


def surplus(files: DataFrame) -> DataFrame:
    """Every file but the first of its content, by path: a grouped minimum, and a join that skips single contents."""
    first = files.groupBy("hash").agg(F.min("path").alias("keep"), F.count("*").alias("copies")).where("copies > 1")
    return files.join(first, "hash").where("path <> keep").select("path", "hash", "size", "keep")


def global_digest(files: DataFrame, letters: tuple[int, ...] = (6, 3, 0)) -> DataFrame:
    """One SHA-256 over the digests of all files in order, with the number of files of each, in levels.

    Equal digests are counted first, so copies are one row. Digests that agree in their
    first six letters are hashed together, then those results that agree in three, then
    all: no task gathers more than 4096 values above the lowest level, where 16 million
    ranges share all digests. The result does not depend on partitions.
    """
    counted = files.groupBy("hash").agg(F.count("*").alias("n"))
    rows = counted.select(F.col("hash").alias("place"), F.concat_ws(":", "hash", "n").alias("digest"), "n")
    for k in letters:
        ordered = F.array_sort(F.collect_list(F.struct("place", "digest")))
        joined = F.array_join(F.transform(ordered, lambda x: x["digest"]), "")
        rows = rows.groupBy(F.substring("place", 1, k).alias("place")).agg(F.sum("n").alias("n"), F.sha2(joined, 256).alias("digest"))
    return rows.select(F.col("n").alias("files"), "digest")


def kind_profile(files: DataFrame, kind: str = "kind") -> DataFrame:
    """Files, bytes and share of all bytes of each kind, largest first."""
    per = files.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes"))
    share = F.round(F.lit(100.0) * F.col("bytes") / F.sum("bytes").over(Window.partitionBy(F.lit(1))), 4)
    return per.withColumn("share", share).orderBy(F.desc("bytes"), "kind")


def compression_summary(files: DataFrame, group: str) -> DataFrame:
    return files.groupBy(group).agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes_in"), F.sum("stored").cast("long").alias("bytes_out"), F.round(F.sum("stored") / F.sum("size"), 6).alias("ratio"))


def occurrences(text: Column, literal: str) -> Column:
    """How often a literal occurs, without overlaps."""
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(literal), F.lit("")))) / len(literal.encode())).cast("long")


def count_string(files: DataFrame, literal: str, wanted: int) -> DataFrame:
    """Occurrences of a string over all files, and whether they are as many as wanted."""
    total = F.coalesce(F.sum(occurrences(F.col("text"), literal)), F.lit(0))
    return files.agg(total.alias("found")).withColumn("ok", F.col("found") == wanted)


def collisions(files: DataFrame) -> DataFrame:
    """Digests that stand for two contents: equal weak, different strong."""
    return files.groupBy("weak").agg(F.count_distinct("strong").alias("contents")).where("contents > 1")


def _counted(blocks: DataFrame, content: str, codes: Callable[[np.ndarray], np.ndarray], kinds: int) -> DataFrame:
    """code and n: how often each code of a block's bytes occurs; counted by numpy where the blocks lie, a row for each code and batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(kinds, np.int64)
            for b in batch.column(0).to_pylist():
                if b:
                    total += np.bincount(codes(np.frombuffer(b, np.uint8)), minlength=kinds)
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"code": pa.array(found.astype(np.int32)), "n": pa.array(total[found])})

    parts = blocks.select(F.col(content).cast("binary")).mapInArrow(run, "code int, n long")
    return parts.groupBy("code").agg(F.sum("n").alias("n"))


def byte_histogram(blocks: DataFrame, content: str = "content") -> DataFrame:
    """How often each byte occurs in all blocks."""
    return _counted(blocks, content, lambda b: b, 256).select(F.col("code").alias("byte"), "n")


def byte_pairs(blocks: DataFrame, content: str = "content") -> DataFrame:
    """How often each byte follows each other one; the first of a block follows byte 0."""
    pairs = lambda b: np.r_[np.uint8(0), b[:-1]].astype(np.int64) * 256 + b
    return _counted(blocks, content, pairs, 65_536).select(F.floor(F.col("code") / 256).cast("int").alias("before"), (F.col("code") % 256).alias("byte"), "n")


def entropy(histogram: DataFrame, given: str | None = None) -> DataFrame:
    """Bits per byte of a histogram, or of one given the byte before."""
    part = Window.partitionBy(given) if given else Window.partitionBy(F.lit(1))
    rows = histogram.withColumn("total", F.sum("n").over(part)).withColumn("all", F.sum("n").over(Window.partitionBy(F.lit(1))))
    bits = F.sum(-F.col("n") / F.col("all") * F.log2(F.col("n") / F.col("total")))
    return rows.agg(F.round(bits, 6).alias("bits"))
