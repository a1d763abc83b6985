"""Cutting contents into fragments, storing each once, and packing them in order."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_line(files: DataFrame, text: str = "text") -> DataFrame:
    """Every column but the text, with ord and fragment: the lines of each text."""
    others = [c for c in files.columns if c != text]
    return files.select(*others, F.posexplode(F.split(F.col(text), "\n")).alias("ord", "fragment"))


def by_length(files: DataFrame, length: int = 1024, text: str = "text") -> DataFrame:
    """The same with fragments of a fixed number of letters; an empty text has one empty fragment."""
    others = [c for c in files.columns if c != text]
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / length) - 1, F.lit(0)).cast("int"))
    at = files.select(*others, text, F.explode(starts).alias("ord"))
    return at.select(*others, "ord", F.substring(F.col(text), F.col("ord") * length + 1, F.lit(length)).alias("fragment"))


#: A table of 256 pseudo-random words, made from a seed, for the rolling hash of content-defined cuts.
GEAR = np.random.default_rng(1701).integers(0, 2**32, 256, np.uint64)


def cuts(data: bytes, least: int, bits: int, most: int) -> list[int]:
    """Ends of content-defined fragments: where the low bits of a rolling hash of 32 bytes are zero, within bounds of length."""
    n = len(data)
    if n <= least:
        return [n]
    gear = GEAR[np.frombuffer(data, np.uint8)]
    rolled = np.zeros(n, np.uint64)
    for age in range(min(32, n)):  # each byte is shifted out after 32 steps
        rolled[age:] += gear[: n - age] << np.uint64(age)
    marks = np.flatnonzero((rolled & np.uint64(((1 << bits) - 1) << (32 - bits))) == 0) + 1
    out, start = [], 0
    while n - start > least:
        i = np.searchsorted(marks, start + least)
        end = int(marks[i]) if i < len(marks) else n
        end = min(end, start + most, n)
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


def by_content(files: DataFrame, key: str, content: str = "content", least: int = 256, bits: int = 10, most: int = 8192) -> DataFrame:
    """key, ord, offset, sha1, size of content-defined fragments: an edit moves only the cuts around it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            rows = []
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = 0
                for n, end in enumerate(cuts(data or b"", least, bits, most)):
                    rows.append((k, n, start, hashlib.sha1((data or b"")[start:end]).hexdigest(), end - start))
                    start = end
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, [batch.schema.types[0], pa.int32(), pa.int64(), pa.string(), pa.int32()], strict=True)], ["key", "ord", "offset", "sha1", "size"])

    kind = dict(files.dtypes)[key]
    return files.select(key, F.col(content).cast("binary")).mapInArrow(run, f"key {kind}, ord int, offset long, sha1 string, size int")


def dedup_counts(fragments: DataFrame, group: str) -> DataFrame:
    """Fragments, distinct ones and bytes of both for each group. Equal fragments meet once, by digest."""
    hashed = fragments.select(group, F.sha1(F.col("fragment").cast("binary")).alias("sha1"), F.octet_length("fragment").cast("long").alias("size"))
    once = hashed.groupBy(group, "sha1").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    return once.groupBy(group).agg(F.sum("n").cast("long").alias("fragments"), F.count("*").alias("distinct_fragments"), F.sum(F.col("n") * F.col("size")).cast("long").alias("bytes"), F.sum("size").cast("long").alias("stored_bytes"))


def dedup_ratio(fragments: DataFrame) -> DataFrame:
    """Bytes, bytes stored once, and their ratio."""
    once = fragments.groupBy(F.sha1(F.col("fragment").cast("binary")).alias("sha1")).agg(F.sum(F.octet_length("fragment").cast("long")).alias("bytes"), F.max(F.octet_length("fragment").cast("long")).alias("size"))
    sums = once.agg(F.sum("bytes").cast("long").alias("bytes"), F.sum("size").cast("long").alias("stored_bytes"))
    return sums.withColumn("ratio", F.round(F.col("stored_bytes") / F.col("bytes"), 6))


def new_fragments(scan: DataFrame, stored: DataFrame) -> DataFrame:
    """Fragments of a scan whose digest is not stored yet, each once; both have sha1."""
    return scan.dropDuplicates(["sha1"]).join(stored.select("sha1"), "sha1", "left_anti")


def reassembled(pieces: DataFrame, key: str, order: str, piece: str, glue: str = "") -> DataFrame:
    """key and content: the pieces of each key in order. A key's pieces are those of one file, which fit a row."""
    ordered = F.array_sort(F.collect_list(F.struct(order, piece)))
    return pieces.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x[piece]), glue).alias("content"))


def packed(rows: DataFrame, group: list[str], order: list[Column], size: str, limit: int) -> DataFrame:
    """rows with part: each group is cut in order, a part closes before the row that would pass the limit, and a larger row stands alone.

    The fold is sequential in a group and streams over sorted partitions, so it
    holds one number for a group, not its rows.
    """
    names = rows.columns
    at, keys = names.index(size), [names.index(g) for g in group]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part, filled = None, 0, 0
        for batch in batches:
            parts = []
            for *key, n in zip(*(batch.column(i).to_pylist() for i in [*keys, at]), strict=True):
                if key != last:
                    last, part, filled = key, 0, 0
                elif filled + n > limit and filled:
                    part, filled = part + 1, 0
                filled += n
                parts.append(part)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.int32())], names=[*names, "part"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    dealt = rows.repartition(*group).sortWithinPartitions(*group, *order)
    return dealt.mapInArrow(run, f"{fields}, part int")


def packed_roughly(rows: DataFrame, group: list[str], order: list[Column], size: str, limit: int) -> DataFrame:
    """rows with part: by running sums, so in SQL alone; a part may pass the limit by one row."""
    before = F.sum(size).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)
    return rows.withColumn("part", F.floor(before / limit).cast("int"))
