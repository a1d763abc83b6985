"""Block codecs: encode(bytes, level) and decode(bytes), as Arrow functions over binary columns.

A block is a short header (codec, size of the original) and a payload. A codec's
output is kept only if it is smaller than the original by more than 16 bytes;
otherwise the block is stored as it is.
"""

from __future__ import annotations

import bz2
import hashlib
import lzma
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAVING = 16
#: Bytes of the dictionary of each level of lzma.
DICTIONARIES = [1 << n for n in (18, 20, 21, 22, 22, 23, 23, 24, 25, 26)]
#: Rows and bytes of contents that go to a worker at a time. Contents may be long.
BATCH_ROWS, BATCH_BYTES = 400, 4_000_000


@dataclass(frozen=True)
class Codec:
    name: str
    family: str
    least: int
    most: int
    default: int
    encode: Callable[[bytes, int], bytes]
    decode: Callable[[bytes, int], bytes]

    @property
    def card(self) -> str:
        return f"name={self.name}\nfamily={self.family}\nmin={self.least}\nmax={self.most}\ndefault={self.default}"


def _arrow(name: str) -> tuple[Callable[[bytes, int], bytes], Callable[[bytes, int], bytes]]:
    def encode(data: bytes, level: int) -> bytes:
        return pa.Codec(name, compression_level=level if name in ("brotli", "gzip") else None).compress(data, asbytes=True)

    def decode(data: bytes, size: int) -> bytes:
        return pa.decompress(data, decompressed_size=size, codec=name, asbytes=True)

    return encode, decode


def runs_encode(data: bytes, level: int) -> bytes:
    """Pairs of a count (1 to 255) and a byte; the data itself, which a block stores, if they are no shorter."""
    values = np.frombuffer(data, np.uint8)
    if 2 * np.count_nonzero(values[1:] != values[:-1]) >= len(data) - 2:
        return data
    starts = np.flatnonzero(np.diff(values, prepend=~values[:1]))
    more, rest = np.divmod(np.diff(starts, append=len(values)) - 1, 255)
    ends = np.cumsum(more + 1)
    out = np.full((ends[-1] if len(ends) else 0, 2), 255, np.uint8)
    out[ends - 1, 0] = rest + 1
    out[:, 1] = np.repeat(values[starts], more + 1)
    return out.tobytes()


def runs_decode(data: bytes, size: int) -> bytes:
    return b"".join(data[i + 1 : i + 2] * data[i] for i in range(0, len(data), 2))


def lzma_encode(data: bytes, level: int) -> bytes:
    """What the level gives, with a dictionary no larger than the data needs: the encoder's tables are as large as that."""
    size = min(DICTIONARIES[level], max(4096, 1 << (len(data) - 1).bit_length()))
    return lzma.compress(data, filters=[{"id": lzma.FILTER_LZMA2, "preset": level, "dict_size": size}])


CODECS = {
    c.name: c
    for c in [
        Codec("store", "none", 0, 0, 0, lambda b, n: b, lambda b, n: b),
        Codec("rle", "run length", 0, 0, 0, runs_encode, runs_decode),
        Codec("deflate", "LZ+Huffman", 0, 9, 6, lambda b, n: zlib.compress(b, n), lambda b, n: zlib.decompress(b)),
        Codec("bzip2", "BWT", 1, 9, 9, lambda b, n: bz2.compress(b, n), lambda b, n: bz2.decompress(b)),
        Codec("lzma", "LZ+range coder", 0, 9, 6, lzma_encode, lambda b, n: lzma.decompress(b)),
        Codec("zstd", "LZ+FSE", 1, 22, 3, lambda b, n: zstandard.ZstdCompressor(level=n).compress(b), lambda b, n: zstandard.ZstdDecompressor().decompress(b, max_output_size=n)),
        Codec("brotli", "LZ+dictionary", 0, 11, 6, *_arrow("brotli")),
        Codec("snappy", "LZ", 1, 1, 1, *_arrow("snappy")),
        Codec("lz4", "LZ", 1, 1, 1, *_arrow("lz4_raw")),
    ]
}
#: Names of levels, and the codec and level they stand for.
LEVELS = {"store": ("store", 0), "fast": ("lz4", 1), "lean": ("zstd", 1), "normal": ("zstd", 3), "good": ("zstd", 9), "better": ("zstd", 15), "ultra": ("zstd", 19), "max": ("lzma", 9)}
HEADER = struct.Struct("<BQ")
ORDER = sorted(CODECS)


class DamagedBlock(ValueError):
    """A block that does not decode to its stated size."""


def encode_block(data: bytes, codec: str, level: int | None = None) -> bytes:
    c = CODECS[codec]
    level = c.default if level is None else level
    if not c.least <= level <= c.most:
        raise ValueError(f"{codec} has levels {c.least} to {c.most}")
    payload = c.encode(data, level)
    if codec != "store" and len(payload) >= len(data) - SAVING:
        codec, payload = "store", data
    return HEADER.pack(ORDER.index(codec), len(data)) + payload


def decode_block(block: bytes) -> bytes:
    try:
        code, size = HEADER.unpack_from(block)
        out = CODECS[ORDER[code]].decode(block[HEADER.size :], size)
    except Exception as error:
        raise DamagedBlock(str(error)) from error
    if len(out) != size:
        raise DamagedBlock(f"{len(out)} bytes, not {size}")
    return out


def small_batches(spark: SparkSession) -> None:
    """Have Spark hand contents to workers in batches of bounded size, so that what a worker holds does not grow with the input."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def encoded(content: Column, codec: str, level: int | None = None) -> Column:
    small_batches(SparkSession.active())

    @F.pandas_udf("binary")
    def of(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else encode_block(bytes(b), codec, level))

    return of(content.cast("binary"))


def decoded(block: Column) -> Column:
    """The content of a block; null if the block is damaged."""
    small_batches(SparkSession.active())

    def one(b: object) -> bytes | None:
        try:
            return None if b is None else decode_block(bytes(b))  # type: ignore[call-overload]
        except DamagedBlock:
            return None

    @F.pandas_udf("binary")
    def of(values: pd.Series) -> pd.Series:
        return values.map(one)

    return of(block)


def recoded(blocks: DataFrame, codec: str, level: int | None = None, column: str = "payload") -> DataFrame:
    """blocks with their payload decoded and encoded anew, batch by batch; null stays null."""
    at = blocks.columns.index(column)
    small_batches(blocks.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [None if b is None else encode_block(decode_block(b), codec, level) for b in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(new, pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return blocks.mapInArrow(run, blocks.schema)


def assembled(blocks: DataFrame, digest: bool = False) -> DataFrame:
    """key and content of every key of blocks (key, ord, payload): its blocks decoded, in order; with digest, key and hash, the content's SHA-256. Null if a block is damaged.

    Blocks stream over sorted partitions, so a worker holds a content at a time, and with digest only a block.
    """
    small_batches(blocks.sparkSession)
    name, kind = ("hash", pa.string()) if digest else ("content", pa.binary())

    def contents(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, str | bytes | None]]:
        last, whole, sound = None, None, True
        value = lambda: None if not sound else whole.hexdigest() if digest else bytes(whole)
        for batch in batches:
            for key, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != last:
                    if last is not None:
                        yield last, value()
                    last, whole, sound = key, hashlib.sha256() if digest else bytearray(), True
                try:
                    piece = decode_block(block)
                except DamagedBlock:
                    sound = False
                else:
                    whole.update(piece) if digest else whole.extend(piece)
        if last is not None:
            yield last, value()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, str | bytes | None]] = []
        size = 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([v for _, v in rows], kind)], ["key", name])
        for row in contents(batches):
            rows.append(row)
            size += len(row[1] or b"")
            if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield pack()
                rows, size = [], 0
        if rows:
            yield pack()

    dealt = blocks.select("key", "ord", "payload").repartition("key").sortWithinPartitions("key", "ord")
    return dealt.select("key", "payload").mapInArrow(run, f"key string, {name} {'string' if digest else 'binary'}")


def block_sizes(contents: DataFrame, names: list[str] | None = None) -> DataFrame:
    """size and, for each codec, the bytes of its block, of every row of contents (content); blocks do not leave the worker. Null for null."""
    names = names or list(CODECS)
    small_batches(contents.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_pylist()
            of = [[None if b is None else len(b) for b in values], *([None if b is None else len(encode_block(b, name)) for b in values] for name in names)]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()) for n in of], ["size", *names])

    return contents.select(F.col("content").cast("binary")).mapInArrow(run, ", ".join(f"`{c}` long" for c in ("size", *names)))


def round_trips(contents: DataFrame, key: str, names: list[str] | None = None) -> DataFrame:
    """key, codec, ok for every row of contents (key, content) and every codec: whether the content comes back from its block. Null comes back as null."""
    names = names or list(CODECS)
    small_batches(contents.sparkSession)

    def back(data: bytes | None, name: str) -> bool:
        try:
            return data is None or decode_block(encode_block(data, name)) == data
        except DamagedBlock:
            return False

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).to_pylist()
            for name in names:
                ok = [back(b, name) for b in values]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([name] * len(ok), pa.string()), pa.array(ok, pa.bool_())], [key, "codec", "ok"])

    kind = dict(contents.dtypes)[key]
    return contents.select(key, F.col("content").cast("binary")).mapInArrow(run, f"`{key}` {kind}, codec string, ok boolean")


def registry(spark: SparkSession) -> DataFrame:
    """name, family, min_level, max_level, card of every codec."""
    rows = [(c.name, c.family, c.least, c.most, c.card) for c in CODECS.values()]
    return spark.createDataFrame(rows, "name string, family string, min_level int, max_level int, card string")


def preferred(wishes: DataFrame, codecs: DataFrame) -> DataFrame:
    """For each id the first entry of its wishes (codec:level) that exists with that level; null if none does."""
    each = wishes.select("id", F.posexplode("wishes").alias("pos", "wish"))
    each = each.withColumn("name", F.substring_index("wish", ":", 1)).withColumn("level", F.when(F.col("wish").contains(":"), F.substring_index("wish", ":", -1).try_cast("int")))
    fits = F.col("level").isNull() & ~F.col("wish").contains(":") | F.col("level").between(F.col("min_level"), F.col("max_level"))
    known = each.join(codecs.select("name", "min_level", "max_level"), "name").where(fits)
    best = known.groupBy("id").agg(F.min_by("wish", "pos").alias("chosen"))
    return wishes.select("id").join(best, "id", "left")
