"""Digests: those that Spark has as columns, the others as Arrow functions over batches."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F


def _bytes(x: object) -> bytes:
    return b"" if x is None else bytes(x)  # type: ignore[call-overload]


#: Digests of bytes that are not Spark's own, as hexadecimal text.
OTHERS: dict[str, Callable[[bytes], str]] = {
    "sha3_256": lambda b: hashlib.sha3_256(b).hexdigest(),
    "blake2b": lambda b: hashlib.blake2b(b).hexdigest(),
    "adler32": lambda b: f"{zlib.adler32(b):08x}",
    "xxh32": xxhash.xxh32_hexdigest,
    "xxh64": xxhash.xxh64_hexdigest,
    "xxh3": xxhash.xxh3_64_hexdigest,
    "xxh128": xxhash.xxh3_128_hexdigest,
}


def digest(data: Column, algorithm: str, offset: int = 0) -> Column:
    """A digest of bytes from an offset on, in lower-case hexadecimal; null for null."""
    data = data.cast("binary")
    if offset:
        data = F.substring(data, F.lit(offset + 1), F.octet_length(data))
    if algorithm == "md5":
        return F.md5(data)
    if algorithm == "sha1":
        return F.sha1(data)
    if algorithm == "sha256":
        return F.sha2(data, 256)
    if algorithm == "crc32":
        return F.lpad(F.lower(F.hex(F.crc32(data))), 8, "0")
    function = OTHERS[algorithm]

    @F.pandas_udf("string")
    def of(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else function(_bytes(b)))

    return of(data)
