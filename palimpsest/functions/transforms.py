"""Reversible transforms of bytes, the building blocks of block codecs, as Arrow functions."""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def delta(data: bytes) -> bytes:
    """Differences of neighbouring bytes, mod 256."""
    return np.diff(np.frombuffer(b"\0" + data, np.uint8)).tobytes() if data else b""


def undelta(data: bytes) -> bytes:
    return np.cumsum(np.frombuffer(data, np.uint8), dtype=np.uint64).astype(np.uint8).tobytes()


def move_to_front(data: bytes) -> bytes:
    table, out = list(range(256)), bytearray()
    for b in data:
        i = table.index(b)
        out.append(i)
        table.insert(0, table.pop(i))
    return bytes(out)


def unmove_to_front(data: bytes) -> bytes:
    table, out = list(range(256)), bytearray()
    for i in data:
        b = table.pop(i)
        out.append(b)
        table.insert(0, b)
    return bytes(out)


def suffix_order(data: np.ndarray) -> np.ndarray:
    """The order of all rotations, by doubling the length that ranks stand for."""
    n = len(data)
    rank, length = data.astype(np.int64), 1
    while True:
        pair = rank * (n + 256) + np.roll(rank, -length)
        order = np.argsort(pair, kind="stable")
        ranked = np.cumsum(np.r_[0, np.diff(pair[order]) != 0])
        rank = np.empty(n, np.int64)
        rank[order] = ranked
        length *= 2
        if ranked[-1] == n - 1 or length >= n:
            return order


def block_sort(data: bytes) -> bytes:
    """The last bytes of all rotations in order, behind the place of the original."""
    if not data:
        return b""
    order = suffix_order(np.frombuffer(data, np.uint8))
    last = np.frombuffer(data, np.uint8)[order - 1]
    return struct.pack("<I", int(np.flatnonzero(order == 0)[0])) + last.tobytes()


def unblock_sort(data: bytes) -> bytes:
    if not data:
        return b""
    at, last = struct.unpack("<I", data[:4])[0], np.frombuffer(data[4:], np.uint8)
    follow = np.argsort(last, kind="stable").tolist()
    out, values = bytearray(), last.tolist()
    for _ in values:
        at = follow[at]
        out.append(values[at])
    return bytes(out)


def zero_runs(data: bytes) -> bytes:
    """A zero byte is followed by how many more follow it, up to 255; other bytes stand for themselves."""
    out, i = bytearray(), 0
    while i < len(data):
        out.append(data[i])
        if data[i] == 0:
            j = i + 1
            while j < len(data) and data[j] == 0 and j - i <= 255:
                j += 1
            out.append(j - i - 1)
            i = j
        else:
            i += 1
    return bytes(out)


def unzero_runs(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        if data[i] == 0:
            out += bytes(data[i + 1] + 1)
            i += 2
        else:
            out.append(data[i])
            i += 1
    return bytes(out)


TRANSFORMS: dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {
    "delta": (delta, undelta),
    "mtf": (move_to_front, unmove_to_front),
    "bwt": (block_sort, unblock_sort),
    "zrlt": (zero_runs, unzero_runs),
}


def apply(chain: list[str], data: bytes) -> bytes:
    for name in chain:
        data = TRANSFORMS[name][0](data)
    return data


def undo(chain: list[str], data: bytes) -> bytes:
    for name in reversed(chain):
        data = TRANSFORMS[name][1](data)
    return data


def transformed(data: Column, chain: list[str], inverse: bool = False) -> Column:
    """A chain of transforms, or its inverse, over binary values."""
    function = undo if inverse else apply

    @F.pandas_udf("binary")
    def of(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else function(chain, bytes(b)))

    return of(data.cast("binary"))
