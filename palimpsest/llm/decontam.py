"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as lower-case words of letters and digits joined by
single spaces. An item of m characters may differ by k = m // 16 edits; the spaces
before and behind it count as part of it, so that an item without a budget is found
as whole words only. It is cut into k + 1 pieces; k edits leave one of them whole,
so every occurrence within the budget holds an exact piece hit. One automaton finds
the pieces of all items in a single pass over a text; each hit gives a window, and
Myers' bit-parallel distance decides how far the item is from the best part of it.

The items are the query set. They go to the workers in blocks of bounded size;
each block is matched against all rows, and rows are never shuffled.

Rows: a null or wordless text has no items; a text of any length is searched whole;
an item that occurs more than once counts with its least edits; repeated rows are
judged one by one; items that are null or have no words match nothing; repeated
items are each reported; a null item_id is left out of the list but still counts;
extra columns, whatever their names, are ignored, or kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import map_batches

#: One edit is allowed for so many characters.
PER_EDIT = 16
#: Characters of items in one block, and of texts that are matched against one block at a time.
BLOCK_CHARS, TEXT_CHARS = 500_000, 8_000_000
#: Automata that a worker keeps; with more blocks it makes them anew for each run of texts.
KEPT_BLOCKS = 8
#: ASCII characters other than letters and digits become spaces.
TABLE = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def normalise(text: str) -> str:
    return b" ".join(text.lower().encode().translate(TABLE).split()).decode()


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """item cut into edits + 1 runs of near equal length, with their offsets."""
    cuts = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def best_distance(pattern: str, text: str) -> int:
    """The least edit distance of pattern to any part of text, by Myers' bit vectors."""
    m = len(pattern)
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = m
    for c in text:
        equal = where.get(c, 0)
        vertical = equal | minus
        horizontal = ((equal & plus) + plus ^ plus) | equal
        up = minus | ~(horizontal | plus) & full
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best = score
        up, down = up << 1 & full, down << 1 & full
        plus = down | ~(vertical | up) & full
        minus = up & vertical
    return best


class Block:
    """An automaton over the pieces of some items."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.items = [(i, f" {t} ", len(t) // PER_EDIT) for i, t in items]
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, edits) in enumerate(self.items):
            for offset, piece in pieces(t, edits):
                found.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, at in found.items():
            self.automaton.add_word(piece, (len(piece), at))
        self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int]]:
        """(place of the item, least edits) of each item within its budget in a normalised text."""
        text = f" {text} "
        windows: dict[int, list[list[int]]] = {}
        for end, (length, at) in self.automaton.iter(text):
            for n, offset in at:
                _, item, edits = self.items[n]
                start = end - length + 1 - offset
                a, b = max(0, start - edits), start + len(item) + edits
                own = windows.setdefault(n, [])
                if own and a <= own[-1][0] + edits:  # the same place, found by another piece
                    own[-1] = [min(own[-1][0], a), max(own[-1][1], b)]
                else:
                    own.append([a, b])
        out = []
        for n, own in windows.items():
            _, item, edits = self.items[n]
            parts = {text[a:b] for a, b in own}
            least = 0 if any(item in part for part in parts) else min(best_distance(item, part) for part in parts)
            if least <= edits:
                out.append((n, least))
        return sorted(out)


def blocks(items: DataFrame) -> list:
    """Broadcast lists of (item_id, normalised text), each of about BLOCK_CHARS characters."""
    context = items.sparkSession.sparkContext
    out, own, size = [], [], 0
    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text")
    for i, text in rows.toLocalIterator():
        if text := normalise(text or ""):
            own.append((i, text))
            size += len(text)
            if size >= BLOCK_CHARS:
                out.append(context.broadcast(own))
                own, size = [], 0
    return out + ([context.broadcast(own)] if own else [])


def finder(shared: list):
    """A function from texts to their lists of (item_id, edits)."""
    ready: dict[int, Block] = {}

    def find(texts: list[str]) -> list[list[tuple[int | None, int]]]:
        out: list[list[tuple[int | None, int]]] = [[] for _ in texts]
        for k, values in enumerate(shared):
            block = ready.get(k)
            if block is None:
                if len(ready) >= KEPT_BLOCKS:
                    ready.pop(next(iter(ready)))
                block = ready[k] = Block(values.value)
            for own, text in zip(out, texts, strict=True):
                if text:
                    own += [(block.items[n][0], d) for n, d in block.matches(text)]
        return out

    return find


def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Runs of rows of bounded size, with their normalised texts; the text is the last column."""
    for batch in batches:
        start = size = 0
        texts: list[str] = []
        for i, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
            texts.append(normalise(t or ""))
            size += len(texts[-1])
            if size >= TEXT_CHARS or i == batch.num_rows - 1:
                yield batch.slice(start, i + 1 - start), texts
                start, size, texts = i + 1, 0, []


def find(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_items, items, least_edits (of any item; null if none), contaminated: a row per row of docs (doc_id, text)."""
    shared = blocks(items)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = finder(shared)
        for batch, texts in runs(batches):
            found = look(texts)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "n_items": pa.array([len(x) for x in found], pa.int64()),
                    "items": pa.array([sorted(i for i, _ in x if i is not None) for x in found], pa.list_(pa.int64())),
                    "least_edits": pa.array([min((d for _, d in x), default=None) for x in found], pa.int32()),
                    "contaminated": pa.array([bool(x) for x in found], pa.bool_()),
                }
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(slim, run, "doc_id long, n_items long, items array<long>, least_edits int, contaminated boolean")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, all of their columns, that hold no item within its budget."""
    shared = blocks(items)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = finder(shared)
        for batch, texts in runs(batches):
            keep = pa.array([not x for x in look(texts)], pa.bool_())
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).filter(keep)

    own = docs.select("*", F.col("text").cast("string").alias("text matched with items"))
    return map_batches(own, run, docs.schema)
