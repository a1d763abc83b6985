"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (equal texts) are items; the largest go first, each into the fullest bin
that still holds it, found in a balanced tree of remaining capacities. The
capacity is the smallest at which the packing needs no more bins than asked for,
found by bisection, so the shards' sizes are near equal.

Every group is packed. Groups of equal bytes are alike to the packing: the driver
packs (bytes, number of groups) and gets how many of them each bin takes, which is
what packing them one by one gives, as the tightest bin that holds one stays the
tightest until it holds no other. B bytes have at most sqrt(2 B) different sizes,
whatever the number of groups. Sizes that one bin takes whole go there by a join;
the groups of the few sizes that bins share are numbered, in parts, and dealt by number.

Rows: a null text counts as empty and has size 1; rows with equal texts are one
group, whatever their doc_id, and never part; groups of equal bytes are dealt in
the order of a digest; a text of any length is one item; a null doc_id takes its
place before the others; extra columns, whatever their names, are ignored. A group
larger than a fair share has a shard of its own, as it cannot be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import materialise, sized

#: Rows of one shard, or groups of one size, that are numbered by one task.
SLOT_ROWS = 1_000_000


class CapacityTree:
    """Remaining capacities of bins in a treap, ordered by (remaining, bin)."""

    def __init__(self) -> None:
        self.root: list | None = None  # [key, priority, left, right]

    def _split(self, node: list | None, key: tuple[int, int]) -> tuple[list | None, list | None]:
        """Nodes below key, and the rest."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], rest = self._split(node[3], key)
            return node, rest
        below, node[2] = self._split(node[2], key)
        return below, node

    def _join(self, a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._join(a[3], b)
            return a
        b[2] = self._join(a, b[2])
        return b

    def add(self, key: tuple[int, int]) -> None:
        below, above = self._split(self.root, key)
        priority = hash((key, 0x9E3779B97F4A7C15))
        self.root = self._join(self._join(below, [key, priority, None, None]), above)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin of least remaining capacity that is not below size."""
        below, above = self._split(self.root, (size, -1))
        if above is None:
            self.root = below
            return None
        node, parent = above, None
        while node[2] is not None:
            node, parent = node[2], node
        if parent is None:
            above = node[3]
        else:
            parent[2] = node[3]
        self.root = self._join(below, above)
        return node[0]


Placed = list[tuple[int, int]]  # (bin, number of items)


def best_fit_decreasing(sizes: list[tuple[int, int]], capacity: int) -> list[Placed]:
    """How many items of each size go to which bin; sizes are (size, number of items) in descending order. A size over the capacity gets bins of its own."""
    tree, out, bins = CapacityTree(), [], 0
    for size, n in sizes:
        own: Placed = []
        while n:
            found = tree.take_tightest(size)
            if found is None:
                found = max(capacity, size), bins
                bins += 1
            take = min(n, found[0] // size)
            own.append((found[1], take))
            tree.add((found[0] - take * size, found[1]))
            n -= take
        out.append(own)
    return out


def pack(sizes: list[tuple[int, int]], bins: int) -> list[Placed]:
    """best_fit_decreasing at the smallest capacity found that needs ``bins`` bins at most.

    Items over a fair share of what is left get bins of their own first, so that
    they do not set the capacity of the other bins.
    """
    out: list[Placed] = [[] for _ in sizes]
    rest = [[size, n, k] for k, (size, n) in enumerate(sizes)]
    left, alone = sum(s * n for s, n in sizes), 0
    while rest and alone < bins - 1 and rest[0][0] * (bins - alone) > left:
        size, _, k = rest[0]
        out[k].append((alone, 1))
        left -= size
        alone += 1
        rest[0][1] -= 1
        if not rest[0][1]:
            rest.pop(0)
    if not rest:
        return out
    items, bins = [(s, n) for s, n, _ in rest], bins - alone
    needed = lambda placed: 1 + max(b for of_size in placed for b, _ in of_size)
    low = max(items[0][0], -(-left // bins))
    high = 2 * low
    best = best_fit_decreasing(items, high)
    while needed(best) > bins:
        high *= 2
        best = best_fit_decreasing(items, high)
    while low < high:
        middle = (low + high) // 2
        found = best_fit_decreasing(items, middle)
        if needed(found) <= bins:
            best, high = found, middle
        else:
            low = middle + 1
    for (_, _, k), of_size in zip(rest, best, strict=True):
        out[k] += [(alone + b, n) for b, n in of_size]
    return out


def numbered(rows: DataFrame, of: str, order: list, parts: int) -> DataFrame:
    """rows with ``place``, from 0 and gapless for each value of column ``of``; numbered inside parts by hash, which follow each other."""
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    sizes = dealt.groupBy(of, "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy(of).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(of, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(of, "part").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    placed = dealt.withColumn("place", F.row_number().over(inside) - 1)
    return placed.join(sized(materialise(offsets)), [of, "part"]).withColumn("place", F.col("offset") + F.col("place")).drop("part", "offset")


def shards(docs: DataFrame, bins: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of docs (doc_id, text)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = materialise(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("g1"),
            F.xxhash64(F.lit(1), text).alias("g2"),
        )
    )
    groups = materialise(rows.groupBy("g1", "g2").agg(F.sum("size").alias("bytes")))
    sizes = sorted(((r.bytes, r["count"]) for r in groups.groupBy("bytes").count().collect()), reverse=True)  # at most sqrt(2 * all bytes) rows
    placed = pack(sizes, bins)
    whole = [(s, own[0][0]) for (s, _), own in zip(sizes, placed, strict=True) if len(own) == 1]
    shared = []
    for (s, _), own in zip(sizes, placed, strict=True):
        if len(own) > 1:
            first = 0
            for b, n in own:
                shared.append((s, b, first, first + n))
                first += n
    of_whole = spark.createDataFrame(whole, "bytes long, shard int")
    of_shared = F.broadcast(spark.createDataFrame(shared, "bytes long, shard int, low long, high long"))  # at most bins rows for each shared size
    split = F.broadcast(spark.createDataFrame(sorted({(r[0],) for r in shared}), "bytes long"))  # at most ``bins`` sizes, but for those of single groups
    placed_whole = groups.join(sized(of_whole), "bytes").select("g1", "g2", "shard")
    parts = max(16, -(-max((n for _, n in sizes), default=0) // SLOT_ROWS))
    some = numbered(groups.join(split, "bytes", "left_semi"), "bytes", ["g1", "g2"], parts)
    placed_shared = some.join(of_shared, "bytes").where("place >= low and place < high").select("g1", "g2", "shard")
    out = rows.join(sized(materialise(placed_whole.union(placed_shared))), ["g1", "g2"])
    parts = max(16, -(-rows.count() // SLOT_ROWS))
    out = numbered(out, "shard", ["doc_id", "text_crc32", "size"], parts)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
