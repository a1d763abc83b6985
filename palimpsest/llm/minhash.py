"""Near-duplicate documents by min-max hashing, banding and exact confirmation.

Every permutation gives two values of a document, the smallest and the largest,
so a signature of n values costs n/2 hash evaluations. Values are banded; only
documents that share a band are compared, on their full shingle sets.

1. One pass over the texts gives a row of fixed size per document: set size, a
   128-bit digest of the set, and one key per band. Documents with equal digests
   form a class, which gets a number of its own and is compared once, whatever
   number of copies it has.
2. In each bucket all classes are compared with the bucket's smallest: as many
   pairs as members. Confirmed links give components.
3. Classes that are not in the largest component of their bucket are compared
   with a few members of that component, so that a large group of near copies
   joins at a cost in proportion to its size.
4. Classes of a bucket that are still in different components are all compared
   with each other, each pair once, on their full sets; nothing but a size that
   rules a link out keeps a pair from it. So no link between different texts that
   share a band is lost; members of one component need no comparison. In a bucket of
   more than PAIRED classes this is done for blocks of classes, not for rows of pairs.

With 6 values a band and 48 bands a pair of similarity 0.8 shares no band with
probability (1 - 0.8^6)^48 < 5e-7. There are no caps on buckets or partners.

Rows: a null or wordless text has an empty set and is linked with nothing; a text of
any length is hashed whole; rows with one doc_id are rows of their own; of rows that
tie for a component's name the smallest doc_id gives it, and a null doc_id never
does unless all of its rows have none; extra columns, whatever their names, are
ignored by ``groups`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.bpe import chunks
from palimpsest.llm.common import compact, let_go, map_batches, materialise, sized
from palimpsest.llm.components import components

BANDS, ROWS = 48, 6
#: Before the last step, so often each class that is left is compared with so many of the main component's.
TURNS, CENTRES = 1, 16
#: Buckets of at most PAIRED classes are joined pair by pair; classes, and shingles in them, of a block of a larger one.
PAIRED, BLOCK, BLOCK_SHINGLES = 64, 512, 2_000_000
#: Partners that are compared with one copy of a set.
PARTNERS = 256
#: Rows of a class, or classes of a component, from which their join is split.
HEAVY, SALTS = 20_000, 16
#: Similarity in hundredths.
PERCENT = 80
CACHE_WORDS = 200_000
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case: what lower() and split() of bytes mean."""
    return text.encode().lower().split()


def shingles(text: str, width: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of all runs of ``width`` words."""
    words = words_of(text)
    if not words:
        return np.empty(0, U)
    h = np.fromiter(map(hashes.__getitem__, words), U, len(words))
    n = min(width, len(words))
    out = np.full(len(words) - n + 1, U(n))
    for i in range(n):
        out = mix(out * U(0x9E3779B97F4A7C15) + h[i : len(words) - n + 1 + i])
    return np.unique(out)


def permutations(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240501)
    n = (bands * rows + 1) // 2
    return rng.integers(0, 2**64, n, U) | U(1), rng.integers(0, 2**64, n, U)


def band_keys(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """One key per (not empty) set and band, a hash of ``rows`` values of its min-max signature."""
    times, plus = permutations(bands, rows)
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    values = np.empty((2 * len(times), len(sets)), U)
    turned = np.empty_like(flat)
    for i, (t, p) in enumerate(zip(times, plus, strict=True)):
        np.multiply(flat, t, out=turned)
        turned += p
        values[2 * i] = np.minimum.reduceat(turned, starts)
        values[2 * i + 1] = np.maximum.reduceat(turned, starts)
    # the minimum and the maximum of one permutation go to different bands
    order = np.r_[np.arange(0, len(values), 2), np.arange(1, len(values), 2)][: bands * rows]
    keys = np.empty((len(sets), bands), U)
    for b in range(bands):
        key = np.full(len(sets), U(b + 1))
        for v in order[b * rows : (b + 1) * rows]:
            key = mix(key * U(0xD6E8FEB86659FD93) + values[v])
        keys[:, b] = key
    return keys


def text_digest() -> list[Column]:
    text = F.col("text").cast("string")
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, t1 and t2 (digest of the text), n_shingles, d1 and d2 (digest of the set), bands; null where the set is empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in chunks(texts, 1_000_000):
                sets = [shingles(t, width, hashes) for t in texts[a:b]]
                full = [s for s in sets if len(s)]
                keys = iter(band_keys(full, bands, rows).view(np.int64).tolist() if full else ())
                digests = [digest(s) for s in sets]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).slice(a, b - a),
                        "t1": batch.column(2).slice(a, b - a),
                        "t2": batch.column(3).slice(a, b - a),
                        "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                        "d1": pa.array([d for d, _ in digests], pa.int64()),
                        "d2": pa.array([d for _, d in digests], pa.int64()),
                        "bands": pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    }
                )

    return map_batches(docs.select("doc_id", "text", *text_digest()), run, "doc_id long, t1 long, t2 long, n_shingles long, d1 long, d2 long, bands array<long>")


def digest(s: np.ndarray) -> tuple[int | None, int | None]:
    """Two numbers that do not depend on the order of the set's hashes."""
    if not len(s):
        return None, None
    other = mix(s * U(0xA0761D6478BD642F) + U(1))
    return int(mix(s).sum(dtype=U).astype(np.int64)), int(np.bitwise_xor.reduce(other).astype(np.int64))


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """d1, d2 (digest) and s (the sorted shingle hashes) of each text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in chunks(texts, 1_000_000):
                sets = [shingles(t, width, hashes) for t in texts[a:b]]
                digests = [digest(s) for s in sets]
                columns = [pa.array([d[i] for d in digests], pa.int64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([s.tobytes() for s in sets], pa.binary())], ["d1", "d2", "s"])

    return map_batches(docs.select("text"), run, "d1 long, d2 long, s binary")


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are alike. A set a goes out once for some PARTNERS of its partners, which are dealt by hash."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("parts")).where("parts > 1")
    dealt = pairs.join(sized(materialise(many)), "a", "left").select("a", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).alias("part"), "b")
    hubs = dealt.select("a", "part").distinct().join(sets.withColumnRenamed("c", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "s")
    others = dealt.join(sets.withColumnRenamed("c", "b"), "b").select("a", "part", "b", "s")
    rows = hubs.union(others).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.empty(0, U)
        for batch in batches:
            good = []
            for a, b, s in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if b is None:
                    hub = np.frombuffer(s, U)
                elif alike(hub, np.frombuffer(s, U), percent):
                    good.append((a, b))
            yield pairs_batch(good)

    return map_batches(rows, run, "a long, b long")


def parts_of(count: Column, shingles_: Column) -> Column:
    """Blocks for so many classes with so many shingles in all."""
    return F.greatest(F.ceil(count / BLOCK), F.ceil(shingles_ / BLOCK_SHINGLES), F.lit(1)).cast("int")


def part(parts: Column) -> Column:
    """The block of class c among ``parts``."""
    return F.pmod(F.xxhash64("c", F.lit(7)), parts).cast("int")


def blockwise(left: DataFrame, right: DataFrame, sets: DataFrame, percent: int, first: bool) -> DataFrame:
    """Links (a, b) between classes of ``left`` and ``right`` with equal key, of different components.

    Both have key, x and y (a pair of blocks), c, g and bands. A pair of blocks is a
    group of some BLOCK rows a side, and of bounded bytes, held in memory by one task
    at a time; it returns no more links than join its components. If ``first``, a pair
    counts only in the bucket of the first band that it shares.
    """
    columns = ["key", "x", "y", "side", "c", "g", "bands"]
    both = left.withColumn("side", F.lit(0)).select(columns).union(right.withColumn("side", F.lit(1)).select(columns))
    dealt = both.join(sets, "c").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "side", "c").select(*columns, "s")

    def links(key: int, sides: tuple[list, list]) -> Iterator[tuple[int, int]]:
        parent: dict[int, int] = {}

        def root(g: int) -> int:
            while (up := parent.get(g, g)) != g:
                g = up
            return g

        if not sides[0] or not sides[1]:
            return
        bands = np.array([r[2] for r in sides[1]], np.int64)
        for c, g, own, s in sides[0]:
            shared = bands == np.array(own, np.int64)
            fits = np.flatnonzero(bands[np.arange(len(bands)), shared.argmax(1)] == key) if first else np.arange(len(bands))
            for j in fits[shared[fits].any(1)] if first else fits:
                d, h, _, t = sides[1][j]
                if root(g) != root(h) and alike(s, t, percent):
                    parent[root(g)] = root(h)
                    yield min(c, d), max(c, d)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sides = None, ([], [])
        for batch in batches:
            out: list[tuple[int, int]] = []
            for key, x, y, side, c, g, own, s in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if (key, x, y) != at:
                    if at:
                        out += links(at[0], sides)
                    at, sides = (key, x, y), ([], [])
                sides[side].append((c, g, own, np.frombuffer(s, U)))
            yield pairs_batch(out)
        if at:
            yield pairs_batch(list(links(at[0], sides)))

    return map_batches(dealt, run, "a long, b long")


def pairs_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])


def unsettled(member: DataFrame, found: DataFrame) -> DataFrame:
    """key, c, n, g (component), main (component with most classes of the bucket), k (size), parts and parts_out (blocks of all classes, and of those outside main): the members of buckets with two components or more."""
    placed = member.join(found.withColumnRenamed("node", "c"), "c", "left").select("key", "c", "n", F.coalesce("component", "c").alias("g"))
    per_group = placed.groupBy("key", "g").agg(F.count("*").alias("k"), F.sum("n").alias("s"))
    largest = per_group.groupBy("key").agg(F.max(F.struct("k", "g", "s")).alias("top"), F.count("*").alias("groups"), F.sum("k").alias("k"), F.sum("s").alias("s")).where("groups > 1")
    k, s = F.col("k"), F.col("s")
    largest = largest.select("key", F.col("top.g").alias("main"), "k", parts_of(k, s).alias("parts"), parts_of(k - F.col("top.k"), s - F.col("top.s")).alias("parts_out"))
    return placed.join(largest, "key")


def slim_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def groups(docs: DataFrame, width: int = 5, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs (doc_id, text)."""
    slim = slim_texts(docs)
    out = grouped(slim, materialise(signatures(slim, width, bands, rows)), width, percent).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def grouped(texts: DataFrame, signed: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, t1, t2, n_shingles, component (null where the set is empty), component_id: one row per row of signed (from signatures()); texts (doc_id, text) has the texts of its rows."""
    # a class: all documents with one set; its name is its smallest doc_id, and the checkpoint fixes its number
    classes = signed.where("n_shingles > 0").groupBy("d1", "d2").agg(F.max("n_shingles").alias("n"), F.min("doc_id").alias("name"), F.count("*").alias("k"), F.min("bands").alias("bands"))
    classes = materialise(classes.withColumn("c", F.monotonically_increasing_id()))
    member = classes.select("c", "n", F.explode("bands").alias("key"))
    shared = member.groupBy("key").agg(F.min("c").alias("m"), F.max("c").alias("o")).where("m < o")
    member = compact(member.join(shared.select("key", "m"), "key"))
    near = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * percent  # noqa: E731  sizes of similar sets
    sizes = classes.select(F.col("c").alias("m"), F.col("n").alias("n_m"))
    pairs = member.where("c > m").select("c", "m", "n").distinct().join(sizes, "m").where(near(F.col("n"), F.col("n_m")))
    pairs = compact(pairs.select(F.col("m").alias("a"), F.col("c").alias("b")))
    # full sets of the classes that share a bucket only, made again from one text each
    wanted = compact(classes.select("c", "d1", "d2", "name").join(member.select("c").distinct(), "c", "left_semi"))
    named = texts.join(sized(wanted.select(F.col("name").alias("wanted_id")).distinct()), F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")
    sets = full_sets(named, width).join(sized(wanted.select("c", "d1", "d2")), ["d1", "d2"])
    sets = materialise(sets.groupBy("c").agg(F.min("s").alias("s")))
    links = compact(confirm(pairs, sets, percent))
    let_go(signed.sparkSession)
    found = compact(components(links))
    bands_of = classes.select("c", "bands")
    for turn in range(TURNS):
        open_ = unsettled(member, found)
        order = Window.partitionBy("key").orderBy(F.xxhash64("c", F.lit(turn)), "c")
        centres = open_.where("g = main").withColumn("place", F.row_number().over(order)).where(F.col("place") <= CENTRES)
        own = open_.where("g <> main").groupBy("c", "g").agg(F.max_by(F.struct("key", "parts_out"), F.struct("k", "key")).alias("to"))
        own = own.select("to.key", part(F.col("to.parts_out")).alias("x"), F.lit(0).alias("y"), "c", "g").join(bands_of, "c")
        centres = centres.join(own.select("key").distinct(), "key", "left_semi").join(bands_of, "c")
        centres = centres.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("parts_out") - 1))).withColumn("y", F.lit(0))
        fresh = compact(blockwise(own, centres, sets, percent, first=False))
        if fresh.isEmpty():
            break
        links = links.union(fresh)
        found = compact(components(links))
    open_ = compact(unsettled(member, found))
    let_go(signed.sparkSession)
    # small buckets: at most PAIRED partners for a class
    small = F.col("k") <= PAIRED
    left = open_.where(small & F.expr("parts = 1 and g <> main")).select(*(F.col(x).alias(f"{x}_a") for x in ("key", "c", "g", "n", "main")))
    right = open_.where(small & F.expr("parts = 1")).select("key", *(F.col(x).alias(f"{x}_b") for x in ("c", "g", "n")))
    different = (F.col("g_a") != F.col("g_b")) & ((F.col("c_a") < F.col("c_b")) | (F.col("g_b") == F.col("main_a")))
    few = left.join(right, (F.col("key_a") == F.col("key")) & different & near(F.col("n_a"), F.col("n_b")))
    few = compact(few.select(F.least("c_a", "c_b").alias("a"), F.greatest("c_a", "c_b").alias("b")).distinct())
    links = links.union(compact(confirm(few, sets, percent)))
    let_go(signed.sparkSession)
    # large ones: block by block
    large = open_.where(~small | F.expr("parts > 1")).withColumn("w", part(F.col("parts"))).withColumn("v", part(F.col("parts_out"))).join(bands_of, "c")
    left = large.where("g <> main").select("key", F.col("v").alias("x"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("y"), "c", "g", "bands")
    right = large.select("key", F.explode(F.sequence(F.lit(0), F.col("parts_out") - 1)).alias("x"), F.col("w").alias("y"), "c", "g", "bands")
    links = links.union(compact(blockwise(left, right, sets, percent, first=True)))
    let_go(signed.sparkSession)
    found = compact(components(links))
    return named_rows(signed, classes, found)


def named_rows(signed: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of grouped(), from the components of classes that have links. Neither a component of many classes nor a class of many rows is one task's."""
    of_node = found.join(classes.select(F.col("c").alias("node"), "name"), "node")
    names = of_node.groupBy("component").agg(F.min("name").alias("component_id"))
    salted = names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    linked = found.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted, ["component", "salt"]).select(F.col("node").alias("c"), "component", "component_id")
    of_class = classes.select("c", "d1", "d2", "name", "k").join(linked, "c", "left")
    of_class = materialise(of_class.select("d1", "d2", "k", F.coalesce("component", "c").alias("component"), F.when(F.col("component").isNull(), F.col("name")).otherwise(F.col("component_id")).alias("component_id")))
    columns = ["doc_id", "t1", "t2", "n_shingles"]
    full = signed.where("n_shingles > 0").select(*columns, "d1", "d2")
    heavy = sized(of_class.where(F.col("k") >= HEAVY).drop("k"))  # one class for HEAVY rows at most
    out = full.join(heavy, ["d1", "d2"]).select(*columns, "component", "component_id")
    light = full.join(heavy.select("d1", "d2"), ["d1", "d2"], "left_anti").join(of_class.where(F.col("k") < HEAVY).drop("k"), ["d1", "d2"])
    empty = signed.where("n_shingles = 0").select(*columns, F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return out.union(light.select(*columns, "component", "component_id")).union(empty)


def line_hashes(text: Column) -> Column:
    return F.array_distinct(F.transform(F.split(text, "\n"), lambda line: F.xxhash64(line)))


def judged(docs: DataFrame, whole: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts to judge, rows). A row of docs is judged on the text of ``whole`` under its id if it has words and all of its lines come from there, else on its own; rows has doc_id, t1, t2 (of the own text) and w1, w2 (of the judged one)."""
    t1, t2 = text_digest()
    of = lambda df: slim_texts(df).select("doc_id", t1, t2, line_hashes(F.col("text")).alias("lines"), F.col("text").rlike(r"[^ \t-\r]").alias("words"))
    own = materialise(of(docs))
    theirs = of(whole).where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("k"), F.first("t1").alias("w1"), F.first("t2").alias("w2"), F.first("lines").alias("all_lines")).where("k = 1")
    both = own.join(theirs, "doc_id", "left")
    part_of = F.coalesce(F.col("words") & (F.size(F.array_except("lines", "all_lines")) == 0), F.lit(False))
    rows = materialise(both.select("doc_id", "t1", "t2", "w1", "w2", part_of.alias("from_whole")))
    odd = rows.where("not from_whole").select(F.col("t1").alias("own_1"), F.col("t2").alias("own_2")).distinct()
    same = F.xxhash64("text").eqNullSafe(F.col("own_1")) & F.xxhash64(F.lit(1), "text").eqNullSafe(F.col("own_2"))
    apart = slim_texts(docs).join(sized(materialise(odd)), same, "left_semi")
    rows = rows.select("doc_id", "t1", "t2", F.when(F.col("from_whole"), F.col("w1")).otherwise(F.col("t1")).alias("w1"), F.when(F.col("from_whole"), F.col("w2")).otherwise(F.col("t2")).alias("w2"))
    return slim_texts(whole).union(apart), rows


def keep_one(docs: DataFrame, width: int = 5, percent: int = PERCENT, whole: DataFrame | None = None) -> DataFrame:
    """docs without all but one row of each group, that of the smallest doc_id (null last); an empty document is always kept. Rows alike in doc_id and text are copies of one document; different texts are different documents, whatever their doc_id. If ``whole`` (doc_id, text) is given, rows that are what is left of a text of it are judged on that text."""
    if whole is None:
        texts = slim_texts(docs)
        signed = materialise(signatures(texts, width, BANDS, ROWS))
        rows = signed.select("doc_id", "t1", "t2", F.col("t1").alias("w1"), F.col("t2").alias("w2"))
    else:
        texts, rows = judged(docs, whole)
        wanted = rows.select("doc_id", F.col("w1").alias("t1"), F.col("w2").alias("t2")).distinct()
        on = ["doc_id", "t1", "t2"]
        all_signed = signatures(texts, width, BANDS, ROWS)
        signed = materialise(all_signed.join(sized(materialise(wanted.withColumnsRenamed({c: f"{c} wanted" for c in on}))), reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"{c} wanted")) for c in on)), "left_semi"))
    components_ = grouped(texts, signed, width, percent).groupBy(F.col("doc_id").alias("of"), F.col("t1").alias("w1"), F.col("t2").alias("w2")).agg(F.max("component").alias("component"))
    found = rows.join(components_, (F.col("doc_id").eqNullSafe(F.col("of"))) & rows.w1.eqNullSafe(components_.w1) & rows.w2.eqNullSafe(components_.w2))
    found = materialise(found.groupBy("doc_id", "t1", "t2", "component").agg(F.count("*").alias("n")))
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "t1", "t2")
    first = found.where("component is not null").groupBy("component").agg(F.min(place).alias("first"), F.count("*").alias("k")).where("k > 1").drop("k")
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "t1"), F.lit(SALTS)).cast("int"))
    gone = dealt.join(first, ["component", "salt"]).where(~place.eqNullSafe(F.col("first"))).select(F.col("doc_id").alias("id of the row"), F.col("t1").alias("t1 of the row"), F.col("t2").alias("t2 of the row"))
    t1, t2 = text_digest()
    id_ = F.col("doc_id").cast("long")
    of_row = id_.eqNullSafe(F.col("id of the row")) & (t1 == F.col("t1 of the row")) & (t2 == F.col("t2 of the row"))
    out = docs.join(sized(materialise(gone)), of_row, "left_anti")
    copies = found.where("n > 1").select(F.col("doc_id").alias("id of the row"), F.col("t1").alias("t1 of the row"), F.col("t2").alias("t2 of the row"))
    if copies.isEmpty():
        return out
    keyed = out.join(sized(copies), of_row, "left")
    names = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]
    once = keyed.where("`t1 of the row` is not null").dropDuplicates(["id of the row", "t1 of the row", "t2 of the row"])
    return keyed.where("`t1 of the row` is null").select(*names).union(once.select(*names))


#: groups() on two-word shingles, by comparing all pairs that share one.
SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents
), shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM worded
), sets AS (
  SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS c, s FROM shingled
), classes AS (
  SELECT c, min(doc_id) AS name, any_value(n) AS n, any_value(s) AS s FROM sets WHERE n > 0 GROUP BY c
), member AS (
  SELECT name, n, unnest(s) AS sh FROM classes
), pairs AS (
  SELECT a.name AS a, b.name AS b FROM member a JOIN member b ON a.sh = b.sh AND a.name < b.name AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80
  GROUP BY a.name, b.name, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), linked AS (
  SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reach AS (
  SELECT name AS a, name AS b FROM classes UNION SELECT r.a, e.b FROM reach r JOIN linked e ON r.b = e.a
), component AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT s.doc_id, s.n::BIGINT AS n_shingles, coalesce(k.component_id, s.doc_id) AS component_id, s.doc_id = coalesce(k.component_id, s.doc_id) AS kept
FROM sets s LEFT JOIN classes c ON s.c = c.c AND s.n > 0 LEFT JOIN component k ON k.a = c.name
"""
