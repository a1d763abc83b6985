"""Quality by an interpolated modified Kneser-Ney n-gram model of trusted text.

The model predicts the pieces of a text one by one, each from the piece before it.
Pieces are those of a byte-level vocabulary, whose merges are public and fixed: a
frequent word is one piece, any other is made of several, so there are no unknown
words, and n-grams cross the borders of words. A word equal to the word before it
is one piece, named after the number of repetitions so far and whether the word is
one piece, so that runs of one word are as improbable as they are in trusted text.

1. n-grams are counted over all trusted texts but a third of them, which is held
   out for the thresholds at every size: partial counts where the texts are, joined
   by key. Probabilities follow by joins with the totals of contexts and pieces, of
   which there are no more than pieces in the vocabulary.
2. The logarithm of a probability is a sum: of the last piece's, of the context's
   back-off weight, and, if the n-gram is known, of what it adds to these. So a
   text's score is the sum of count times weight over its distinct n-grams. Weights
   of pieces and contexts, and of the n-grams that make up HEAD of all trusted ones
   or more, go to the workers; their number is bounded by 1 / HEAD. All other
   n-grams of texts are dealt to shards by a hash of the n-gram, and joined there
   with the model's counts; sums go back to the texts. For this a block of texts
   sends each shard one compressed list of its n-grams, and of the texts that have
   them. What is gathered so grows with the corpus, and no key is folded or cut.
3. A text's perplexity is per piece. The limit of a language is a high quantile of
   the perplexities of trusted documents that the model has not seen; languages
   with fewer than LEAST_TRUSTED of them share one limit of all trusted documents.
   A text counts as if PRIOR pieces of the language's median stood before it.

Rows: a text without words has no perplexity and is rejected; a text of any length
is scored whole, as a block of its own if need be; a perplexity equal to the limit
is accepted; a null language is a language; repeated rows are judged one by one and
alike; with no trusted document at all nothing is rejected but texts without words;
extra columns, whatever their names, are ignored, or kept by ``accepted``.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import map_batches, materialise, reread, sized

#: Splits a word into runs of letters, digits and marks, before the merges; a fixed value of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Least share of an n-gram among the trusted ones to go to all workers: at most 1 / HEAD do.
HEAD = 2.0**-18
#: Pieces and texts of a block; pieces and texts for which there is a shard, and a copy of the shards.
BLOCK_PIECES, BLOCK_TEXTS, SHARD_PIECES, COPY_TEXTS = 3_000_000, 50_000, 8_000_000, 20_000_000
#: Pieces of a block that are worked at once.
RUN_PIECES = 250_000
#: Letters of a word that are merged together; words, and letters in them, that a worker remembers.
WORD_LETTERS, CACHE_WORDS, CACHE_LETTERS = 1000, 200_000, 4_000_000
#: Repetitions of a word that have pieces of their own; later ones share the last.
REPEATS = 8
QUANTILE, PRIOR, LEAST_TRUSTED = 0.995, 40, 10
#: Trusted ids that are sent to all workers.
IDS = 4_000_000


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Pieces:
    """Texts as arrays of piece numbers."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.start = max(ranks.values()) + 1
        self.symbols = self.start + 1 + 2 * REPEATS
        if self.symbols > 1 << 16:
            raise ValueError("a piece must be a number of 16 bits")
        # a word like the one before it: by repetitions so far, first for words of one piece, then for longer ones
        same = [np.uint16(self.start + 1 + i).tobytes() for i in range(2 * REPEATS)]
        self.same = same[:REPEATS], same[REPEATS:]
        self.words: dict[str, bytes] = {}
        self.letters = 0

    def word(self, word: str) -> bytes:
        parts = [word[i : i + WORD_LETTERS] for i in range(0, len(word), WORD_LETTERS)]
        ids = [i for k, p in enumerate(parts) for i in self.encoding.encode_ordinary(p if k else f" {p}")]
        return np.array(ids, np.uint16).tobytes()

    def forget(self) -> None:
        """Drop the words: a worker lives on after its task, and other stages need the memory."""
        self.words, self.letters = {}, 0

    def of(self, text: str) -> np.ndarray:
        if len(self.words) > CACHE_WORDS or self.letters > CACHE_LETTERS:
            self.forget()
        words = text.split()
        known = self.words
        for w in set(words).difference(known):
            known[w] = self.word(w)
            self.letters += len(w)
        out, before, run = [], "", 0
        for w in words:
            if w == before:
                out.append(self.same[len(known[w]) > 2][min(run, REPEATS - 1)])
                run += 1
            else:
                out.append(known[w])
                before, run = w, 0
        return np.frombuffer(b"".join(out), np.uint16)


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One table of words for each worker process."""
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def bigrams(texts: list[np.ndarray], start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, piece and number of the text of every place of texts, in as few bytes as hold them."""
    flat = np.concatenate([*texts, np.empty(0, np.uint16)])
    lengths = np.array([len(t) for t in texts], np.int64)
    before = np.empty_like(flat)
    before[1:] = flat[:-1]
    before[np.cumsum(np.r_[0, lengths])[:-1][lengths > 0]] = start
    return before, flat, np.repeat(np.arange(len(texts), dtype=np.uint32), lengths)


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and how often each stands there; sorts values in place, as copies of a block add up."""
    values.sort()
    first = np.flatnonzero(np.r_[np.ones(min(1, len(values)), bool), values[1:] != values[:-1]])
    return values[first], np.diff(first, append=len(values))


def counts_of(trusted: DataFrame, path: str) -> DataFrame:
    """key (context * 2^16 + piece), n over all rows of trusted (text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, size, seen = pieces(path), 0, []

        def flush() -> pa.RecordBatch:
            before, flat = bigrams(seen, own.start)[:2]
            keys = before.astype(np.uint32)
            keys <<= 16
            keys |= flat
            keys, n = counted(keys)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["key", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.append(own.of(text or ""))
                size += len(seen[-1])
                if size >= BLOCK_PIECES:
                    yield flush()
                    size, seen = 0, []
        own.forget()
        yield flush()

    return map_batches(trusted.select("text"), run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def discounts(of_count: dict[int, int]) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and 3 or more, from the counts of counts."""
    n1, n2, n3, n4 = (of_count.get(i, 0) for i in range(1, 5))
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1))  # type: ignore[return-value]


class Model:
    """Logarithms: of the probability of each piece and the back-off weight of each context (arrays), and key, n, weight of each known bigram (weights, a DataFrame)."""

    def __init__(self, counts: DataFrame, symbols: int):
        context, piece = F.shiftright("key", 16).alias("h"), F.col("key").bitwiseAND(0xFFFF).alias("w")
        of_count = {r.n: r["count"] for r in counts.where("n <= 4").groupBy("n").count().collect()}
        d = discounts(of_count)
        # one row for each piece of the vocabulary at most
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        by_context = materialise(counts.groupBy(context).agg(F.sum("n").alias("total"), F.sum(cut).alias("cut")))
        by_piece = materialise(counts.groupBy(piece).agg(F.count("*").alias("a")))
        contexts, follow = by_context.collect(), {r.w: r.a for r in by_piece.collect()}
        self.total = sum(r.total for r in contexts)
        a = np.zeros(symbols)
        a[list(follow)] = list(follow.values())
        e = discounts({i: int((a == i).sum()) for i in range(1, 5)})
        taken = np.select([a == 0, a == 1, a == 2], [0.0, e[0], e[1]], e[2])
        every = max(1.0, a.sum())
        unseen = (taken.sum() / every if self.total else 1.0) / (symbols - 1)  # all but the start
        p = (a - taken) / every + unseen
        self.log_piece, self.log_back = np.log(p), np.zeros(symbols)
        for r in contexts:
            self.log_back[r.h] = np.log(r.cut / r.total)
        # from the tables, as createDataFrame() of a list starts Python processes of its own on every executor, which stay
        taken_of = F.when(F.col("a") == 1, e[0]).when(F.col("a") == 2, e[1]).otherwise(e[2])
        of_context = F.broadcast(by_context.select("h", "total", (F.col("cut") / F.col("total")).alias("back")))
        of_piece = F.broadcast(by_piece.select("w", ((F.col("a") - taken_of) / F.lit(float(every)) + F.lit(float(unseen))).alias("p")))
        joined = counts.select("key", "n", context, piece).join(of_context, "h").join(of_piece, "w")
        below = F.col("back") * F.col("p")
        self.weights = joined.select("key", "n", F.log1p((F.col("n") - cut) / F.col("total") / below).alias("weight"))


def shard_of(key, shards: int):
    """The shard of a key, alike for a Column and for numbers; shards is odd."""
    if isinstance(key, Column):
        return F.pmod(key * 40503 + F.shiftright(key, 16) * 60493, F.lit(shards)).cast("int")
    return (key * 40503 + (key >> 16) * 60493) % shards


def packed(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(b"".join(np.asarray(a, np.uint32).tobytes() for a in arrays))


def unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint32).astype(np.int64)


def runs_of(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of neighbours whose sizes add up to about ``most``, or that are one larger one."""
    cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - 1) // most)) + 1
    yield from pairwise([0, *cuts.tolist(), len(sizes)])


def block_of(texts: list[np.ndarray], model: dict, shards: int) -> tuple[np.ndarray, list[tuple[int, bytes]]]:
    """The part of each text's score that the workers know, and for each shard the other n-grams of the texts. Sums are taken in the order of places and of n-grams, however the block is cut into runs."""
    before, flat, of = bigrams(texts, model["start"])
    local, known, contexts = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(1 << 16, np.int64)
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(np.r_[0, lengths])
    for a, b in runs_of(lengths, RUN_PIECES):
        run = slice(ends[a], ends[b])
        weights = model["log_piece"][flat[run]]
        weights += model["log_back"][before[run]]
        local[a:b] = np.bincount(of[run] - np.uint32(a), weights=weights, minlength=b - a)
        contexts += np.bincount(before[run], minlength=1 << 16)
    heads, rest = model["heads"], []
    for a, b in runs_of(contexts, RUN_PIECES):
        places = np.flatnonzero((before >= a) & (before <= b - 1))
        entries = before[places].astype(np.int64)
        for array, bits in ((flat, 16), (of, 24)):
            entries <<= bits
            entries |= array[places]
        entries, times = counted(entries)
        of_text = (entries & 0xFFFFFF).astype(np.uint32)
        entries >>= 24
        at = np.minimum(np.searchsorted(heads, entries), max(0, len(heads) - 1))
        head = heads[at] == entries if len(heads) else np.zeros(len(entries), bool)
        np.add.at(known, of_text[head], model["head_weights"][at[head]] * times[head])
        shard = shard_of(entries[~head], shards)
        rest.append([x.astype(np.uint32) for x in (shard, entries[~head], of_text[~head], times[~head])])
    local += known
    del before, flat, of
    shard, key, of, times = map(np.concatenate, zip(*rest, strict=True))
    del rest
    order = np.argsort(shard, kind="stable")
    bounds = np.searchsorted(shard, np.arange(shards + 1), sorter=order)
    out = []
    for k in np.flatnonzero(np.diff(bounds)):
        own = order[bounds[k] : bounds[k + 1]]
        distinct, first = np.unique(key[own], return_index=True)
        sizes = np.diff(np.r_[first, len(own)])
        out.append((int(k), packed([len(distinct)], np.diff(distinct, prepend=0), sizes, of[own], times[own])))
    return local, out


def sums_of(blob: bytes, keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the texts of a block's list that have known n-grams, and the sums of their weights; keys are sorted."""
    numbers = unpacked(blob)
    n = numbers[0]
    wanted, sizes = np.cumsum(numbers[1 : n + 1]), numbers[n + 1 : 2 * n + 1]
    of, times = numbers[2 * n + 1 :].reshape(2, -1)
    if not len(keys):
        return of[:0], np.zeros(0)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    value = np.repeat(np.where(keys[at] == wanted, weights[at], 0.0), sizes) * times
    known = np.unique(of[value != 0])
    return known, np.bincount(of, weights=value, minlength=int(known[-1]) + 1)[known] if len(known) else np.zeros(0)


SCORED = "block long, shard int, blob binary, place int, doc_id long, lang string, t1 long, t2 long, score double, pieces long"


def blocks(docs: DataFrame, model: dict, path: str, shards: int) -> DataFrame:
    """Rows of texts (block, place, doc_id, lang, t1, t2, score so far, pieces) and of lists for shards (block, shard, blob); docs has doc_id, lang, t1, t2, text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c.split()[0] for c in SCORED.split(", ")]
    types = {"shard": pa.int32(), "blob": pa.binary(), "place": pa.int32(), "lang": pa.string(), "score": pa.float64()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows, texts, size = pieces(path), [], [], 0

        def flush() -> pa.RecordBatch:
            block = uuid.uuid4().int >> 65
            local, lists = block_of(texts, shared.value, shards)
            out = [(block, None, None, i, *r, float(s), len(t)) for i, (r, s, t) in enumerate(zip(rows, local, texts, strict=True))]
            out += [(block, shard, blob, *[None] * 7) for shard, blob in lists]
            return pa.RecordBatch.from_arrays([pa.array(c, types.get(name, pa.int64())) for name, c in zip(names, zip(*out, strict=True), strict=True)], names)

        for batch in batches:
            for *row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(row)
                texts.append(own.of(text or ""))
                size += len(texts[-1])
                if size >= BLOCK_PIECES or len(texts) >= BLOCK_TEXTS:
                    yield flush()
                    rows, texts, size = [], [], 0
        own.forget()
        if rows:
            yield flush()

    return map_batches(docs.select("doc_id", "lang", "t1", "t2", "text"), run, SCORED)


def joined(scored: DataFrame, weights: DataFrame, shards: int, copies: int) -> DataFrame:
    """doc_id, lang, t1, t2, score, pieces of each text: the lists of blocks() joined with weights (key, weight) shard by shard, and the sums brought back to the blocks."""

    def join(lists: pa.Table, model: pa.Table) -> pa.Table:
        keys, weight = (model.column(c).to_numpy() for c in ("key", "weight"))
        order = np.argsort(keys)
        keys, weight = keys[order], weight[order]
        out = []
        for block, blob in zip(*(lists.column(c).to_pylist() for c in ("block", "blob")), strict=True):
            of, sums = sums_of(blob, keys, weight)
            if len(of):
                out.append((block, of.astype(np.int32).tobytes(), sums.tobytes()))
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["block", "of", "sums"])

    def add(texts: pa.Table, found: pa.Table) -> pa.Table:
        place = texts.column("place").to_numpy()
        score = np.zeros(place.max(initial=-1) + 1)
        score[place] = texts.column("score").to_numpy()
        for of, sums in sorted(zip(*(found.column(c).to_pylist() for c in ("of", "sums")), strict=True)):
            score[np.frombuffer(of, np.int32)] += np.frombuffer(sums)
        return texts.select(["doc_id", "lang", "t1", "t2"]).append_column("score", pa.array(score[place])).append_column("pieces", texts.column("pieces"))

    copy = F.pmod(F.col("block"), F.lit(copies)).cast("int").alias("copy")
    lists = scored.where("shard is not null").select("shard", copy, "block", "blob")
    model = weights.select(shard_of(F.col("key"), shards).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), "key", "weight")
    found = lists.groupBy("shard", "copy").cogroup(model.groupBy("shard", "copy")).applyInArrow(join, "block long, of binary, sums binary")
    texts = scored.where("shard is null").drop("shard", "blob")
    return texts.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(add, "doc_id long, lang string, t1 long, t2 long, score double, pieces long")


def trusted_ids(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids of trusted documents: two thirds train the model, the others, which it has not seen, set the thresholds."""
    own = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("trusted_id")).distinct()
    unseen = F.crc32(F.col("trusted_id").cast("string").cast("binary")) % 3 == 0
    return sized(own.where(~unseen), IDS), sized(own.where(unseen), IDS)


def perplexities(docs: DataFrame, labels: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """doc_id, lang, t1, t2, bits (per piece), pieces of each row of docs (doc_id, lang, t1, t2, text), and the ids of trusted documents that the model has not seen."""
    seen, unseen = trusted_ids(labels)
    trusted = docs.join(seen, F.col("doc_id") == F.col("trusted_id"), "left_semi")
    own = pieces(path)
    model = Model(materialise(counts_of(trusted, path)), own.symbols)
    weights = materialise(model.weights)
    least = max(2, int(np.ceil(HEAD * model.total)))
    heads = weights.where(F.col("n") >= least).select("key", "weight").toPandas().sort_values("key")  # at most 1 / HEAD rows
    known = {"start": own.start, "log_piece": model.log_piece, "log_back": model.log_back, "heads": heads["key"].to_numpy(np.int64), "head_weights": heads["weight"].to_numpy(np.float64)}
    n = docs.count()
    share = max(1, trusted.count()) / max(1, n)
    shards = int(model.total / share / SHARD_PIECES) // 2 * 2 + 33
    scored = reread(blocks(docs, known, path, shards))
    out = joined(scored, weights.where(F.col("n") < least).select("key", "weight"), shards, 1 + n // COPY_TEXTS)
    bits = F.when(F.col("pieces") > 0, -F.col("score") / F.col("pieces") / F.log(F.lit(2.0)))
    return out.select("doc_id", "lang", "t1", "t2", bits.alias("bits"), "pieces"), unseen


def steadied(bits: Column, pieces_: Column, median: Column) -> Column:
    """bits of a text as if PRIOR pieces of the median stood before it, so that a short text is not judged by a few pieces."""
    return (bits * pieces_ + median * PRIOR) / (pieces_ + PRIOR)


def thresholds(scored: DataFrame, ids: DataFrame) -> tuple[DataFrame, tuple[float, float]]:
    """limit_lang, middle (median) and limit of each language, and both for all others; scored has doc_id, lang, bits, pieces."""
    own = scored.where("bits is not null").join(ids, F.col("doc_id") == F.col("trusted_id"), "left_semi")
    middle = F.percentile_approx("bits", 0.5, 10_000)
    limit = F.percentile_approx(steadied(F.col("bits"), F.col("pieces"), F.col("middle")), QUANTILE, 10_000).alias("limit")
    medians = own.groupBy("lang").agg(middle.alias("middle"), F.count("*").alias("n")).where(F.col("n") >= LEAST_TRUSTED)
    medians = medians.select(F.col("lang").alias("limit_lang"), "middle")
    by = own.join(sized(medians), F.col("lang").eqNullSafe(F.col("limit_lang"))).groupBy("limit_lang", "middle").agg(limit)
    centre = own.agg(middle).first()[0]
    if centre is None:
        return by, (0.0, float("inf"))
    rest = own.withColumn("middle", F.lit(centre)).groupBy("middle").agg(limit).first()
    return by, (float(centre), float(rest["limit"]))


def verdicts(docs: DataFrame, labels: DataFrame, path: str | None) -> DataFrame:
    """doc_id, lang, t1, t2, bits, pieces, limit, accepted of each row of docs (doc_id, text, lang)."""
    text = F.col("text").cast("string")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"))
    scored, ids = perplexities(slim, labels, path or vocabulary())
    scored = materialise(scored)
    by, (middle, limit) = thresholds(scored, ids)
    out = scored.join(sized(by), F.col("lang").eqNullSafe(F.col("limit_lang")), "left")
    out = out.withColumn("limit", F.coalesce("limit", F.lit(limit))).withColumn("middle", F.coalesce("middle", F.lit(middle)))
    return out.withColumn("accepted", F.coalesce(steadied(F.col("bits"), F.col("pieces"), F.col("middle")) <= F.col("limit"), F.lit(False)))


def classify(docs: DataFrame, labels: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, lang, n_pieces, perplexity (per piece), threshold, accepted: a row per row of docs (doc_id, text, lang). path names the vocabulary of pieces."""
    power = lambda c: F.round(F.pow(F.lit(2.0), F.col(c)), 6)
    return verdicts(docs, labels, path).select("doc_id", "lang", F.col("pieces").alias("n_pieces"), power("bits").alias("perplexity"), power("limit").alias("threshold"), "accepted")


def accepted(docs: DataFrame, labels: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of docs that classify() accepts, all of their columns."""
    gone = verdicts(docs, labels, path).where("not accepted").select(*(F.col(c).alias(f"{c} of the row") for c in ("doc_id", "lang", "t1", "t2"))).distinct()
    text = F.col("text").cast("string")
    own = {"doc_id": F.col("doc_id").cast("long"), "lang": F.col("lang").cast("string"), "t1": F.xxhash64(text), "t2": F.xxhash64(F.lit(1), text)}
    same = reduce(Column.__and__, (value.eqNullSafe(F.col(f"{c} of the row")) for c, value in own.items()))
    return docs.join(sized(materialise(gone)), same, "left_anti")
