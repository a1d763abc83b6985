"""Byte-pair encoding and decoding by batched numpy merge rounds.

The symbols of all new words of a batch lie in one flat array. A round looks up
the rank of every changed pair by binary search over the sorted pair keys, takes
each word's lowest rank and merges all of its places, left to right. Words that
have no pair left leave the array. Whole texts are encoded; a word is encoded
once per batch of documents and remembered in a table bounded in words and letters.

Letters and case are those of Python's Unicode tables. Texts with a character
younger than Unicode 3.2, on which versions of these tables differ, are normalised
by the tokenizer library, and their words with such characters split by it, so
that results are equal for every code point.

Rows: a null or empty text has no tokens and decodes to the empty string; a text
of any length is one row, its words encoded together; a null doc_id is kept;
equal pairs of one rank merge from the left; repeated rows are encoded one by
one; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from palimpsest.llm.common import map_batches

#: Words, and letters in them, that a worker remembers before the table starts anew.
CACHE_WORDS, CACHE_LETTERS = 120_000, 4_000_000
NO_RANK = np.int32(2**31 - 1)
SPACES = regex.compile(r"\p{White_Space}+")
#: What str.split() takes for white space and Unicode does not.
SEPARATORS = regex.compile("[\x1c-\x1f]")


def young_characters() -> np.ndarray:
    """For each code point whether Unicode 3.2 leaves it unassigned: what became of it depends on the version of the tables."""
    return np.array([unicodedata.ucd_3_2_0.category(chr(c)) == "Cn" for c in range(0x110000)])


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class WordBpe:
    """A lower-casing BPE with word ends, from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocabulary: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocabulary.items()} | {i: t for t, i in self.special.items()}
        self.numbers = {i: str(i) for i in self.tokens}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        symbols = byte_symbols()
        self.inner = np.array([vocabulary[s] for s in symbols], np.int32)
        self.final = np.array([vocabulary[s + self.suffix] for s in symbols], np.int32)
        left, right, made = (np.empty(len(model["merges"]), np.int64) for _ in range(3))
        for i, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left[i], right[i], made[i] = vocabulary[a], vocabulary[b], vocabulary[a + b]
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made[order].astype(np.int32)
        self.made_by_rank = made.astype(np.int32)
        self.words: dict[str, tuple[str, int, str]] = {}
        self.letters = 0
        self.path, self.young, self._library = path, young_characters(), None

    def is_young(self, text: str) -> bool:
        """Whether a character of text is younger than Unicode 3.2."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return bool(self.young[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any())
        return False

    @property
    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NO_RANK where there is none."""
        wanted = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NO_RANK)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The token ids of all (not empty) pieces, and where each piece starts, with the end."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.final[raw[ends]]
        word = np.repeat(np.arange(len(pieces)), lengths)
        rank = np.full(len(symbols), NO_RANK, np.int32)
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside] = self.rank(symbols[inside], symbols[inside + 1])
        done_word, done_symbols = [], []
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            counts = np.diff(np.r_[starts, len(word)])
            lowest = np.minimum.reduceat(rank, starts)
            open_words = np.repeat(lowest != NO_RANK, counts)
            if not open_words.all():  # finished words leave
                done_word.append(word[~open_words])
                done_symbols.append(symbols[~open_words])
                symbols, word, rank = symbols[open_words], word[open_words], rank[open_words]
                counts, lowest = counts[lowest != NO_RANK], lowest[lowest != NO_RANK]
                if not len(symbols):
                    break
            hits = np.flatnonzero(rank == np.repeat(lowest, counts))
            # in a run of overlapping places every second one counts, from the left
            first = np.r_[True, np.diff(hits) != 1]
            run = np.maximum.accumulate(np.where(first, np.arange(len(hits)), 0))
            hits = hits[(np.arange(len(hits)) - run) % 2 == 0]
            symbols[hits] = self.made_by_rank[rank[hits]]
            keep = np.ones(len(symbols), bool)
            keep[hits + 1] = False
            shifted = np.cumsum(keep) - 1
            symbols, word, rank = symbols[keep], word[keep], rank[keep]
            hits = shifted[hits]
            changed = np.unique(np.r_[hits, hits[hits > 0] - 1])
            rank[changed] = NO_RANK
            changed = changed[changed + 1 < len(symbols)]
            changed = changed[word[changed] == word[changed + 1]]
            rank[changed] = self.rank(symbols[changed], symbols[changed + 1])
        word, symbols = np.concatenate(done_word), np.concatenate(done_symbols)
        order = np.argsort(word, kind="stable")
        return symbols[order], np.r_[0, np.cumsum(np.bincount(word, minlength=len(pieces)))]

    def learn(self, words: Iterable[str]) -> None:
        """Encode new words (runs without white space) into the table."""
        words = list(words)
        pieces: list[bytes] = []
        last = [0]  # pieces up to each word
        for word in words:
            self.letters += len(word)
            if self.is_young(word):
                found = [word[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(word)]
            else:
                found = [word] if word.isalpha() else self.pieces.findall(word)
            pieces += [piece.encode("utf-8", "surrogatepass") for piece in found]
            last.append(len(pieces))
        if not pieces:
            self.words |= dict.fromkeys(words, ("", 0, ""))
            return
        ids, starts = self.merge(pieces)
        bounds = starts[last].tolist()
        numbers, tokens = list(map(self.numbers.__getitem__, ids.tolist())), list(map(self.tokens.__getitem__, ids.tolist()))
        join = " ".join
        for word, a, b in zip(words, bounds[:-1], bounds[1:], strict=True):
            self.words[word] = join(numbers[a:b]), b - a, join(tokens[a:b])

    def normalise(self, text: str) -> str:
        """NFC and lower case, letter by letter (a final sigma is no exception)."""
        if self.is_young(text):
            return self.library.normalizer.normalize_str(text)
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    def split(self, text: str) -> list[str]:
        """Runs without white space, special tokens apart."""
        out: list[str] = []
        specials = self.special_split and "<|" in text
        for part in self.special_split.split(text) if specials else [text]:
            if specials and part in self.special:
                out.append(f" {part}")  # no word has a space
                continue
            part = self.normalise(part)
            out += [x for x in SPACES.split(part) if x] if SEPARATORS.search(part) else part.split()
        return out

    def forget(self) -> None:
        """Drop the words: a worker lives on after its task, and other stages need the memory."""
        self.words, self.letters = {}, 0

    def encode_texts(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text: tokens, decimal ids joined by a space, decoded text."""
        split = [self.split(t) for t in texts]
        if len(self.words) > CACHE_WORDS or self.letters > CACHE_LETTERS:
            self.forget()
        for content, i in self.special.items():
            self.words[f" {content}"] = str(i), 1, content
        self.learn({w for words in split for w in words}.difference(self.words))
        known = self.words
        for words in split:
            found = [x for w in words if (x := known[w])[1]]
            yield sum(x[1] for x in found), " ".join(x[0] for x in found), " ".join(x[2] for x in found)

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by a space, as a tokenizer without a decoder gives them."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


_LOADED: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """One tokenizer a worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def chunks(texts: list[str], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with about ``most`` characters each."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, path: str, ids: bool = True, decoded: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked, the ids and the decoded text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in chunks(texts):
                rows = list(bpe.encode_texts(texts[a:b]))
                columns = {
                    "doc_id": batch.column(0).slice(a, b - a),
                    "n_tokens": pa.array([n for n, _, _ in rows], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(i.encode()).hexdigest() for _, i, _ in rows], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for _, _, t in rows], pa.string()),
                }
                if ids:
                    columns["ids"] = pa.array([list(map(int, i.split())) for _, i, _ in rows], pa.list_(pa.int32()))
                if decoded:
                    columns["decoded"] = pa.array([t for _, _, t in rows], pa.string())
                yield pa.RecordBatch.from_pydict(columns)
        bpe.forget()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded string" * decoded
    return map_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), run, schema)
