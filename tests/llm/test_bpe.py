import hashlib
import random

import pytest

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

from palimpsest.llm import bpe  # noqa: E402

PATH = public.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    return tokenizers.Tokenizer.from_file(PATH), bpe.WordBpe(PATH)


def agree(both, text):
    theirs, ours = both
    want = theirs.encode(text, add_special_tokens=False)
    n, ids, decoded = next(iter(ours.encode_texts([text])))
    assert ids == " ".join(map(str, want.ids)) and n == len(want.ids)
    assert decoded == theirs.decode(want.ids, skip_special_tokens=False) == ours.decode(want.ids)


@pytest.mark.parametrize("text", ["", " \n", "aaa aaaa", "it's we'll 12 ½٣", "ΣΑΣ ς İı ẞ é", "a\x1cb\x85c d", "x<|endoftext|>y <|STARTOFTEXT|><|startoftext|>", "a" * 50_001])
def test_single(both, text):
    agree(both, text)


def test_random(both):
    rnd = random.Random(3)
    pool = "aAbB'stre 0٣½ΣσςİIıßẞÉé́ẞ  \x1c\x1f\x85\t\n漢字🙂​﻿Ａ̈ǅ!?.,#"
    for _ in range(1500):
        agree(both, "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 60))))
    agree(both, "".join(rnd.choice("abcdefghij") for _ in range(30_000)))


def test_every_code_point(both):
    theirs, ours = both
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not (0x20000 < c < 0xE0000 and c % 97)]
    for wrap in ("a{}b", "{} e\u0301{}\u0301"):
        texts = [wrap.format(c, c) for c in points]
        for i in range(0, len(texts), 20_000):
            part = texts[i : i + 20_000]
            want = [e.ids for e in theirs.encode_batch(part, add_special_tokens=False)]
            got = [list(map(int, ids.split())) for _, ids, _ in ours.encode_texts(part)]
            assert [t for t, a, b in zip(part, want, got, strict=True) if a != b] == []


def test_the_table_of_words_is_bounded(both, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_LETTERS", 1000)
    ours = bpe.WordBpe(PATH)
    for i in range(20):
        list(ours.encode_texts([f"{i}" + "ab" * 300]))
        assert ours.letters <= 1602


def test_query(spark, both):
    rows = [(1, "The cat\nsat", 1, "a", "b"), (2, None, 2, "a", "b"), (None, "", 3, "a", "b"), (1, "The cat\nsat", 4, "a", "b")]
    got = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, ids string, decoded string"), PATH).collect()
    rows = [r[:2] for r in rows]
    theirs = both[0]
    assert len(got) == 4
    for (doc, text), row in zip(rows, got, strict=True):
        want = theirs.encode(text or "", add_special_tokens=False)
        assert row.doc_id == doc and row.ids == want.ids and row.n_tokens == len(want.ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, want.ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(theirs.decode(want.ids, skip_special_tokens=False).encode()).hexdigest()


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
