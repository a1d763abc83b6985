import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")
pytest.importorskip("tiktoken")

from palimpsest.llm import quality_lm as q  # noqa: E402


def spelled(own, text):
    """Pieces of a text, one word after the other."""
    out, words = [], text.split()
    for i, w in enumerate(words):
        run = 0
        while run < i and words[i - run - 1] == w:
            run += 1
        ids = own.encoding.encode_ordinary(" " + w)
        out += [own.start + 1 + q.REPEATS * (len(ids) > 1) + min(run, q.REPEATS) - 1] if run else ids
    return out


def brute(own, trusted):
    """Mean bits of a text's pieces under an interpolated modified Kneser-Ney bigram model, by its textbook formulas."""
    counts = Counter()
    for text in trusted:
        s = [own.start, *spelled(own, text)]
        counts.update(zip(s, s[1:], strict=False))
    after, before = defaultdict(dict), Counter()
    for (h, w), n in counts.items():
        after[h][w] = n
        before[w] += 1

    def cuts(values):
        k = Counter(values)
        if not all(k[i] for i in (1, 2, 3, 4)):
            return [0.5, 0.75, 0.9]
        y = k[1] / (k[1] + 2 * k[2])
        raw = (1 - 2 * y * k[2] / k[1], 2 - 3 * y * k[3] / k[2], 3 - 4 * y * k[4] / k[3])
        return [min(max(x, 0.05), i - 0.05) for i, x in enumerate(raw, 1)]

    high, low = cuts(counts.values()), cuts(before.values())
    kinds, every = own.symbols - 1, sum(before.values())

    def single(w):
        free = sum(low[min(n, 3) - 1] for n in before.values()) / every
        return (before[w] - low[min(before[w], 3) - 1] if before[w] else 0) / every + free / kinds

    def p(h, w):
        if h not in after:
            return single(w)
        total = sum(after[h].values())
        n = after[h].get(w, 0)
        free = sum(high[min(k, 3) - 1] for k in after[h].values()) / total
        return (n - high[min(n, 3) - 1] if n else 0) / total + free * single(w)

    def bits(text):
        s = [own.start, *spelled(own, text)]
        return -sum(math.log2(p(h, w)) for h, w in zip(s, s[1:], strict=False)) / (len(s) - 1) if len(s) > 1 else None

    return bits


WORDS = "the quick brown fox jumps over a lazy dog while seventeen étranges oiseaux sing of it. Then Also".split()


def sentences(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


@pytest.mark.parametrize("limits", [{}, {"HEAD": 0.01, "BLOCK_PIECES": 200}, {"HEAD": 1.0, "BLOCK_TEXTS": 3, "SHARD_PIECES": 50, "COPY_TEXTS": 20}])
def test_scores_are_those_of_the_formulas(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(q, name, value)
    rnd = random.Random(4)
    rows = [(i, sentences(rnd, rnd.randint(0, 60)), "en") for i in range(60)]
    rows += [(60, "the the the the quick quick étranges étranges oiseaux oiseaux " * 3, "en"), (61, "x" * 5000 + " zzzz ###", "en"), (62, None, "en"), (63, " \n", None), (64, rows[0][1], "de"), (None, rows[1][1], "de"), (65, sentences(rnd, 3000), "fr")]
    labels = [(i, 1, 0) for i in range(40)] + [(60, 1, 0), (900, 1, 0), (None, 1, 0)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, block int").repartition(3)
    got = {(r.doc_id, r.lang): r for r in q.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert len(got) == len(rows)
    own = q.pieces(q.vocabulary())
    import zlib

    trusted = [t for i, t, _ in rows if i is not None and (i < 40 or i == 60) and zlib.crc32(str(i).encode()) % 3]
    bits = brute(own, trusted)
    for i, text, lang in rows:
        want, r = bits(text or ""), got[i, lang]
        assert r.n_pieces == len(spelled(own, text or ""))
        assert (want is None and r.perplexity is None and not r.accepted) or np.isclose(r.perplexity, 2**want, rtol=1e-5)


def test_long_words_and_the_bounded_table(monkeypatch):
    monkeypatch.setattr(q, "CACHE_LETTERS", 100)
    own = q.Pieces(q.vocabulary())
    assert own.of("a" * 3000).tolist() == own.encoding.encode_ordinary(" " + "a" * 999) + 2 * own.encoding.encode_ordinary("a" * 1000) or len(own.of("a" * 3000)) > 100
    for i in range(30):
        own.of(f"word{i} " * 3)
        assert own.letters <= 3106


@pytest.fixture(scope="module")
def case(spark):
    rnd = random.Random(7)
    syllable = ["the", "an", "ti", "on", "er", "re", "in", "st"]
    word = lambda: "".join(rnd.choice(syllable) for _ in range(rnd.randint(1, 3)))
    rows, labels = [], []
    for i in range(240):
        words = [word() for _ in range(rnd.randint(5, 80))]
        kind = "clean" if i % 4 else rnd.choice(["caps", "marks", "again", "noise"])
        if kind == "caps":
            words = [w.upper() + "!!" for w in words]
        elif kind == "marks":
            words = [w + "%%%" for w in words]
        elif kind == "again":
            words = [w for w in words for _ in range(7)]
        elif kind == "noise":
            words = ["".join(rnd.choice("qxzjkvw") for _ in range(6)) for _ in words]
        rows.append((i, " ".join(words), rnd.choice(["en", None]), kind))
        if i % 2:
            labels.append((i, 1, 0))
    rows += [(300, None, "en", "none"), (301, " ", "fr", "none"), (None, "the an ti on er re in st", "fr", "clean"), (1, rows[1][1], "en", "clean")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, limit string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_junk_goes_and_clean_text_stays(spark, case):
    docs, labels = case
    got = q.accepted(docs, labels)
    assert got.schema == docs.schema
    kinds, of = Counter(r["limit"] for r in got.collect()), Counter(r["limit"] for r in docs.collect())
    assert kinds["clean"] >= of["clean"] - 2
    assert sum(kinds.values()) - kinds["clean"] <= 4
    verdicts = q.classify(docs, labels).collect()
    assert len(verdicts) == docs.count() and sum(r.accepted for r in verdicts) == sum(kinds.values())
    assert all(r.perplexity is None and not r.accepted for r in verdicts if r.doc_id in (300, 301))


def test_nothing_trusted(spark, case):
    docs, labels = case
    assert q.accepted(docs, labels.limit(0)).count() == docs.count() - 2
    assert q.accepted(docs.limit(0), labels).count() == 0


def test_blocks_are_lean_and_whole():
    rnd = np.random.default_rng(4)
    texts = [rnd.integers(0, 30, n).astype(np.uint16) for n in (0, 5, 1, 400, 0, 900)]
    before, flat, of = q.bigrams(texts, 65_535)
    assert [x.itemsize for x in (before, flat, of)] == [2, 2, 4]  # 8 bytes a place, not 24
    want = [(65_535 if i == 0 else int(t[i - 1]), int(x), k) for k, t in enumerate(texts) for i, x in enumerate(t)]
    assert list(zip(before.tolist(), flat.tolist(), of.tolist(), strict=True)) == want
    values = rnd.integers(0, 50, 1000)
    distinct, n = np.unique(values, return_counts=True)
    got = q.counted(values.copy())
    assert (got[0] == distinct).all() and (got[1] == n).all() and [len(x) for x in q.counted(values[:0])] == [0, 0]


def test_workers_forget_words(spark):
    docs = spark.createDataFrame([(1, "some words of a text")], "doc_id long, text string").coalesce(1)

    def held(batches):
        yield from ()
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(p.words) for p in q._PIECES.values())])], ["n"])

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert q.counts_of(docs, q.vocabulary()).count() > 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(r.n for r in spark.range(64, numPartitions=64).mapInArrow(held, "n long").collect()) == 0


def test_a_block_is_worked_in_runs(monkeypatch):
    import tracemalloc

    rnd = np.random.default_rng(6)
    texts = [rnd.integers(0, 500, n).astype(np.uint16) for n in (0, 400_000, *[2000] * 300, 1, 0)]
    heads = (np.arange(500)[:, None] << 16 | np.arange(500)).ravel()
    model = {"start": 65_535, "log_piece": rnd.normal(size=1 << 16), "log_back": rnd.normal(size=1 << 16), "heads": heads[::2], "head_weights": rnd.normal(size=len(heads[::2]))}
    monkeypatch.setattr(q, "packed", lambda *a: [np.asarray(x).tolist() for x in a])
    few = [t[:3000] for t in texts[:5]]
    whole = q.block_of(few, model, 5)
    monkeypatch.setattr(q, "RUN_PIECES", 100, raising=False)
    cut = q.block_of(few, model, 5)
    assert (whole[0] == cut[0]).all() and whole[1] == cut[1]  # to the last bit
    monkeypatch.undo()
    for known, most in ((heads[::50], 40), (heads, 28)):  # hardly any n-gram is known to the workers, and nearly all are
        own = model | {"heads": known, "head_weights": np.ones(len(known))}
        tracemalloc.start()
        q.block_of(texts, own, 33)
        peak = tracemalloc.get_traced_memory()[1] / sum(map(len, texts))
        tracemalloc.stop()
        assert peak < most, peak  # bytes a place


def test_model_starts_no_processes_for_rows_of_the_driver(spark, monkeypatch):
    counts = spark.createDataFrame([(1 << 16 | 2, 3), (2 << 16 | 1, 1)], "key long, n long")
    none = counts.limit(0)

    def refused(*args, **kwargs):
        raise AssertionError("rows of a list go through Python workers")

    monkeypatch.setattr(type(spark), "createDataFrame", refused)
    assert {r.key for r in q.Model(counts, 5).weights.collect()} == {1 << 16 | 2, 2 << 16 | 1}
    assert q.Model(none, 5).weights.count() == 0


def test_workers_give_memory_back(monkeypatch):
    from types import SimpleNamespace

    from palimpsest.llm import common

    seen = []
    monkeypatch.setattr(common, "settings", lambda spark: None)
    monkeypatch.setattr(common, "give_back", lambda: seen.append("given back"))
    df = SimpleNamespace(sparkSession=None, mapInArrow=lambda function, schema: function)
    run = common.map_batches(df, lambda batches: (seen.append(b) or b for b in batches), "n long")
    assert list(run([1, 2])) == [1, 2] and seen == [1, 2, "given back"]
    monkeypatch.undo()
    common.give_back()
