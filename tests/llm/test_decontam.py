import random

import pytest

from palimpsest.llm import decontam as d


def least(pattern, text):
    """Dynamic programming over all parts of text."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        before, row[0] = row[:], 0
        for i, p in enumerate(pattern, 1):
            row[i] = min(before[i] + 1, row[i - 1] + 1, before[i - 1] + (p != c))
        best = min(best, row[-1])
    return best


def test_myers():
    rnd = random.Random(1)
    for _ in range(300):
        p, t = ("".join(rnd.choice("ab c") for _ in range(rnd.randint(1, n))) for n in (80, 120))
        assert d.best_distance(p, t) == least(p, t)


def edited(rnd, text, n):
    out = list(text)
    for _ in range(n):
        i = rnd.randrange(len(out))
        out[i : i + 1] = rnd.choice([[], [out[i], "q"], ["z"]])
    return "".join(out)


@pytest.fixture(scope="module")
def case():
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rnd.randint(4, 40)))) for i in range(12)]
    docs = []
    for i in range(150):
        body = [word() for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 2)):
            item = rnd.choice(items)[1]
            body.insert(rnd.randint(0, len(body)), edited(rnd, item, rnd.randint(0, len(item) // 12)))
        docs.append((i, " ".join(body)))
    return docs + [(150, None), (None, ""), (151, "X" * 5000), (0, docs[0][1])], items + [(12, None), (13, " !"), (None, "one two three four five")]


def test_against_brute_force(spark, case, monkeypatch):
    docs, items = case
    want, fewest = {}, {}
    for _, text in docs:
        t = d.normalise(text or "")
        own = [(i, least(f" {n} ", f" {t} "), len(n) // 16) for i, x in items if x and (n := d.normalise(x))]
        want[text] = [i for i, edits, most in own if edits <= most]
        fewest[text] = min((edits for _, edits, most in own if edits <= most), default=None)
    assert any(want.values()) and any(fewest.values())
    for size, kept in ((500_000, 8), (300, 2)):
        monkeypatch.setattr(d, "BLOCK_CHARS", size)
        monkeypatch.setattr(d, "KEPT_BLOCKS", kept)
        got = d.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
        assert [(r.doc_id, r.items) for r in got] == [(i, sorted(x for x in want[t] if x is not None)) for i, t in docs]
        assert [r.least_edits for r in got] == [fewest[t] for _, t in docs]
        assert all(r.n_items == len(want[t]) and r.contaminated == bool(want[t]) for r, (_, t) in zip(got, docs, strict=True))


def test_case_and_marks_do_not_hide_an_item(spark):
    items = spark.createDataFrame([(7, "The quick, brown fox jumps over the lazy dog again")], "item_id long, text string")
    rows = [(1, "x\nTHE QUICK brown--fox\njumps over the lazy dog  again!", "a"), (2, "the quick brown fox", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, items string")
    assert [r.items for r in d.find(docs, items).collect()] == [[7], []]
    out = d.clean(docs, items)
    assert out.schema == docs.schema and [r.doc_id for r in out.collect()] == [2]


def test_the_least_edits_count_and_words_are_whole(spark):
    item = "the quick brown fox jumps over the lazy dog again"
    items = spark.createDataFrame([(1, item), (2, "no")], "item_id long, text string")
    rows = [(1, item.replace("fox", "fix") + " and then " + item), (2, item.replace("fox", "fix") + " another note"), (3, "oh no!"), (4, "x" * 300_000 + " no " + "y" * 300_000)]
    got = {r.doc_id: (r.items, r.least_edits) for r in d.find(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got == {1: ([1], 0), 2: ([1], 1), 3: ([2], 0), 4: ([2], 0)}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.find(docs, none).first().n_items == 0
    assert d.find(docs.limit(0), none).count() == 0 and d.clean(docs, none).count() == 1
