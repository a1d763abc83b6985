import random

import pytest

from palimpsest.llm import common
from palimpsest.llm import line_dedup as d

BLANK = " "


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def brute(rows):
    """The texts that stay; rows have distinct doc_ids."""
    seen, out = [], {}
    earlier = set()
    for doc, text in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is not None, r[0] or 0)):
        kept = []
        for raw in text.split("\n"):
            line = raw.strip(BLANK)
            words = line.split(" ")
            if not line:
                kept.append(raw)
                continue
            long = len(words) >= d.NEAR_WORDS
            units = words if long else list(line)
            near = (long or len(line) >= d.NEAR_LETTERS) and any(k == long and abs(len(w) - len(units)) < 2 and distance(w, units) < 2 for k, w in seen)
            if line not in earlier and not near:
                kept.append(raw)
            if line not in earlier:
                earlier.add(line)
                if long or len(line) >= d.NEAR_LETTERS:
                    seen.append((long, units))
        out[doc] = "\n".join(kept)
    return out


def edited(rnd, words, n):
    words = words[:]
    for _ in range(n):
        i = rnd.randrange(len(words))
        words[i : i + 1] = rnd.choice([[], [f"n{rnd.randint(0, 9)}"], [words[i], "more"]])
    return words


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    bases = [[f"w{rnd.randint(0, 30)}" for _ in range(n)] for n in [1, 2, 9, 10, 11, 12, 19, 20, 21, 22, 23, 40, 41, 42, 43, 81, 82, 90]]
    out = []
    for i in range(120):
        own = []
        for _ in range(rnd.randint(0, 8)):
            line = " ".join(edited(rnd, rnd.choice(bases), rnd.choice([0, 0, 1, 1, 2])))
            own.append(rnd.choice(["", " "]) + line + rnd.choice(["", "  "]))
        own += [""] * rnd.randint(0, 2)
        rnd.shuffle(own)
        out.append((i, "\n".join(own)))
    return out + [(None, "w1\nfirst of all\n" + " ".join(bases[8])), (500, None), (501, ""), (502, "\n\n"), (503, "x" * 40_000 + "\n" + " ".join(map(str, range(9000))))]


def typo(rnd, line):
    i = rnd.randrange(len(line))
    return line[:i] + rnd.choice(["", line[i] + "é", "q"]) + line[i + 1 :]


def test_letters_of_short_lines(spark):
    rnd = random.Random(3)
    base = [" ".join("".join(rnd.choice("abcé🙂") for _ in range(rnd.randint(1, 9))) for _ in range(n)) for n in [1, 2, 3, 3, 4, 5, 8, 10, 10, 11, 11, 12]] + ["x" * k for k in range(13, 44)]
    rows = [(i, "\n".join(rnd.choice([x, x, typo(rnd, x), typo(rnd, typo(rnd, x))]) for x in rnd.sample(base, 9))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.text for r in d.deduplicate(df).collect()} == brute(rows)


@pytest.mark.parametrize(
    "first, second, goes",
    [
        ("Anat with nteres", "Anat with ntares", True),
        ("Anat with ntere", "Anat with ntare", False),  # 15 letters
        ("one two three four five six seven eight nine ten", "one two three four five six seven eight nine tan", True),
        ("one two three four five six seven eight nine ten", "one two three four five six seven eight nine else", False),
        ("one two three four five six seven eight nine ten more", "one two three four five six seven eight nine else more", True),
        ("one two three four five six seven eight nine ten more", "one twa three four five six seven eight nine tan more", False),
    ],
)
def test_bounds(spark, first, second, goes):
    got = d.deduplicate(spark.createDataFrame([(1, first), (2, second)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == {1: first, 2: "" if goes else second}


def test_without_broadcasts(spark, rows, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    got = {r.doc_id: r.text for r in d.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) | {500: None}


def test_against_brute_force(spark, rows):
    want = brute(rows)
    for n in (1, 6):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        got = {r.doc_id: r.text for r in d.deduplicate(df).collect()}
        assert got == want | {500: None}
    assert sum(len(t or "") for _, t in rows) > 1.2 * sum(map(len, want.values()))


def test_columns_and_copies(spark):
    schema = "doc_id long, text string, h1 int, near string, pos int"
    rows = [(1, "a b\nc", 1, "n", 5), (1, "a b\nc", 2, "m", 6), (2, "a b\nd", 3, "k", 7)]
    out = d.deduplicate(spark.createDataFrame(rows, schema), counts=True)
    assert out.columns == ["doc_id", "text", "h1", "near", "pos", "n_lines", "n_exact", "n_near"]
    got = sorted((r.h1, r.text, r.n_lines, r.n_exact, r.n_near) for r in out.collect())
    assert got == [(1, "a b\nc", 2, 0, 0), (2, "a b\nc", 2, 0, 0), (3, "d", 2, 1, 0)]
    assert d.deduplicate(spark.createDataFrame([], schema)).count() == 0


def test_no_python_in_the_plan(spark, rows):
    plan = d.deduplicate(spark.createDataFrame(rows[:3], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_within_one(spark):
    cases = [("a b c", "a b c", True), ("a b c", "a x c", True), ("a b c", "a c", True), ("b c", "a b c", True), ("a b c", "a b c d", True), ("a b c", "a x y", False), ("a b c d", "a c x", False), ("a", "b", True), ("a b", "b a", False), ("a b c d", "b c d e", False)]
    df = spark.createDataFrame([(a.split(), b.split(), w) for a, b, w in cases], "a array<string>, b array<string>, want boolean")
    assert df.where(d.within_one(df.a, df.b) != df.want).count() == 0
