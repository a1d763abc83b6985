import random

import pytest

from palimpsest.llm import common, minhash
from palimpsest.llm.components import components


def brute(rows, width=2, percent=80):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        n = min(width, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed=1):
    rnd = random.Random(seed)
    rows = []
    for g in range(40):
        base = [f"w{rnd.randint(0, 500)}" for _ in range(rnd.randint(1, 120))]
        for c in range(rnd.randint(1, 6)):
            own = base[:]
            for _ in range(rnd.randint(0, 1 + len(base) // 12)):
                own[rnd.randrange(len(own))] = f"x{rnd.randint(0, 9)}"
            rows.append((len(rows), " ".join(own) if c else " \n".join(own).upper()))
    hub = [f"h{i}" for i in range(200)]
    for i in range(60):  # a large group of near copies, a chain among them
        rows.append((len(rows), " ".join(hub[:i] + [f"z{i}"] + hub[i + 1 :])))
    rows += [(len(rows) + i, t) for i, t in enumerate(["", None, "one", "ONE", "a b", "A\tB", "É x", "é x", "a b c"])]
    rnd.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    for n in (1, 7):
        rows = corpus()
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        got = minhash.groups(df, width=2).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_odd_rows(spark):
    rows = [(None, "a b c"), (5, "a b c"), (5, "a b c"), (5, "q r s"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.groups(df, 2).collect()), key=str)
    assert got == sorted([(None, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (5, 2, 5, True), (None, 0, None, True)], key=str)
    assert minhash.groups(df.limit(0), 2).count() == 0


@pytest.mark.parametrize("limits", [{"PAIRED": 3, "BLOCK": 4, "PARTNERS": 3, "HEAVY": 2}, {"BLOCK_SHINGLES": 300}, {"PAIRED": 0}])
def test_small_blocks_and_no_broadcasts(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(minhash, name, value)
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    rows = corpus(2)
    got = minhash.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), width=2).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


def test_a_very_long_text(spark):
    words = [f"w{i * i % 65_537}" for i in range(150_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:149_000])), (3, " ".join(words[:60_000]))]
    got = minhash.groups(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def test_what_is_left_of_a_text_is_judged_whole(spark):
    a, b, c = ([" ".join(f"{x}{i}.{j}" for j in range(12)) for i in range(9)] for x in "abc")
    near = [*a[:4], a[4] + " more", *a[5:]]
    whole = [(1, "\n".join(a)), (2, "\n".join(near)), (3, "\n".join(b)), (4, "\n".join(c)), (5, "\n".join(c)), (5, "x"), (6, "\n".join(b))]
    docs = [(1, whole[0][1]), (2, near[4]), (3, b[0]), (4, whole[3][1]), (5, c[0] + " y"), (None, whole[3][1]), (6, "not from there"), (7, "nor this")]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id for r in minhash.keep_one(frame(docs), whole=frame(whole)).collect()), key=str)
    assert got == [1, 3, 4, 5, 6, 7]
    assert minhash.keep_one(frame([]), whole=frame(whole)).count() == 0
    assert minhash.keep_one(frame(docs), whole=frame([])).count() == 7


def test_keep_one(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(3, long, "k"), (1, long.upper(), "c"), (2, "something else", "m"), (4, None, "n"), (1, long, "component_id")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = minhash.keep_one(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 2, 4]


def test_keep_one_goes_by_rows(spark):
    texts = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcd"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1].upper()), (5, texts[2]), (5, texts[3]), (6, texts[3]), (7, "x y"), (7, "x y"), (None, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, (r.text or "").lower()) for r in minhash.keep_one(df).collect()]
    want = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (7, "x y"), (None, ""), (8, "")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)], "a long, b long")
    got = dict(components(edges).collect())
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100}


def test_bands_find_similar_sets():
    rnd = random.Random(2)
    missed = 0
    for _ in range(300):
        words = [f"v{rnd.random()}" for _ in range(100)]
        other = words[:]
        other[:11] = [f"u{rnd.random()}" for _ in range(11)]
        sets = [minhash.shingles(" ".join(x), 1, minhash.WordHashes()) for x in (words, other)]
        keys = minhash.band_keys(sets, minhash.BANDS, minhash.ROWS)
        missed += not (keys[0] == keys[1]).any()
    assert missed == 0
