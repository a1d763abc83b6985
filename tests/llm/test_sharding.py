import random
import zlib
from collections import Counter

from palimpsest.llm import sharding as s


def one_by_one(sizes, capacity):
    """The bins of items packed singly, each in the tightest that holds it."""
    free, out = [], []
    for x in sizes:
        fit = [(f, i) for i, f in enumerate(free) if f >= x]
        i = min(fit)[1] if fit else len(free)
        if not fit:
            free.append(max(capacity, x))
        free[i] -= x
        out.append(i)
    return out


def runs(sizes):
    return sorted(Counter(sizes).items(), reverse=True)


def test_best_fit_takes_the_tightest_bin():
    rnd = random.Random(1)
    for _ in range(100):
        sizes = sorted((rnd.randint(1, rnd.choice([4, 50])) for _ in range(rnd.randint(1, 60))), reverse=True)
        single = Counter(zip(sizes, one_by_one(sizes, 60), strict=True))
        found = Counter()
        for (size, _), own in zip(runs(sizes), s.best_fit_decreasing(runs(sizes), 60), strict=True):
            for b, n in own:
                found[size, b] += n
        loads = lambda c: sorted(sum(x * n for (x, b), n in c.items() if b == k) for k in {b for _, b in c})
        assert loads(found) == loads(single)


def test_pack():
    assert s.pack([], 3) == []
    assert s.pack(runs([100, 1, 1]), 2) == [[(0, 1)], [(1, 2)]]
    assert s.pack(runs([100, 100, 100, 1]), 3) == [[(0, 1), (1, 1), (2, 1)], [(0, 1)]]
    rnd = random.Random(2)
    sizes = runs([rnd.randint(1, 1000) for _ in range(3000)] + [7] * 5000)
    placed = s.pack(sizes, 8)
    sums = [0] * 8
    for (x, n), own in zip(sizes, placed, strict=True):
        assert sum(k for _, k in own) == n
        for b, k in own:
            sums[b] += k * x
    assert max(sums) - min(sums) <= 8


def test_shards(spark):
    rnd = random.Random(3)
    rows = [(i, "x" * rnd.randint(0, 400) + str(i)) for i in range(800)] + [(i, "hot copy " * 3) for i in range(800, 1100)]
    rows += [(i, f"same size {i}") for i in range(2000, 3500)]
    rows += [(None, None), (5, ""), (5, "é"), (5, "é"), (6, "long " * 1500)]
    got = s.shards(spark.createDataFrame([(*r, 0, 1) for r in rows], "doc_id long, text string, shard int, bytes long").repartition(6)).collect()
    assert len(got) == len(rows)
    want = sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == want
    by, group, sums = {}, {}, [0] * 8
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        group.setdefault((r.text_crc32, r.size), set()).add(r.shard)
        sums[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(x) == list(range(len(x))) for x in by.values()) and set(by) == set(range(8))
    assert all(len(x) == 1 for x in group.values())
    assert max(sums) - min(sums) <= 10


def test_a_group_over_a_fair_share_stands_alone(spark):
    rows = [(i, "hot copy " * 90) for i in range(300)] + [(i, f"small {i}") for i in range(300, 900)]
    got = s.shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    of = {}
    for r in got:
        of.setdefault(r.shard, []).append(r.size)
    assert sorted(len(x) for x in of.values())[-1] == 300 and len(of) == 8
    rest = [sum(x) for x in of.values() if x[0] < 700]
    assert max(rest) - min(rest) <= 20


def test_empty(spark):
    assert s.shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0
