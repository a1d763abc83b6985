import random

from palimpsest.llm import quality_rules as q


def brute(text):
    words = [w.decode() for w in (text or "").encode().split()]
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + d for at in windows.values() if len(at) > 1 for i in at for d in range(3)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_figures(spark):
    rnd = random.Random(5)
    texts = ["", None, " \n\t", "one", "a b", "a b c", "a a a a", "a\x0bb\x0cc\rd\x1ce f", "x\n\nx\n x\nx"]
    for _ in range(60):
        texts.append("".join(rnd.choice(["a", "b", "é", " ", " ", "\n", "#", "the "]) for _ in range(rnd.randint(0, 300))))
    texts.append(" ".join(str(i % 7000) for i in range(20_000)))
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    for r in q.judge(df).collect():
        n, chars, symbols, lines, repeated = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeated)
        assert r.base_failed == (n < 50 or 100 * repeated > 50 * n)
        assert not (r.base_failed and r.kept)


def test_verdicts(spark):
    clean = " ".join(f"the word{chr(97 + i % 26)}{chr(97 + i // 26)} of" for i in range(60)) + "."
    rows = [(1, clean), (1, clean), (2, " ".join(f"{w}***" for w in clean.split())), (3, clean.upper()), (None, None)]
    got = q.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.kept for r in got] == [True, True, False, False, False]
    assert not got[2].ok_symbols_per_word and not got[3].ok_upper_case
    assert q.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_table_decides(spark):
    df = spark.createDataFrame([(1, "the cat " * 2 + " ".join(f"w{i}" for i in range(80)))], "doc_id long, text string")
    assert q.judge(df, []).first().kept
    assert not q.judge(df, [("few", "n_words", "n_lines", None, 10.0)]).first().kept


def test_no_shuffle_and_no_python(spark):
    plan = q.judge(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan
