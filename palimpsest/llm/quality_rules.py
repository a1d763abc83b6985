"""Quality rules as a threshold table, compiled into Spark projections without user functions.

Words are runs of anything but ASCII white space. Every figure of a document is
made from its own row, so the plan has no shuffle and a long or popular document
costs no other row anything. Windows of three words are compared by 64-bit
hashes inside one document.

Rows: a null text has no words (all figures 0, base_failed, not kept); repeated
rows are judged one by one; a null doc_id is kept; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import let

SPACE = r"[ \t\n\x0B\f\r]+"
#: Frequent words of the languages the rules know.
STOP_WORDS = sorted(
    set(
        "the of and to in is that it for on with as was be by this are or from at "
        "de la le les et des en un une du que qui dans pour par sur au "
        "der die und den von zu das mit des auf ist nicht ein eine "
        "el los y a las del se con por su al".split()
    )
)
#: name of a ratio, numerator, denominator, least and most that pass (None: no bound).
#: A ratio with an empty denominator passes.
THRESHOLDS: list[tuple[str, str, str, float | None, float | None]] = [
    ("word_length", "word_chars", "n_words", 2.0, 14.0),
    ("symbols_per_word", "n_symbols", "n_words", None, 0.1),
    ("exclamations_per_word", "n_exclaimed", "n_words", None, 0.3),
    ("upper_case", "n_upper", "word_chars", None, 0.4),
    ("letters", "n_letters", "word_chars", 0.6, None),
    ("stop_words", "n_stop_words", "n_words", 0.02, None),
    ("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
    ("repeated_words", "n_same_as_last", "n_words", None, 0.2),
]


def without(text: Column, letters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, letters, ""))


def repeat_words(words: Column) -> Column:
    """Words in three-word windows that are found twice or more."""
    count = F.size(words)
    starts = F.when(count >= 3, F.sequence(F.lit(0), count - 3)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.arrays_zip(h.alias("h"), starts.alias("i")))

        def marked(s: Column) -> Column:
            same = lambda k, d: F.coalesce(F.get(s, k)["h"] == F.get(s, k + d)["h"], F.lit(False))
            twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, -1) | same(k, 1))
            at = F.transform(twice, lambda k: F.get(s, k)["i"])
            return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ordered, marked))

    return let(hashes, covered)


def figures(docs: DataFrame) -> DataFrame:
    """doc_id and every figure the table of thresholds names, one row per row of docs (doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
    df = df.select("doc_id", "t", F.array_remove(F.split("t", SPACE), "").alias("words"), F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, " \t\x0b\f\r", "")) > 0).alias("lines"))
    words, t = F.col("words"), F.col("t")
    stop = F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))
    # words equal to the word before them, whatever the case
    after = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.when(a == b, 1))
    made = {
        "n_words": F.size(words),
        "word_chars": F.length(F.translate(t, " \t\n\x0b\f\r", "")),
        "n_symbols": without(t, "#*$%&|<>"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": repeat_words(words),
        "n_lines": F.size("lines"),
        "n_exclaimed": without(t, "!"),
        "n_upper": F.length(F.regexp_replace(t, r"\P{Lu}+", "")),
        "n_letters": F.length(F.regexp_replace(t, r"\P{L}+", "")),
        "n_stop_words": F.size(stop),
        "n_same_as_last": F.size(F.array_compact(after)),
    }
    return df.select("doc_id", *(c.cast("long").alias(k) for k, c in made.items()))


def judge(docs: DataFrame, thresholds: list[tuple[str, str, str, float | None, float | None]] | None = None) -> DataFrame:
    """figures, base_failed, a boolean column for each rule (true: passed), and kept."""
    df = figures(docs)
    base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    passed = {}
    for name, top, below, least, most in THRESHOLDS if thresholds is None else thresholds:
        ratio = F.col(top) / F.nullif(F.col(below), F.lit(0))
        bounds = [ratio >= least] * (least is not None) + [ratio <= most] * (most is not None)
        ok = F.lit(True)
        for b in bounds:
            ok = ok & b
        passed[f"ok_{name}"] = F.coalesce(ok, F.lit(True))
    df = df.select("*", base.alias("base_failed"), *(c.alias(k) for k, c in passed.items()))
    kept = ~F.col("base_failed")
    for k in passed:
        kept = kept & F.col(k)
    return df.withColumn("kept", kept)


def sql() -> str:
    """The result of judge() as registered, in DuckDB's SQL."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    rules = []
    for name, top, below, least, most in THRESHOLDS:
        ratio = f"({top}::DOUBLE / nullif({below}, 0))"
        tests = [f"{ratio} >= {least}"] * (least is not None) + [f"{ratio} <= {most}"] * (most is not None)
        rules.append(f"coalesce({' AND '.join(tests)}, true) AS ok_{name}")
    kept = " AND ".join(["NOT base_failed", *(f"ok_{name}" for name, *_ in THRESHOLDS)])
    return f"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(translate(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13), '')) > 0) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM split)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS k FROM windows) WHERE k > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + d) AS n FROM twice, (VALUES (0), (1), (2)) AS s(d) GROUP BY doc_id
), figures AS (
  SELECT s.doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(t, '[ \\t\\n\\x0B\\f\\r]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(lines)::BIGINT AS n_lines,
         (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclaimed,
         length(regexp_replace(t, '\\P{{Lu}}+', '', 'g'))::BIGINT AS n_upper,
         length(regexp_replace(t, '\\P{{L}}+', '', 'g'))::BIGINT AS n_letters,
         len(list_filter(words, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words,
         len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1]))::BIGINT AS n_same_as_last
  FROM split s LEFT JOIN covered c ON s.doc_id = c.doc_id
), based AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM figures
), ruled AS (
  SELECT *, {", ".join(rules)} FROM based
)
SELECT *, {kept} AS kept FROM ruled
"""
