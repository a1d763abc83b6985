"""Line deduplication by a deletion-neighbourhood join, in DataFrame operations only.

A line is what newlines separate, without spaces at its ends; its words are what single spaces
separate; empty lines stay. A line goes if an earlier line (by doc_id, then place)
is equal to it, or lies within one edit: of a whole word (one word inserted, deleted
or replaced) if both have at least NEAR_WORDS words, of a letter if both have fewer
words and at least NEAR_LETTERS letters. So an edited letter counts at any length,
unless it is a space that makes two words of one in a long line.

1. Equal lines are counted by a 128-bit hash, with map-side combining; the
   earliest place is looked for among the lines that occur twice or more.
2. The units of a line are its words, or the letters of a short line. An edit leaves
   the first or the last half of the units whole. Lines that share no half with
   another distinct line have no neighbour and need no variants; halves are measured
   in lengths of 5, 10, 20, ... units, and lines near a step of that scale take both
   lengths.
3. The others emit one hashed key per deleted unit, and one for the whole line.
   The key of a variant is the exclusive or of the hashes of the units with their
   places, so that all keys of a line take time in proportion to its length.
4. In a bucket of equal keys, lines that lack the same place differ by one
   replaced unit, and a whole line differs from a variant's line by one inserted
   unit. So the earliest of either kind is all a line must be compared with: no
   pairs of a bucket are formed. The units of both lines then verify the distance.

Rows: a null text has no lines and stays null; a line of any length takes part whole;
rows alike in doc_id and text are copies of one document, they keep and lose the same
lines; of different texts with one doc_id a hash decides which is earlier; a null
doc_id comes first; extra columns, whatever their names, are kept by ``deduplicate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import materialise, sized

#: Lines of so many words may differ by a word, shorter ones of so many letters by a letter.
NEAR_WORDS, NEAR_LETTERS = 11, 16


def half(n: Column) -> Column:
    """Units of a line's half: the largest of 5, 10, 20, ... up to (n - 1) / 2."""
    steps = F.floor(F.log2((n - 1) / F.lit(10.0)) + F.lit(1e-9))
    return (F.lit(5) * F.pow(F.lit(2.0), F.greatest(steps, F.lit(0)))).cast("int")


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text), pos, line of every line that is not empty; docs has doc_id and text."""
    split = docs.select("doc_id", F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    return split.select("doc_id", "t", "pos", F.trim("raw").alias("line")).where("line <> ''")


def hashes() -> list[Column]:
    return [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")]


PLACE = ("doc_id", "t", "pos")


HALVES = ("head", "tail", "head_up", "tail_up")


def by_words(line: Column) -> Column:
    """Whether the units of a line are its words."""
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1 >= NEAR_WORDS


def size(line: Column) -> Column:
    """Units of a line."""
    words = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    return F.when(words >= NEAR_WORDS, words).otherwise(F.length(line))


def units(line: Column, words: Column) -> Column:
    return F.when(words, F.split(line, " ")).otherwise(F.regexp_extract_all(line, F.lit("(?s)."), F.lit(0)))


def distinct_lines(slim: DataFrame) -> DataFrame:
    """h1, h2, copies and the hashes of the first and last halves of each distinct line; those one step up are null for most."""
    own = lines(slim).select("line", by_words(F.col("line")).alias("words"), size(F.col("line")).alias("n"))
    own = own.select("line", "words", half(F.greatest(F.col("n") - 1, F.lit(NEAR_WORDS))).alias("h"), half(F.col("n") + 1).alias("up"), "n")
    words = lambda h: F.call_function("substring_index", F.col("line"), F.lit(" "), h)
    letters = lambda h: F.when(h > 0, F.substring(F.col("line"), F.lit(1), h)).otherwise(F.substring(F.col("line"), h, -h))
    part = lambda name, h: F.when(F.col("words"), F.xxhash64(F.lit(name), words(h))).otherwise(F.xxhash64(F.lit(name), F.lit(0), letters(h)))
    near, up = F.col("words") | (F.col("n") >= NEAR_LETTERS), (F.col("up") != F.col("h")) & (F.col("up") * 2 <= F.col("n"))
    halves = [F.when(near, part("head", F.col("h"))), F.when(near, part("tail", -F.col("h"))), F.when(near & up, part("head", F.col("up"))), F.when(near & up, part("tail", -F.col("up")))]
    return own.select(*hashes(), *(c.alias(k) for k, c in zip(HALVES, halves, strict=True))).groupBy("h1", "h2").agg(F.count("*").alias("copies"), *(F.max(k).alias(k) for k in HALVES))


def neighbours(slim: DataFrame, found: DataFrame) -> DataFrame:
    """h1, h2 of the distinct lines that lie within one unit of an earlier line."""
    sides = F.array(*(F.struct(F.col(k).alias("half"), F.lit(k.startswith("head")).alias("head")) for k in HALVES))
    halves = found.where("head is not null").select("h1", "h2", F.inline(sides)).where("half is not null")
    shared = materialise(halves.groupBy("half").count().where("count > 1").select("half"))
    wanted = halves.join(sized(shared), "half", "left_semi").groupBy("h1", "h2").agg(F.bool_or("head").alias("by_head"), F.bool_or(~F.col("head")).alias("by_tail"))
    wanted = materialise(wanted)
    texts = lines(slim).select(*PLACE, "line", *hashes()).join(sized(wanted), ["h1", "h2"])
    texts = texts.groupBy("h1", "h2", "by_head", "by_tail").agg(F.min(F.struct(*PLACE)).alias("place"), F.first("line").alias("line"))
    # r numbers the lines in their order; the checkpoint fixes it
    ordered = texts.orderBy(F.col("place.doc_id").asc_nulls_first(), "place.t", "place.pos").select(F.monotonically_increasing_id().alias("r"), "h1", "h2", "by_head", "by_tail", "line", by_words(F.col("line")).alias("words"))
    numbered = materialise(ordered)
    # where the first halves are alike the edit lies behind them, where the last ones are it lies before
    n = size(F.col("line"))
    low, high = F.when(F.col("by_tail"), 0).otherwise(half(F.greatest(n - 1, F.lit(NEAR_WORDS)))), F.when(F.col("by_head"), n).otherwise(half(n + 1))
    # once a line: what stands beside a generator is computed for each of its rows
    split = numbered.repartition("r").select("r", low.alias("low"), high.alias("high"), "words", units(F.col("line"), F.col("words")).alias("units"))
    unit = split.select("r", "low", "high", "words", F.posexplode("units").alias("i", "w"))
    word = unit.select("r", "low", "high", "i", F.xxhash64("w", "i", "words").alias("here"), F.xxhash64("w", F.col("i") - 1, "words").alias("moved"))
    upto = Window.partitionBy("r").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("r").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.expr("bit_xor(here)").over(upto).bitwiseXOR(F.col("here"))
    after = F.expr("bit_xor(moved)").over(whole).bitwiseXOR(F.expr("bit_xor(moved)").over(upto))
    keyed = word.select("r", "low", "high", "i", before.bitwiseXOR(after).alias("key"), F.expr("bit_xor(here)").over(whole).alias("all"))
    own, all_ = F.struct("i", "key"), F.struct(F.lit(-1).alias("i"), F.col("all").alias("key"))
    inside = (F.col("i") >= F.col("low")) & (F.col("i") < F.col("high"))
    some = F.array_compact(F.array(F.when(inside, own), F.when(F.col("i") == 0, all_)))
    keys = keyed.where(inside | (F.col("i") == 0)).select("r", F.inline(some))
    keys = materialise(keys)
    of_place = keys.groupBy("key", "i").agg(F.min("r").alias("least"), F.count("*").alias("k"))
    bucket = of_place.groupBy("key").agg(F.min(F.when(F.col("i") < 0, F.col("least"))).alias("least_whole"), F.min(F.when(F.col("i") >= 0, F.col("least"))).alias("least_variant"), F.sum("k").alias("k"))
    crowded = materialise(bucket.where("k > 1").drop("k"))
    at = keys.join(sized(crowded), "key")
    same = at.where("i >= 0").groupBy("key", "i").agg(F.min("r").alias("least"), F.count("*").alias("k")).where("k > 1").drop("k")
    pairs = at.where("i < 0").select("r", F.col("least_variant").alias("e")).union(at.where("i >= 0").select("r", F.col("least_whole").alias("e")))
    pairs = pairs.union(at.where("i >= 0").select("r", "key", "i").join(sized(materialise(same)), ["key", "i"]).select("r", F.col("least").alias("e")))
    pairs = pairs.where("e < r").distinct()
    mine = numbered.select("r", "h1", "h2", F.col("line").alias("a"), "words")
    theirs = numbered.select(F.col("r").alias("e"), F.col("line").alias("b"), F.col("words").alias("words_b"))
    both = pairs.join(mine, "r").join(theirs, "e").where("words = words_b")
    both = both.select("h1", "h2", units(F.col("a"), F.col("words")).alias("a"), units(F.col("b"), F.col("words")).alias("b"))
    return both.where(within_one(F.col("a"), F.col("b"))).select("h1", "h2").distinct()


def within_one(a: Column, b: Column) -> Column:
    """Whether two arrays of units differ by one unit inserted, deleted or replaced at most."""
    m, n = F.size(a), F.size(b)
    short = F.least(m, n)
    same = F.zip_with(F.slice(a, F.lit(1), short), F.slice(b, F.lit(1), short), lambda x, y: x == y)
    differ = F.array_position(same, F.lit(False)).cast("int")  # 0: none
    start = F.when(differ == 0, short + 1).otherwise(differ)
    rest = lambda x, size, skip: F.slice(x, start + skip, F.greatest(size - start - skip + 1, F.lit(0)))
    return (
        F.when(m == n, (differ == 0) | (rest(a, m, 1) == rest(b, n, 1)))
        .when(m == n + 1, rest(a, m, 1) == rest(b, n, 0))
        .when(n == m + 1, rest(a, m, 0) == rest(b, n, 1))
        .otherwise(False)
    )


def dropped(docs: DataFrame) -> DataFrame:
    """d, t (document), exact and near: the places of the lines that go; docs has doc_id and text."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    found = materialise(distinct_lines(slim))
    near = neighbours(slim, found).withColumn("near", F.lit(True))
    flagged = found.select("h1", "h2", "copies").join(near, ["h1", "h2"], "left").where("copies > 1 or near")
    flagged = materialise(flagged.select("h1", "h2", F.coalesce("near", F.lit(False)).alias("near")))
    at = materialise(lines(slim).select(*PLACE, *hashes()).join(sized(flagged), ["h1", "h2"]))
    first = at.groupBy("h1", "h2").agg(F.min(F.struct(*PLACE)).alias("place"))
    gone = at.join(sized(first), ["h1", "h2"]).withColumn("exact", ~F.struct(*PLACE).eqNullSafe(F.col("place"))).where("exact or near")
    spots = gone.groupBy(F.col("doc_id").alias("d"), "t").agg(F.collect_set(F.when(F.col("exact"), F.col("pos"))).alias("exact"), F.collect_set(F.when(~F.col("exact"), F.col("pos"))).alias("near"))
    return materialise(spots)


def deduplicate(docs: DataFrame, counts: bool = False) -> DataFrame:
    """docs with the lines that stay in text; if asked, with n_lines, n_exact and n_near of each text behind."""
    spots = dropped(docs).withColumnsRenamed({"d": "doc of the spots", "t": "text of the spots", "exact": "exact spots", "near": "near spots"})
    text = F.col("text").cast("string")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("doc of the spots")) & (F.xxhash64(text) == F.col("text of the spots"))
    joined = docs.join(sized(spots, 200_000), same, "left")
    split = F.split(text, "\n")
    gone = F.concat("exact spots", "near spots")
    left = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), gone))
    short = F.array_join(F.transform(left, lambda i: F.get(split, i)), "\n")
    kept = F.when(F.col("exact spots").isNull(), text).otherwise(short)
    columns = [kept.alias("text") if c == "text" else F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]
    if counts:
        size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
        columns += [F.when(text.isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"), size(F.col("exact spots")).alias("n_exact"), size(F.col("near spots")).alias("n_near")]
    return joined.select(*columns)


SQL = f"""
WITH raw AS (
  SELECT doc_id, i - 1 AS pos, trim(parts[i], ' ') AS line
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))
), named AS (
  SELECT * FROM raw WHERE line <> ''
), firsts AS (
  SELECT line, doc_id, pos, row_number() OVER (ORDER BY doc_id, pos) AS r
  FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS k FROM named) WHERE k = 1
), worded AS (
  SELECT r, line, string_split(line, ' ') AS words FROM firsts
), united AS (
  SELECT r, line, len(words) >= {NEAR_WORDS} AS kind, CASE WHEN len(words) >= {NEAR_WORDS} THEN words ELSE string_split(line, '') END AS units
  FROM worded WHERE len(words) >= {NEAR_WORDS} OR length(line) >= {NEAR_LETTERS}
), keys AS (
  SELECT r, kind, -1 AS i, line AS key FROM united
  UNION ALL
  SELECT r, kind, i, CASE WHEN kind THEN array_to_string(list_concat(units[1:i - 1], units[i + 1:len(units)]), ' ') ELSE array_to_string(list_concat(units[1:i - 1], units[i + 1:len(units)]), '') END AS key
  FROM (SELECT r, kind, units, unnest(range(1, len(units) + 1)) AS i FROM united)
), least AS (
  SELECT r, i, min(r) OVER (PARTITION BY kind, key, i) AS same,
         min(CASE WHEN i < 0 THEN r END) OVER (PARTITION BY kind, key) AS whole,
         min(CASE WHEN i >= 0 THEN r END) OVER (PARTITION BY kind, key) AS variant
  FROM keys
), near AS (
  SELECT DISTINCT r FROM least WHERE (i < 0 AND variant < r) OR (i >= 0 AND (same < r OR whole < r))
), gone AS (
  SELECT n.doc_id, n.pos, (n.doc_id <> f.doc_id OR n.pos <> f.pos) AS exact, near.r IS NOT NULL AS near
  FROM named n JOIN firsts f ON n.line = f.line LEFT JOIN near ON near.r = f.r
), kept AS (
  SELECT p.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE g.exact) AS n_exact, count(*) FILTER (WHERE g.near AND NOT g.exact) AS n_near,
         string_agg(part, chr(10) ORDER BY p.pos) FILTER (WHERE NOT coalesce(g.exact OR g.near, false)) AS text
  FROM (SELECT doc_id, parts[i] AS part, i - 1 AS pos
        FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))) p
  LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.pos = p.pos
  GROUP BY p.doc_id
)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_exact::BIGINT AS n_exact, n_near::BIGINT AS n_near, sha256(coalesce(text, '')) AS text_sha256 FROM kept
"""
