"""URL rules by a sort-merge range join on reversed hosts.

A host's labels are reversed and each ends in a dot (``blog.example.org`` gives
``org.example.blog.``), so a rule's host and all of its subdomains are one
interval of keys. Pages and rules are cut into ranges of keys, balanced by the
pages' keys with a hash of the row behind them, so that a host with a third of
all pages spreads over many ranges. A rule goes to each range that its interval
meets. Each range is sorted and swept once, with a stack of the rules' hosts
that enclose the current key; the longest fitting path of the stack wins.

Longest is the length of host and path together; between equals the longer host.
Rows: a null url, or one without ``://``, has an empty host and path and no
rule; repeated rows are judged one by one; rules with a null or empty host fit
nothing; repeated rules count once, block before allow; extra columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import map_batches

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
HOST_END, PATH_END = regex.compile("[/?#]"), regex.compile("[?#]")
#: Keys sampled for each range, and letters kept of each; they only balance the ranges.
SAMPLES, PREFIX = 8, 80


def host_and_path(url: str | None) -> tuple[str, str]:
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = HOST_END.search(rest)
    host, rest = (rest, "") if end is None else (rest[: end.start()], rest[end.start() :])
    return host.translate(UPPER), PATH_END.split(rest, 1)[0]


def key_of(host: str) -> str:
    return "".join(f"{label}." for label in reversed(host.split(".")))


class Sweep:
    """The rules that enclose the current key, outermost first."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []

    def up_to(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def rule(self, key: str, host: str, path: str, verdict: str) -> None:
        self.up_to(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, {}, []))
        _, paths, lengths = self.stack[-1]
        if path not in paths or verdict == "block":
            paths[path] = host + path, verdict
        if len(path) not in lengths:
            bisect.insort(lengths, len(path))

    def page(self, key: str, path: str) -> tuple[str | None, str | None]:
        self.up_to(key)
        best: tuple[str | None, str | None] = None, None
        for _, paths, lengths in self.stack:
            for n in reversed(lengths):
                if n <= len(path) and (found := paths.get(path[:n])):
                    if best[0] is None or len(found[0]) >= len(best[0]):
                        best = found
                    break
        return best


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", ranges: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of pages (page_id, url) under rules (host, path, verdict)."""
    spark = pages.sparkSession
    n = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))

    def sort_key(url: str | None, page_id: int | None) -> str:
        return f"{key_of(host_and_path(url)[0])[:PREFIX]}\0{xxhash.xxh3_64_hexdigest(f'{page_id} {url}')}"

    # some SAMPLES keys for each range, those whose hash is under a share of all; only the balance of the ranges hangs on them
    share = min(1.0, SAMPLES * n / max(1, pages.count()))
    uniform = (F.xxhash64("page_id", "url") / F.lit(float(2**64))) + 0.5
    taken = pages.select("page_id", F.substring("url", 1, 200).alias("url"), uniform.alias("h")).where(F.col("h") < share).collect()
    keys = sorted(sort_key(r.url, r.page_id) for r in taken)
    bounds = sorted({keys[i * len(keys) // n] for i in range(1, n)}) if keys else []

    schema = "part int, key string, kind int, page_id long, host string, path string, verdict string"
    names = [x.split(" ")[0] for x in schema.split(", ")]
    types = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def place_pages(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                host, path = host_and_path(url)
                rows.append((bisect.bisect_right(bounds, sort_key(url, i)), key_of(host), 1, i, host, path, None))
            yield batch_of(rows)

    def place_rules(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host, path, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not host:
                    continue
                host = host.translate(UPPER)
                low = key_of(host)
                short = low[:PREFIX]
                first, last = bisect.bisect_left(bounds, short), bisect.bisect_right(bounds, short[:-1] + chr(ord(short[-1]) + 1))
                yield batch_of([(p, low, 0, None, host, path or "", verdict) for p in range(first, last + 1)])

    def sweep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, Sweep()
        for batch in batches:
            out = []
            for part, key, kind, i, host, path, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != at:
                    at, state = part, Sweep()
                if kind == 0:
                    state.rule(key, host, path, verdict)
                else:
                    rule, found = state.page(key, path)
                    out.append((i, host, path, rule, found or default))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 5, types[3:] + [pa.string()], strict=True)], ["page_id", "host", "path", "rule", "verdict"])

    rules = rules.select(*(F.col(c).cast("string").alias(c) for c in ("host", "path", "verdict")))
    placed = map_batches(pages, place_pages, schema).union(map_batches(rules, place_rules, schema))
    dealt = placed.repartition(n, "part").sortWithinPartitions("part", "key", "kind", "host", "path", "verdict")
    return map_batches(dealt, sweep, "page_id long, host string, path string, rule string, verdict string")


#: The rules of the registered query.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path
  FROM cut
), rules AS (
  SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                        ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) AS t(rule_host, rule_path, rule_verdict)
), fits AS (
  SELECT p.page_id, p.host, p.path, r.rule_host || r.rule_path AS rule, r.rule_verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST, length(r.rule_host) DESC) AS place
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM fits WHERE place = 1
"""
