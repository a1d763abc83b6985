"""Personal data, and the terms that give it away.

Base spans are e-mail addresses, IPv4 addresses, payment card numbers and phone
numbers, found in whole texts by patterns and their checks. Beside them stand secrets:
long runs of letters and digits in which a letter carries so much information that no
word does. Every value is a protected entity, and so is the presence of each kind of
them. Information-theoretic sanitisation then looks for terms that reveal it: over all documents, a term's disclosure of an entity is their pointwise
mutual information, of the entity and the term in one document, as a share of the
entity's information content,

    log(N n(t, e) / (n(t) n(e))) / log(N / n(e)),

with numbers of different texts, so that copies bear nothing out: N all, n(e) with the
entity, n(t) with the term, n(t, e) with both. 1 means that the term occurs with the
entity alone. From GENERALISE on every occurrence of the term in the documents of that
entity becomes a generalised span, from REMOVE on a removed one; at least SUPPORT
texts must bear it out, KIND_SUPPORT for a kind, as words meet a frequent kind by chance;
kinds in over a KIND_SHARE-th of all texts are no secret. Documents without the entity
are left alone.

Candidates are all terms of the whole documents that hold such an entity. n(t) is at
least the number of these documents that have the term: pairs that cannot reach
GENERALISE with it go before terms are counted, and none is lost by it. All counts are
partial sums made where the rows are, joined by key; in the corpus a text of c copies
counts 1/c in each of them.

Rows: a null text is empty and has no spans; a text of any length is searched whole;
of disclosures that tie or differ the largest counts; rows with equal texts have equal
spans, whatever their doc_id, which may be null; extra columns, whatever their names,
are ignored, or kept by ``sanitise``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from math import log2

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import is_small, map_batches, materialise, sized

KINDS = ("email", "ip", "card", "phone")
SUPPORT, GENERALISE, REMOVE = 2, 0.75, 0.95
KIND_SUPPORT, KIND_SHARE = 5, 10
#: The names of all kinds of spans: base, generalised and removed terms, secrets.
NAMES = (*KINDS, "term", "term", "secret")
TERM_KIND, REMOVED_KIND, SECRET_KIND = 4, 5, 6
#: The patterns of the base spans.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT_RUNS = re.compile(r"[0-9]{14}|[0-9][ -]?[0-9]")
#: A secret: its letters, how many at least, and the least entropy of their distribution in bits.
SECRET, SECRET_BITS = re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 3.0
#: A term is a run of anything but ASCII marks, spaces and controls, A-Z in lower case.
TERM = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
BREAK = r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER = str.maketrans(CAPITALS, SMALL)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of a local part, @ and two labels or more, each letter looked at once."""
    last = 0  # where the next match may begin
    at = text.find("@")
    floor = 0  # behind the last @, which no local part holds
    while at >= 0:
        low = max(last, floor)
        local = LOCAL.match(text[low:at][::-1]).end()
        domain = DOMAIN.match(text, at + 1) if local else None
        if domain:
            yield at - local, domain.end()
            last = domain.end()
        floor = at + 1
        at = text.find("@", at + 1)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four dotted numbers up to 255; a longer dotted run is cut in fours from the left."""
    for run in DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        start, parts = run.start(), run.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield start, end
            start = end + 1


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), by start, then kind."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in emails(text)]
    if DIGIT_RUNS.search(text) or "." in text:
        out += [(a, 1, b) for a, b in addresses(text)]
        out += [(a, 2, b) for a, b in cards(text)]
    if "+" in text:
        out += [(a, 3, b) for a, b in phones(text)]
    return sorted(out)


def secrets(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of runs of letters and digits, both in them, that no base span (sorted) meets and whose letters are as many-valued as random ones."""
    out = []
    i = last = 0
    for m in SECRET.finditer(text):
        x, y = m.span()
        while i < len(spans) and spans[i][0] < y:
            last = max(last, spans[i][2])
            i += 1
        value = m.group()
        if last <= x and any(map(str.isdigit, value)) and any(map(str.isalpha, value)):
            if -sum(n / len(value) * log2(n / len(value)) for n in Counter(value).values()) >= SECRET_BITS:
                out.append((x, SECRET_KIND, y))
    return out


def private_spans(text: str) -> list[tuple[int, int, int]]:
    """Base spans and secrets, by start, then kind."""
    spans = base_spans(text)
    return sorted(spans + secrets(text, spans))


def entity(kind: int, value: str) -> int:
    """A number for a value, whatever its writing."""
    plain = value.translate(LOWER) if kind == 0 else value if kind in (1, SECRET_KIND) else re.sub(r"[^0-9]", "", value)
    return xxhash.xxh3_64_intdigest(f"{kind}:{plain}".encode()) - 2**63


def terms_of(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """(term, start, end) of all terms of a text that no base span (sorted) meets."""
    out = []
    i = last = 0  # spans that begin before the term's end, and the furthest end of those
    for m in TERM.finditer(text):
        x, y = m.span()
        while i < len(spans) and spans[i][0] < y:
            last = max(last, spans[i][2])
            i += 1
        term = m.group().translate(LOWER)
        if last <= x and len(term) > 1 and not term.isdigit():
            out.append((term, x, y))
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text), text; docs may have any columns beside doc_id and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, key, spans, entities (distinct; a kind is its number), and of rows with spans the text; docs has doc_id, key, text."""
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_spans, all_entities, texts = [], [], []
            for text in batch.column(2).to_pylist():
                spans = private_spans(text)
                all_spans.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
                all_entities.append(sorted({entity(k, text[a:b]) for a, k, b in spans} | {k for _, k, _ in spans}))
                texts.append(text if spans else None)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "key": batch.column(1), "spans": pa.array(all_spans, pa.list_(span)), "entities": pa.array(all_entities, pa.list_(pa.int64())), "text": pa.array(texts, pa.string())})

    return map_batches(docs, run, "doc_id long, key long, spans array<struct<start:int,kind:int,end:int>>, entities array<long>, text string")


def as_tuples(spans: list[dict]) -> list[tuple[int, int, int]]:
    return [(s["start"], s["kind"], s["end"]) for s in spans]


def vocabulary(rows: DataFrame) -> DataFrame:
    """key, terms (distinct) of each row of rows (key, spans, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted({t for t, _, _ in terms_of(text, as_tuples(spans))}) for spans, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"key": batch.column(0), "terms": pa.array(terms, pa.list_(pa.string()))})

    return map_batches(rows.select("key", "spans", "text"), run, "key long, terms array<string>")


def revealing(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """key, term, disclosure: for each text the terms that reach GENERALISE with SUPPORT texts for an entity of it; docs has key and text."""
    total = float(scanned.select("key").distinct().count())
    held = scanned.where(F.size("spans") > 0)
    entities = held.select("key", F.explode("entities").alias("entity")).distinct()
    is_kind = F.col("entity").between(0, len(NAMES) - 1)
    support = F.when(is_kind, KIND_SUPPORT).otherwise(SUPPORT)
    n_e = entities.groupBy("entity").agg(F.count("*").alias("n_e"))
    n_e = materialise(n_e.where((F.col("n_e") >= support) & (~is_kind | (F.col("n_e") * KIND_SHARE <= total))))
    holders = materialise(entities.join(sized(n_e), "entity"))
    concerned = held.join(sized(holders.select("key").distinct()), "key", "left_semi").dropDuplicates(["key"])
    terms = materialise(vocabulary(concerned)).select("key", F.explode("terms").alias("term"))
    own = terms.groupBy("term").agg(F.count("*").alias("n_own")).where(F.col("n_own") >= SUPPORT)
    disclosure = lambda n_t: F.round(F.log(F.lit(total) * F.col("n_te") / (n_t * F.col("n_e"))) / F.nullif(F.log(F.lit(total) / F.col("n_e")), F.lit(0.0)), 9)
    both = terms.join(holders, "key").groupBy("entity", "term", "n_e").agg(F.count("*").alias("n_te")).where(F.col("n_te") >= support)
    both = materialise(both.join(sized(materialise(own)), "term").where(disclosure(F.col("n_own")) >= GENERALISE).drop("n_own"))
    wanted = sized(both.select("term").distinct())
    copies = sized(materialise(docs.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1")))
    words = F.array_distinct(F.split(F.translate("text", CAPITALS, SMALL), BREAK))
    everywhere = docs.join(copies, "key", "left").select((1 / F.coalesce("copies", F.lit(1))).alias("one"), F.explode(words).alias("term"))
    n_t = everywhere.join(wanted, "term", "left_semi").groupBy("term").agg(F.round(F.sum("one")).alias("n_t"))
    told = both.join(sized(materialise(n_t)), "term").select("entity", "term", disclosure(F.col("n_t")).alias("disclosure")).where(F.col("disclosure") >= GENERALISE)
    told = materialise(told)
    return terms.join(sized(told.select("term").distinct()), "term", "left_semi").join(holders.select("key", "entity"), "key").join(sized(told), ["entity", "term"]).groupBy("key", "term").agg(F.max("disclosure").alias("disclosure"))


def marked(rows: DataFrame) -> DataFrame:
    """doc_id, key, spans with those of every occurrence of terms (term, kind); rows has doc_id, key, spans, text, terms."""
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans, text, terms in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                kinds = {t["term"]: t["kind"] for t in terms}
                found = [{"start": x, "kind": kinds[t], "end": y} for t, x, y in terms_of(text, as_tuples(spans)) if t in kinds]
                out.append(spans + found)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "key": batch.column(1), "spans": pa.array(out, pa.list_(span))})

    return map_batches(rows.select("doc_id", "key", "spans", "text", "terms"), run, "doc_id long, key long, spans array<struct<start:int,kind:int,end:int>>")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, key, all_spans (start, kind, end; kind 4: generalised term, 5: removed term, 6: secret), by start, then kind."""
    slim = keyed(docs)
    scanned = materialise(scan(slim))
    kind = F.when(F.col("disclosure") >= REMOVE, REMOVED_KIND).otherwise(TERM_KIND)
    terms = revealing(slim, scanned).groupBy("key").agg(F.collect_list(F.struct("term", kind.alias("kind"))).alias("terms"))
    rest = scanned.where(F.size("spans") == 0).select("doc_id", "key", "spans")
    few = scanned.where(F.size("spans") > 0).join(sized(materialise(terms), 20_000), "key", "left")
    few = marked(few.withColumn("terms", F.coalesce("terms", F.array().cast("array<struct<term:string,kind:int>>"))))
    return few.union(rest).select("doc_id", "key", F.sort_array("spans").alias("all_spans"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_private (base spans and secrets), n_generalised, n_removed of find()'s rows."""
    names = F.array(*map(F.lit, NAMES))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("all_spans", lambda s: s["kind"] < TERM_KIND)
    count = lambda k: F.size(F.filter("all_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)),
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("all_spans")).alias("spans"),
        count(SECRET_KIND).alias("n_secret"),
        (F.size(base) + count(SECRET_KIND)).cast("long").alias("n_private"),
        count(TERM_KIND).alias("n_generalised"),
        count(REMOVED_KIND).alias("n_removed"),
    )


def rewritten(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with base spans and secrets as their kind, removed terms gone and generalised ones as a class of their letters; of overlapping spans the first counts."""
    out, last = [], 0
    for start, kind, end in spans:
        if start < last:
            continue
        value = text[start:end]
        general = "[NUMBER]" if any(c.isdigit() for c in value) else "[NAME]" if value[:1].isupper() else "[WORD]"
        out += [text[last:start], general if kind == TERM_KIND else f"[{NAMES[kind].upper()}]"]
        last = end
    return "".join(out) + text[last:]


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with personal data and revealing terms replaced in text."""
    found = find(docs).where(F.size("all_spans") > 0).select(F.col("key").alias("key of the text"), F.col("all_spans").alias("spans of the text")).dropDuplicates(["key of the text"])

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("text")
            texts, spans = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            new = [t if s is None else rewritten(t, [(x["start"], x["kind"], x["end"]) for x in s]) for t, s in zip(texts, spans, strict=True)]
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    joined = docs.join(sized(found, 200_000), key == F.col("key of the text"), "left")
    names = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]
    return map_batches(joined.select(*names, "spans of the text"), write, fields)
