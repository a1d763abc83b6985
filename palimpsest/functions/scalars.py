"""Scalar functions over texts, bytes, names and dates, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squash(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def stretch(p: Column) -> Column:
    return F.log(p / (1 - p))


def trailing_zeros(x: Column) -> Column:
    """Zero bits behind the last one bit; 64 for zero."""
    lowest = F.when(x == 0, F.lit(-1)).otherwise(x.bitwiseAND(-x) - 1)
    return F.bit_count(lowest)


def rolling_hash(data: Column) -> Column:
    """The context hash a = (a + byte + 512) * 773 mod 2^32 over all bytes, from a = 0."""
    h = F.hex(data.cast("binary"))
    codes = F.transform(F.sequence(F.lit(1), F.length(h) - 1, F.lit(2)), lambda i: F.conv(F.substring(h, i, F.lit(2)), 16, 10).cast("long"))
    return F.when(F.length(h) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(codes, F.lit(0).cast("long"), lambda a, b: ((a + b + 512) * 773) % 4294967296))


def text_score(text: Column) -> Column:
    """Letters, digits, full stops and commas that a space follows, for each letter of the text."""
    return F.when(F.length(text) > 0, F.round(F.regexp_count(text, F.lit("[A-Za-z0-9.,] ")) / F.length(text), 6)).otherwise(0.0)


#: First bytes, in hexadecimal, of kinds of files; the first that fits names the kind.
SIGNATURES = [
    ("89504E470D0A1A0A", "png"),
    ("FFD8FF", "jpeg"),
    ("47494638", "gif"),
    ("25504446", "pdf"),
    ("504B0304", "zip"),
    ("1F8B", "gzip"),
    ("425A68", "bzip2"),
    ("FD377A585A00", "xz"),
    ("28B52FFD", "zstd"),
    ("7F454C46", "elf"),
    ("4D5A", "exe"),
    ("52494646", "riff"),
    ("664C6143", "flac"),
    ("4F676753", "ogg"),
    ("494433", "mp3"),
    ("3C21646F6374797065", "html"),
    ("3C21444F4354595045", "html"),
    ("3C68746D6C", "html"),
    ("3C3F786D6C", "xml"),
    ("7B", "json"),
]


def kind(content: Column) -> Column:
    """The kind of a file by its first bytes; text if they are printable, else unknown."""
    head = F.hex(F.substring(content.cast("binary"), 1, 16))
    out = F.when(head == "", "empty")
    for mark, name in SIGNATURES:
        out = out.when(head.startswith(mark), name)
    printable = ~F.hex(F.substring(content.cast("binary"), 1, 512)).rlike("^(..)*(0[0-8]|0B|0[EF]|1.|7F)")
    return out.when(printable, "text").otherwise("unknown")


def data_type(text: Column) -> Column:
    """DNA, NUMERIC, BASE64, SMALL_ALPHABET or UNDEFINED, tried in this order by the shares of letters."""
    n = F.length(text)
    share = lambda letters: F.regexp_count(text, F.lit(letters))
    distinct = F.size(F.array_distinct(F.split(text, "")))
    return (
        F.when(n == 0, "UNDEFINED")
        .when(share("[ACGTUNacgtun]") * 12 > n * 11, "DNA")
        .when(share("[0-9+*/=,.:; -]") * 10 > n * 9, "NUMERIC")
        .when(share("[A-Za-z0-9+/=\n]") == n, "BASE64")
        .when(distinct <= 16, "SMALL_ALPHABET")
        .otherwise("UNDEFINED")
    )


def run_share(data: Column) -> Column:
    """The share of letters that stand in runs of three or more of the same letter."""
    runs = F.regexp_extract_all(data, F.lit(r"(?s)(.)\1{2,}"), F.lit(0))
    length = F.aggregate(runs, F.lit(0), lambda a, r: a + F.length(r))
    return F.when(F.length(data) > 0, F.round(length / F.length(data), 6)).otherwise(0.0)


#: Names of date variables and the patterns they stand for.
DATE_VARIABLES = {"%year": "yyyy", "%month": "MM", "%day": "dd", "%hour": "HH", "%min": "mm", "%sec": "ss", "%datetime": "yyyyMMddHHmmss", "%date": "yyyyMMdd", "%time": "HHmmss"}


def expanded(template: Column, ts: Column) -> Column:
    """A name with its date variables filled in; longer names first."""
    out = template
    for name in sorted(DATE_VARIABLES, key=lambda k: (-len(k), k)):
        out = F.replace(out, F.lit(name), F.date_format(ts, DATE_VARIABLES[name]))
    out = F.replace(out, F.lit("%weekday"), F.dayofweek(ts).cast("string"))
    return F.replace(out, F.lit("%week"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def card(text: Column) -> Column:
    """key=value lines as a map."""
    return F.str_to_map(text, F.lit("\n"), F.lit("="))


def valid_name(name: Column, most: int = 255) -> Column:
    """Whether a name is UTF-8 and short enough in bytes."""
    return F.is_valid_utf8(name) & (F.octet_length(name) <= most)
