"""Comparison of trees: tables of path, size, mtime, hash and the like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _beside(master: DataFrame, slave: DataFrame, key: str, columns: list[str]) -> DataFrame:
    m = master.select(F.col(key).alias("path"), F.lit(True).alias("in_m"), *(F.col(c).alias(f"m_{c}") for c in columns))
    s = slave.select(F.col(key).alias("path"), F.lit(True).alias("in_s"), *(F.col(c).alias(f"s_{c}") for c in columns))
    return m.join(s, "path", "full_outer")


def _equal(columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"m_{c}").eqNullSafe(F.col(f"s_{c}"))
    return out


def compare(master: DataFrame, slave: DataFrame, key: str = "path", columns: list[str] = ["hash"]) -> DataFrame:  # noqa: B006
    """path and class: same, different, missing (in the slave) or extra."""
    both = _beside(master, slave, key, columns)
    klass = F.when(F.col("in_s").isNull(), "missing").when(F.col("in_m").isNull(), "extra").when(_equal(columns), "same").otherwise("different")
    return both.select("path", klass.alias("class"))


def compare_many(master: DataFrame, slaves: dict[str, DataFrame], key: str = "path", columns: list[str] = ["hash"]) -> DataFrame:  # noqa: B006
    """compare() of one master with each slave, by the slave's name."""
    out = None
    for name, slave in slaves.items():
        own = compare(master, slave, key, columns).withColumn("slave", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def incremental(state: DataFrame, scan: DataFrame, always: bool = False, delete: bool = True) -> DataFrame:
    """path and action of an incremental add: add, modify, attr, delete or same.

    Content is read again where size or mtime differ, and where the stored hash is
    missing or of another algorithm; a change of attributes alone keeps the hash.
    Both tables have path, size, mtime, attr, hash_alg and hash.
    """
    both = _beside(state, scan, "path", ["size", "mtime", "attr", "hash_alg", "hash"])
    reread = F.lit(always) | ~_equal(["size", "mtime"]) | F.col("m_hash").isNull() | ~_equal(["hash_alg"])
    action = (
        F.when(F.col("in_m").isNull(), "add")
        .when(F.col("in_s").isNull(), "delete" if delete else "same")
        .when(reread & (F.lit(always) | ~_equal(["hash"])), "modify")
        .when(reread & ~_equal(["size", "mtime", "hash_alg", "attr"]), "attr")
        .when(~_equal(["attr"]), "attr")
        .otherwise("same")
    )
    return both.select("path", action.alias("action"))


def sync_estimate(state: DataFrame, scan: DataFrame) -> DataFrame:
    """Files and bytes of each class: new, changed, gone or same; bytes are those that an add would read."""
    both = _beside(state, scan, "path", ["size", "hash"])
    klass = F.when(F.col("in_m").isNull(), "new").when(F.col("in_s").isNull(), "gone").when(_equal(["size", "hash"]), "same").otherwise("changed")
    bytes_ = F.when(klass.isin("new", "changed"), F.col("s_size")).otherwise(0)
    return both.groupBy(klass.alias("class")).agg(F.count("*").alias("files"), F.sum(bytes_).cast("long").alias("bytes"))


def mirror_plan(master: DataFrame, slave: DataFrame) -> DataFrame:
    """path, action (copy, overwrite, delete) and bytes that make slave equal to master."""
    both = _beside(master, slave, "path", ["size", "hash"])
    action = F.when(F.col("in_s").isNull(), "copy").when(F.col("in_m").isNull(), "delete").when(~_equal(["size", "hash"]), "overwrite")
    plan = both.select("path", action.alias("action"), F.when(F.col("in_m").isNotNull(), F.col("m_size")).otherwise(0).cast("long").alias("bytes"))
    return plan.where("action is not null")


def verify(stored: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    """path and verdict of each stored file: ok, bad or missing, by the given columns."""
    both = _beside(stored, found, "path", columns).where("in_m")
    return both.select("path", F.when(F.col("in_s").isNull(), "missing").when(_equal(columns), "ok").otherwise("bad").alias("verdict"))


def tally(verdicts: DataFrame) -> DataFrame:
    """Good and bad files, whether all are good, and the exit code: 0 all good, 1 some missing, 2 some bad."""
    severity = F.when(F.col("verdict") == "ok", 0).when(F.col("verdict") == "missing", 1).otherwise(2)
    return verdicts.agg(
        F.count_if(severity == 0).alias("good"),
        F.count_if(severity > 0).alias("bad"),
        F.coalesce(F.bool_and(severity == 0), F.lit(True)).alias("all_good"),
        F.coalesce(F.max(severity), F.lit(0)).alias("code"),
    )


def only_on_disk(disk: DataFrame, archive: DataFrame) -> DataFrame:
    """Everything on disk that is not in the archive, by path."""
    return disk.join(archive.select("path"), "path", "left_anti")


def duplicates_in(other: DataFrame, master: DataFrame, by: list[str]) -> DataFrame:
    """Rows of other that master has too, by name, hash or both."""
    return other.join(master.select(*by), by, "left_semi")


def new_and_gone(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that one state has and the other has not, marked + or -."""
    return after.exceptAll(before).withColumn("mark", F.lit("+")).unionByName(before.exceptAll(after).withColumn("mark", F.lit("-")))


def equal_tokens(a: DataFrame, b: DataFrame, label: str, length: int, b_label: str | None = None) -> DataFrame:
    """Lines of a and b that carry the same hexadecimal token, in letters of either case, behind a label (b_label in b, if given); both have line_id and line."""
    token = lambda own: F.lower(F.regexp_extract("line", f"{own}([0-9A-Fa-f]{{{length}}})", 1)).alias("token")
    x = a.select(F.col("line_id").alias("a_id"), token(label)).where("token <> ''")
    y = b.select(F.col("line_id").alias("b_id"), token(b_label or label)).where("token <> ''")
    return x.join(y, "token")
