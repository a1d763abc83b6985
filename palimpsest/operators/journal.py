"""Time travel over an append-only journal: one row for each change of a key at a version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def state_at(journal: DataFrame, key: list[str], version: str, deleted: Column | None = None, until: int | None = None) -> DataFrame:
    """The last row of each key up to a version, without keys whose last row deletes them.

    A grouped maximum, so partial results combine before the shuffle and a hot key
    costs one row for each task.
    """
    rows = journal if until is None else journal.where(F.col(version) <= until)
    if deleted is not None:
        rows = rows.withColumn("is deleted", deleted)
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), F.col(version)).alias("last"))
    out = last.select("last.*")
    return out if deleted is None else out.where(~F.col("is deleted")).drop("is deleted")


def version_range(journal: DataFrame, version: str, spec: str) -> DataFrame:
    """Rows written in a range of versions: ``X:Y``, ``X:``, ``:Y``, ``X``, or ``::N`` for the last N versions."""
    v = F.col(version)
    if spec.startswith("::"):
        last = int(spec[2:])
        kept = journal.select(version).distinct().orderBy(F.desc(version)).limit(last)
        return journal.join(F.broadcast(kept), version, "left_semi")  # as many rows as the caller names
    low, colon, high = spec.partition(":")
    if not colon:
        return journal.where(v == int(low))
    if low:
        journal = journal.where(v >= int(low))
    return journal.where(v <= int(high)) if high else journal


def with_comment(journal: DataFrame, versions: DataFrame, comment: str) -> DataFrame:
    """Rows of the versions that bear a comment."""
    return journal.join(versions.where(F.col("comment") == comment).select("version"), "version", "left_semi")


def version_info(journal: DataFrame, version: str, op: Column, size: Column) -> DataFrame:
    """Per version: rows added, modified and deleted, and bytes; and the total of all in a row whose version is null."""
    rows = journal.select(F.col(version).alias("version"), op.alias("op"), size.alias("size"))
    n = lambda o: F.count_if(F.col("op") == o)
    return rows.rollup("version").agg(n("+").alias("added"), n("#").alias("modified"), n("-").alias("deleted"), F.sum("size").cast("long").alias("bytes"), F.grouping_id().cast("long").alias("level"))


def running_size(journal: DataFrame, version: str, size: Column) -> DataFrame:
    """Bytes written by each version, and the archive's size after it. The window sees one row for each version."""
    per = journal.groupBy(F.col(version).alias("version")).agg(F.sum(size).cast("long").alias("written"))
    return per.withColumn("archive", F.sum("written").over(Window.orderBy("version").rowsBetween(Window.unboundedPreceding, 0)))


def version_delta(journal: DataFrame, version: str, size: Column) -> DataFrame:
    """Bytes written by each version, and by how much they differ from the version before."""
    per = journal.groupBy(F.col(version).alias("version")).agg(F.sum(size).cast("long").alias("written"))
    return per.withColumn("delta", F.col("written") - F.lag("written").over(Window.orderBy("version")))


def first_seen(journal: DataFrame, key: list[str], version: str) -> DataFrame:
    """The first and the last version of each key, and how many rows it has."""
    return journal.groupBy(*key).agg(F.min(version).alias("first_version"), F.max(version).alias("last_version"), F.count("*").alias("n_rows"))


def keep_newest(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The n newest rows of each group. The rank filter limits groups before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("place in group", place).where(F.col("place in group") <= n).drop("place in group")


def last_two(rows: DataFrame, order: str, value: str) -> DataFrame:
    """The last row of a log beside the one before it, and whether their values are equal."""
    two = rows.orderBy(F.desc(order)).limit(2)
    beside = two.select(F.col(order).alias("last"), F.col(value).alias("last_value"), F.lag(order, -1).over(Window.orderBy(F.desc(order))).alias("before"), F.lag(value, -1).over(Window.orderBy(F.desc(order))).alias("before_value"))
    return beside.orderBy(F.desc("last")).limit(1).withColumn("equal", F.col("last_value").eqNullSafe(F.col("before_value")))
