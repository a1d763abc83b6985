"""Files of a tree as rows, lists of names, and numbered parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, folder: str, content: bool = True) -> DataFrame:
    """path (below the folder), size, mtime and, if asked, content of every file of a tree."""
    base = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    whole = F.regexp_replace(F.col("path"), "^file:/+", "file:/")
    cut = len(root.replace("file:///", "file:/")) + 2
    out = files.select(F.substring(whole, F.lit(cut), F.length(whole)).alias("path"), F.col("length").alias("size"), F.col("modificationTime").cast("timestamp_ntz").alias("mtime"), *([F.col("content")] if content else []))
    return out


def names(spark: SparkSession, path: str) -> DataFrame:
    """name and, behind a tab, destination of each line of a list; empty lines are left out."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parts = F.split("value", "\t", 2)
    return lines.select(F.get(parts, F.lit(0)).alias("name"), F.get(parts, F.lit(1)).alias("destination"))


def listed(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """The files whose path a list names, with their destination."""
    return files.join(wanted.withColumnRenamed("name", "path"), "path").withColumn("destination", F.coalesce("destination", "path"))


def parts(spark: SparkSession, pattern: str) -> DataFrame:
    """All rows of numbered Parquet parts, with part_no from the name's last number."""
    rows = spark.read.parquet(pattern)
    return rows.withColumn("part_no", F.regexp_extract(F.col("_metadata.file_path"), r"(\d+)(?:\.parquet)?(?:/[^/]*)?$", 1).cast("int"))


def from_lines(spark: SparkSession, name: str, lines: list[str]) -> DataFrame:
    """One named stream as a file."""
    text = "\n".join(lines)
    return spark.createDataFrame([(name, len(text.encode()), text.encode())], "path string, size long, content binary")


def to_delimited(rows: DataFrame, path: str, separator: str = ";", header: str | None = None, footer: str | None = None) -> None:
    """Rows as delimited lines, sorted by their columns, with a header and a footer line of their own."""
    body = rows.orderBy(*rows.columns).select(F.concat_ws(separator, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns)).alias("value"), F.lit(1).alias("place"))
    extra = [(t, p) for t, p in ((header, 0), (footer, 2)) if t is not None]
    if extra:
        body = body.union(rows.sparkSession.createDataFrame(extra, "value string, place int"))
    body.orderBy("place", "value").select("value").write.mode("overwrite").text(path)


def to_json_lines(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
