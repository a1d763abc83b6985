"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from functools import reduce
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when measured to have at most this many rows and bytes;
#: beyond it the plan is an ordinary shuffle join.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 16_000_000
#: Rows per Arrow batch. Texts may be long, so batches are short.
ARROW_ROWS = 400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to all cores if it is a table of fewer parts than half of them (a single small file); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() < cores else df


def settings(spark: SparkSession) -> None:
    """Arrow batches of bounded size for operators that hand texts to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only a session without executors on other hosts may go without: it gets one of its own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir", None)
        if not named and not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all hosts share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def compact(df: DataFrame, rows: int = 250_000) -> DataFrame:
    """A checkpoint of slim rows in as many partitions as hold ``rows`` each, so that a small table does not leave a file for every task of every later shuffle."""
    done = materialise(df)
    return done.coalesce(max(1, -(-done.count() // rows)))


def let_go(spark: SparkSession) -> None:
    """Have Spark's cleaner drop the shuffle files and checkpoints of finished steps, which it does when the driver's heap is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def reread(df: DataFrame) -> DataFrame:
    """df from a Parquet table in the shared folder, for wide rows that are read more than once."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Bytes of a value of each type, its share of the row's overhead included; of strings and lists besides what they hold.
WIDTHS = {"bigint": 12, "double": 12, "int": 8, "float": 8, "boolean": 6, "binary": 24, "string": 24}


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row of df takes in memory."""

    def width(value: Column, kind: str) -> Column:
        if kind.startswith("array<"):
            inner = WIDTHS.get(kind[6:-1], 40)
            return F.lit(24) + F.coalesce(F.size(value), F.lit(0)) * inner
        held = F.coalesce(F.octet_length(value), F.lit(0)) if kind in ("string", "binary") else F.lit(0)
        return F.lit(WIDTHS.get(kind, 64)) + held

    return reduce(Column.__add__, (width(F.col(f"`{f.name}`"), f.dataType.simpleString()) for f in df.schema.fields))


def is_small(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most ``most`` rows and BROADCAST_BYTES; reads no more rows than that."""
    rows, size = df.limit(most + 1).agg(F.count("*"), F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()
    return rows <= most and size <= BROADCAST_BYTES


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it was measured to be small, else unchanged."""
    return F.broadcast(df) if is_small(df, most) else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, though body names it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def give_back() -> None:
    """Return to the system what this process has freed: a worker lives on after its task, and other stages need the memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def map_batches(
    df: DataFrame, function: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    settings(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back()

    return df.mapInArrow(run, schema)
