"""Incremental ingestion: one version of a repository for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from palimpsest.sources.repository import Repository


def writer(stream: DataFrame, repository: Repository, checkpoint: str) -> DataStreamWriter:
    """A stream writer that adds each batch of files (path, size, mtime, attr, content).

    A batch that is run again after a failure finds its files stored and makes no
    second version. Fragments are never forgotten, so they are looked up in the
    repository, not in the stream's own state.
    """

    def commit(batch: DataFrame, number: int) -> None:
        newest = batch.dropDuplicates(["path"])
        repository.add(newest, comment=f"batch {number}", delete=False)

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)


def drain(stream: DataFrame, repository: Repository, checkpoint: str) -> StreamingQuery:
    """Take in all that is there, then stop."""
    query = writer(stream, repository, checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
