"""Putting files that a trace holds in parts back together.

A raw record is a part (partial) or the record that closes a file. A part belongs to the next closing record of its
filename in trace order; parts that nothing closes belong to no file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assign_parts(records: DataFrame) -> DataFrame:
    """records (run, record_seq, filename, partial, ...) with file_seq, the record that closes the file; null if none does."""
    keys = [c for c in ("run", "filename") if c in records.columns]
    ahead = Window.partitionBy(*keys).orderBy("record_seq").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return records.withColumn("file_seq", F.min(F.when(~F.col("partial"), F.col("record_seq"))).over(ahead))


def reassemble(records: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, chunks): chunks numbered through the parts of their file. chunks: run, record_seq, chunk_seq, fp, chunksize."""
    keys = [c for c in ("run",) if c in records.columns]
    assigned = assign_parts(records)
    files = assigned.where(~F.col("partial")).drop("partial")
    both = chunks.join(assigned.select(*keys, "record_seq", "file_seq", "filename", "partial"), [*keys, "record_seq"]).where(F.col("file_seq").isNotNull())
    order = Window.partitionBy(*keys, "file_seq").orderBy("record_seq", "chunk_seq")
    return files, both.withColumn("chunk_seq", (F.row_number().over(order) - 1).cast("long"))
