"""Trace formats as Spark tables: decoding from binary files that Spark reads, encoding in each task of a writer.

read() gives one row a record; a record's chunks are an array, so a trace is one narrow pass without a shuffle. Traces
are not splittable: each file is one task's, and many files make the parallelism.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from dupstrata.sources import wire

SCHEMA = "run string, record_seq long, filename string, filesize long, filetype string, label string, partial boolean, chunks array<struct<chunksize:long,fp:binary,chunk_hash:long>>"
FORMATS: dict[str, tuple] = {name: (reader, wire.WRITERS.get(name)) for name, reader in wire.READERS.items()}


def register_format(name: str, reader, writer=None) -> None:
    """reader: from a binary file to records; writer: a file and records."""
    FORMATS[name] = (reader, writer)


def is_format(name: str) -> bool:
    return name in FORMATS


def _row(run: str, seq: int, r: wire.Record) -> tuple:
    return (run, seq, r.filename, r.size, r.type, r.label, r.partial, [{"chunksize": c.size, "fp": c.fp, "chunk_hash": c.hash} for c in r.chunks])


def read(spark: SparkSession, path: str | list[str], format: str = "protobuf", batch: int = 1000) -> DataFrame:
    """Records of all traces below path; run is a trace's place. Any file system that Spark reads will do."""
    if not is_format(format):
        raise ValueError(f"unknown format {format!r}; known: {', '.join(FORMATS)}")
    reader = FORMATS[format][0]
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark.createDataFrame([], SCHEMA).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows = []
                for seq, r in enumerate(reader(io.BytesIO(b.column("content")[i].as_py()))):
                    rows.append(_row(b.column("path")[i].as_py(), seq, r))
                    if len(rows) == batch:
                        yield _batch(rows, arrow)
                        rows = []
                if rows:
                    yield _batch(rows, arrow)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=f.type) for k, f in enumerate(arrow)], schema=arrow)


def files(records: DataFrame) -> DataFrame:
    """Closing records as files."""
    return records.where(~F.col("partial")).select("run", F.col("record_seq").alias("file_seq"), "filename", "filesize", "filetype", "label")


def chunks(records: DataFrame) -> DataFrame:
    """One row a chunk of every record: run, record_seq, chunk_seq, filename, partial, filesize, filetype, chunksize, fp (hex), chunk_hash."""
    each = records.select("run", "record_seq", "filename", "partial", "filesize", "filetype", F.posexplode("chunks").alias("chunk_seq", "c"))
    return each.select("run", "record_seq", F.col("chunk_seq").cast("long").alias("chunk_seq"), "filename", "partial", "filesize", "filetype", F.col("c.chunksize").alias("chunksize"), F.lower(F.hex("c.fp")).alias("fp"), F.col("c.chunk_hash").alias("chunk_hash"))


class TracePartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class TraceReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        import glob
        import os

        path = self.options["path"].removeprefix("file://")
        return [TracePartition(p) for p in sorted(glob.glob(f"{path}/**", recursive=True) if os.path.isdir(path) else glob.glob(path)) if os.path.isfile(p) and not os.path.basename(p).startswith((".", "_")) and "/_staging-" not in p]

    def read(self, partition: TracePartition):
        reader = FORMATS[self.options.get("format", "protobuf")][0]
        extra = {"mode": self.options["mode"]} if "mode" in self.options else {}
        with open(partition.path, "rb", buffering=4 << 20) as f:
            for seq, r in enumerate(reader(f, **extra)):
                yield (partition.path, seq, r.filename, r.size, r.type, r.label, r.partial, [(c.size, c.fp, c.hash) for c in r.chunks])


@dataclass
class Written(WriterCommitMessage):
    """The staged file of the attempt that counts for a task; empty if it had no rows."""

    name: str


class TraceWriter(DataSourceWriter):
    """A file a task, staged below the target. Only those that the committed attempts name are moved into place; what repeated, speculative or failed attempts left goes with the staging folder."""

    def __init__(self, options: dict):
        self.options = options
        self.folder = options["path"].removeprefix("file://")
        self.staging = f"{self.folder}/_staging-{uuid.uuid4().hex}"

    def write(self, rows) -> WriterCommitMessage:
        import os

        name = self.options.get("format", "protobuf")
        writer = FORMATS[name][1]
        if writer is None:
            raise NotImplementedError(f"{name} is read only")
        os.makedirs(self.staging, exist_ok=True)
        part = f"part-{uuid.uuid4().hex}.trace"
        with open(f"{self.staging}/{part}", "wb", buffering=4 << 20) as f:
            n = writer(f, (wire.Record(r["filename"], r["filesize"], r["filetype"] or "", r["label"], bool(r["partial"]), [wire.Chunk(c["chunksize"], bytes(c["fp"]), c["chunk_hash"]) for c in r["chunks"] or []]) for r in rows))
        return Written(part if n else "")

    def commit(self, messages) -> None:
        import os
        import shutil

        os.makedirs(self.folder, exist_ok=True)
        for m in messages:
            if m is not None and m.name:
                os.rename(f"{self.staging}/{m.name}", f"{self.folder}/{m.name}")
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages) -> None:
        import shutil

        shutil.rmtree(self.staging, ignore_errors=True)


class TraceSource(DataSource):
    """spark.read / df.write.format("trace"), options format, path and mode; path is a folder that all tasks share."""

    @classmethod
    def name(cls) -> str:
        return "trace"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TraceReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return TraceWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TraceSource)


def convert(spark: SparkSession, source: str, target: str, format: str = "legacy") -> None:
    """A trace of any format that can be read as protobuf."""
    register(spark)
    read(spark, source, format).write.format("trace").option("path", target).option("format", "protobuf").mode("append").save()
