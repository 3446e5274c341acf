"""Helpers shared by the corpus operators: tables, scratch space, Arrow batches, hold-outs."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; a word is a maximal run of anything else.
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"

#: A-Z to a-z on UTF-8 bytes; bytes of longer characters are 128 and above, so they stay.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Texts handled together inside one Python task, so that memory follows the texts and not the Arrow batch.
SLICE_BYTES = 2 << 20

#: Rows of whole texts that travel to a Python worker at once; both ends hold such a batch outside the heap.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset: on one machine a folder of this application's own; on a cluster an error, as no folder is known there that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"{tempfile.gettempdir()}/dupstrata-{spark.sparkContext.applicationId}"
    return base.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh folder in the shared one."""
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write df to shared storage and read it back, so that a lost executor costs no recomputation of what is above."""
    spark, schema = df.sparkSession, df.schema
    path = scratch(spark, tag)
    df.write.parquet(path)
    back = spark.read.schema(schema).parquet(path)
    back._scratch = path
    return back


def there(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def drop(*tables: DataFrame) -> None:
    """Delete what cut() wrote for these; nothing that is still to be computed may read them."""
    for df in tables:
        if path := getattr(df, "_scratch", None):
            fs, at = there(df.sparkSession, path)
            fs.delete(at, True)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that text operators read; text as UTF-8 bytes, null kept."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def held_out(column: str | Column, parts: int, part: int) -> Column:
    """True where crc32 of the id as text leaves this remainder; false for a null id."""
    col = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % parts == part, F.lit(False))


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, cut where the texts of a piece would pass `most` bytes; a longer text stands alone."""
    for batch in batches:
        sizes = [v or 0 for v in pc.binary_length(batch.column(column)).to_pylist()]
        begin = total = 0
        for i, n in enumerate(sizes):
            if i > begin and total + n > most:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        if batch.num_rows > begin:
            yield batch.slice(begin)


def give_back() -> None:
    """Hand memory that Arrow and the C library hold unused back to the machine: a worker outlives its task and would keep it beside the tasks to come."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # C libraries other than glibc have no such call
        pass


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limit of rows in an Arrow batch to BATCH_ROWS; a lower one stays. Only batches change by it, no result does."""
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(limit)) <= BATCH_ROWS:
        spark.conf.set(limit, BATCH_ROWS)


def map_texts(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, list]], schema: str, most: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow over slices of texts of so many bytes: fn turns one into columns of the schema, in its order."""
    spark = df.sparkSession
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    bound_batches(spark)
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema if not isinstance(schema, StructType) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for piece in slices(batches, most=most):
                out = fn(piece)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)
        finally:
            fn.__dict__.clear()
            give_back()

    return df.mapInArrow(run, schema)


def bounded_sample(df: DataFrame, key: str, rows: int, seed: str) -> DataFrame:
    """About `rows` rows at most, chosen by a hash of the key: the same rows on every run, no sort and no shuffle.

    The expected count is min(rows, all); it exceeds that by a few square roots at worst.
    """
    total = df.count()
    if total <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) < int(rows / total * (1 << 30)))
