"""Descriptive statistics of files and chunks, validation, listing, and windows over a file's chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERCENTILES = (10, 25, 50, 75, 90)
LARGE_FILE = 1 << 20


def _bucket(value: Column) -> Column:
    """A number that grows with value and takes about a thousand values: its power of two and the four bits below."""
    v = value.cast("long")
    e = F.when(v > 0, F.length(F.bin(v)) - 1).otherwise(F.lit(0))
    fine = F.when(v < 16, v).otherwise(F.floor(v / F.pow(F.lit(2.0), e - 4)) - 16)
    return F.when(v < 16, v).otherwise(e * 16 + fine).cast("long")


def order_statistics(rows: DataFrame, value: str, keys: Sequence[str] = (), ps: Sequence[int] = PERCENTILES, count: str | None = None) -> DataFrame:
    """keys, n, total, largest, p<k> (element floor(k n / 100), counted from 0, in ascending order) and c<k> (the same of running sums).

    Equal values are counted together before any sort; running counts are taken over about a thousand buckets and then
    inside each bucket, so no task sorts all values.
    """
    weight = F.col(count) if count else F.lit(1)
    hist = rows.groupBy(*keys, F.col(value).cast("long").alias("_v")).agg(F.sum(weight).cast("long").alias("_n")).withColumn("_b", _bucket(F.col("_v")))
    sums = hist.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn"), F.sum(F.col("_n") * F.col("_v")).alias("_bs"), F.max("_v").alias("_bm"))
    prior = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    zero = F.lit(0).cast("long")
    sums = sums.select(*keys, "_b", F.coalesce(F.sum("_bn").over(prior), zero).alias("_n0"), F.coalesce(F.sum("_bs").over(prior), zero).alias("_s0"), F.sum("_bn").over(whole).alias("n"), F.sum("_bs").over(whole).alias("total"), F.max("_bm").over(whole).alias("largest"))
    same = [F.col(f"h.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys] + [F.col("h._b") == F.col("s._b")]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    both = hist.alias("h").join(sums.alias("s"), cond).select(*[F.col(f"h.{k}").alias(k) for k in keys], "h._b", "_v", "_n", "_n0", "_s0", "n", "total", "largest")
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("_from", F.col("_n0") + F.coalesce(F.sum("_n").over(inside), zero)).withColumn("_sum", F.col("_s0") + F.coalesce(F.sum(F.col("_n") * F.col("_v")).over(inside), zero))
    at = {p: F.floor(F.col("n") * p / 100).cast("long") for p in ps}
    here = {p: (F.col("_from") <= at[p]) & (at[p] < F.col("_from") + F.col("_n")) for p in ps}
    return both.groupBy(*keys, "n", "total", "largest").agg(
        *[F.max(F.when(here[p], F.col("_v"))).alias(f"p{p}") for p in ps],
        *[F.max(F.when(here[p], F.col("_sum") + (at[p] - F.col("_from") + 1) * F.col("_v"))).alias(f"c{p}") for p in ps],
    )


def file_statistics(files: DataFrame) -> DataFrame:
    """n, total, mean (whole bytes), largest, percentiles of sizes and of running sizes."""
    got = order_statistics(files, "filesize")
    return got.select("n", "total", F.floor(F.col("total") / F.col("n")).cast("long").alias("mean"), "largest", *[c for c in got.columns if c[0] in "pc" and c[1:].isdigit()])


def file_details(files: DataFrame, key: str) -> DataFrame:
    """key, n, total, mean, largest, median, cumulative_median by file type or size class."""
    got = order_statistics(files, "filesize", [key], (50,))
    return got.select(F.col(key).cast("string").alias("key"), "n", "total", F.floor(F.col("total") / F.col("n")).cast("long").alias("mean"), "largest", F.col("p50").alias("median"), F.col("c50").alias("cumulative_median"))


def file_totals(files: DataFrame, key: str) -> DataFrame:
    """key, total, n."""
    return files.groupBy(F.col(key).cast("string").alias("key")).agg(F.sum("filesize").alias("total"), F.count(F.lit(1)).alias("n"))


def chunked_totals(files: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """key, stat_bytes, chunk_bytes, n of files that have chunks."""
    per = chunks.groupBy("file_seq").agg(F.sum("chunksize").alias("chunk_bytes"))
    return files.join(per, "file_seq").groupBy(F.col(key).cast("string").alias("key")).agg(F.sum("filesize").alias("stat_bytes"), F.sum("chunk_bytes").alias("chunk_bytes"), F.count(F.lit(1)).alias("n"))


def chunk_sizes(chunks: DataFrame) -> DataFrame:
    """chunksize, n, n_large: how many chunks have that size, and how many of them lie in large files or in parts of files."""
    large = F.col("filesize") > LARGE_FILE
    if "partial" in chunks.columns:
        large = F.coalesce(F.col("partial"), F.lit(False)) | F.coalesce(large, F.lit(False))
    return chunks.groupBy("chunksize").agg(F.count(F.lit(1)).alias("n"), F.count_if(large).alias("n_large"))


def validate(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """file_bytes, n_files, n_chunks; chunks of parts count."""
    f = files.agg(F.coalesce(F.sum("filesize"), F.lit(0)).alias("file_bytes"), F.count(F.lit(1)).alias("n_files"))
    return f.crossJoin(chunks.agg(F.count(F.lit(1)).alias("n_chunks")))


def with_offsets(chunks: DataFrame, keys: Sequence[str] = ("file_seq",)) -> DataFrame:
    """chunks with `begin`, the running offset inside the file."""
    order = Window.partitionBy(*keys).orderBy("chunk_seq").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("begin", F.coalesce(F.sum("chunksize").over(order), F.lit(0).cast("long")))


def combine_chunks(chunks: DataFrame, keys: Sequence[str] = ("file_seq",)) -> DataFrame:
    """keys, pair_seq, fp: adjacent fingerprints hashed together by twos (one level of a Merkle tree); an odd last one stays."""
    order = Window.partitionBy(*keys).orderBy("chunk_seq")
    placed = chunks.withColumn("_i", F.row_number().over(order) - 1).withColumn("_next", F.lead("fp").over(order)).where(F.col("_i") % 2 == 0)
    both = F.md5(F.unhex(F.concat("fp", "_next")))
    return placed.select(*keys, F.floor(F.col("_i") / 2).cast("long").alias("pair_seq"), F.coalesce(both, F.col("fp")).alias("fp"))


def sliding_average(rows: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], window: int) -> DataFrame:
    """rows with `moving`, the mean of the last window + 1 values."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-window, 0)
    return rows.withColumn("moving", F.round(F.avg(value).over(w), 6))
