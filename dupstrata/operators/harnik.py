"""Estimating the deduplication ratio from a sample of chunk occurrences.

A pass over the chunks draws a fixed number of occurrences; a second one counts how often each sampled fingerprint
occurs; the ratio is 1 - sum(base size / scan) / sum(base size), where base is how often it was drawn.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE, SAMPLE_WITH_BREAKDOWN = 445_570, 4_951_752
ERROR, DOUBT = 0.01, 0.0001


def needed(ratio: float) -> float:
    """Samples that an error of at most ERROR needs at this ratio."""
    return (math.log(2) + math.log(1 / DOUBT)) / (2 * ERROR**2 * ratio**2)


def sample_key(seed: str, columns: Sequence[str]) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in columns]).cast("binary"))


def draw(chunks: DataFrame, k: int, seed: str = "1", by: Sequence[str] = ("file_seq", "chunk_seq")) -> DataFrame:
    """The k occurrences of smallest key: a uniform sample without replacement, the same on every run.

    A histogram over the first 4 hex digits (at most 65,536 rows) finds the bucket in which the k-th lies; lower buckets
    are taken whole by a filter, and only that bucket's rows are ranked.
    """
    keyed = chunks.withColumn("sample_key", sample_key(seed, by)).withColumn("_b", F.substring("sample_key", 1, 4))
    hist = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = hist.select("_b", before.alias("_before")).where(F.col("_before") < k).agg(F.max_by("_b", "_before").alias("_edge"), F.max("_before").alias("_taken"))
    marked = keyed.crossJoin(F.broadcast(edge)).where(F.col("_b") <= F.col("_edge"))  # edge: one row
    whole = marked.where(F.col("_b") < F.col("_edge"))
    last = marked.where(F.col("_b") == F.col("_edge")).withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("sample_key"))).where(F.col("_r") <= k - F.col("_taken")).drop("_r")
    return whole.unionByName(last).drop("_b", "_edge", "_taken")


def compact(sample: DataFrame) -> DataFrame:
    """fp, base_count, chunk_size."""
    return sample.groupBy("fp").agg(F.count(F.lit(1)).alias("base_count"), F.min("chunksize").alias("chunk_size"))


def estimate(sample: DataFrame, chunks: DataFrame, key: str | None = None) -> DataFrame:
    """(key,) n_samples, total_bytes, ratio, real_bytes, redundant_bytes, enough from a compacted sample and the chunks it was drawn from."""
    keys = [key] if key else []
    per = chunks.groupBy(*keys, "fp").agg(F.count(F.lit(1)).alias("scan"), F.sum("chunksize").alias("bytes"))
    both = per.join(sample, "fp", "left")
    w = F.col("base_count") * F.col("chunk_size").cast("double")
    got = both.groupBy(*keys).agg(F.coalesce(F.sum("base_count"), F.lit(0)).alias("n_samples"), F.sum("bytes").alias("total_bytes"), F.sum(w / F.col("scan")).alias("_part"), F.sum(w).alias("_all"))
    ratio = F.when(F.col("_all") > 0, 1.0 - F.col("_part") / F.col("_all"))
    got = got.withColumn("ratio", ratio)
    enough = F.coalesce((F.col("ratio") > 0) & (F.col("n_samples") >= needed(1.0) / (F.col("ratio") * F.col("ratio"))), F.lit(False))
    return got.select(*keys, "n_samples", "total_bytes", F.round("ratio", 6).alias("ratio"), F.round((1.0 - F.col("ratio")) * F.col("total_bytes"), 3).alias("real_bytes"), F.round(F.col("ratio") * F.col("total_bytes"), 3).alias("redundant_bytes"), enough.alias("enough"))


def estimate_temporal(both: DataFrame, first: DataFrame, k: int, seed: str = "1", by: Sequence[str] = ("file_seq", "chunk_seq")) -> DataFrame:
    """ratio_all, ratio_first, ratio_second: what a second generation saves, from estimates of both together and of the first."""
    s_all, s_first = compact(draw(both, k, seed, by)), compact(draw(first, k, seed, by))
    a = estimate(s_all, both).select(F.col("ratio").alias("ratio_all"), F.col("total_bytes").alias("_all"))
    b = estimate(s_first, first).select(F.col("ratio").alias("ratio_first"), F.col("total_bytes").alias("_first"))
    second = (F.col("ratio_all") * F.col("_all") - F.col("ratio_first") * F.col("_first")) / F.nullif(F.col("_all") - F.col("_first"), F.lit(0))
    return a.crossJoin(b).select("ratio_all", "ratio_first", F.round(second, 6).alias("ratio_second"))
