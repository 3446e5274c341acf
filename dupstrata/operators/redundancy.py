"""Redundancy analyses over chunk tables.

A chunk table has run, file_seq, chunk_seq, fp, chunksize, and what a breakdown needs (filetype, filesize); run may be
left out where there is only one. The first occurrence of a fingerprint in the order of (run, file_seq, chunk_seq) is
what it really costs; every later one is redundant.

First occurrences never gather a fingerprint's rows: chunks are aggregated to (fp, breakdown) before the shuffle, with
the least position as a struct, and only those few rows meet in a window over fp. A chunk that most files hold (a block
of zeros, say) is therefore a handful of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dupstrata.functions.scalars import percent, size_class, temporal_real, temporal_total

ALL = "ALL"


#: Chunks of one file are fewer than this.
FILE_ROOM = 10**10


def position(chunks: DataFrame) -> Column:
    """A chunk's place in the order of the trace. Without runs it is one number, so its minimum is kept by a hash aggregate."""
    if "run" in chunks.columns:
        return F.struct("run", "file_seq", "chunk_seq")
    return F.col("file_seq").cast("decimal(19,0)") * F.lit(FILE_ROOM).cast("decimal(11,0)") + F.col("chunk_seq").cast("decimal(19,0)")


def first_cost(chunks: DataFrame, keys: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """One row for each (within, fp, keys): total bytes, n (occurrences), and real, the bytes of fp's first occurrence if it is here."""
    grouped = chunks.groupBy(*within, "fp", *keys).agg(F.sum("chunksize").alias("total"), F.count(F.lit(1)).alias("n"), F.min(position(chunks)).alias("_at"), F.max("chunksize").alias("size"))
    first = F.min("_at").over(Window.partitionBy(*within, "fp"))
    return grouped.withColumn("real", F.when(F.col("_at") == first, F.col("size")).otherwise(F.lit(0).cast("long"))).drop("_at")


def by_key_and_all(rows: DataFrame, key: str, keep: Sequence[str] = (), measures: Sequence[str] = ("real", "total")) -> DataFrame:
    """Sums of the measures by key, and over everything as `ALL`, from one aggregate with two grouping sets."""
    sets = [[*keep, key], [*keep]]
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in (*keep, key)]).agg(*[F.sum(m).alias(m) for m in measures], F.grouping(key).alias("_all"))
    return out.select(*keep, F.when(F.col("_all") == 1, F.lit(ALL)).otherwise(F.col(key).cast("string")).alias("key"), *measures)


def ordered(rows: DataFrame, by: str = "key") -> DataFrame:
    """Rows of a breakdown as reports list them: types ascending, size classes and sizes by their number, `ALL` last; or, by "total" (or another measure), the largest first, ties by key."""
    if by != "key":
        return rows.orderBy(F.desc(by), *[c for c in ("key",) if c in rows.columns])
    number = F.expr("try_cast(key as bigint)")
    return rows.orderBy(*[c for c in ("gen",) if c in rows.columns], F.col("key") == ALL, number.asc_nulls_last(), "key")


def internal(chunks: DataFrame, key: str) -> DataFrame:
    """Redundancy inside a data set by file type or size class: key, real, total, dedup_pct."""
    got = by_key_and_all(first_cost(chunks, [key]), key)
    return got.select("key", "real", "total", F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.round(100.0 * (1.0 - F.col("real") / F.col("total")), 6)).alias("dedup_pct"))


def simple_totals(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """total_bytes, unique_bytes, redundant_bytes, redundancy_pct, n_chunks, mean_chunk."""
    c = first_cost(chunks, []).agg(F.coalesce(F.sum("real"), F.lit(0)).alias("unique_bytes"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks"))
    f = files.agg(F.coalesce(F.sum("filesize"), F.lit(0)).alias("total_bytes"))
    red = F.col("total_bytes") - F.col("unique_bytes")
    return f.crossJoin(c).select("total_bytes", "unique_bytes", red.alias("redundant_bytes"), F.round(percent(red, "total_bytes"), 6).alias("redundancy_pct"), "n_chunks", F.when(F.col("n_chunks") > 0, F.floor(F.col("total_bytes") / F.col("n_chunks"))).otherwise(F.lit(0)).cast("long").alias("mean_chunk"))


def simple_per_file(files: DataFrame, chunks: DataFrame, strict: bool = False) -> DataFrame:
    """file_seq, filesize, chunk_bytes, redundancy, redundancy_pct, patch, illegal; empty files stay. strict: raise on an illegal file."""
    first = chunks.groupBy("fp").agg(F.min(F.struct(position(chunks).alias("at"), F.col("file_seq"), F.col("chunksize"))).alias("first"))  # a fingerprint in every file is a row a task
    new = first.groupBy(F.col("first.file_seq").alias("file_seq")).agg(F.sum("first.chunksize").alias("new_bytes"))
    cost = chunks.groupBy("file_seq").agg(F.sum("chunksize").alias("chunk_bytes")).join(new, "file_seq", "left")
    both = files.select("file_seq", "filesize").join(cost, "file_seq", "left").na.fill(0, ["chunk_bytes", "new_bytes"])
    red = F.col("filesize") - F.col("new_bytes")
    both = both.withColumn("redundancy", red).withColumn("patch", F.col("chunk_bytes") - red)
    illegal = (F.col("patch") < 0) | (F.col("redundancy") < 0) | (F.col("filesize") != F.col("chunk_bytes"))
    if strict:
        illegal = F.when(illegal, F.raise_error(F.concat(F.lit("chunks do not add up to file "), F.col("file_seq")))).otherwise(F.lit(False)).cast("boolean")
    return both.select("file_seq", "filesize", "chunk_bytes", "redundancy", F.round(percent("redundancy", "chunk_bytes"), 6).alias("redundancy_pct"), "patch", illegal.alias("illegal"))


def temporal(chunks: DataFrame, key: str, gen: str = "gen") -> DataFrame:
    """Redundancy of each generation against the one just before it: gen, key, real, total, patch_pct.

    real: chunks that the preceding generation lacks, at their first occurrence in this one. Any number of generations
    in one plan: a generation's fingerprints are shifted by one and joined out.
    """
    cost = first_cost(chunks, [key], [gen])
    before = chunks.select((F.col(gen) + 1).alias(gen), "fp").distinct().withColumn("_known", F.lit(True))
    cost = cost.join(before, [gen, "fp"], "left").withColumn("real", F.when(F.col("_known").isNotNull(), F.lit(0).cast("long")).otherwise(F.col("real")))
    got = by_key_and_all(cost, key, [gen])
    return got.select(gen, "key", "real", "total", F.when(F.col("total") == 0, F.lit(100.0)).otherwise(F.round(100.0 * F.col("real") / F.col("total"), 6)).alias("patch_pct"))


def distinct_fingerprints(chunks: DataFrame) -> DataFrame:
    return chunks.select("fp").distinct()


def unseen(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """Chunks whose fingerprint the index lacks."""
    return chunks.join(index.select("fp").distinct(), "fp", "left_anti")


def zero_chunks(chunks: DataFrame, zero_fps: Sequence[str]) -> DataFrame:
    """total_bytes, n_chunks, zero_bytes, n_zero, zero_pct (null for no bytes)."""
    zero = F.col("fp").isin(list(zero_fps))
    got = chunks.agg(F.coalesce(F.sum("chunksize"), F.lit(0)).alias("total_bytes"), F.count(F.lit(1)).alias("n_chunks"), F.coalesce(F.sum(F.when(zero, F.col("chunksize"))), F.lit(0)).alias("zero_bytes"), F.count_if(zero).alias("n_zero"))
    return got.withColumn("zero_pct", F.when(F.col("total_bytes") > 0, F.round(100.0 * F.col("zero_bytes") / F.col("total_bytes"), 6)))


def file_fingerprints(chunks: DataFrame, keys: Sequence[str] = ("file_seq",), kind: str = "MD5") -> DataFrame:
    """keys, fingerprint: a hash over the file's chunk digests in order. A group is one file's digests."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_seq", "fp"))), lambda x: x["fp"])
    joined = F.unhex(F.array_join(parts, ""))
    return chunks.groupBy(*keys).agg((F.md5(joined) if kind == "MD5" else F.sha1(joined)).alias("fingerprint"))


def full_file(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Whole-file redundancy: n_files, total_bytes, duplicate_files, duplicate_bytes, duplicate_pct."""
    marked = files.select("file_seq", "filesize").join(file_fingerprints(chunks), "file_seq", "left")
    empty = F.md5(F.lit("").cast("binary"))
    groups = marked.groupBy(F.coalesce("fingerprint", empty).alias("fingerprint"), "filesize").agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(Window.partitionBy("fingerprint").orderBy("filesize")) == 1
    again = F.col("n") - F.when(first, F.lit(1)).otherwise(F.lit(0))
    got = groups.withColumn("again", again).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_files"), F.coalesce(F.sum(F.col("n") * F.col("filesize")), F.lit(0)).alias("total_bytes"), F.coalesce(F.sum("again"), F.lit(0)).alias("duplicate_files"), F.coalesce(F.sum(F.col("again") * F.col("filesize")), F.lit(0)).alias("duplicate_bytes"))
    return got.withColumn("duplicate_pct", F.round(percent("duplicate_bytes", "total_bytes"), 6))


# Attribution of shared chunks by reference counts: to the modal type, or in proportion.


def fast_totals(chunks: DataFrame) -> DataFrame:
    """Totals without attribution: real_mib, total_mib, n_fps."""
    per = chunks.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.avg("chunksize").alias("size"))
    return per.agg((F.sum("size") / 1048576.0).alias("real_mib"), (F.sum(F.col("n") * F.col("size")) / 1048576.0).alias("total_mib"), F.count(F.lit(1)).alias("n_fps")).select(F.round("real_mib", 6).alias("real_mib"), F.round("total_mib", 6).alias("total_mib"), "n_fps")


def mode_attributed(chunks: DataFrame, key: str) -> DataFrame:
    """key, real_mib, total_mib: every fingerprint counts for its modal key."""
    per = chunks.groupBy("fp", key).agg(F.count(F.lit(1)).alias("n"), F.sum("chunksize").alias("bytes"))
    whole = Window.partitionBy("fp")
    ranked = per.withColumn("_n", F.sum("n").over(whole)).withColumn("_b", F.sum("bytes").over(whole)).withColumn("_r", F.row_number().over(whole.orderBy(F.desc("n"), key)))
    one = ranked.where("_r = 1").select(F.col(key), (F.col("_b") / F.col("_n")).alias("real"), F.col("_b").cast("double").alias("total"))
    return _mib(by_key_and_all(one, key))


def _mib(rows: DataFrame) -> DataFrame:
    return rows.select(*[c for c in rows.columns if c not in ("real", "total")], F.round(F.col("real") / 1048576.0, 6).alias("real_mib"), F.round(F.col("total") / 1048576.0, 6).alias("total_mib"))


def chunk_data(chunks: DataFrame) -> DataFrame:
    """fp, filelength (size class), filetype, usage_count, chunksize: the table that the proportional analyses reuse."""
    return chunks.groupBy("fp", size_class("filesize").alias("filelength"), "filetype").agg(F.count(F.lit(1)).alias("usage_count"), F.max("chunksize").alias("chunksize"))


def exact_attributed(data: DataFrame, key: str) -> DataFrame:
    """key, real_mib, total_mib from chunk_data: a fingerprint's bytes are shared out in proportion to references."""
    share = F.col("chunksize") / F.sum("usage_count").over(Window.partitionBy("fp"))
    per = data.select(key, (F.col("usage_count") * share).alias("real"), (F.col("usage_count") * F.col("chunksize")).cast("double").alias("total"))
    return _mib(by_key_and_all(per, key))


def union_fast(runs: Sequence[DataFrame]) -> DataFrame:
    """Totals over several prepared runs as one: real_mib, total_mib, n_fps."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    per = out.groupBy("fp").agg(F.sum("usage_count").alias("n"), F.max("chunksize").alias("size"))
    return per.agg(F.round(F.sum("size") / 1048576.0, 6).alias("real_mib"), F.round(F.sum(F.col("n") * F.col("size")) / 1048576.0, 6).alias("total_mib"), F.count(F.lit(1)).alias("n_fps"))


def file_redundancy(files: DataFrame, fingerprints: DataFrame, key: str) -> DataFrame:
    """key, real_mib, total_mib of whole files: each fingerprint counts for its modal key."""
    joined = files.join(fingerprints, "file_seq").select("fingerprint", key, "filesize")
    return mode_attributed(joined.select(F.col("fingerprint").alias("fp"), key, F.col("filesize").alias("chunksize")), key)


def temporal_modal(chunks: DataFrame, key: str, old_gen: int, new_gen: int, gen: str = "gen") -> DataFrame:
    """key, real_mib, total_mib of one generation against another: fingerprints of the new one count for their modal key there."""
    new = chunks.where(F.col(gen) == new_gen).groupBy("fp", key).agg(F.count(F.lit(1)).alias("n"), F.sum("chunksize").alias("bytes"))
    whole = Window.partitionBy("fp")
    one = new.withColumn("new", F.sum("n").over(whole)).withColumn("size", F.sum("bytes").over(whole) / F.sum("n").over(whole)).withColumn("_r", F.row_number().over(whole.orderBy(F.desc("n"), key))).where("_r = 1")
    old = chunks.where(F.col(gen) == old_gen).groupBy("fp").agg(F.count(F.lit(1)).alias("old"))
    both = one.join(old, "fp", "left").select(key, temporal_total("new", "size").alias("total"), temporal_real("old", "size").cast("double").alias("real"))
    return _mib(by_key_and_all(both, key))
