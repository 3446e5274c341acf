"""Delimited text and Parquet: what imports and exports read and write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS, FILES4 = "filename string, fp string, chunksize int", "filename string, filesize long, filetype string, label string"
FILES3, FINGERPRINTS = "filename string, filesize long, filetype string", "filename string, fingerprint string"
CHUNK_DATA = "fp string, filelength long, filetype string, usage_count long, chunksize int"
NO_LABEL = "-"


def read_tsv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Tab-separated text without quoting; globs, several paths and bzip2 as Spark takes them."""
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").option("escape", "").csv(path)


def write_tsv(df: DataFrame, path: str, compression: str | None = None) -> None:
    w = df.write.option("sep", "\t").option("quote", "").option("escapeQuotes", "false").option("emptyValue", "")
    (w.option("compression", compression) if compression else w).csv(path)


def export_import(files: DataFrame, chunks: DataFrame, path: str, compression: str | None = None) -> None:
    """files, chunks (fp in base64) and file-fingerprint below path, as tab-separated text; chunks need file_seq, chunk_seq, filename, fp in hex."""
    from dupstrata.operators.redundancy import file_fingerprints

    write_tsv(files.select("filename", "filesize", "filetype", F.coalesce("label", F.lit(NO_LABEL))), f"{path}/files", compression)
    write_tsv(chunks.select("filename", F.base64(F.unhex("fp")), "chunksize"), f"{path}/chunks", compression)
    marks = file_fingerprints(chunks, ["file_seq", "filename"])
    write_tsv(marks.select("filename", F.base64(F.unhex("fingerprint"))), f"{path}/file-fingerprint", compression)


def _quoted(c: str) -> Column:
    return F.concat(F.lit('"'), F.coalesce(F.col(c), F.lit("")), F.lit('"'))


def database_chunk_lines(chunks: DataFrame) -> DataFrame:
    """`"name"|"fp in base64"|size`."""
    return chunks.select(F.concat_ws("|", _quoted("filename"), F.concat(F.lit('"'), F.base64(F.unhex("fp")), F.lit('"')), F.col("chunksize").cast("string")).alias("value"))


def database_file_lines(files: DataFrame) -> DataFrame:
    """`"name"|size|"type"|"label"`; no label is empty."""
    return files.select(F.concat_ws("|", _quoted("filename"), F.col("filesize").cast("string"), _quoted("filetype"), _quoted("label")).alias("value"))


def breakdown_lines(rows: DataFrame) -> DataFrame:
    """`"key";real;total` of a redundancy breakdown."""
    return rows.select(F.concat_ws(";", _quoted("key"), F.col("real").cast("string"), F.col("total").cast("string")).alias("value"))


def detail_lines(by_type: DataFrame, by_class: DataFrame) -> DataFrame:
    """`title;count;capacity` for types, an empty line, then size classes: value, in the order of part and place."""
    line = F.concat_ws(";", "key", F.col("n").cast("string"), F.col("total").cast("string")).alias("value")
    a = by_type.select(F.lit(0).alias("part"), F.col("key").alias("place"), line)
    gap = by_type.sparkSession.range(1).select(F.lit(1).alias("part"), F.lit("").alias("place"), F.lit("").alias("value"))
    b = by_class.select(F.lit(2).alias("part"), F.lpad("key", 20, "0").alias("place"), line)
    return a.unionAll(gap).unionAll(b).orderBy("part", "place")


def write_lines(lines: DataFrame, path: str, rows_per_file: int = 0) -> None:
    w = lines.select("value").write
    (w.option("maxRecordsPerFile", rows_per_file) if rows_per_file else w).text(path)


def listing(spark: SparkSession, path: str, default_label: str | None = None) -> DataFrame:
    """path, label from lines `path` or `path=label`; the last `=` counts."""
    return parse_listing(spark.read.text(path), "value", default_label)


def parse_listing(lines: DataFrame, column: str, default_label: str | None = None) -> DataFrame:
    c = F.col(column)
    has = c.contains("=")
    return lines.select(F.when(has, F.regexp_extract(c, r"^(.*)=([^=]*)$", 1)).otherwise(c).alias("path"), F.when(has, F.regexp_extract(c, r"^(.*)=([^=]*)$", 2)).otherwise(F.lit(default_label)).alias("label"))
