"""File and chunk tables made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dupstrata.functions.scalars import size_class
from dupstrata.operators.chunking import Digest, fixed_chunks

CHUNK = 1024
FILE_COLUMNS = ("file_seq", "filename", "filetype", "filesize", "label")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: the text's UTF-8 bytes are the body, the language is the type, the source the label."""
    d = read(spark, sf_dir, "documents").where("text is not null")
    body = F.col("text").cast("binary")
    name = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.coalesce("lang", F.lit("")))
    return d.select(F.col("doc_id").alias("file_seq"), name.alias("filename"), F.col("lang").alias("filetype"), F.octet_length(body).cast("long").alias("filesize"), F.col("source").alias("label"), body.alias("body"))


def document_chunks(spark: SparkSession, sf_dir: str, size: int = CHUNK, digest: Digest = Digest()) -> DataFrame:
    return fixed_chunks(document_files(spark, sf_dir), "body", size, FILE_COLUMNS, digest).withColumn("size_class", size_class("filesize"))


def order_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files and their lines as chunks: a part is a fingerprint and its size gives the chunk's size."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_size")
    order = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.year("o_orderdate").alias("gen"))
    c = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(order, F.col("l_orderkey") == F.col("o_orderkey"))
    return c.select(F.col("l_orderkey").alias("file_seq"), F.col("l_linenumber").cast("long").alias("chunk_seq"), F.col("o_orderpriority").alias("filetype"), "gen", (F.col("p_size").cast("long") * 1024).alias("chunksize"), F.md5(F.col("l_partkey").cast("string").cast("binary")).alias("fp"))
