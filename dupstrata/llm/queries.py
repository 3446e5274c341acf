"""The corpus queries: each applies one operator, with production parameters, to the whole table it is meant for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dupstrata.llm import chat_format, language_id, mixing, ngram_join, piece_codec, quality_rules, secret_scan, toxicity, url_filters, vector_search
from dupstrata.llm.common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    shard = F.when(F.size("shards") > 0, F.element_at("shards", 1)["shard"]).otherwise(F.lit(-1))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", shard.alias("shard"))


#: The tokenizer file; another place is given by this parameter.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digest(piece_codec.encode(table(spark, sf_dir, "documents"), PIECE_MODEL, n=3))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.summarize(chat_format.rotate(table(spark, sf_dir, "conversations")))


def op4_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the ledger of this table, which a second run finds complete."""
    return secret_scan.scan_with_ledger(spark, table(spark, sf_dir, "documents"), secret_scan.ledger_of(spark, f"{sf_dir}/documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), n=3, num=9, den=10)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mixing, op2_piece_codec, op3_chat_format, op4_vector_search, op5_secret_scan, op6_language_id, op7_ngram_join, op8_quality_rules, op9_url_filters, op10_toxicity)
}

ORACLE = {"op1_mixing": mixing.ORACLE, "op3_chat_format": chat_format.ORACLE, "op4_vector_search": vector_search.ORACLE, "op5_secret_scan": secret_scan.ORACLE, "op9_url_filters": url_filters.ORACLE}
