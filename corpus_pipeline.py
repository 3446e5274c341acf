"""A training-data pipeline over the document table: five stages, each one corpus operator over all that is left.

language ID drops documents without a letter of any language or with a score under LEAST_SURE; the near-duplicate join
keeps one row, of the smallest id, of each group of texts alike in four fifths of their five-word shingles; secret scans drop
documents with a finding of any kind; mixing repeats documents to the sources' target weights; the last stage encodes every
copy into pieces and decodes it again. Null texts go in the first stage. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dupstrata.llm import language_id, mixing, ngram_join, piece_codec, secret_scan
from dupstrata.llm.common import cut, drop, held_out, table
from dupstrata.llm.queries import PIECE_MODEL

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SURE = 0.2

#: Bytes of text that the codec handles together and words that it remembers: fewer than by default, as the earlier stages leave their executors less memory.
CODEC_SLICE, CODEC_MEMORY = 1 << 20, 100_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts and texts without a letter go, as do those of a low score; repeated rows and ids stay, an empty table stays empty, very long texts are read whole."""
    model = language_id.fit(docs, ~held_out("doc_id", language_id.HELD_PARTS, language_id.HELD_PART))
    said = language_id.classify(docs, model, keep=COLUMNS[1:])
    return said.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SURE)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows go by a key of id and text, as an id may be null or stand for several texts; rows of one key are copies.

    Null and wordless texts link with nothing: each such row stays. Of equal rows one stays, that of the smallest other
    columns; of a group, the row of the smallest id, null ids last. Texts move once at most: rows with a marked key (one
    that goes, or that several rows have) are told from the others by a join that sends the keys to all tasks while they
    are few.
    """
    docs = docs.select(*COLUMNS, F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).alias("row_key"))
    groups = ngram_join.join(docs, n=5, num=4, den=5, id_col="row_key").withColumnRenamed("doc_id", "row_key")
    names = docs.select("row_key", "doc_id").distinct()
    keys = cut(groups.groupBy("row_key", "component_id").agg(F.count(F.lit(1)).alias("n"), F.max("n_shingles").alias("n_shingles")).join(names, "row_key"), "row-keys")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key"))
    kept = keys.groupBy("component_id").agg(first.alias("first")).select(F.col("first.row_key").alias("row_key"), F.lit(True).alias("stays"))
    marked = keys.join(kept, "row_key", "left").where("stays is null or (n > 1 and n_shingles > 0)")
    marked = cut(marked.select("row_key", F.coalesce("stays", F.lit(False)).alias("stays")), "marked-rows")
    told = docs.join(F.broadcast(marked) if marked.count() <= ngram_join.BROADCAST_IDS else marked, "row_key", "left")
    others = [c for c in COLUMNS if c != "text"]
    left = told.where("stays is null").select(*COLUMNS)
    if marked.where("stays").isEmpty():
        return left
    once = told.where("stays").groupBy("row_key").agg(F.min(F.struct(*others)).alias("row"), F.first("text").alias("text"))
    return left.unionByName(once.select("row.*", "text"))


def drop_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """By the table's ledger, which is extended by what it lacks. Null and empty texts hold no secret and stay; copies and repeated rows go or stay together."""
    found = cut(secret_scan.found_blobs(spark, docs, secret_scan.ledger_of(spark, f"{sf_dir}/documents")), "secret-blobs")
    few = F.broadcast(found) if found.count() <= secret_scan.BROADCAST_BLOBS else found
    address = F.unhex(F.sha2(F.coalesce(F.col("text").cast("binary"), F.lit(b"")), 256))
    return docs.select(*COLUMNS, address.alias("blob")).join(few, "blob", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy; the one document of a source that is taken in part stays whole if half of it is taken. Wordless texts have nothing to take and go; a null source is a source of its own."""
    taken = mixing.copies(mixing.mix(docs, keep=COLUMNS))
    return taken.where(2 * F.col("words") >= F.col("size")).select("kept.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each row: its N best segmentations by lattice. Null texts have null ids, very long ones are encoded whole, repeated rows stay."""
    keep = ("doc_id", "lang", "source")
    encoded = piece_codec.encode(docs, PIECE_MODEL, n=3, keep=keep, slice_bytes=CODEC_SLICE, memory=CODEC_MEMORY)
    return piece_codec.digest(encoded, keep)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("secret scans", drop_secrets),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: Language ID is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, "pipeline")
            drop(before)
    return docs
