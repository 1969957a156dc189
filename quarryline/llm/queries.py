"""The registered queries of the text operators, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import digest, hyperdim, lines, media, oddsketch, packing, pieces, ppm, quotes, triecounts
from .common import tokenizer_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stored as grey maps and read back."""
    return media.text_images(_table(spark, sf_dir, "documents"))


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction by partial matching, learnt from nine tenths."""
    return ppm.held_out_scores(_table(spark, sf_dir, "documents"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge-type piece encoding and decoding."""
    return pieces.encode_documents(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op4_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in reply order without quotes."""
    out = quotes.conversations(_table(spark, sf_dir, "conversations"))
    return out.withColumn("n_chars", F.length("text").cast("long")).withColumn("text_sha256", F.sha2("text", 256)).drop("text")


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated runs of lines deleted."""
    return lines.line_report(_table(spark, sf_dir, "documents"))


def op6_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartile bucket digests of texts and edited texts."""
    return digest.fingerprints(_table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages by hyperdimensional profiles."""
    return hyperdim.identify(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 2048 ids."""
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates on two-word shingles at a similarity of 0.8."""
    return oddsketch.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts."""
    return triecounts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_media, op2_ppm, op3_pieces, op4_quotes, op5_lines, op6_digest, op7_language, op8_packing, op9_near, op10_tokens)}

#: Queries that DuckDB can express over the same tables.
ORACLES: dict[str, str] = {}
