"""From raw documents to packed sequences.

``STAGES`` are applied in order to the table ``documents``; each one's result is
written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import hyperdim, lines, oddsketch, packing
from quarryline.llm.common import save, tokenizer_path

#: A text whose best cosine with any language is lower isn't text of these languages.
LEAST_SCORE = 0.05
#: The same for a text of ``ENOUGH`` letters or more; a shorter one scores too much by chance to ask more of it.
CLEAR_SCORE, ENOUGH = 0.165, 40


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; those without letters or unlike any language go.

    A text of fewer than ``ENOUGH`` letters goes by the lower mark only, so some
    short ones in other languages stay.
    """
    protos = hyperdim.prototypes(docs, F.lit(True))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    found = hyperdim.predict(docs.select(row.alias("row")), protos, [F.col("row")], text="row.text")
    found = found.where((F.col("lang_pred") != hyperdim.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    letters = F.length(F.regexp_replace(F.col("row.text"), r"\P{L}+", ""))
    found = found.where((F.col("score") >= CLEAR_SCORE) | (letters < ENOUGH))
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines cut out."""
    return lines.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, on five-word shingles at 0.8.

    Documents without a word, and those with a null doc_id, stay.  Of rows that
    share the kept doc_id all stay.
    """
    found = oddsketch.near_duplicates(docs, k=5)
    gone = found.where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of at most 2048 ids."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("pack", pack)]

#: Language profiles and id packing can't be said in SQL; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
