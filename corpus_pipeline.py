"""The corpus pipeline: its stages, each over all that the one before it kept.

All stages take rows of `documents`: null ids and sources, null and empty texts, ties, repeated rows and empty tables have
the results that each stage states. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.llm.bpe import bpe_encode
from cairnflow.llm.common import broadcast_if_small, saved
from cairnflow.llm.line_dedup import deduped_lines
from cairnflow.llm.mixing import mixed_rows
from cairnflow.llm.near_dups import near_unique
from cairnflow.llm.quality import quality_rules

RANKS = "byte_bpe_50k.tiktoken"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules reject go; other rows of the same id, or of none, stay unless their text is the same.

    Null and empty texts have too few words and go. Rows at the threshold stay, repeated rows fare alike, and without
    labels only the base rules judge.
    """
    judged = quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), digest=True)
    gone = judged.where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest")).distinct()
    gone = broadcast_if_small(saved(gone, "pipeline-gone"))
    digest = F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col("gone_id")) & (digest == F.col("gone_digest")), "left_anti")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document of smaller id holds too go; a document stays, even if no line does.

    Rows that share an id are one document, and null ids are one, the largest. Null texts become empty; n_chars follows.
    """
    rows, _ = deduped_lines(docs)
    return rows.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id stays.

    Rows that repeat its id and text stay with it; of a group in which all ids are null all rows stay. Texts without words
    are equal to each other, and else near nothing.
    """
    return near_unique(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated so that each source has its share of words.

    The null source is a source. Rows equal in id and text go together, and texts without words as their hash says. At a
    threshold the row is taken if that brings its source nearer to its target.
    """
    return mixed_rows(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's token ids, and digests of these and of the text they decode to; null texts have none. Rows repeat as they come."""
    coded = bpe_encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, decode=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("bpe encoding", encoding_stage),
]
#: SQL expresses neither the similarity join nor the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of `sf_dir`; each stage's rows are written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs, "stage-" + name.replace(" ", "-"))
    return docs
