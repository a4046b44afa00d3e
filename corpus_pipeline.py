"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next
one's docs.  All stages but the last return the columns of documents; rows with a null doc_id go no further
than packing, which has no place for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import common, decontam, kernels, langid, linetemplates, neardup, packing

#: Workers serve all stages in turn, so packing holds fewer words, and smaller slices, here than by itself, and keeps neither
#: them nor its tokenizer when a task ends.
PACKING_CACHE_WORDS = 400_000


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language that the labelled ones teach; texts that are null or have no letter go."""
    return langid.keep_known(docs, langid.fit(docs))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines of recurring templates; n_chars follows.  No row goes."""
    lines, dropped = "_pipeline_lines", "_pipeline_dropped"
    out = linetemplates.drop_recurring_lines(docs, counts=(lines, dropped))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more.  Null ids and empty texts stay."""
    return neardup.drop_near_duplicates(docs, **neardup.STAGE).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.  Null ids and texts stay."""
    return decontam.decontaminate(docs, common.table(spark, sf_dir, "benchmark")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens, with their token ids: what training reads.  Null ids go."""
    return packing.pack(docs, with_ids=True, cache_words=PACKING_CACHE_WORDS, slice_bytes=kernels.STAGE_BYTES, keep=False)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Learned models and a space-filling curve have no SQL form; tests/llm/test_plain.py holds each stage, and all of them in
#: turn, against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
