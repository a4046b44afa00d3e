"""Concordance views over the generic tables: documents as papers by (source, language), conversations as papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXAM_NAMES = ("6월 모평", "9월 모평", "수능", "3월 학평", "10월 학평")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _exam_columns() -> dict:
    n = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    letter = lambda i: F.ascii(F.substring("lang", i, 1)) - 97
    return {"exam_id": (n * 676 + letter(1) * 26 + letter(2)).cast("long"), "subject": F.col("lang"), "year": 2015 + n % 12, "exam": F.get(F.array(*map(F.lit, EXAM_NAMES)), n % 5)}


def segments_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    number = (F.col("doc_id") % 45 + 1).cast("int")
    return d.select(F.col("doc_id").alias("segment_id"), _exam_columns()["exam_id"].alias("exam_id"), F.lit("question").alias("kind"), number.alias("number"), number.alias("number_end"), F.lit(1).alias("page"), F.lit(None).cast("string").alias("part"), "text")


def exams_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = _exam_columns()
    rows = documents(spark, sf_dir).select(*[c.alias(k) for k, c in cols.items()])
    return rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("n_questions")).withColumns({"grade": F.lit("고3"), "n_pages": F.lit(4).cast("long")})


def segments_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("role") == "user", "question").when(F.col("role") == "assistant", "passage").otherwise("front")
    number = F.col("turn").cast("int")
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("segment_id"), F.col("conv_id").alias("exam_id"), kind.alias("kind"), number.alias("number"), number.alias("number_end"), F.lit(1).alias("page"), F.lit(None).cast("string").alias("part"), "text")


KEY_SQL = """translate(text, '‐‑‒–—―−‘’“”～〜 ' || chr(10) || chr(65532), '-------''''""~~')"""
SQL = f"""c AS (SELECT *, CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) AS n FROM documents),
ex AS (SELECT *, CAST(n * 676 + (ascii(lang[1]) - 97) * 26 + ascii(lang[2]) - 97 AS BIGINT) AS exam_id, lang AS subject, 2015 + n % 12 AS year, list_extract({list(EXAM_NAMES)}, n % 5 + 1) AS exam, CAST(doc_id % 45 + 1 AS INT) AS number, doc_id AS segment_id,
  (2015 + n % 12) || '학년도 ' || CASE WHEN n % 5 > 2 THEN '고3 ' ELSE '' END || list_extract({list(EXAM_NAMES)}, n % 5 + 1) || ' · ' || lang || ' · ' || (doc_id % 45 + 1) || '번' AS source_label,
  {KEY_SQL} AS key FROM c),
exams AS (SELECT exam_id, subject, year, exam, count(*) AS n_questions FROM ex GROUP BY ALL)"""
