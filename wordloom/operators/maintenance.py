"""Keyed changes of a stored corpus as pure DataFrame plans; a caller writes the result as a new snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(exams: DataFrame, incoming: DataFrame, force: bool = False, key: str = "sha1") -> DataFrame:
    """Both tables with one row for each known key: the stored one, or with ``force`` the incoming one."""
    first, second = (incoming, exams) if force else (exams, incoming)
    fresh = incoming.dropDuplicates([key])
    first, second = (fresh, exams) if force else (exams, fresh)
    return first.unionByName(second.join(first.select(key), key, "left_anti"), allowMissingColumns=True)


def ingest_status(exams: DataFrame, incoming: DataFrame, force: bool = False) -> DataFrame:
    known = exams.select("sha1", F.lit(True).alias("_known"))
    return incoming.select("sha1").distinct().join(known, "sha1", "left").select("sha1", F.when(F.col("_known").isNull(), "added").otherwise("replaced" if force else "skipped").alias("status"))


def delete(rows: DataFrame, gone: DataFrame, key: str = "exam_id") -> DataFrame:
    return rows.join(gone.select(key), key, "left_anti")


def superseded(exams: DataFrame) -> DataFrame:
    """Papers without questions for which another paper of the same year, subject and (null-safe) exam has some.

    What is asked of a year, subject and exam is whether any paper has questions, one row for each, so one that is very
    common costs no more: a paper without questions is never the one that has them.
    """
    asked = exams.where("n_questions > 0").select("year", "subject", F.struct("exam").alias("_e")).distinct()
    empty = exams.where("n_questions = 0").withColumn("_e", F.struct("exam"))
    return empty.join(asked, ["year", "subject", "_e"], "left_semi").drop("_e")


def present(exams: DataFrame, files: DataFrame) -> DataFrame:
    """Papers whose file is still there."""
    return exams.join(files.select("path").distinct(), "path", "left_semi")


def targets(files: DataFrame, target: str) -> DataFrame:
    """Files to read again: those in a folder of this name, or whose own name begins with it."""
    parts = F.split("path", "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return files.where(F.array_contains(folders, target) | F.element_at(parts, -1).startswith(target))


def vanished(exams: DataFrame, files: DataFrame, enabled: bool = False) -> DataFrame:
    """Papers whose file is gone; those with questions only if pruning is enabled."""
    gone = exams.join(files.select("path"), "path", "left_anti")
    return gone if enabled else gone.where(F.coalesce("n_questions", F.lit(0)) == 0)


def stale(exams: DataFrame, version: int) -> DataFrame:
    return exams.where(F.coalesce("parser", F.lit(0)) < version)


def repair(exams: DataFrame, files: DataFrame) -> DataFrame:
    """Fill null fields from file names (matched by sha1); an explicit subject wins over the stored one.

    files: sha1, path, filename, year, exam, grade, subject, explicit.
    """
    f = files.dropDuplicates(["sha1"]).select("sha1", *[F.col(c).alias(f"_{c}") for c in ("path", "filename", "year", "exam", "grade", "subject", "explicit")])
    out = exams.join(f, "sha1", "left")
    for c in ("year", "exam", "grade"):
        out = out.withColumn(c, F.coalesce(c, f"_{c}"))
    subject = F.when(F.col("_explicit") & F.col("_subject").isNotNull(), F.col("_subject")).otherwise(F.coalesce("subject", "_subject"))
    out = out.withColumns({"subject": subject, "path": F.coalesce("_path", "path"), "filename": F.coalesce("_filename", "filename")})
    return out.select(*exams.columns)


def relocation(files: DataFrame) -> DataFrame:
    """What to do with a newcomer of a resident's name: drop it, put it in the resident's place, or leave both.

    files: name, new_sha1, old_sha1, new_questions, old_questions (old_* null where nothing is there).
    """
    action = F.when(F.col("old_sha1").isNull(), "move").when(F.col("old_sha1") == F.col("new_sha1"), "drop").when((F.col("old_questions") == 0) & (F.col("new_questions") > 0), "swap").otherwise("leave")
    return files.withColumn("action", action)
