"""The rebuild of a corpus from its files as one change: read, repair, replace, read again, prune.

Each step sees what the one before leaves, and the store gets one entry at the end, so a failure in between changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import meta
from . import ingest, maintenance


@dataclass
class Rebuild:
    """What comes, what goes (exam_id, whole), and a log with a row for each paper or file that is concerned."""

    exams: DataFrame
    segments: DataFrame
    gone: DataFrame
    log: DataFrame


def to_read(exams: DataFrame, files: DataFrame, target: str | None = None, parser: int = ingest.PARSER) -> DataFrame:
    """Files that the corpus doesn't hold, that an older parser read, or that the target names."""
    new = ingest.fresh(files, exams)
    old = files.join(maintenance.stale(maintenance.present(exams, files), parser).select("sha1"), "sha1", "left_semi")
    asked = maintenance.targets(files, target) if target else files.limit(0)
    return new.unionByName(old).unionByName(asked).dropDuplicates(["path"])


def named(files: DataFrame) -> DataFrame:
    """What file names say of each content: sha1, path, filename and facts."""
    facts = files.groupBy("sha1").agg(F.min_by("path", "path").alias("path"), F.min_by("filename", "path").alias("filename")).withColumn("f", meta.from_filename(F.col("filename")))
    return facts.select("sha1", "path", "filename", F.coalesce("f.year", meta.directory_year(F.col("path"))).alias("year"), *[F.col(f"f.{c}").alias(c) for c in ("exam", "grade", "subject", "explicit")])


def rebuild(exams: DataFrame, files: DataFrame, batch: ingest.Batch, prune: bool = False, hold: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Rebuild:
    """The change that brings a corpus up to its files(path, filename, sha1): ``batch`` has the papers that were read.

    Papers that were read take the place of their content's; names fill what is unknown and pinned subjects win; papers
    without questions go where another of their year, subject and sitting has some, and so do those whose file is
    gone, if they have no questions or ``prune`` says so.  ``hold`` keeps a table that several steps read.
    """
    read = ingest.change(exams, batch, force=True)
    before = exams.join(read.gone, "exam_id", "left_anti")
    after = before.withColumn("_read", F.lit(False)).unionByName(read.exams.select(*exams.columns).withColumn("_read", F.lit(True)))
    after = hold(after)
    repaired = maintenance.repair(after, hold(named(files)))
    old = after.select("exam_id", *[F.col(c).alias(f"_{c}") for c in ("year", "exam", "grade", "subject", "path", "filename")])
    changed = ~F.lit(True)
    for c in ("year", "exam", "grade", "subject", "path", "filename"):
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    repaired = hold(repaired.join(old, "exam_id").withColumn("_changed", changed).select(*exams.columns, "_read", "_changed"))
    replaced = maintenance.superseded(repaired).select("exam_id", F.lit("superseded").alias("status"))
    lost = maintenance.vanished(repaired.join(replaced, "exam_id", "left_anti"), files, prune).select("exam_id", F.lit("pruned").alias("status"))
    going = hold(replaced.unionByName(lost))
    staying = repaired.join(going, "exam_id", "left_anti")
    new, fixed = staying.where("_read"), staying.where("not _read and _changed")
    gone = going.select("exam_id", F.lit(True).alias("whole")).unionByName(read.gone.select("exam_id", F.lit(True).alias("whole"))).unionByName(fixed.select("exam_id", F.lit(False).alias("whole")))
    log = read.log.select("status", "filename", "error").unionByName(fixed.select(F.lit("repaired").alias("status"), "filename", F.lit(None).cast("string").alias("error")))
    log = log.unionByName(repaired.join(going, "exam_id").select("status", "filename", F.lit(None).cast("string").alias("error")))
    return Rebuild(new.unionByName(fixed).select(*exams.columns), read.segments.join(new.select("exam_id"), "exam_id", "left_semi"), gone, log)
