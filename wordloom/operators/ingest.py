"""From decoded files to papers and segments: layout, segmentation, metadata, tables, warnings, and what was done.

Everything of a batch runs in parallel over documents; text moves only by doc_id.  A paper's id is a hash of its content
hash and a segment's one of that and its place, so ingesting the same file again gives the same ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import meta, text
from . import layout, maintenance, segmenting

PARSER = 2
BLOCKS = "doc_id string, page int, block_no int, x0 double, y0 double, x1 double, y1 double, text string, width double, height double, error string"
COVER_CHARS = 1500
BROKEN_SHARE, FEW_QUESTIONS, LISTED = 0.02, 1.5, 15
FIELDS = ("year", "exam", "grade", "subject")


@dataclass
class Batch:
    """Papers and segments of a batch, and a log with a row for each of its files."""

    exams: DataFrame
    segments: DataFrame
    log: DataFrame
    #: Lets go of what is held for the batch.
    release: Callable[[], object] = lambda: None


def decode(files: DataFrame, reader: Callable[[bytes], Iterable[tuple]]) -> DataFrame:
    """Positioned blocks of files(sha1, content) by a reader of one file's bytes.

    The reader gives (page, block_no, x0, y0, x1, y1, text, width, height), with text None for a page without blocks.  A file
    that it fails on gives one row with the error, and fails nothing else.
    """

    def run(batches):
        names = [f.split()[0] for f in BLOCKS.split(", ")]
        for batch in batches:
            for sha1, content in zip(batch["sha1"], batch["content"], strict=True):
                try:
                    rows = [(sha1, *b, None) for b in reader(bytes(content))]
                except Exception as e:  # noqa: BLE001 - one file must not fail the others; the log has it
                    rows = [(sha1, *[None] * 9, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=names)

    return files.select("sha1", "content").mapInPandas(run, BLOCKS)


def warnings(numbers: Column, n_questions: Column, n_pages: Column, scanned: Column, n_chars: Column, n_broken: Column) -> Column:
    """What looks wrong with a paper, as codes with their figures."""
    n = F.size(numbers)
    missing = F.when(n > 0, F.array_except(F.sequence(F.lit(1), F.array_max(numbers)), numbers))
    listed = lambda a: F.concat_ws(",", F.slice(a, 1, LISTED).cast("array<string>"))
    found = [
        F.when((n_chars > 0) & (n_broken > BROKEN_SHARE * n_chars), F.concat(F.lit("unreadable:"), n_broken.cast("string"), F.lit("/"), n_chars.cast("string"))),
        F.when(n == 0, F.lit("no_questions")),
        F.when(F.size(missing) > 0, F.concat(F.lit("missing:"), listed(missing), F.when(F.size(missing) > LISTED, ",…").otherwise(""))),
        F.when(F.size(scanned) > 0, F.concat(F.lit("scanned_pages:"), F.concat_ws(",", scanned.cast("array<string>")))),
        F.when((n > 0) & (n_pages > 0) & (n_questions < FEW_QUESTIONS * n_pages), F.lit("few_questions")),
    ]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def _metadata(cover: Column, name: Column, path: Column, overrides: dict) -> dict[str, Column]:
    """Given values come first, then a subject that the file name pins, the cover, the file name, the folder."""
    front, file = meta.from_cover(cover), meta.from_filename(name)
    kinds = {"year": "int"}
    empty = {f: F.lit(None).cast(kinds.get(f, "string")) for f in FIELDS}
    row = lambda **have: F.struct(*[(empty | have)[f].alias(f) for f in FIELDS])
    given = row(**{f: F.lit(v).cast(kinds.get(f, "string")) for f, v in overrides.items() if v})
    pinned = row(subject=F.when(file["explicit"], file["subject"]))
    return {f: meta.merge(f, given, pinned, front, file, row(year=meta.directory_year(path))) for f in FIELDS}


def ingest(files: DataFrame, blocks: DataFrame, tables: DataFrame | None = None, drawings: DataFrame | None = None, overrides: dict | None = None) -> Batch:
    """files(sha1, path, filename) and their blocks (BLOCKS, doc_id = sha1) as papers and segments.

    tables(doc_id, page, table_no, x0, y0, x1, y1, page_area, rows) and drawings(doc_id, page, x0, x1) are optional.
    """
    files = files.groupBy("sha1").agg(F.min_by("path", "path").alias("path"), F.min_by("filename", "path").alias("filename"))
    bad = blocks.where("error is not null").groupBy("doc_id").agg(F.first("error").alias("error"))
    sound = blocks.where("error is null").drop("error", "height")
    ordered = layout.reading_order(sound)
    cleaned = layout.lines(ordered, layout.column_bounds(ordered, drawings))
    stats = layout.page_stats(ordered, cleaned, sound)
    kept = layout.strip_running_heads(cleaned).withColumn("line_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "pos")))
    found = segmenting.segment(kept)

    placed = found.select("doc_id", "seg_no", F.explode("line_nos").alias("line_no")).join(kept, ["doc_id", "line_no"])
    rects = layout.regions(placed)
    segs = found.drop("line_nos").join(rects, ["doc_id", "seg_no"], "left")
    if tables is not None:
        good = layout.accepted_tables(tables)
        owned = layout.attach_tables(good, rects).join(good.select("doc_id", "table_no", "rows"), ["doc_id", "table_no"]).groupBy("doc_id", "seg_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("table_no", "rows"))), lambda x: x["rows"]).alias("tables"))
        segs = segs.join(owned, ["doc_id", "seg_no"], "left")
    else:
        segs = segs.withColumn("tables", F.lit(None).cast("array<array<array<string>>>"))

    whole = kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("_text"))
    per = found.groupBy("doc_id").agg(F.min_by(F.when(F.col("kind") == "front", F.col("text")), F.when(F.col("kind") == "front", F.col("seg_no"))).alias("_front"), F.array_sort(F.collect_set(F.when(F.col("kind") == "question", F.col("number")))).alias("_numbers"), F.count_if(F.col("kind") == "question").alias("n_questions"))
    papers = files.join(stats.withColumnRenamed("doc_id", "sha1"), "sha1").join(whole.withColumnRenamed("doc_id", "sha1"), "sha1", "left").join(per.withColumnRenamed("doc_id", "sha1"), "sha1", "left")
    cover = F.concat(F.substring(F.coalesce("_front", F.lit("")), 1, COVER_CHARS), F.lit("\n"), F.coalesce("_text", F.lit("")))
    numbers = F.coalesce("_numbers", F.array().cast("array<int>"))
    papers = papers.withColumns(_metadata(cover, F.col("filename"), F.col("path"), overrides or {}) | {"exam_id": F.xxhash64("sha1"), "parser": F.lit(PARSER), "n_questions": F.coalesce("n_questions", F.lit(0)).cast("long"), "ingested_at": F.current_timestamp(), "warnings": warnings(numbers, F.coalesce("n_questions", F.lit(0)), F.col("n_pages"), F.col("scanned_pages"), F.col("n_chars"), F.col("n_broken"))})
    exams = papers.select("exam_id", "sha1", "path", "filename", *FIELDS, "n_pages", "n_questions", "parser", "scanned_pages", "ingested_at")
    segments = segs.select(F.xxhash64("doc_id", "seg_no").alias("segment_id"), F.xxhash64("doc_id").alias("exam_id"), "seg_no", "kind", "number", "number_end", "page", "part", "rects", "tables", "text")
    log = files.join(papers.select("sha1", "exam_id", *FIELDS, "n_pages", "n_questions", "warnings"), "sha1", "left").join(bad.withColumnRenamed("doc_id", "sha1"), "sha1", "left")
    log = log.withColumn("error", F.when(F.col("exam_id").isNull(), F.coalesce("error", F.lit("no pages"))))
    return Batch(exams, segments, log)


def fresh(files: DataFrame, exams: DataFrame) -> DataFrame:
    """Files whose content the corpus does not hold; only these need decoding unless all are forced."""
    return files.join(exams.select("sha1"), "sha1", "left_anti")


@dataclass
class Change:
    """What a batch does to a corpus: papers and segments that come, papers (exam_id) whose old rows go, and a log."""

    exams: DataFrame
    segments: DataFrame
    gone: DataFrame | None
    log: DataFrame


def change(exams: DataFrame, batch: Batch, force: bool = False) -> Change:
    """A known paper stays as it is, or with ``force`` is replaced with all its segments."""
    known = exams.select("sha1").distinct()
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("_known").isNull(), "added").otherwise("replaced" if force else "skipped")
    log = batch.log.join(known.withColumn("_known", F.lit(True)), "sha1", "left").withColumn("status", status).drop("_known")
    if force:
        return Change(batch.exams, batch.segments, exams.join(batch.exams.select("sha1"), "sha1", "left_semi").select("exam_id"), log)
    new = batch.exams.join(known, "sha1", "left_anti")
    return Change(new, batch.segments.join(new.select("exam_id"), "exam_id", "left_semi"), None, log)


def add(exams: DataFrame, segments: DataFrame, batch: Batch, force: bool = False) -> Batch:
    """The whole corpus with a batch."""
    done = change(exams, batch, force)
    if done.gone is not None:
        exams, segments = (maintenance.delete(rows, done.gone) for rows in (exams, segments))
    return Batch(exams.unionByName(done.exams, allowMissingColumns=True), segments.unionByName(done.segments, allowMissingColumns=True), done.log)
