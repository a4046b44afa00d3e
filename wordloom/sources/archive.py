"""JSON Lines archive of papers with nested segments, and files as a source.

The first line is the format's; then there is one for each paper, by id.  A paper's facts and a segment's numbers are written
even where they are null; a segment's part, rects and tables only where it has them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest
from ..plans import schemas

FORMAT = "wordloom-jsonl/1"
_SEGMENT = ("kind", "number", "number_end", "page", "text", "part", "rects", "tables")


def records(exams: DataFrame, segments: DataFrame) -> DataFrame:
    """One row for each paper, segments in order; absent parts, rects and tables are left out of the JSON."""
    have = set(segments.columns)
    absent = {"rects": "array<array<double>>", "tables": "array<array<array<string>>>", "part": "string"}
    cell = {c: F.col(c) if c in have else F.lit(None).cast(absent[c]) for c in _SEGMENT}
    if "rects" in have and "struct" in dict(segments.dtypes)["rects"]:
        cell["rects"] = F.transform("rects", lambda r: F.array(*[r[c].cast("double") for c in ("page", "x0", "y0", "x1", "y1")]))
    nested = segments.groupBy("exam_id").agg(F.array_sort(F.collect_list(F.struct("seg_no" if "seg_no" in have else "segment_id", *[v.alias(k) for k, v in cell.items()]))).alias("s"))
    fields = [f.split()[0] for f in schemas.ARCHIVE.split(", ")[:10]]
    cols = [F.array_join("scanned_pages", ",").alias(c) if c == "scanned_pages" and dict(exams.dtypes).get(c, "").startswith("array") else (F.col(c) if c in exams.columns else F.lit(None).cast("string")).alias(c) for c in fields]
    out = exams.join(nested, "exam_id", "left")
    return out.select(*cols, F.transform(F.coalesce("s", F.array()), lambda x: F.struct(*[x[c].alias(c) for c in _SEGMENT])).alias("segments"))


def lines(exams: DataFrame, segments: DataFrame) -> DataFrame:
    """The archive's lines of papers, as ``value``, by exam_id."""
    rows = records(exams, segments).join(exams.select("sha1", "exam_id"), "sha1")
    whole = lambda *cols: F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    inner = lambda json: F.substr(json, F.lit(2), F.length(json) - 2)

    def segment(x):
        have = F.struct(*[F.when(cond, x[c]).alias(c) for c, cond in (("part", x["part"] != ""), ("rects", F.size(x["rects"]) > 0), ("tables", x["tables"].isNotNull()))])
        more = inner(F.to_json(have))
        return F.concat(F.lit("{"), inner(whole(*[x[c].alias(c) for c in _SEGMENT[:5]])), F.when(more != "", F.concat(F.lit(","), more)).otherwise(""), F.lit("}"))

    nested = F.array_join(F.transform("segments", segment), ",")
    head = inner(whole(*[c for c in rows.columns if c not in ("segments", "exam_id")]))
    return rows.orderBy("exam_id").select(F.concat(F.lit("{"), head, F.lit(',"segments":['), nested, F.lit("]}")).alias("value"))


def export(exams: DataFrame, segments: DataFrame, path: str, compression: str = "gzip") -> None:
    """Writes an archive; the format's line comes first."""
    mark = exams.sparkSession.range(0, 1, 1, 1).select(F.to_json(F.struct(F.lit(FORMAT).alias("format"))).alias("value"))
    mark.union(lines(exams, segments)).write.mode("overwrite").text(path, compression=compression)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Papers of an archive; header and blank lines have no sha1, and another format is refused.

    A field that cannot be read (say rects that are no array) is null, and its paper stays.
    """
    rows = spark.read.schema(schemas.ARCHIVE + ", format string").json(path)
    odd = rows.where(F.col("format").isNotNull() & ~F.col("format").endswith(FORMAT.split("-")[-1])).select("format").head()
    if odd:
        raise schemas.SchemaMismatch(f"unknown archive format {odd[0]}")
    return rows.where("sha1 is not null").drop("format")


def batch(found: DataFrame) -> ingest.Batch:
    """An archive's papers as a batch to add to a corpus; one of each content."""
    found = found.dropDuplicates(["sha1"])
    own = {"exam_id": F.xxhash64("sha1"), "ingested_at": F.current_timestamp()}
    rects = F.transform("rects", lambda r: F.struct(r[0].cast("int").alias("page"), *[r[i + 1].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]))
    segs = segments(found).withColumns({"exam_id": F.xxhash64("sha1"), "segment_id": F.xxhash64("sha1", "seg_no"), "rects": rects}).drop("sha1")
    exams = papers(found).withColumns(own)
    return ingest.Batch(exams, segs, exams.select("sha1", "filename", *ingest.FIELDS, "n_questions", F.array().cast("array<string>").alias("warnings"), F.lit(None).cast("string").alias("error")))


def papers(archive: DataFrame) -> DataFrame:
    pages = F.transform(F.filter(F.split(F.coalesce("scanned_pages", F.lit("")), ","), lambda x: x != ""), lambda x: x.cast("int"))
    return archive.withColumns({"scanned_pages": pages, "path": F.coalesce("path", "filename"), "parser": F.coalesce("parser", F.lit(0)), "n_questions": F.size(F.filter("segments", lambda s: s["kind"] == "question")).cast("long")}).drop("segments")


def segments(archive: DataFrame) -> DataFrame:
    return archive.select("sha1", F.posexplode("segments").alias("seg_no", "s")).select("sha1", "seg_no", "s.*")


PAPERS = "*.[pP][dD][fF]"
FILES = "path string, modificationTime timestamp, length long, content binary"


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """Paper files below a folder with their content hash; empty ones are still being written."""
    return hashed(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", PAPERS).load(folder))


def hashed(files: DataFrame) -> DataFrame:
    return files.where("length > 0").select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "modificationTime", F.sha1("content").alias("sha1"), "content")
