"""Fixed schemas; a version beside a stored corpus guards against reading another layout."""

from __future__ import annotations

SCHEMA_VERSION = 4
EXAMS = "exam_id long, sha1 string, path string, filename string, year int, exam string, grade string, subject string, n_pages long, n_questions long, parser int, scanned_pages array<int>, ingested_at timestamp"
SEGMENTS = "segment_id long, exam_id long, kind string, number int, number_end int, page int, part string, rects array<struct<page:int,x0:double,y0:double,x1:double,y1:double>>, tables array<array<array<string>>>, text string"
LINES = "doc_id long, line_no int, page int, text string, col int, bbox struct<x0:double,y0:double,x1:double,y1:double>, colbox struct<x0:double,x1:double>"
ARCHIVE = "sha1 string, filename string, path string, year int, exam string, grade string, subject string, n_pages long, parser int, scanned_pages string, segments array<struct<kind:string,number:int,number_end:int,page:int,text:string,part:string,rects:array<array<double>>,tables:array<array<array<string>>>>>"


class SchemaMismatch(RuntimeError):
    """A stored corpus has another layout than this version reads."""
