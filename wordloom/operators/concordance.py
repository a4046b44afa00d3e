"""Wording queries over segments: search, variants, compare, and corpus statistics.

Segments and exams are DataFrames; every result is one.  Filters are literal predicates, so they reach the scan; a
join picks its side by size, never by a hint.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import meta, text

KINDS = ("question", "passage")


def corpus(segments: DataFrame, exams: DataFrame) -> DataFrame:
    return segments.join(exams, "exam_id")


def paper_predicates(subject: str | None = None, year: int | None = None, exam: str | None = None) -> Column:
    """What the filters ask of a paper."""
    found = [F.lit(True)]
    if subject:
        found.append(F.col("subject").isin(*meta.subject_aliases(subject)))
    if year:
        found.append(F.col("year") == year)
    if exam:
        found.append(F.col("exam").ilike(f"%{exam}%"))
    return reduce(Column.__and__, found)


def predicates(subject: str | None = None, year: int | None = None, exam: str | None = None, kinds: tuple[str, ...] = KINDS) -> Column:
    return F.col("kind").isin(*kinds) & paper_predicates(subject, year, exam)


def hits(segments: DataFrame, exams: DataFrame, query: str, **filters) -> DataFrame:
    """Segments that hold the wording, with their papers and a source label."""
    label = meta.segment_label(F.col("kind"), F.col("part"), F.col("number"), F.col("number_end"))
    source = meta.source_label(F.col("year"), F.col("exam"), F.col("grade"), F.col("subject"), label)
    return corpus(segments.where(text.held("text", query)), exams).where(predicates(**filters)).withColumn("source", source)


def matches(segments: DataFrame, exams: DataFrame, query: str, **filters) -> DataFrame:
    """Hits with ``surface``, the array of their occurrences as written."""
    return hits(segments, exams, query, **filters).withColumn("surface", text.surface_forms("text", query))


HIT_ORDER = (F.desc_nulls_last, "year"), (F.asc_nulls_first, "subject"), (F.asc_nulls_first, "number"), (F.asc, "segment_id")


def hit_order() -> list[Column]:
    return [f(c) for f, c in HIT_ORDER]


def search(segments: DataFrame, exams: DataFrame, query: str, limit: int | None = 50, width: int = 60, **filters) -> DataFrame:
    """Hits, newest first; limited after the exact check, so a short query never gives fewer than there are.

    Spellings and snippets are made of the hits that are left.
    """
    found = hits(segments, exams, query, **filters)
    found = found.orderBy(*hit_order()).limit(limit) if limit else found
    surface = text.surface_forms("text", query)
    return found.select("segment_id", "exam_id", "source", "subject", "year", "exam", "number", "page", F.size(surface).cast("long").alias("matches"), text.snippet(F.col("text"), query, width).alias("snippet"))


def _decided(form: Column) -> Column:
    return ~form.rlike("[\\n" + text.OBJECT + "]")


def variants(hits: DataFrame) -> DataFrame:
    """form, n and up to three sources of each decidable spelling; order by n desc, form to list them."""
    rows = hits.select("source", F.struct((-F.coalesce("year", F.lit(-1))).alias("y"), F.coalesce("subject", F.lit("")).alias("s"), F.coalesce("number", F.lit(-1)).alias("n"), F.col("segment_id").alias("i")).alias("at"), F.explode("surface").alias("raw"))
    forms = rows.where(_decided(F.col("raw"))).withColumn("form", F.regexp_replace("raw", "[ \\t]+", " "))
    by_source = forms.groupBy("form", "source").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    # Ranked and summed by one window: the forms' rows are shuffled once.
    form = Window.partitionBy("form")
    ranked = by_source.withColumns({"total": F.sum("n").over(form), "r": F.row_number().over(form.orderBy("at"))}).where("r <= 3")
    first = F.array_sort(F.collect_list(F.struct("at", "source")))
    return ranked.groupBy("form").agg(F.first("total").alias("n"), first.alias("f")).select("form", "n", F.transform("f", lambda x: x["source"]).alias("sources"))


def with_share(forms: DataFrame) -> DataFrame:
    """Forms with the total and the share of each in per cent by the three rules in use: to the nearest, ties to even; down; ties up."""
    whole = F.col("n") * 100
    shares = {"percent": F.bround(whole / F.col("total"), 0), "percent_down": F.floor(whole / F.col("total")), "percent_up": F.floor(whole / F.col("total") + 0.5)}
    every = forms.join(forms.agg(F.sum("n").alias("total")), F.lit(True))  # one row on the right
    return every.withColumns({k: v.cast("int") for k, v in shares.items()})


def occurrence_totals(hits: DataFrame) -> DataFrame:
    """One row: hits, occurrences, decidable and undecidable ones."""
    undecided = F.size(F.filter("surface", lambda f: ~_decided(f)))
    total = F.size("surface")
    return hits.agg(F.count(F.lit(1)).alias("hits"), F.coalesce(F.sum(total), F.lit(0)).cast("long").alias("occurrences"), F.coalesce(F.sum(total - undecided), F.lit(0)).cast("long").alias("decided"), F.coalesce(F.sum(undecided), F.lit(0)).cast("long").alias("undecided"))


def compare(segments: DataFrame, exams: DataFrame, queries: list[str], **filters) -> DataFrame:
    """A row for each wording with its hits and occurrences, in one pass over the segments."""
    wanted = list(enumerate(queries))
    rows = corpus(segments, exams).where(predicates(**filters))
    per = F.array(*[F.when(text.held("text", q), F.struct(F.lit(i).alias("ord"), F.lit(q).alias("query"), text.surface_forms("text", q).alias("surface"))) for i, q in wanted])
    found = rows.select(F.explode(F.filter(per, lambda x: x.isNotNull())).alias("m"), F.col("subject")).select("m.*", "subject")
    undecided = F.size(F.filter("surface", lambda f: ~_decided(f)))
    sums = found.groupBy("ord").agg(F.count(F.lit(1)).alias("hits"), F.sum(F.size("surface") - undecided).cast("long").alias("total"), F.sum(undecided).cast("long").alias("undecided"))
    names = segments.sparkSession.createDataFrame(wanted, "ord int, query string")
    return names.join(sums, "ord", "left").select("ord", "query", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("hits", "total", "undecided")])


def with_dominant(compared: DataFrame) -> DataFrame:
    """Compared wordings with all their occurrences, undecidable ones too, and whether one alone has the most."""
    every = compared.withColumn("occurrences", F.col("total") + F.col("undecided"))
    top = every.groupBy("occurrences").agg(F.count(F.lit(1)).alias("_n")).agg(F.max_by("_n", "occurrences").alias("_n"), F.max("occurrences").alias("_top"))
    dominant = (F.col("occurrences") == F.col("_top")) & (F.col("_n") == 1) & (F.col("_top") > 0)
    return every.join(top, F.lit(True)).withColumn("dominant", dominant).drop("_n", "_top")  # one row on the right


def compare_by_subject(segments: DataFrame, exams: DataFrame, queries: list[str], **filters) -> DataFrame:
    """Hits and occurrences of each wording in each subject that has any."""
    rows = corpus(segments, exams).where(predicates(**filters))
    per = F.array(*[F.when(text.held("text", q), F.struct(F.lit(q).alias("query"), F.size(text.surface_forms("text", q)).alias("n"))) for q in queries])
    found = rows.select("subject", F.explode(F.filter(per, lambda x: x.isNotNull())).alias("m"))
    return found.groupBy(F.coalesce("subject", F.lit("(미상)")).alias("subject"), F.col("m.query").alias("query")).agg(F.count(F.lit(1)).alias("hits"), F.sum("m.n").cast("long").alias("occurrences"))


def terms_of(line: str) -> list[str]:
    """The terms of a query line: cut at commas, slashes and ``vs``; five at most, as the interface has it."""
    parts = [t.strip() for t in re.split(r"[,，/]|\s+vs\s+", line, flags=re.I) if t.strip()]
    return parts[:5] if len(parts) > 1 else [line.strip()]


def multi_term_spans(segments: DataFrame, exams: DataFrame, line: str, **filters) -> DataFrame:
    """Segments that hold any of the terms, with the spans of all of them in one array, by start (then by term)."""
    terms = terms_of(line)
    rows = corpus(segments, exams).where(predicates(**filters)).where(reduce(Column.__or__, [text.held("text", t) for t in terms], F.lit(False)))
    of_term = lambda i: lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("term"), x["end"].alias("end"))
    marked = [F.transform(text.spans("text", t), of_term(i)) for i, t in enumerate(terms)]
    return rows.select("segment_id", F.array_sort(F.concat(*marked)).alias("spans"))


def multi_term(segments: DataFrame, exams: DataFrame, line: str, **filters) -> DataFrame:
    """Segments that hold any of the terms (cut at commas, slashes and ``vs``; five at most), with terms and occurrences."""
    terms = terms_of(line)
    rows = corpus(segments, exams).where(predicates(**filters))
    counts = F.array(*[F.size(text.surface_forms("text", t)) for t in terms])
    out = rows.where(reduce(Column.__or__, [text.held("text", t) for t in terms], F.lit(False)))
    return out.select("segment_id", F.size(F.filter(counts, lambda n: n > 0)).cast("long").alias("n_terms"), F.aggregate(counts, F.lit(0), lambda a, n: a + n).cast("long").alias("occurrences"))


def with_image(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows (path, rects) with has_image: there are places on the page, if none in number, and the file is still there."""
    there = files.select("path").distinct().withColumn("_there", F.lit(True))
    return rows.join(there, "path", "left").withColumn("has_image", F.col("rects").isNotNull() & F.col("_there").isNotNull()).drop("_there")


def show(segments: DataFrame, exams: DataFrame, segment_id: int) -> DataFrame:
    return corpus(segments.where(F.col("segment_id") == segment_id), exams)


def subjects(exams: DataFrame) -> DataFrame:
    return exams.groupBy(F.coalesce("subject", F.lit("(미상)")).alias("subject")).agg(F.count(F.lit(1)).alias("n_exams"), F.coalesce(F.sum("n_questions"), F.lit(0)).cast("long").alias("n_questions"))


def stats(segments: DataFrame, exams: DataFrame) -> DataFrame:
    papers = exams.agg(F.count(F.lit(1)).alias("exams"), F.coalesce(F.sum("n_pages"), F.lit(0)).cast("long").alias("pages"))
    asked = segments.where("kind = 'question'").agg(F.count(F.lit(1)).alias("questions"))
    return papers.join(asked, F.lit(True))  # one row on either side


def coverage(exams: DataFrame) -> DataFrame:
    """Questions by (year, exam, subject); a cell that is absent has no paper, a 0 has one without text."""
    known = exams.where("subject is not null")
    return known.groupBy(F.coalesce("year", F.lit(0)).cast("int").alias("year"), F.coalesce("exam", F.lit("?")).alias("exam"), "subject").agg(F.coalesce(F.sum("n_questions"), F.lit(0)).cast("long").alias("n_questions"))


def coverage_pivot(exams: DataFrame, subjects_: list[str]) -> DataFrame:
    return coverage(exams).groupBy("year", "exam").pivot("subject", subjects_).sum("n_questions")


def missing_numbers(segments: DataFrame) -> DataFrame:
    """For each paper the numbers under its largest that no question has."""
    seen = segments.where("kind = 'question'").groupBy("exam_id").agg(F.collect_set(F.col("number").cast("int")).alias("s"))
    return seen.select("exam_id", F.array_sort(F.array_except(F.sequence(F.lit(1), F.array_max("s")), F.col("s"))).alias("missing"))
