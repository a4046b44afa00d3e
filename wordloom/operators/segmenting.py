"""Questions and passages from ordered lines.

A line's head (a question's number, a passage's range, the name of an elective part) is read by column expressions.  Only
heads, a few for each page, go through a fold that decides which of them open a segment; texts never leave the JVM.
The fold numbers the sections of a paper (0 is what comes before any part) and keeps their names apart from the
segments, so a name that arrives late, or a boundary that turns out to lie earlier, rewrites nothing.

Numbers must go on: a question's is at most REACH above the last one, a passage's first REACH + 1.  Otherwise
a number is taken only if a section begins there, that is within REACH of the number that the first part followed:
after the header of another part, or, without a header, soon after a cover line.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import BLANK

# The elective parts, the marks in the heads of lines, what cover lines say, and how far numbers reach.
PARTS = ("확률과 통계", "미적분", "기하", "화법과 작문", "언어와 매체")
NUMBER_MARKS = ".．"
RANGE_MARKS = "~～∼-–"
BRACKETS = ("(（", ")）")
COVER_ENDS = "문제지"
COVER_BEGINS = ("제", "교시")
REACH, NEAR_COVER = 3, 8

HEAD = "at int, what string, number int, number_end int, name string, cover int"
START = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("number", T.IntegerType()), T.StructField("number_end", T.IntegerType()), T.StructField("part", T.StringType())])
_B = f"[{BLANK}]*"
_DIGITS = ("０１２３４５６７８９", "0123456789")


def stripped(line: Column) -> Column:
    return F.regexp_replace(line, f"^{_B}|{_B}$", "")


def question_number(line: Column) -> Column:
    """The number before a line's first mark, unless what follows makes it a decimal or a date.

    Text may follow the mark at once.  A digit may only follow after a blank, and not if it begins another marked number.
    """
    part = lambda i: F.regexp_extract(line, f"(?s)^([0-9]{{1,2}}){_B}[{NUMBER_MARKS}]({_B})(.*)$", i)
    rest = part(3)
    text_follows = ~rest.rlike("^[0-9]")
    figure_follows = (part(2) != "") & ~rest.rlike(f"^[0-9]{{1,2}}{_B}[{NUMBER_MARKS}]")
    return F.when(text_follows | figure_follows, F.nullif(part(1), F.lit("")).cast("int"))


def passage_range(line: Column) -> Column:
    """struct(a, b) of a line that begins with a bracketed range of numbers."""
    marks = "".join("\\" + c for c in RANGE_MARKS)
    end = lambda i: F.nullif(F.regexp_extract(line, rf"^\[{_B}([0-9]{{1,2}}){_B}[{marks}]{_B}([0-9]{{1,2}}){_B}\]", i), F.lit("")).cast("int")
    return F.struct(end(1).alias("a"), end(2).alias("b"))


def part_name(line: Column) -> Column:
    """The elective part that a line in round brackets names, blanks squeezed."""
    bare = stripped(line)
    inner = F.regexp_replace(stripped(F.substr(bare, F.lit(2), F.greatest(F.length(bare) - 2, F.lit(0)))), f"[{BLANK}]+", " ")
    closed = F.left(bare, F.lit(1)).isin(*BRACKETS[0]) & F.right(bare, F.lit(1)).isin(*BRACKETS[1]) & (F.length(bare) > 2)
    return F.when(closed & inner.isin(*PARTS, *(p.replace(" ", "") for p in PARTS)), inner)


def is_cover(line: Column) -> Column:
    bare = stripped(line)
    return bare.endswith(COVER_ENDS) | bare.rlike(f"^{COVER_BEGINS[0]}{_B}[0-9]{_B}{COVER_BEGINS[1]}")


@dataclass
class Paper:
    """What the heads read so far say.  ``name`` of a section is None until its header comes."""

    last: int = 0
    border: int = 0  # the number that the first part followed; sections start again after it
    section: int = 0
    turned: bool = False  # a header has opened the section, and no number yet
    names: list = field(default_factory=lambda: [None])
    claims: list = field(default_factory=list)  # (k, n, section): numbers from n on among the first k starts belong to it
    starts: list = field(default_factory=list)  # (at, kind, a, b, section)

    def open(self, at: int, kind: str, a: int | None, b: int | None) -> None:
        self.starts.append((at, kind, a, b, self.section))

    def enter(self, name: str | None) -> None:
        self.names.append(name)
        self.section = len(self.names) - 1

    def header(self, at: int, name: str) -> None:
        here = self.names[self.section]
        if not self.last or name == here:
            return
        if self.section and here is None:
            self.names[self.section] = name
            self.claims.append((len(self.starts), self.border + 1, self.section))
            return
        if self.section:
            self.last, self.turned = self.border, True
        else:
            self.border = self.last
        self.enter(name)
        self.open(at, "front", None, None)

    def restarts(self, n: int, cover: int) -> bool:
        """Whether a section begins with this number, without its header if none has opened it."""
        if not self.section or abs(n - self.border) > REACH:
            return False
        silent = not self.turned
        if silent and (self.names[self.section] is None or n > self.last or cover > NEAR_COVER):
            return False
        if n <= self.border:  # the common questions ended earlier: these were the part's before this one
            self.claims.append((len(self.starts), n, self.section if silent else self.section - 1))
            self.border = n - 1
        if silent:
            self.enter(None)
        self.last = n - 1
        return True

    def numbered(self, at: int, kind: str, a: int, b: int, cover: int) -> None:
        question = kind == "question"
        if a > b or not (0 < a - self.last <= REACH + (not question) or self.restarts(a, cover)):
            return
        self.open(at, kind, a, b)
        self.turned = False
        if question:
            self.last = a

    def resolved(self) -> list[dict]:
        def part(i, number, section):
            """The section's name or, while it has none, that of the first claim to the number."""
            named = [self.names[section], *(self.names[s] for k, n, s in self.claims if i < k and number >= n)]
            return next((x for x in named if x is not None), None)

        return [{"at": at, "kind": kind, "number": a, "number_end": b, "part": None if a is None else part(i, a, s)} for i, (at, kind, a, b, s) in enumerate(self.starts)]


def fold(heads: Iterable[dict]) -> list[dict]:
    """The segments that a paper's heads open, in order."""
    paper = Paper()
    for h in heads:
        if h["what"] == "part":
            paper.header(h["at"], h["name"])
        else:
            paper.numbered(h["at"], h["what"], h["number"], h["number_end"], h["cover"])
    return paper.resolved()


@F.pandas_udf(T.ArrayType(START))
def _starts(heads: pd.Series) -> pd.Series:
    return pd.Series([fold(h) for h in heads])


def heads(lines: DataFrame) -> DataFrame:
    """lines with ``at`` (their place in the paper) and ``head``, a struct (HEAD) or null."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    line = F.translate(F.coalesce("text", F.lit("")), *_DIGITS)
    placed = lines.withColumns({"at": F.row_number().over(order), "_q": question_number(line), "_r": passage_range(line), "_p": part_name(line), "_c": is_cover(line)})
    since = F.col("at") - F.coalesce(F.max(F.when(F.col("_c"), F.col("at"))).over(order), F.lit(-(1 << 20)))
    what = F.when(F.col("_p").isNotNull(), "part").when(F.col("_r.b").isNotNull(), "passage").when(F.col("_q").isNotNull(), "question")
    head = F.struct("at", what.alias("what"), F.coalesce("_r.a", "_q").alias("number"), F.coalesce("_r.b", "_q").alias("number_end"), F.col("_p").alias("name"), since.cast("int").alias("cover"))
    return placed.withColumn("head", F.when(what.isNotNull(), head)).drop("_q", "_r", "_p", "_c")


def segment(lines: DataFrame) -> DataFrame:
    """lines(doc_id, line_no, page, text) -> doc_id, seg_no, kind, number, number_end, page, part, text, line_nos.

    Segments come in order, each with its lines; lines before the first head, and those after the header of a part, are front
    matter; segments without text are left out.  A null text is an empty line.
    """
    read = heads(lines.select("doc_id", "line_no", "page", "text"))
    papers = read.where("head is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list("head")).alias("heads"))
    starts = papers.select("doc_id", F.map_from_entries(F.transform(_starts("heads"), lambda s: F.struct(s["at"], s))).alias("starts"))
    order = Window.partitionBy("doc_id").orderBy("at")
    opened = F.try_element_at("starts", F.col("at"))
    own = read.drop("head").join(starts, "doc_id", "left").withColumn("start", opened).drop("starts").withColumn("ord", F.count("start").over(order))
    rows = F.array_sort(F.collect_list(F.struct("at", "line_no", "page", F.coalesce("text", F.lit("")).alias("text"), "start")))
    joined = F.array_join(F.transform("rows", lambda r: r["text"]), "\n")
    first = F.get("rows", F.lit(0))
    out = own.groupBy("doc_id", "ord").agg(rows.alias("rows")).select(
        "doc_id", "ord", F.coalesce(first["start"]["kind"], F.lit("front")).alias("kind"), *[first["start"][c].alias(c) for c in ("number", "number_end")], first["page"].cast("int").alias("page"), first["start"]["part"].alias("part"),
        stripped(joined).alias("text"), F.transform("rows", lambda r: r["line_no"].cast("int")).alias("line_nos"),
    ).where("text <> ''")
    return out.withColumn("seg_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1).select("doc_id", "seg_no", "kind", "number", "number_end", "page", "part", "text", "line_nos")
