"""A self-contained HTML page of questions with a search box, and the Markdown report of a corpus."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import meta, text
from ..operators import concordance, layout

MAX_MB = 30.0
# The order of sittings in a report.
SITTINGS = ("6월 모평", "9월 모평", "수능")
_HEAD = """<!doctype html><meta charset="utf-8"><meta name="viewport" content="width=device-width"><title>wordloom</title>
<style>body{font:16px/1.6 sans-serif;max-width:50em;margin:auto;padding:1em}input,select{font:inherit;padding:.3em}article{border-top:1px solid #ccc;white-space:pre-wrap}td{border:1px solid #ccc}</style>
<input id="q" type="search" autofocus><select id="s"><option value=""></option></select><p id="n"></p><main id="out"></main><script>const DATA="""
_TAIL = """;
const FOLDS=DATA.folds, pick=id=>document.getElementById(id);
const keyOf=t=>[...t.normalize("NFC")].filter(c=>!/\\s|\\uFFFC/.test(c)).map(c=>FOLDS[c]||c).join("");
for(const item of DATA.items)item.key=keyOf(item.text);
for(const name of DATA.order)pick("s").append(new Option(`${name} (${DATA.counts[name]})`,name));
function show(){const key=keyOf(pick("q").value),only=pick("s").value;
 const hits=key?DATA.items.filter(x=>(!only||x.subject===only)&&x.key.includes(key)):[];
 pick("n").textContent=hits.length;  // the number of all hits; the first 200 are shown
 pick("out").replaceChildren(...hits.slice(0,200).map(x=>{const a=document.createElement("article"),h=document.createElement("strong");h.textContent=x.src+"\\n";a.append(h,x.text);
  for(const rows of x.tables||[]){const t=document.createElement("table");for(const r of rows){const tr=t.insertRow();for(const c of r)tr.insertCell().textContent=c}a.append(t)}return a}))}
for(const id of ["q","s"])pick(id).addEventListener("input",show);
</script>
"""


def items(segments: DataFrame, exams: DataFrame, **filters) -> DataFrame:
    """What a page holds of each question: id, src, subject, num, part, page, text, tables (padded), rects."""
    rows = concordance.corpus(segments, exams).where(concordance.predicates(kinds=("question",), **filters))
    label = meta.segment_label(F.col("kind"), F.col("part"), F.col("number"), F.col("number_end"))
    src = meta.source_label(F.col("year"), F.col("exam"), F.col("grade"), F.col("subject"), label)
    tables = F.transform("tables", layout.padded) if "tables" in segments.columns else F.lit(None)
    rects = F.transform("rects", lambda r: F.array(r["page"].cast("double"), *[F.round(r[c], 1) for c in ("x0", "y0", "x1", "y1")])) if "rects" in segments.columns else F.lit(None)
    return rows.select(F.col("exam_id"), F.col("segment_id").cast("string").alias("id"), src.alias("src"), "subject", F.col("number").alias("num"), "part", "page", text.readable("text").alias("text"), tables.alias("tables"), rects.alias("rects"))


def papers(segments: DataFrame, exams: DataFrame, **filters) -> DataFrame:
    """The papers that have a question of the page."""
    held = items(segments, exams, **filters).select("exam_id")
    return exams.join(held, "exam_id", "left_semi").select("subject", "year", "exam", "grade", F.col("n_pages").alias("pages"), F.col("n_questions").alias("questions"))


def write(segments: DataFrame, exams: DataFrame, path: str, max_mb: float = MAX_MB, **filters) -> dict:
    """Writes the page to a file of the driver; (questions, papers, bytes).

    Its size is summed on the cluster first and a page over ``max_mb`` is refused: narrow it with filters (subject, year,
    exam).  Rows then come to the driver one partition at a time.
    """
    rows = items(segments, exams, **filters)
    body = F.to_json(F.struct(*[c for c in rows.columns if c != "exam_id"]))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(body)), F.lit(0)).alias("b")).first()
    if total["b"] > max_mb * 2**20:
        raise ValueError(f"{total['n']} questions take {total['b'] / 2**20:.1f} MiB, over {max_mb}")
    counts = {r["subject"]: r["n"] for r in rows.groupBy("subject").agg(F.count(F.lit(1)).alias("n")).orderBy(meta.timetable_order(F.col("subject"))).collect() if r["subject"]}
    shown = [r.asDict() for r in papers(segments, exams, **filters).orderBy("subject", F.desc("year"), "exam").collect()]
    facts = {"papers": shown, "counts": counts, "order": list(counts), "folds": text.FOLDS}
    size = 0
    with open(path, "w", encoding="utf-8") as out:
        for piece in _pieces(rows.orderBy("exam_id", "num", "id").select(body.alias("j")), facts):
            size += len(piece.encode())
            out.write(piece)
    return {"questions": total["n"], "papers": len(shown), "size": size}


def _pieces(rows: DataFrame, facts: dict) -> Iterator[str]:
    safe = lambda s: s.replace("<", "\\u003c")  # noqa: E731 - no text may end the script
    yield _HEAD + safe(json.dumps(facts, ensure_ascii=False))[:-1] + ',"items":['
    for i, r in enumerate(rows.toLocalIterator()):
        yield ("," if i else "") + safe(r["j"])
    yield "]}" + _TAIL


def year_span(exams: DataFrame) -> str:
    """The years of the papers, as one or as first–last; empty if none is known."""
    r = exams.where("year <> 0").agg(F.min("year").alias("a"), F.max("year").alias("b")).first()
    return "" if r["a"] is None else f"{r['a']}" if r["a"] == r["b"] else f"{r['a']}–{r['b']}"


def report(segments: DataFrame, exams: DataFrame, log: DataFrame | None = None, now: datetime | None = None) -> str:
    """Markdown with the time in Korea: what a run did, papers without a subject, coverage (─ is absent, 0 has no text), and totals."""
    time = (now or datetime.now(UTC)).astimezone(timezone(timedelta(hours=9))).strftime("%Y-%m-%d %H:%M")
    out = ["# Corpus report", "", f"{time} KST", ""]
    if log is not None:
        out += ["## This run", ""]
        for r in log.where("status != 'skipped'").orderBy("status", "filename").toLocalIterator():
            if r["status"] == "failed":
                out.append(f"- failed `{r['filename']}`: {r['error']}")
            else:
                out.append(f"- {r['status']} `{r['filename']}`: {r['year'] or '?'} {r['exam'] or '?'} {r['subject'] or '?'}, {r['n_questions']} questions")
                out += [f"  - {w}" for w in r["warnings"] or []]
        out += [f"- {n} {s}" for s, n in sorted((r["status"], r["count"]) for r in log.groupBy("status").count().collect())] + [""]
    unknown = [r["filename"] for r in exams.where("subject is null").select("filename").orderBy("filename").toLocalIterator()]
    if unknown:
        out += ["## Subject unknown", ""] + [f"- `{x}`" for x in unknown] + [""]
    subjects = concordance.subjects(exams)
    rows = subjects.orderBy(F.desc("n_exams"), "subject").collect()
    columns = [r["subject"] for r in subjects.where("subject != '(미상)'").orderBy(meta.timetable_order(F.col("subject"))).collect()]
    if columns:
        place = F.array_position(F.array(*map(F.lit, SITTINGS)), F.col("exam"))
        table = concordance.coverage_pivot(exams, columns).orderBy(F.desc("year"), F.when(place > 0, place).otherwise(len(SITTINGS) + 1), "exam").collect()
        out += ["## Coverage", "", "| | " + " | ".join(columns) + " |", "|-|" + "-:|" * len(columns)]
        out += [f"| {r['year']} {r['exam']} | " + " | ".join("─" if r[c] is None else str(r[c]) for c in columns) + " |" for r in table] + [""]
    s = concordance.stats(segments, exams).first()
    out += ["## Totals", "", "| subject | papers | questions |", "|-|-:|-:|"] + [f"| {r['subject']} | {r['n_exams']} | {r['n_questions']} |" for r in rows]
    return "\n".join([*out, "", f"{s['exams']} papers, {s['pages']} pages, {s['questions']} questions" + (f", {span}" if (span := year_span(exams)) else ""), ""])
