"""The command line: ``python -m wordloom --store FOLDER COMMAND``.

Exit codes: 0 with results, 1 without, 2 if the store has another layout.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import concordance, ingest, layout, maintenance
from .plans.schemas import SchemaMismatch
from .sources import archive, page
from .sources.store import Store
from .streaming import watch


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="wordloom")
    p.add_argument("--store", default="wordloom-store")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: str, filters: bool = False) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        if filters:
            c.add_argument("--subject")
            c.add_argument("--year", type=int)
            c.add_argument("--exam")
        return c

    c = command("search", "query", filters=True)
    c.add_argument("--limit", type=int, default=50)
    c.add_argument("--width", type=int, default=60)
    c.add_argument("--json", action="store_true")
    command("variants", "query", filters=True)
    command("compare", filters=True).add_argument("queries", nargs="+")
    command("show").add_argument("segment_id", type=int)
    for name in ("subjects", "stats", "coverage", "report", "compact"):
        command(name)
    c = command("ingest", "source", filters=True)  # a folder of papers with --reader, else Parquet blocks with --files
    c.add_argument("--reader", help="module:function that gives the blocks of a file's bytes")
    c.add_argument("--files", help="Parquet of sha1, path, filename")
    c.add_argument("--target", help="only files in a folder of this name, or whose name begins with it")
    c.add_argument("--tables")
    c.add_argument("--drawings")
    c.add_argument("--force", action="store_true")
    command("import", "path").add_argument("--force", action="store_true")
    command("export", "path")
    command("html", "path", filters=True).add_argument("--max-mb", type=float, default=page.MAX_MB)
    c = command("maintain", "folder")
    c.add_argument("--reader", required=True)
    c.add_argument("--target")
    c.add_argument("--prune", action="store_true", help="papers with questions go too where their file is gone")
    c = command("watch", "folder")
    c.add_argument("--reader")
    c.add_argument("--once", action="store_true")
    c.add_argument("--interval", default="5 seconds")
    return p


def run(spark: SparkSession, argv: list[str]) -> int:
    a = parser().parse_args(argv)
    try:
        return COMMANDS[a.command](spark, Store(spark, a.store), a)
    except SchemaMismatch as e:
        print(e, file=sys.stderr)
        return 2


def _filters(a) -> dict:
    return {"subject": a.subject, "year": a.year, "exam": a.exam}


def _table(df) -> int:
    n = 0
    for n, r in enumerate(df.toLocalIterator(), 1):
        print("\t".join("─" if v is None else str(v) for v in r))
    return 0 if n else 1


def search(spark, store, a) -> int:
    exams, segments = store.narrowed(a.query, **_filters(a))
    if not a.json:
        return _table(concordance.search(segments, exams, a.query, a.limit, a.width, **_filters(a)).select("segment_id", "source", "page", "matches", "snippet"))
    first = concordance.hits(segments, exams, a.query, **_filters(a)).orderBy(*concordance.hit_order()).limit(a.limit)
    rows = first.select("segment_id", "source", "subject", "year", "page", F.col("filename").alias("file"), text.surface_forms("text", a.query).alias("matches"), text.snippet(F.col("text"), a.query, a.width).alias("snippet")).collect()
    print(json.dumps([r.asDict() for r in rows], ensure_ascii=False, indent=2))
    return 0


def variants(spark, store, a) -> int:
    exams, segments = store.narrowed(a.query, **_filters(a))
    hits = concordance.matches(segments, exams, a.query, **_filters(a))
    forms = concordance.with_share(concordance.variants(hits)).select("form", "n", F.concat(F.col("percent").cast("string"), F.lit("%")), F.array_join("sources", "; "))
    code = _table(forms.orderBy(F.desc("n"), "form"))
    print("undecidable\t" + str(concordance.occurrence_totals(hits).first()["undecided"]))
    return code


def compare(spark, store, a) -> int:
    exams, segments = store.narrowed(**_filters(a))
    rows = concordance.with_dominant(concordance.compare(segments, exams, a.queries, **_filters(a)))
    _table(rows.orderBy(F.desc("total"), "ord").drop("ord"))
    return 0 if rows.where("total > 0").head() else 1


def show(spark, store, a) -> int:
    exams, segments = store.read()
    r = concordance.show(segments, exams, a.segment_id).select("filename", "page", text.readable("text").alias("text"), F.transform("tables", layout.padded).alias("tables")).first()
    if not r:
        return 1
    print(f"{r['filename']} p.{r['page']}\n\n{r['text']}")
    for rows in r["tables"] or []:
        print("\n".join("| " + " | ".join(x) + " |" for x in rows))
    return 0


def stats(spark, store, a) -> int:
    exams, segments = store.read()
    _table(concordance.stats(segments, exams))
    return _table(exams.select("year", "exam", "subject", "n_questions", "filename").orderBy(F.desc("year"), "subject", "filename"))


def _reader(name: str | None):
    if not name:
        return None
    module, function = name.split(":")
    return getattr(importlib.import_module(module), function)


def _told(log: list) -> int:
    for r in log:
        print(*["" if v is None else v for v in r], sep="\t")
    return 0 if not log or any(r["status"] != "failed" for r in log) else 1


def ingest_papers(spark, store, a) -> int:
    exams, _ = store.read()
    if a.reader:
        files = archive.pdf_files(spark, a.source)
        files = maintenance.targets(files, a.target) if a.target else files
        return _told(watch.apply(store, exams, watch.read_files(files, exams, _reader(a.reader), a.force, _filters(a)), a.force))
    files, more = spark.read.parquet(a.files), {k: spark.read.parquet(v) for k in ("tables", "drawings") if (v := getattr(a, k))}
    files = maintenance.targets(files, a.target) if a.target else files
    todo = files if a.force else ingest.fresh(files, exams)
    blocks = spark.read.parquet(a.source).join(todo.select(F.col("sha1").alias("doc_id")).distinct(), "doc_id", "left_semi")
    return _told(watch.apply(store, exams, ingest.ingest(todo, blocks, overrides=_filters(a), **more), a.force))


def import_archive(spark, store, a) -> int:
    exams, _ = store.read()
    done = ingest.change(exams, archive.batch(archive.read(spark, a.path)), a.force)
    tallies = {r["status"]: r["n"] for r in watch.status_tallies(done.log).collect()}
    if tallies.keys() - {"skipped"}:
        store.append(done.exams, done.segments, done.gone)
    print(*[f"{k} {v}" for k, v in tallies.items()], sep="\n")
    return 0


def export(spark, store, a) -> int:
    exams, segments = store.read()
    archive.export(exams, segments, a.path)
    return 0


def html(spark, store, a) -> int:
    exams, segments = store.read()
    done = page.write(segments, exams, a.path, a.max_mb, **_filters(a))
    print(*[f"{k} {v}" for k, v in done.items()], sep="\n")
    return 0 if done["questions"] else 1


def report(spark, store, a) -> int:
    exams, segments = store.read()
    print(page.report(segments, exams))
    return 0


def follow(spark, store, a) -> int:
    watch.watch(spark, a.folder, store, f"{a.store}-watch-checkpoint", _reader(a.reader), a.once, a.interval, _told).awaitTermination()
    return 0


def maintain(spark, store, a) -> int:
    return _told(watch.maintain(store, archive.pdf_files(spark, a.folder), _reader(a.reader), a.target, a.prune))


COMMANDS = {
    "search": search, "variants": variants, "compare": compare, "show": show, "stats": stats, "ingest": ingest_papers, "import": import_archive, "export": export, "html": html, "report": report, "watch": follow, "maintain": maintain,
    "subjects": lambda spark, store, a: _table(concordance.subjects(store.read()[0]).orderBy(F.desc("n_exams"), "subject")),
    "coverage": lambda spark, store, a: _table(concordance.coverage(store.read()[0]).orderBy(F.desc("year"), "exam", "subject")),
    "compact": lambda spark, store, a: print("%d -> %d bytes" % store.compact()) or 0,
}


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.appName("wordloom").getOrCreate(), sys.argv[1:]))
