"""From positioned blocks to a stored corpus, its page, report and command line."""

import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from wordloom import __main__ as cli
from wordloom.functions import text
from wordloom.operators import concordance, ingest, layout
from wordloom.plans.schemas import SchemaMismatch
from wordloom.sources import page
from wordloom.sources.store import Store

LONG = " 다음 글을 읽고 물음에 답하시오 가나다라마바사"


def exam(sha1, head, n, extra=""):
    """A page of a full-width heading and two columns, n questions in each."""
    rows = [(sha1, 1, 0, 40.0, 20.0, 555.0, 50.0, head, 595.0, 842.0, None)]
    for i in range(2 * n):
        right = i >= n
        x0 = 306.0 if right else 40.0
        y0 = 80.0 + 60 * (i - n if right else i)
        rows.append((sha1, 1, i + 1, x0, y0, x0 + 240, y0 + 40, f"{i + 1}. 빛 에너지{extra}\n{LONG}", 595.0, 842.0, None))
    return rows[:1] + rows[:0:-1]  # blocks do not come in reading order


@pytest.fixture(scope="module")
def batch(spark):
    blocks = exam("s1", "2014학년도 대학수학능력시험 문제지\n제4교시 과학탐구 영역 (생명 과학Ⅰ)", 4) + exam("s2", "2026학년도 6월 모의평가 문제지", 3, " <b>") + [("s3", *[None] * 9, "ValueError: broken")]
    files = [("s1", "/p/2013/a.pdf", "a.pdf"), ("s2", "/p/2026_6월모평_국어.pdf", "2026_6월모평_국어.pdf"), ("s3", "/p/c.pdf", "c.pdf"), ("s1", "/p/2013/copy.pdf", "copy.pdf")]
    tables = [("s1", 1, 0, 50.0, 90.0, 100.0, 110.0, 595.0 * 842, [["a", "b"], ["c"], ["", None]]), ("s1", 1, 1, 0.0, 0.0, 595.0, 842.0, 595.0 * 842, [["a", "b"], ["c", "d"]]), ("s2", 1, 0, 50.0, 90.0, 100.0, 110.0, 595.0 * 842, [["a", "b"]])]
    done = ingest.ingest(
        spark.createDataFrame(files, "sha1 string, path string, filename string"),
        spark.createDataFrame(blocks, ingest.BLOCKS),
        spark.createDataFrame(tables, "doc_id string, page int, table_no int, x0 double, y0 double, x1 double, y1 double, page_area double, rows array<array<string>>"),
    )
    return ingest.Batch(*[x.cache() for x in (done.exams, done.segments, done.log)])


def test_papers_and_segments(batch):
    got = {r.sha1: r for r in batch.exams.collect()}
    assert sorted(got) == ["s1", "s2"]
    assert (got["s1"].year, got["s1"].exam, got["s1"].subject, got["s1"].n_questions, got["s1"].n_pages, got["s1"].scanned_pages) == (2014, "수능", "생명과학I", 8, 1, [])
    assert (got["s2"].year, got["s2"].exam, got["s2"].subject, got["s2"].n_questions) == (2026, "6월 모평", "국어", 6)
    segs = batch.segments.join(batch.exams.select("exam_id", "sha1"), "exam_id").where("sha1 = 's1'").orderBy("seg_no").collect()
    assert [s.number for s in segs] == [None, *range(1, 9)] and [s.kind for s in segs[:2]] == ["front", "question"]
    assert segs[1].tables == [[["a", "b"], ["c"]]]
    assert all(s.tables is None for s in segs[2:])
    left, right = segs[1].rects[0], segs[5].rects[0]
    assert (left.page, left.x0, left.y0, left.x1, left.y1) == (1, 40.0, 76.0, 280.0, 124.0) and right.x0 == 306.0


def test_log_has_failures(batch, spark):
    log = {r.sha1: r for r in ingest.add(batch.exams.where("sha1 = 's1'"), batch.segments, batch).log.collect()}
    assert {k: r.status for k, r in log.items()} == {"s1": "skipped", "s2": "added", "s3": "failed"} and log["s3"].error == "ValueError: broken"


def test_decode_isolates_errors(spark):
    def reader(content):
        if content == b"bad":
            raise ValueError("no")
        return [(1, 0, 0.0, 0.0, 1.0, 1.0, "t", 595.0, 842.0)]

    got = ingest.decode(spark.createDataFrame([("a", b"bad"), ("b", b"good")], "sha1 string, content binary"), reader).orderBy("doc_id").collect()
    assert got[0].error == "ValueError: no" and (got[1].text, got[1].error) == ("t", None)


@pytest.mark.parametrize(
    ("numbers", "n", "pages", "scanned", "broken", "want"),
    [
        ([1, 2, 3], 3, 1, [], 0, []),
        ([], 0, 2, [1, 2], 0, ["no_questions", "scanned_pages:1,2"]),
        ([1, 4], 2, 2, [], 3, ["unreadable:3/100", "missing:2,3", "few_questions"]),
        ([20], 20, 1, [], 2, ["missing:" + ",".join(map(str, range(1, 16))) + ",…"]),
    ],
)
def test_warnings(spark, numbers, n, pages, scanned, broken, want):
    rows = spark.createDataFrame([(numbers, n, pages, scanned, broken)], "a array<int>, q int, p int, s array<int>, b int")
    assert rows.select(ingest.warnings(F.col("a"), F.col("q"), F.col("p"), F.col("s"), F.lit(100), F.col("b")).alias("w")).first().w == want


def test_running_heads_count_once_a_page(spark):
    rows = [(1, p, i, t) for p in range(1, 7) for i, t in enumerate(["x", "x", f"b{p}", f"c{p}", f"d{p}"] if p == 1 else [f"h{p}", "k" if p < 4 else f"k{p}", f"b{p}", f"c{p}", f"d{p}"])]
    left = {r.text for r in layout.strip_running_heads(spark.createDataFrame(rows, "doc_id int, page int, pos int, text string")).collect()}
    assert "x" in left and "k" in left  # 1 and 2 of 6 pages
    rows = [(1, p, i, t) for p in range(1, 4) for i, t in enumerate(["head", f"b{p}", f"c{p}", f"d{p}", f"e{p}"])]
    assert "head" not in {r.text for r in layout.strip_running_heads(spark.createDataFrame(rows, "doc_id int, page int, pos int, text string")).collect()}


def test_store_page_report_and_commands(batch, spark, tmp_path, capsys):
    at = f"{tmp_path}/store"
    run = lambda *argv: (cli.run(spark, ["--store", at, *argv]), capsys.readouterr().out)
    assert run("search", "빛에너지")[0] == 1
    store = Store(spark, at)
    store.write(batch.exams, batch.segments)
    exams, segments = store.read()
    assert exams.count() == 2 and segments.count() == 16
    code, out = run("search", "빛에너지", "--json", "--subject", "생명과학1", "--limit", "3")
    assert code == 0 and [x["matches"] for x in json.loads(out)] == [["빛 에너지"]] * 3
    assert "14" in run("variants", "빛에너지")[1] and run("compare", "빛에너지", "없음")[0] == 0 and run("compare", "없음")[0] == 1
    some = segments.where("number = 1").first().segment_id
    assert run("show", str(some))[0] == 0 and run("show", "0")[0] == 1
    assert "생명과학I\t1\t8" in run("subjects")[1] and run("stats")[1].startswith("2\t2\t14") and "2026\t6월 모평\t국어\t6" in run("coverage")[1]
    code, out = run("html", f"{tmp_path}/page.html", "--exam", "모평")
    html = open(f"{tmp_path}/page.html", encoding="utf-8").read()
    facts = json.loads(html[html.index("const DATA=") + 11 : html.index(";\nconst FOLDS")])
    assert code == 0 and len(facts["items"]) == 6 and facts["counts"] == {"국어": 6} and len(facts["papers"]) == 1 and "<b>" not in html
    with pytest.raises(ValueError):
        page.write(segments, exams, f"{tmp_path}/x.html", max_mb=0.0001)
    assert "| 2026 6월 모평 | 6 | ─ |" in run("report")[1] and run("compact")[0] == 0
    run("export", f"{tmp_path}/out")
    other = ["--store", f"{tmp_path}/other"]
    assert cli.run(spark, [*other, "import", f"{tmp_path}/out"]) == 0 and "added 2" in capsys.readouterr().out
    assert cli.run(spark, [*other, "import", f"{tmp_path}/out"]) == 0 and "skipped 2" in capsys.readouterr().out
    assert cli.run(spark, [*other, "import", f"{tmp_path}/out", "--force"]) == 0
    back_exams, back = Store(spark, f"{tmp_path}/other").read()
    cols = ["exam_id", "seg_no", "kind", "number", "page", "part", "rects", "tables", "text"]
    assert back.count() == 16 and back_exams.count() == 2 and back.select(cols).exceptAll(segments.select(cols)).count() == 0
    spark.createDataFrame([("2",)], "v string").write.mode("overwrite").text(f"{at}/layout")
    with pytest.raises(SchemaMismatch):
        store.read()
    assert cli.run(spark, ["--store", at, "stats"]) == 2


def test_watched_papers_are_searched(spark, tmp_path, capsys):
    folder = tmp_path / "in" / "2019"
    folder.mkdir(parents=True)
    at = ["--store", f"{tmp_path}/store"]
    put = lambda name, *lines: (folder / name).write_text("\n".join(lines))
    watch = lambda: cli.run(spark, [*at, "watch", f"{tmp_path}/in", "--once", "--reader", "tests.readers:read_lines"])
    put(unicodedata.normalize("NFD", "2026_6월모평_생명과학1.pdf"), "1. 빛 에너지", LONG, "2. 둘", LONG)
    put("bad.pdf", "broken")
    put("empty.pdf")
    assert watch() == 0
    assert capsys.readouterr().out.count("failed") == 1
    put("b.pdf", "1. 빛에너지", LONG)
    put("c.pdf", "1. 빛 에너지", LONG, "2. 둘", LONG)  # what the first one holds, but for a byte
    put("copy.pdf", "1. 빛에너지", LONG)
    assert watch() == 0
    store = Store(spark, f"{tmp_path}/store")
    exams, _ = store.read()
    assert {(r.year, r.exam, r.subject) for r in exams.collect()} >= {(2026, "6월 모평", "생명과학I"), (2019, None, None)} and len(store._live()) == 2
    capsys.readouterr()
    assert cli.run(spark, [*at, "search", "빛에너지", "--subject", "생명과학1"]) == 0 and "2026학년도 6월 모평 · 생명과학I · 1번" in capsys.readouterr().out
    before = {r.segment_id for r in store.read()[1].collect()}
    assert cli.run(spark, [*at, "ingest", f"{tmp_path}/in", "--reader", "tests.readers:read_lines", "--target", "b.pdf", "--force", "--year", "2001"]) == 0
    exams, segments = store.read()
    assert exams.where("year = 2001").count() == 1 and exams.count() == 2 and {r.segment_id for r in segments.collect()} == before and segments.count() == len(before)
    store.compact()
    assert store.read()[0].count() == 2 and store._live()[0].startswith("v=") and len(store._live()) == 1


def test_dominant_and_highlight(batch, spark):
    got = concordance.with_dominant(concordance.compare(batch.segments, batch.exams, ["빛에너지", "물음", "없음"])).orderBy("ord").collect()
    assert [(r.occurrences, r.dominant) for r in got] == [(14, False), (14, False), (0, False)]
    d = spark.createDataFrame([("a <b> & of  the 'x'",), ("nothing",)], "t string").select(text.highlight(F.col("t"), "ofthe").alias("h")).collect()
    assert [r.h for r in d] == ["a &lt;b&gt; &amp; <mark>of  the</mark> &#x27;x&#x27;", "nothing"]
