import json

from pyspark.sql import functions as F

from wordloom.functions import meta, text
from wordloom.operators import concordance, layout, maintenance
from wordloom.sources import archive
from wordloom.sources.store import Store
from wordloom.streaming import watch


def test_spans_keys_and_hostile_queries(spark):
    d = spark.createDataFrame([("상호 작용은 상리 공생",), ("a – b a-b a—\nb a￼-b",), (None,), ("",), ("haha(?x",)], "t string")
    got = d.select(text.spans("t", "상리공생").alias("s"), text.surface_forms("t", "a-b").alias("f"), F.size(text.surface_forms("t", "(?")).alias("n")).collect()
    assert [tuple(x) for x in got[0].s] == [(7, 12)]
    assert got[1].f == ["a – b", "a-b", "a—\nb", "a￼-b"]
    assert got[4].n == 1 and got[3].s == [] and got[2].s == []


def test_cover_and_label(spark):
    d = spark.createDataFrame([("2014학년도 대학수학능력시험 문제지\n제4교시 과학탐구 영역 (생명 과학Ⅰ)",), ("2019학년도 6월 모의평가 수학 영역 (가형)",)], "t string")
    a, b = d.select(meta.from_cover(F.col("t")).alias("m")).select("m.*").collect()
    assert (a.year, a.exam, a.subject) == (2014, "수능", "생명과학I") and (b.exam, b.subject) == ("6월 모평", "수학가형")


def test_canonical_literal_equals_column(spark):
    names = ["생명 과학Ⅰ", "생명과학1", "물리학 Ⅱ", "사회·문화", "국어 영역", "(가형)", "수학2", "영어", "화학 1", "한국사과목"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(meta.canon_subject(F.col("n")).alias("c")).collect()
    assert [r.c for r in got] == [meta.canonical(n) for n in names]
    assert meta.subject_aliases("생명과학1") == meta.subject_aliases("생명 과학Ⅰ") == ["생명과학1", "생명과학I", "생명과학Ⅰ"]


def corpus(spark):
    exams = spark.createDataFrame([(1, "s1", 2014, "수능", None, "생명과학I"), (2, "s2", 2026, "6월 모평", None, "생명과학I")], "exam_id long, sha1 string, year int, exam string, grade string, subject string").withColumns({"filename": F.lit("f.pdf"), "path": F.lit("/f.pdf"), "n_pages": F.lit(2).cast("long"), "parser": F.lit(2), "scanned_pages": F.lit("1,2"), "n_questions": F.lit(1).cast("long")})
    segs = spark.createDataFrame([(1, 1, "question", 1, 1, 1, None, "빛에너지 빛\n에너지"), (2, 2, "question", 1, 1, 1, None, "빛 에너지 빛 에너지 빛에너지")], "segment_id long, exam_id long, kind string, number int, number_end int, page int, part string, text string")
    return exams, segs


def test_search_variants_compare(spark):
    exams, segs = corpus(spark)
    hits = concordance.search(segs, exams, "빛에너지", subject="생명과학I").collect()
    assert [h.source for h in hits] == ["2026학년도 6월 모평 · 생명과학I · 1번", "2014학년도 수능 · 생명과학I · 1번"]
    assert {r.form: r.n for r in concordance.variants(concordance.matches(segs, exams, "빛에너지")).collect()} == {"빛에너지": 2, "빛 에너지": 2}
    assert [tuple(r)[1:] for r in concordance.compare(segs, exams, ["빛에너지", "없음"]).orderBy("ord").collect()] == [("빛에너지", 2, 4, 1), ("없음", 0, 0, 0)]
    assert concordance.search(segs, exams, " ").count() == 0


def test_archive_round_trip_and_watch(spark, tmp_path):
    exams, segs = corpus(spark)
    archive.export(exams, segs, f"{tmp_path}/in", compression="none")
    back = archive.read(spark, f"{tmp_path}/in")
    assert archive.papers(back).count() == 2 and archive.segments(back).count() == 2
    text = sorted(line for f in sorted((tmp_path / "in").glob("part-*")) for line in f.read_text().splitlines())
    assert json.loads((sorted((tmp_path / "in").glob("part-*"))[0]).read_text())["format"] == archive.FORMAT
    paper = json.loads(text[-1])
    assert len(text) == 3 and paper["grade"] is None and set(paper["segments"][0]) == {"kind", "number", "number_end", "page", "text"}
    with open(f"{tmp_path}/in/part-odd.json", "w") as f:
        f.write(json.dumps(paper | {"sha1": "s3", "segments": [paper["segments"][0] | {"rects": "not an array", "tables": [[["a"]]]}]}) + "\n")
    kept, told = Store(spark, f"{tmp_path}/store"), []
    for _ in range(2):
        watch.watch(spark, f"{tmp_path}/in", kept, f"{tmp_path}/ck", told=told.append).awaitTermination()
    assert kept.read()[0].count() == 3 and [r.status for log in told for r in log] == ["added"] * 3
    assert [r.source for r in concordance.search(*kept.read()[::-1], "빛에너지").collect()][0].startswith("2026")
    odd = kept.read()[1].where(F.col("exam_id") == F.xxhash64(F.lit("s3"))).first()
    assert odd.rects is None and odd.tables == [[["a"]]]
    assert maintenance.upsert(exams, exams).count() == 2


def test_regions_and_tables(spark):
    ln = spark.createDataFrame([(1, 0, 1, 0, 10.0, 10.0, 50.0, 20.0, 5.0, 60.0), (1, 0, 1, 0, 10.0, 30.0, 55.0, 40.0, 5.0, 60.0)], "doc_id long, seg_no int, page int, col int, x0 double, y0 double, x1 double, y1 double, cx0 double, cx1 double")
    r = layout.regions(ln)
    assert [tuple(x) for x in r.first().rects] == [(1, 5.0, 6.0, 60.0, 44.0)]
    t = spark.createDataFrame([(1, 7, 1, 10.0, 10.0, 20.0, 20.0), (1, 8, 2, 10.0, 10.0, 20.0, 20.0)], "doc_id long, table_no int, page int, x0 double, y0 double, x1 double, y1 double")
    assert [tuple(x) for x in layout.attach_tables(t, r).collect()] == [(1, 7, 0)]
