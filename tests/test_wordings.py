"""Many wordings at once, boxes of characters, cover subjects and percentages."""

import time

import pytest
from pyspark.sql import functions as F

from wordloom.functions import meta
from wordloom.operators import concordance, pageboxes, wordings
from wordloom.plans import views

SF = "/root/testdata/sf0.001"


def test_a_table_of_wordings_gives_what_compare_gives(spark):
    segments, exams = views.segments_a(spark, SF), views.exams_a(spark, SF)
    extra = [(10**6 + i, "haha the end of\n the\tand a – b ￼-B aaaa" if i else None) for i in range(2)]
    one = segments.limit(1).drop("segment_id", "text")
    segments = segments.unionByName(one.crossJoin(spark.createDataFrame(extra, "segment_id long, text string")).select(*segments.columns))
    asked = ["of the", "the and", "haha", "aa", "aaa", "the end", "a-b", "-b", "", " ", "nowhere", "of the", "e", "ttheand"]
    queries = spark.createDataFrame([*enumerate(asked), (99, None)], "qid long, query string")
    want = {r.ord: (r.hits, r.total, r.undecided) for r in concordance.compare(segments, exams, asked).collect()}
    got = {r.qid: (r.hits, r.total, r.undecided) for r in wordings.compare_table(segments, exams, queries).collect()}
    assert got == want | {99: (0, 0, 0)}
    assert wordings.compare_table(segments, exams, queries.limit(0)).count() == 0


def test_rounds_of_queries(spark, monkeypatch):
    segments, exams = views.segments_a(spark, SF), views.exams_a(spark, SF)
    queries = segments.where("segment_id < 40").select(F.col("segment_id").alias("qid"), F.substring("text", 5, 9).alias("query"))
    one = sorted(map(str, wordings.compare_table(segments, exams, queries).collect()))
    monkeypatch.setattr(wordings, "QUERY_CHARS", 60)
    assert sorted(map(str, wordings.compare_table(segments, exams, queries).collect())) == one


def test_a_thousand_wordings_cost_little_more_than_three(spark):
    segments, exams = views.segments_a(spark, SF).cache(), views.exams_a(spark, SF).cache()
    words = segments.select(F.explode(F.split("text", " ")).alias("query")).where("length(query) > 5").distinct().orderBy("query").limit(1000)
    many = words.select(F.monotonically_increasing_id().alias("qid"), "query").cache()
    took = []
    for queries in (many.limit(3), many.limit(3), many):
        began = time.time()
        assert wordings.compare_table(segments, exams, queries).collect()
        took.append(time.time() - began)
    assert many.count() > 500 and took[2] < 3 * took[1] + 1


def folded(chars, query):
    """Boxes of one page by a plain loop over its characters."""
    kept = [c for c in sorted(chars) if not c[1].isspace() and c[1] != "￼"]
    key, out, k = "".join({"–": "-"}.get(c[1], c[1]) for c in kept), [], 0
    for p in range(len(key)):
        if query and key.startswith(query, p):
            runs = []
            for _, _, x, y, w, h in kept[p : p + len(query)]:
                if runs and abs(y - runs[-1][1]) < 0.7 * h:
                    r = runs[-1]
                    right = max(r[0] + r[2], x + w)
                    r[0] = min(r[0], x)
                    r[2], r[3] = right - r[0], max(r[3], h)
                else:
                    runs.append([x, y, w, h])
            out += [(k, i, *r) for i, r in enumerate(runs)]
            k += 1
    return out


@pytest.mark.parametrize("query", ["ana", "a - b", "zz", ""])
def test_boxes(spark, query):
    line = "an ana a–b anana\nba a -b￼an\na"
    chars = [(i, c, 5.0 * (i % 9), 3.0 * (i // 4) + (i % 3), 4.0 + i % 2, 8.0 - i % 5) for i, c in enumerate(line)]
    rows = spark.createDataFrame([(7, *c) for c in chars] + [(8, 0, "a", 0.0, 0.0, 1.0, 1.0), (None, 0, "a", 0.0, 0.0, 1.0, 1.0)], "page_id int, pos int, ch string, x double, y double, w double, h double")
    got = sorted((r.occurrence, r.run, r.x, r.y, r.w, r.h) for r in pageboxes.boxes(rows, query).collect())
    assert got == folded(chars, query.replace(" ", ""))


def test_subjects_of_covers_with_a_period(spark):
    covers = {"제1교시 국어 영역": "국어", "제1교시국어 영역": "국어", "제4교시한국사영역": "한국사", "제 2 교시 수학 영역 (가형)": "수학가형", "영어 영역": "영어", "제4교시 과학탐구 영역 (물리학Ⅰ)": "물리학I", "제4교시과학탐구영역 화학Ⅱ": "화학II"}
    rows = spark.createDataFrame([*covers.items()], "c string, s string").select("s", meta.from_cover(F.col("c"))["subject"].alias("got")).collect()
    assert [r.got for r in rows] == [r.s for r in rows]


def test_percentages_by_three_rules(spark):
    got = concordance.with_share(spark.createDataFrame([("a", 1), ("b", 7), ("c", 32)], "form string, n long")).orderBy("form").collect()
    assert [(r.total, r.percent, r.percent_down, r.percent_up) for r in got] == [(40, 2, 2, 3), (40, 18, 17, 18), (40, 80, 80, 80)]


def test_images(spark):
    rows = spark.createDataFrame([(1, "/a", [1]), (2, "/a", None), (3, "/b", [1]), (4, "/a", []), (5, None, [1])], "segment_id int, path string, rects array<int>")
    files = spark.createDataFrame([("/a",), ("/a",), ("/c",)], "path string")
    assert {r.segment_id for r in concordance.with_image(rows, files).where("has_image").collect()} == {1, 4}
