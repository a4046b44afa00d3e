"""Line heads and the numbering of papers with elective parts; the query segment_lines has an SQL twin."""

from pyspark.sql import functions as F

from wordloom.operators import segmenting

A, B, C = "확률과 통계", "미적분", "기하"


def paper(spark, texts):
    return segmenting.segment(spark.createDataFrame([(1, i, 1, t) for i, t in enumerate(texts)], "doc_id long, line_no int, page int, text string")).orderBy("seg_no").collect()


def numbers(rows, kind="question"):
    return [(r.number, r.part) for r in rows if r.kind == kind]


def test_heads(spark):
    asked = ["1. 다음", "12．", "3.5 배", "28. 2024 Green", "3. 15. 에", "7 . x", "123. x", " 1. x", "［1~3]", "[1~3] 글", "[ 35 ～ 37 ] x", "[4-2]", "( 미적분 )", "（확률과  통계）", "(확률과통계)", "(미 적분)", "기하", "(기하) x", "국어 영역 문제지 ", "제 1 교시", "제1교시 국어", "４. 전각", None]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(asked)], "doc_id long, line_no int, text string")
    got = {r.line_no: r.head for r in segmenting.heads(rows).collect()}
    q = {i: h.number for i, h in got.items() if h and h.what == "question"}
    assert q == {0: 1, 1: 12, 3: 28, 5: 7, 21: 4}
    assert {i: (h.number, h.number_end) for i, h in got.items() if h and h.what == "passage"} == {9: (1, 3), 10: (35, 37), 11: (4, 2)}
    assert {i: h.name for i, h in got.items() if h and h.what == "part"} == {12: "미적분", 13: "확률과 통계", 14: "확률과통계"}
    line = F.coalesce("text", F.lit(""))
    assert [r.line_no for r in rows.where(segmenting.is_cover(line)).orderBy("line_no").collect()] == [18, 19, 20]


def test_numeric_bodies_and_decimals(spark):
    got = paper(spark, [f"{i}. 다음 글" for i in range(1, 28)] + ["28. 2024 Green Future", "농도가 1.5 배가 되고", "3. 15. 에 일어난", "29. 다음"])
    assert [n for n, _ in numbers(got)] == list(range(1, 30)) and got[27].text.endswith("3. 15. 에 일어난") and got[27].line_nos == [27, 28, 29]


def test_elective_parts_start_again(spark):
    body = [f"{i}. 문항" for i in range(1, 23)]
    for name in (A, B, C):
        body += [f"({name})"] + [f"{i}. 문항" for i in range(23, 31)]
    got = paper(spark, body)
    assert numbers(got) == [(i, None) for i in range(1, 23)] + [(i, p) for p in (A, B, C) for i in range(23, 31)]
    assert [r.text for r in got if r.kind == "front"] == [f"({p})" for p in (A, B, C)]


def test_part_named_after_its_first_question(spark):
    one, two = "화법과 작문", "언어와 매체"
    body = [f"{i}. 문항" for i in range(1, 35)] + ["국어 영역 문제지", "[35～37] 다음 글", "35. 문항", f"({one})"]
    body += [f"{i}. 문항" for i in range(36, 46)] + ["국어 영역 문제지", "35. 문항", f"({two})"] + [f"{i}. 문항" for i in range(36, 46)]
    got = paper(spark, body)
    assert numbers(got) == [(i, None) for i in range(1, 35)] + [(i, p) for p in (one, two) for i in range(35, 46)]
    assert numbers(got, "passage") == [(35, one)]
    late = [*body[:48], *["줄"] * 9, *body[49:]]  # no cover line near: the number is not taken
    got = numbers(paper(spark, late))
    assert len(got) == 55 and (35, two) not in got


def test_empty_and_odd_papers(spark):
    assert paper(spark, ["", " ", None]) == []
    assert segmenting.segment(spark.createDataFrame([], "doc_id long, line_no int, page int, text string")).count() == 0
    got = paper(spark, ["표지", None, "5. 먼저", "1. 하나", "[2~1] 거꾸로", "[2~9] 글", "6. 멀리", "2. 둘", f"({A})", "(끝)"])
    assert [(r.kind, r.number, r.number_end, r.part) for r in got] == [("front", None, None, None), ("question", 1, 1, None), ("passage", 2, 9, None), ("question", 2, 2, None), ("front", None, None, None)]
    assert got[0].text == "표지\n\n5. 먼저" and got[2].text == "[2~9] 글\n6. 멀리"


def test_a_border_found_late_reaches_back_only():
    def head(at, what, n, name=None, cover=99):
        return {"at": at, "what": what, "number": n, "number_end": n, "name": name, "cover": cover}

    one = [head(0, "question", 1), head(1, "question", 2), head(2, "part", None, A), head(3, "question", 3), head(4, "question", 2, cover=8)]
    parts = lambda heads: [(r["number"], r["part"]) for r in segmenting.fold(heads)]
    assert parts(one) == [(1, None), (2, A), (None, None), (3, A), (2, None)]
    assert parts([*one, head(5, "part", None, B)]) == [(1, None), (2, A), (None, None), (3, A), (2, B)]
    assert parts([*one[:4], head(4, "question", 2, cover=9)]) == [(1, None), (2, None), (None, None), (3, A)]
    turned = [*one[:4], head(4, "part", None, B), head(5, "part", None, C), head(6, "question", 9), head(7, "question", 2)]
    assert parts(turned) == [(1, None), (2, B), (None, None), (3, A), (None, None), (None, None), (2, C)]
