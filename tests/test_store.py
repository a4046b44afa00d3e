"""The stored corpus under several writers, and its narrowed reads against whole ones."""

import random

import pytest
from pyspark.sql import functions as F

from wordloom.operators import concordance
from wordloom.sources import index, store as stores
from wordloom.sources.store import EXAMS, SEGMENTS, Conflict, Store

WORDS = ["빛 에너지", "빛에너지", "of the", "the—end", "ha\nha", "ß", "𝒳y", "한 국", "a", "zz top"]


def papers(spark, numbers, tail="", subject=None):
    """Papers of three segments each."""
    rng = random.Random(7)
    exams = [(n, f"sha{n}", f"/p/{n}.pdf", f"{n}.pdf", 2015 + n % 5, "수능", None, subject or ("국어", "수학", None)[n % 3], 1, 2, 2, None, None) for n in numbers]
    segs = [(10 * n + k, n, k, ("question", "passage", "front")[k % 3], k, k, 1, None, None, None, " ".join(rng.choices(WORDS, k=3)) + f" {n}{tail}") for n in numbers for k in range(3)]
    return spark.createDataFrame(exams, EXAMS), spark.createDataFrame(segs, SEGMENTS)


def held(store):
    exams, segments = store.read()
    return sorted(r.exam_id for r in exams.collect()), sorted(r.segment_id for r in segments.collect())


def of(*numbers):
    return sorted(numbers), sorted(10 * n + k for n in numbers for k in range(3))


def meanwhile(monkeypatch, store, what):
    """Runs ``what`` once, after the next part is staged and before it is committed."""
    stage = Store._stage

    def staged(self, *a):
        part = stage(self, *a)
        if self is store:
            monkeypatch.setattr(Store, "_stage", stage)
            what()
        return part

    monkeypatch.setattr(Store, "_stage", staged)


@pytest.fixture
def two(spark, tmp_path):
    return Store(spark, f"{tmp_path}/s"), Store(spark, f"{tmp_path}/s")


def test_an_append_during_a_compaction_stays(spark, two, monkeypatch):
    one, other = two
    one.append(*papers(spark, [1]))
    meanwhile(monkeypatch, one, lambda: other.append(*papers(spark, [2])))
    one.compact()
    assert held(one) == of(1, 2) and [p[0] for p in one._live()] == ["v", "d"]


def test_a_deletion_during_a_compaction_holds(spark, two, monkeypatch):
    one, other = two
    one.append(*papers(spark, [1, 2]))
    none = [x.limit(0) for x in papers(spark, [9])]
    meanwhile(monkeypatch, one, lambda: other.append(*none, spark.createDataFrame([(2,)], "exam_id long")))
    one.compact()
    assert held(one) == of(1)


def test_two_compactions_at_once(spark, two, monkeypatch):
    one, other = two
    one.append(*papers(spark, [1]))
    one.append(*papers(spark, [2]))
    meanwhile(monkeypatch, one, other.compact)
    one.compact()
    assert held(one) == of(1, 2) and len(one._live()) == 1


def test_first_writers_at_once(spark, two, monkeypatch):
    one, other = two
    meanwhile(monkeypatch, one, lambda: other.append(*papers(spark, [4])))
    one.append(*papers(spark, [5]))
    assert held(one) == of(4, 5)


def test_the_same_file_ingested_twice_at_once(spark, two, monkeypatch):
    one, other = two
    meanwhile(monkeypatch, one, lambda: other.append(*papers(spark, [1, 2])))
    one.append(*papers(spark, [2, 3]))
    assert held(one) == of(1, 2, 3)
    version = one.state().version
    one.append(*papers(spark, [1, 3]))
    assert held(one) == of(1, 2, 3) and one.state().version == version


def test_replaced_twice_at_once_and_facts_alone(spark, two, monkeypatch):
    one, other = two
    one.append(*papers(spark, [1, 2]))
    gone = spark.createDataFrame([(2,)], "exam_id long")
    meanwhile(monkeypatch, one, lambda: other.append(*papers(spark, [2], "x"), gone))
    one.append(*papers(spark, [2], "y"), gone)
    assert held(one) == of(1, 2) and one.read()[1].where("exam_id = 2 and text not like '%2y'").count() == 0
    facts, _ = papers(spark, [1], subject="물리학I")
    one.append(facts, papers(spark, [9])[1].limit(0), spark.createDataFrame([(1, False)], "exam_id long, whole boolean"))
    assert held(one) == of(1, 2) and {r.subject for r in one.read()[0].collect()} == {"물리학I", None}
    assert concordance.search(*reversed(one.narrowed("1", subject="물리학1")), "1", subject="물리학1").count() == 2


def test_a_change_that_builds_on_a_version(spark, two):
    one, other = two
    one.append(*papers(spark, [1]))
    base = one.state()
    other.append(*papers(spark, [2]))
    with pytest.raises(Conflict):
        one.append(*papers(spark, [3]), base=base)
    assert held(one) == of(1, 2)
    assert {r.exam_id for r in one.read(base)[0].collect()} == {1}


def test_old_parts_go_and_running_readers_keep_theirs(spark, two):
    one, _ = two
    for n in (1, 2, 3):
        one.append(*papers(spark, [n]))
    old = one.read()[1]
    one.compact()
    assert old.count() == 9
    one.vacuum(keep_seconds=-1)
    assert held(one) == of(1, 2, 3) and one._versions() == [3] and len(one._live()) == 1


@pytest.mark.parametrize("listed", [stores.LISTED, 2])
def test_narrowed_reads_find_the_same(spark, tmp_path, monkeypatch, listed):
    monkeypatch.setattr(stores, "LISTED", listed)
    store = Store(spark, f"{tmp_path}/s", slot_bytes=300)
    assert concordance.search(*reversed(store.narrowed("abc")), "abc").count() == 0
    store.append(*papers(spark, range(40)))
    exams, segments = papers(spark, [70])
    store.append(exams, segments.withColumn("text", F.when(F.col("seg_no") == 0, "q").when(F.col("seg_no") == 1, F.lit(None)).otherwise("")))
    store.append(*papers(spark, [3, 4], " 빛에  너지"), spark.createDataFrame([(3,), (4,), (5,)], "exam_id long"))
    exams, segments = store.read()
    asked = [(q, {}) for q in ("빛에너지", "the-e", "𝒳y", "q", "zztopzztopzztopzztop", "nowhere at all", "")] + [("haha", {"subject": "수학"}), ("국", {"year": 2017, "exam": "수"}), ("a", {"subject": "물리"})]
    for query, filters in asked:
        want = sorted(map(str, concordance.search(segments, exams, query, None, **filters).collect()))
        assert sorted(map(str, concordance.search(*reversed(store.narrowed(query, **filters)), query, None, **filters).collect())) == want
    files = lambda df: len(df.inputFiles())
    every = files(store.read()[1].select("text"))
    assert files(store.narrowed("q")[1].select("text")) < every and files(store.narrowed(subject="수학")[1].select("text")) < every


def test_postings_are_those_of_the_keys(spark):
    rows = [(0, 1, "ab c—d"), (0, 2, "ab"), (1, 3, "aaaa"), (1, 4, None), (1, 5, "")]
    segs = spark.createDataFrame(rows, "slot int, segment_id long, text string")
    posted = index.postings(segs)
    assert {(r.gram, r.slot, *r.ids) for r in posted.collect()} == {("abc", 0, 1), ("bc-", 0, 1), ("c-d", 0, 1), ("aaa", 1, 3)}
    assert {(r.gram, r.slot) for r in index.presence(segs, posted).collect()} == {(g, 0) for g in ("a", "b", "c", "-", "d", "ab", "bc", "c-", "-d")} | {("a", 1), ("aa", 1)}
