"""Mixing against plain water-filling, expected inclusions and odd tables."""

from fractions import Fraction

import pytest

from wordloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, weight long, size long, target double, bucket int, id long"


def poured(sizes, weights=(5, 2, 1), share=Fraction(3, 2), most=2):
    """Targets by pouring what capped sources leave over the others, again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        out = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if out[s] > most * sizes[s]}
        if not above:
            return {s: float(out.get(s, most * sizes[s])) for s in names}
        full |= above


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, w, 0, 0.0, 0, 0) for i, t, s, w in rows], SCHEMA)


def test_targets_and_words_taken(spark):
    texts = lambda n, k: " ".join(["w"] * (1 + (n * 7919 + k) % 97))
    docs = [(1000 * k + n, texts(n, k), s, 1) for k, (s, many) in enumerate([("b", 400), ("a", 40), ("é", 3), ("Z", 90), (None, 60), ("", 200)]) for n in range(many)]
    got = mixing.mix(frame(spark, docs)).collect()
    assert len(got) == len(docs)
    sizes = {}
    for _, t, s, _ in docs:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = poured(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size and int(want[r.source] // sizes[r.source]) <= r.copies <= 2
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 3 for s in sizes)
    assert sorted(got, key=str) == sorted(mixing.mix(frame(spark, docs[::-1])).collect(), key=str)


def test_unequal_inclusions_and_certain_copies(spark):
    """Over many seeds a document's copies come to its weight's share; full ones are certain."""
    docs = frame(spark, [(i, "a b c d", "s", (1, 2, 5, 40)[i % 4]) for i in range(800)])
    runs = 2
    total = dict.fromkeys(range(4), 0)
    for seed in range(runs):
        for r in mixing.mix(docs, share=Fraction(1, 2), seed=seed, weight="weight", touches=0).collect():
            total[r.doc_id % 4] += r.copies
            assert r.copies <= 2
    # Half the words of 800 documents of 4 words each: 400 copies, shared by weight.
    per = 400 / (200 * (1 + 2 + 5 + 40))
    for k, w in enumerate((1, 2, 5, 40)):
        assert total[k] / (200 * runs) == pytest.approx(min(2, w * per), abs=0.12)
    heavy = mixing.mix(docs, share=Fraction(3, 2), weight="weight").where("doc_id % 4 = 3")
    assert {r.copies for r in heavy.collect()} == {2}


def test_odd_tables(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    bare = mixing.mix(frame(spark, [(1, None, None, None), (2, "", "x", 1), (None, " \n", "x", 1)])).collect()
    assert {(r.size, r.target, r.taken) for r in bare} == {(0, 0.0, 0)}
    twins = [(7, "a b", "s", 1)] * 5 + [(None, "a b c", "s", 1)] * 4 + [(9, "x " * 5000, "s", 1), (9, "y", "t", 1)]
    got = mixing.mix(frame(spark, twins))
    assert got.count() == len(twins) and got.where("taken > 2 * size or taken % size <> 0").count() == 0


def test_salted_sources(spark, monkeypatch):
    docs = frame(spark, [(i, "a " * (i % 9), f"s{i % 3}", 1) for i in range(200)])
    plain = sorted(mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert sorted(mixing.mix(docs).collect()) == plain
