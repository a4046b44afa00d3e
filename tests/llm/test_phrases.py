"""Phrase mining against counting all phrases in dictionaries."""

import random
import re
from collections import Counter

import numpy as np

from wordloom.llm import phrases

SCHEMA = "doc_id long, text string, lang string, size int, phrase string, n long, a long, score long"


def mined(rows, min_count, longest=5, first=2000):
    f, total, out = Counter(), Counter(), {}
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= min_count}
    within = Counter()
    for (lang, p), a in found.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                within[lang, p[i : i + k]] = max(within[lang, p[i : i + k]], a)
    for (lang, p), a in found.items():
        if within[lang, p] < a:
            cuts = [(1000 * a * total[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return {(lang, i, p.decode(), -a, left, right, total[lang], -s) for lang, all_ in out.items() for i, (s, a, p, left, right) in enumerate(sorted(all_)[:first], 1)}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 0, "", 0, 0, 0) for i, (t, lang) in enumerate(rows)], SCHEMA)


def test_intervals_of_a_suffix_array():
    rng = np.random.default_rng(4)
    ids = rng.integers(0, 3, 400)
    edge = rng.random(400) < 0.9
    edge[-1] = False
    _, kept, left = phrases.chains(ids, edge, 2)
    for k, at, n in phrases.intervals(kept, left, 5):
        want = Counter(tuple(kept[i : i + k]) for i in range(len(kept)) if left[i] >= k)
        assert {tuple(kept[i : i + k]): c for i, c in zip(at, n, strict=True)} == want


def test_against_plain_counts(spark):
    rng = random.Random(5)
    words = ["Der", "die", "über", "Ü", "x\x00y", "a b", "ünd"]
    rows = [("".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ","]) for _ in range(rng.randrange(80))), rng.choice(["de", "en", None, "und"])) for _ in range(150)]
    rows += [("one and the same text, copied. Over and over", "en")] * 60 + [(None, "en"), ("", None), ("  \t\n", "fr"), ("only Once", "fr"), ("w" * 100_000 + " of", "de"), ("of ha " * 20_000, "de")]
    for min_count, size in ((3, 1000), (40, 1 << 20)):
        got = {tuple(r) for r in phrases.collocations(frame(spark, rows), min_count, shard_bytes=size).collect()}
        assert got == mined(rows, min_count)
    got = {tuple(r) for r in phrases.collocations(frame(spark, rows), 3, longest=3, first=7).collect()}
    assert got == mined(rows, 3, 3, 7)


def test_slots_set_by_chance_decide_nothing(spark, monkeypatch):
    rows = [("a b c d e. c d e f", "x"), ("a b c d", "y")] * 30
    monkeypatch.setattr(phrases, "_set", lambda bitmap, keys: np.ones(len(keys), bool))
    assert {tuple(r) for r in phrases.collocations(frame(spark, rows), 40).collect()} == mined(rows, 40)


def test_empty(spark):
    assert phrases.collocations(frame(spark, [])).count() == 0
