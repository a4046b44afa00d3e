"""Hard negatives against all pairs in plain whole numbers."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from wordloom.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>, i long, block int, scores string"


def mined(rows):
    kept = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            one = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v])
            kept[i] = min(kept.get(i, one), one)
    score = lambda a, b: sum(x * y for x, y in zip(kept[a][1], kept[b][1]))  # noqa: E731,B905
    out = set()
    for a in kept:
        if a % 50 == 0:
            ranked = sorted((-score(a, b), b) for b in kept if b != a)
            for s, p in [x for x in ranked if kept[x[1]][0] == kept[a][0]][:5]:
                fits = [(t, n) for t, n in ranked if kept[n][0] != kept[a][0] and -50 * s <= -100 * t <= -95 * s][:3]
                out |= {(a, p, k, n, -s, -t) for k, (t, n) in enumerate(fits, 1)}
    return out


def asked(frame, **blocks):
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return {tuple(r) for r in negatives.mine(negatives.whole_vectors(frame, label=label), F.col("vec_id") % 50 == 0, **blocks).collect()}


def test_against_all_pairs(spark):
    rng = random.Random(8)
    common = [rng.gauss(0, 1) for _ in range(40)]
    rows = [(i, rng.randrange(10), [c + rng.gauss(0, 0.8) for c in common] if i % 3 else common) for i in range(400)]
    rows += [(1000, 3, None), (1050, None, common), (1100, 3, [1.0, None]), (1150, 3, [float("nan")] * 40), (1200, 3, [float("inf")] * 40), (None, 3, common)]
    rows += [(50, 3, common), (50, 3, common), (1250, 4, []), (1300, 5, common[:3]), (1350, 6, [-x for x in common]), (1400, 6, [0.0] * 40)]
    frame = spark.createDataFrame([(*r, 0, 0, "") for r in rows], SCHEMA)
    want = mined(rows)
    assert len(want) > 50
    assert asked(frame) == want
    assert asked(frame, anchor_block=3, row_block=37, chunk=7) == want


def test_large_components_stay_exact(spark):
    rng = random.Random(9)
    rows = [(i, i % 2, [rng.uniform(1e5, 3e5) for _ in range(6)]) for i in range(120)]
    assert asked(spark.createDataFrame([(*r, 0, 0, "") for r in rows], SCHEMA), row_block=50) == mined(rows)
    b = np.array([[1 << 30, -5]])
    assert negatives.product(b, b).tolist() == [[(1 << 60) + 25]]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert asked(none) == set()
    assert asked(spark.createDataFrame([(1, 2, [1.0], 0, 0, "")], SCHEMA)) == set()
    assert asked(spark.createDataFrame([(50, 2, [1.0], 0, 0, "")], SCHEMA)) == set()


def test_blocks_are_never_broadcast(spark, monkeypatch):
    """Copies of blocks for all tiles grow with the square of the input; a broadcast of them went through the driver."""
    rng = random.Random(10)
    rows = [(i, i % 3, [rng.gauss(1, 1) for _ in range(8)]) for i in range(300)]
    plans = []
    for name in ("positives_of", "negatives_of"):
        monkeypatch.setattr(negatives, name, lambda *a, real=getattr(negatives, name): plans.append(real(*a)) or plans[-1])
    assert asked(spark.createDataFrame([(*r, 0, 0, "") for r in rows], SCHEMA), anchor_block=2, row_block=20, chunk=3) == mined(rows)
    assert len(plans) == 2
    assert not any("Broadcast" in p._jdf.queryExecution().executedPlan().toString() for p in plans)


def test_tiles_are_exact_in_each_kind_of_number():
    rng = np.random.default_rng(11)
    for most in (100, 1 << 20, 1 << 29):
        a, b = ([rng.integers(-most, most, (n, w)) for w in (4, 3)] for n in (7, 9))
        want = sum(x.astype(object) @ y.T.astype(object) for x, y in zip(a, b, strict=True))
        got = list(negatives.strips(a, b, 3))
        assert [at for at, _ in got] == [0, 3, 6]
        assert (np.concatenate([s for _, s in got]).astype(np.int64) == want).all()
