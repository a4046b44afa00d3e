"""Hard-negative mining by a two-dimensional block matrix product, in the manner of SUMMA.

Vectors are whole numbers, floor(256 x).  Rows are dealt to blocks by a hash of their id, anchors to blocks of their own, and
every block is cut into chunks of dimensions.  Tile (i, j) holds the scores of anchor block i with row block j: chunk k of both
meet in the task of the tile, which adds their product to it.  Tiles are made twice and never leave their task: once for
each anchor's first positives, then, for each anchor and positive, for the first negatives inside the window that the
positive's score opens.  What tiles give is a few rows for each anchor, merged by rank.  Blocks reach tiles by a shuffle and
never by a broadcast, since copies of one block for all tiles grow with the square of the input.

A block has about ``anchors`` or ``rows`` vectors (fewer where they are long: NUMBERS components at most) and a dimension is in
one of MAX_CHUNKS chunks at most; a task holds its two blocks and STRIP anchors' scores at every size.  Scores
are added in floating point only where no sum of the tile can pass what it holds exactly, else as 64-bit whole numbers.

Rows with a null id, label or vector, or with a component that is null or not finite, take no part.  Of rows that repeat an
id the one of the least (label, vector) counts.  Vectors of unlike lengths are as long as the longest, with zeros.
An anchor without a positive, or a window without a row, gives no row; so does an empty table.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

ANCHORS, ROWS, CHUNK, MAX_CHUNKS = 2048, 8192, 32, 8
NUMBERS, STRIP = 1 << 22, 256
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
_BLOCK = "block long, chunk int, ids binary, labels binary, part binary"
_FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def whole_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: Column | str = "label", scale: int = 256) -> DataFrame:
    """vec_id, label and v, the vector's components as floor(scale * x), one row for each id."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = rows.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull()).where(~bad)
    some = usable.select(F.col(vec_id).cast("long").alias("vec_id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"))
    return some.where("label is not null").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")


def _blocks(rows: DataFrame, n: int, per_block: int, width: int, chunk: int) -> DataFrame:
    """A row for each block of rows and chunk of dimensions: ids, labels and that part of the vectors."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        ids, labels = np.asarray(table.column("vec_id")), np.asarray(table.column("label"))
        order = np.argsort(ids)
        v = table.column("v").combine_chunks()
        size = np.asarray(v.value_lengths())
        m = np.zeros((len(ids), width), np.int64)
        m[np.arange(width) < size[:, None]] = np.asarray(v.flatten())
        block = table.column("block")[0].as_py()
        for k in range(0, max(width, 1), chunk):
            yield pa.RecordBatch.from_pydict({"block": [block], "chunk": pa.array([k // chunk], pa.int32()), "ids": [ids[order].tobytes()], "labels": [labels[order].tobytes()], "part": [_packed(m[order, k : k + chunk])]})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(-(-n // per_block))))
    return dealt.groupBy("block").applyInArrow(lambda t: pa.Table.from_batches(build(iter(t.to_batches()))), _BLOCK)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, exactly."""
    most = lambda x: int(np.abs(x).max(initial=0))
    if most(a) * most(b) * max(a.shape[1], 1) < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _packed(part: np.ndarray) -> bytes:
    """Whole numbers in 2, 4 or 8 bytes each, the fewest in which all fit."""
    low, high = int(part.min(initial=0)), int(part.max(initial=0))
    size = next(n for n in (2, 4, 8) if -(1 << 8 * n - 1) <= low and high < 1 << 8 * n - 1)
    return bytes([size]) + part.astype(f"<i{size}").tobytes()


def _side(block: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Ids and labels of a block, and its chunks in their order."""
    rows = sorted(block.select(["chunk", "ids", "labels", "part"]).to_pylist(), key=lambda r: r["chunk"])
    ids, labels = (np.frombuffer(rows[0][c], np.int64) for c in ("ids", "labels"))
    return ids, labels, [np.frombuffer(r["part"], f"<i{r['part'][0]}", offset=1).reshape(len(ids), -1) for r in rows]


def _most(x: np.ndarray) -> int:
    return max(-int(x.min(initial=0)), int(x.max(initial=0)))


def strips(a: list[np.ndarray], b: list[np.ndarray], size: int = STRIP) -> Iterator[tuple[int, np.ndarray]]:
    """The scores of a tile, ``size`` anchors at a time: the first one's place, and the sum of the chunks' products."""
    bound = sum(_most(x) * _most(y) * x.shape[1] for x, y in zip(a, b, strict=True))
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    a, b = [x.astype(kind) for x in a], [y.astype(kind) for y in b]
    for at in range(0, len(a[0]), size):
        total = 0
        for x, y in zip(a, b, strict=True):
            total = total + (product(x[at : at + size], y) if kind is np.int64 else x[at : at + size] @ y.T)
        yield at, total


def blocks_of(anchors: DataFrame, rows: DataFrame, anchor_block: int = ANCHORS, row_block: int = ROWS, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame, int, int] | None:
    """Blocks i of anchors (vec_id, label, v), blocks j of rows (the same), and how many there are of both; None if a table is empty."""
    sizes = lambda x: x.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    (n_a, wide_a), (n_b, wide_b) = sizes(anchors), sizes(rows)
    width = max(wide_a, wide_b)
    if not (n_a and n_b):
        return None
    chunk = max(chunk, -(-width // MAX_CHUNKS))
    fit = max(1, NUMBERS // max(width, 1))
    anchor_block, row_block = min(anchor_block, fit), min(row_block, fit)
    a = common.materialize(_blocks(anchors, n_a, anchor_block, width, chunk), "anchor-blocks")
    b = common.materialize(_blocks(rows, n_b, row_block, width, chunk), "row-blocks")
    return a.withColumnRenamed("block", "i"), b.withColumnRenamed("block", "j"), -(-n_a // anchor_block), -(-n_b // row_block)


def _by_tile(anchors: DataFrame, rows: DataFrame, n_i: int, n_j: int, run: Callable[[pa.Table, pa.Table], dict], kind: str) -> DataFrame:
    """What run gives for each tile, from the chunks of its two blocks."""
    none = {c.split()[0]: pa.array([], pa.int64()) for c in kind.split(", ")}

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        return pa.table(run(a, b) if a.num_rows and b.num_rows else none)

    every = lambda x, name, n: x.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).groupBy("i", "j")
    return every(anchors, "j", n_j).cogroup(every(rows, "i", n_i)).applyInArrow(tile, kind)


def _first(rows: DataFrame, by: list[str], score: str, name: str, most: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), F.asc(name)))
    return rows.withColumn("rank", place).where(F.col("rank") <= most)


def _ranked(score: np.ndarray, most: int) -> np.ndarray:
    """Places of the first of the scores, equal ones by place."""
    at = np.arange(len(score))
    if len(at) > 8 * most:  # only what can be among the first is sorted
        at = np.flatnonzero(score >= -np.partition(-score, most - 1)[most - 1])
    return at[np.argsort(-score[at], kind="stable")][:most]


def _inside(score: np.ndarray, low: np.ndarray, high: np.ndarray, most: int) -> list[np.ndarray]:
    """For each window, places of the first of the scores from low to high, equal ones by place."""
    at = np.arange(len(score))
    under = score[score <= high.min()]
    if len(under) > most:  # every window has as many from here up
        at = np.flatnonzero(score >= -np.partition(-under, most - 1)[most - 1])
    at = at[np.argsort(-score[at], kind="stable")]
    down = -score[at]
    return [at[x:y][:most] for x, y in zip(np.searchsorted(down, -high), np.searchsorted(down, -low, "right"), strict=True)]


def positives_of(anchors: DataFrame, rows: DataFrame, n_i: int, n_j: int, most: int = POSITIVES) -> DataFrame:
    """anchor_id, i (its block), positive_id, positive_score: the first rows of the anchor's label."""

    def run(left: pa.Table, right: pa.Table) -> dict:
        (a, al, x), (b, bl, y) = _side(left), _side(right)
        same = {k: np.flatnonzero(bl == k) for k in set(al.tolist())}
        owner, place, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for first, scores in strips(x, y):
            for n, s in enumerate(scores, first):
                at = same[int(al[n])]
                at = at[_ranked(s[at], most + 1)]
                at = at[b[at] != a[n]][:most]
                owner.append(np.full(len(at), n))
                place.append(at)
                score.append(s[at].astype(np.int64))
        owner, place = np.concatenate(owner), np.concatenate(place)
        return {"i": np.full(len(owner), left.column("i")[0].as_py()), "anchor_id": a[owner], "positive_id": b[place], "positive_score": np.concatenate(score)}

    some = _by_tile(anchors, rows, n_i, n_j, run, "i long, anchor_id long, positive_id long, positive_score long")
    return _first(some, ["anchor_id"], "positive_score", "positive_id", most).drop("rank")


def negatives_of(anchors: DataFrame, rows: DataFrame, n_i: int, n_j: int, positives: DataFrame, most: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """The first rows of other labels whose score is from ``low`` to ``high`` per cent of the positive's."""
    names = ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")

    def run(left: pa.Table, right: pa.Table) -> dict:
        (a, al, x), (b, bl, y) = _side(left), _side(right)
        windows: dict[int, list] = {}
        for w in next(r for r in left.column("windows").to_pylist() if r is not None):
            p = w["positive_score"]
            # low p <= 100 s <= high p, in whole numbers
            bounds = -(-low * p // 100), high * p // 100
            if bounds[0] <= bounds[1]:
                windows.setdefault(w["anchor_id"], []).append((w["positive_id"], p, *bounds))
        other = {k: bl != k for k in set(al.tolist())}
        out = []
        for first, scores in strips(x, y):
            for n, s in enumerate(scores, first):
                own = windows.get(int(a[n]))
                if not own:
                    continue
                _, _, lows, highs = zip(*own, strict=True)
                at = np.flatnonzero((s >= min(lows)) & (s <= max(highs)) & other[int(al[n])])
                if not len(at):
                    continue
                near = s[at].astype(np.int64)
                for (positive, p, _, _), found in zip(own, _inside(near, np.array(lows), np.array(highs), most), strict=True):
                    out += [(int(a[n]), positive, p, int(b[at[z]]), int(near[z])) for z in found]
        return {c: pa.array([o[k] for o in out], pa.int64()) for k, c in enumerate(names)}

    windows = positives.groupBy("i").agg(F.collect_list(F.struct("anchor_id", "positive_id", "positive_score")).alias("windows"))  # of one block of anchors
    with_windows = anchors.join(windows.hint("merge"), "i").withColumn("windows", F.when(F.col("chunk") == 0, F.col("windows")))
    found = _by_tile(with_windows, rows, n_i, n_j, run, ", ".join(f"{c} long" for c in names))
    return _first(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", most).select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")


def mine(rows: DataFrame, is_anchor: Column, anchor_block: int = ANCHORS, row_block: int = ROWS, chunk: int = CHUNK) -> DataFrame:
    """Hard negatives of the anchors among rows (vec_id, label, v): anchor_id, positive_id, rank, negative_id and both scores."""
    spark = rows.sparkSession
    common.small_batches(spark)
    rows = common.materialize(rows, "vectors")
    blocks = blocks_of(rows.where(is_anchor), rows, anchor_block, row_block, chunk)
    common.discard(rows)
    if blocks is None:
        return spark.createDataFrame([], _FOUND)
    positives = common.materialize(positives_of(*blocks), "positives")
    return negatives_of(*blocks, positives)


def op13_hard_negatives(embeddings: DataFrame) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return mine(whole_vectors(embeddings, label=label), F.col("vec_id") % 50 == 0)


OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM v AS a JOIN v AS b ON a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same AND vec_id <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""
