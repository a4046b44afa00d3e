"""MinHash near-duplicates: banded universal-hash minima, signature checks, exact checks, star components.

A document's set holds the distinct 5-word shingles of its lower-cased text (a shorter text is one shingle).  Equal
sets form a class at once, by a 128-bit sum over the set, and only a class's smallest document goes on: a
group of exact copies costs one signature.  Classes meet in the buckets of ``bands`` bands of ``rows`` minima (at
similarity 0.85, 24 x 4 miss a pair with probability 2e-8).  Within a bucket first its centre
(the member that shares most buckets) is compared with its members; a pair whose signatures agree in too few places
(under ``floor``; 0.85 less five standard deviations) is dropped, others are confirmed on full sets.  Linked documents
then form components, and only members of one bucket that are still in different components are compared again, by
signature, in blocks of bounded size; those with a partner meet with their texts, one row for each member and block,
and are checked exactly there.  So no link between components is lost, and a group of which a centre is a copy costs as
many pairs as it has members; members that stay apart cost all pairs of signatures, and a list of those that agree.

Exact checks read texts in blocks of BLOCK members, sorted by block and streamed, so a text is hashed once for a block.

Nulls: a null doc_id is dropped; a null or blank text has an empty set and is linked with nothing.  Ties: among members
that share equally many buckets the smallest doc_id is the centre.  Rows that repeat a doc_id: the result has one row of
that id for each; if their texts differ, each set is a node with its own links, and sets of one doc_id are linked, being
one document.  A node is the smallest doc_id of its class or, where that id has several classes, a larger number by a hash
of the set for all but one.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, components, kernels
from .kernels import U64

SHINGLE = 5
BANDS, ROWS = 24, 4
#: Minima of a signature; the bands use the first BANDS * ROWS of them, the check all (8 bits of each).
HASHES = 256
#: Members of a bucket that are compared at a time.
BLOCK = 500
#: Settings where op8's contract of 0.85 does not bind: similarity 0.8 or more, and a floor five deviations below it.
STAGE = {"num": 80, "den": 100, "floor": 0.67}
#: Columns that tell one set from another.
SET = ["n_shingles", "f1", "f2"]
U32 = np.uint32


def _hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20250101)
    return rng.integers(0, 1 << 32, n, dtype=np.uint32) | U32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def shingle_sets(text) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, flat, and their offsets."""
    words = kernels.Words(text, lower=True)
    h, owner, _ = kernels.windows(words, SHINGLE, short_whole=True)
    n_docs = len(words.off) - 1
    cuts = np.searchsorted(owner, np.arange(n_docs + 1))
    for d in range(n_docs):
        h[cuts[d] : cuts[d + 1]].sort()
    new = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])) if len(h) else np.zeros(0, bool)
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(n_docs + 1))


def _signatures(n_hashes: int, bands: int, rows: int):
    mult, add = _hash_family(n_hashes)

    def run(batches):
        for batch in batches:
            for part in kernels.slices(batch, limit=kernels.STAGE_BYTES):
                h, off = shingle_sets(part.column("text"))
                sizes = np.diff(off)
                full = np.flatnonzero(sizes)
                f1, f2 = np.zeros(len(sizes), U64), np.zeros(len(sizes), U64)
                minima = np.zeros((len(sizes), n_hashes), np.uint32)
                if len(full):
                    at = off[:-1][full]
                    f1[full] = np.add.reduceat(kernels.mix(h, 5), at)
                    f2[full] = np.add.reduceat(kernels.mix(h, 6), at)
                    x = (h >> U64(32)).astype(np.uint32)
                    value = np.empty_like(x)
                    for k in range(n_hashes):
                        np.multiply(x, mult[k], out=value)
                        value += add[k]
                        minima[full, k] = np.minimum.reduceat(value, at)
                keys = _band_keys(minima[:, : bands * rows].reshape(-1, bands, rows).astype(U64))
                blobs = lambda x: pa.array([v.tobytes() if s else None for v, s in zip(x, sizes, strict=True)], pa.binary())
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"),
                    "row": part.column("row"),
                    "n_shingles": pa.array(sizes.astype(np.int64)),
                    "f1": pa.array(f1.view(np.int64)),
                    "f2": pa.array(f2.view(np.int64)),
                    "sig": blobs(minima.astype(np.uint8)),
                    "keys": blobs(keys),
                })

    return run


def _band_keys(minima: np.ndarray) -> np.ndarray:
    """64-bit keys (documents x bands) from minima (documents x bands x rows)."""
    bands, rows = minima.shape[1:]
    key = np.zeros(minima.shape[:2], U64)
    for r in range(rows):
        key = kernels.mix(key * U64(0x9E3779B97F4A7C15) + minima[:, :, r], 7)
    return kernels.mix(key + np.arange(bands, dtype=U64)[None, :] * U64(0xC2B2AE3D27D4EB4F), 8)


def _explode_keys(bands: int):
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            keys = np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.int64)
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys), "band": pa.array(np.tile(np.arange(bands, dtype=np.int32), n)), "doc_id": pa.array(np.repeat(np.asarray(batch.column("doc_id")), bands))})

    return run


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of equal places of signatures, by row; eight places are summed at a time."""
    same = a == b
    if same.shape[1] % 8 or same.shape[1] > 8 * 255:
        return np.count_nonzero(same, axis=1)
    lanes = same.view(U64).sum(axis=1)
    pairs = (lanes & U64(0x00FF00FF00FF00FF)) + (lanes >> U64(8) & U64(0x00FF00FF00FF00FF))
    return (pairs * U64(0x0001000100010001) >> U64(48)).astype(np.int64)


def _agreeing(n_hashes: int, least: float):
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(n, n_hashes) for c in ("sig_a", "sig_b"))
            good = _agree(a, b) / n_hashes >= least
            yield pa.RecordBatch.from_pydict({c: batch.column(c).filter(pa.array(good)) for c in ("a", "b", "c")})

    return run


def _whole_blocks(batches, *columns: str):
    """Rows sorted by these columns, as tables of as many whole blocks (rows that agree in them) as have come; and where those begin."""

    def changes(table):
        values = [np.asarray(table.column(c)) for c in columns]
        return np.flatnonzero(np.append(True, np.logical_or.reduce([v[1:] != v[:-1] for v in values])))

    held, last = [], None  # the rows so far of the block that may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        begins = int(changes(batch)[-1])
        goes_on = last == [batch.column(c)[0] for c in columns]
        if held and (begins or not goes_on):
            done = pa.Table.from_batches([*held, batch.slice(0, begins)])
            yield done, changes(done)
            held = []
        elif begins:
            done = pa.Table.from_batches([batch.slice(0, begins)])
            yield done, changes(done)
        held.append(batch.slice(begins))
        last = [batch.column(c)[-1] for c in columns]
    if held:
        done = pa.Table.from_batches(held)
        yield done, changes(done)


def _block_pairs(n_hashes: int, least: float):
    """Members of two blocks of a bucket with their partners: in another component, agreeing, no earlier band in common.

    Most blocks have two or three members, so rows come sorted by block, many blocks at a time.
    """

    def run(batches):
        for table, begins in _whole_blocks(batches, "key", "i", "j"):
            bucket, i, j, ids, comp, own, band = (np.asarray(table.column(c)) for c in ("key", "i", "j", "doc_id", "component", "own", "band"))
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(ids), n_hashes)
            keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), U64).reshape(len(ids), -1)
            partners: dict[int, np.ndarray] = {}
            met = np.zeros(len(ids), bool)
            for begin, end in zip(begins, [*begins[1:], len(ids)], strict=True):
                mine = own[begin:end]
                left, right = begin + np.flatnonzero(mine == i[begin]), begin + np.flatnonzero(mine == j[begin])
                one = i[begin] == j[begin]
                for x in left:
                    to = right[(comp[right] != comp[x]) & ((ids[right] > ids[x]) if one else True)]
                    to = to[_agree(sig[to], sig[x]) / n_hashes >= least] if len(to) else to
                    to = to[~(keys[to, : band[x]] == keys[x, : band[x]]).any(1)] if len(to) else to
                    if len(to):
                        partners[int(x)] = ids[to]
                        met[x] = True
                        met[to] = True
            rows = np.flatnonzero(met)
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(bucket[rows], pa.int64()), "i": pa.array(i[rows], pa.int32()), "j": pa.array(j[rows], pa.int32()),
                "doc_id": pa.array(ids[rows], pa.int64()),
                "partners": pa.array([partners.get(int(x), np.zeros(0, np.int64)).tolist() for x in rows], pa.list_(pa.int64())),
            })

    return run


def _check(table, num: int, den: int) -> tuple[list[int], list[int]]:
    """Exact checks of members with their partners, over one numbering of the shingles of the rows given."""
    ids = table.column("doc_id").to_pylist()
    found = [shingle_sets(part.column("text")) for part in kernels.slices(table, limit=kernels.STAGE_BYTES)]
    off = np.cumsum(np.concatenate([[0], *(np.diff(o) for _, o in found)]))
    vocabulary, number = np.unique(np.concatenate([h for h, _ in found]), return_inverse=True)
    sets = {d: number[a:b] for d, a, b in zip(ids, off[:-1], off[1:], strict=True)}
    flag, out_a, out_b = np.zeros(len(vocabulary), bool), [], []
    for d, partners in zip(ids, table.column("partners").to_pylist(), strict=True):
        if not partners:
            continue
        own = sets[d]
        flag[own] = True
        for p in partners:
            both = int(np.count_nonzero(flag[sets[p]]))
            if both and den * both >= num * (len(own) + len(sets[p]) - both):
                out_a.append(min(d, p))
                out_b.append(max(d, p))
        flag[own] = False
    return out_a, out_b


def _confirm(num: int, den: int):
    """Checks rows sorted by block, as many whole blocks at a time as have come."""

    def run(batches):
        for table, _ in _whole_blocks(batches, "block"):
            a, b = _check(table, num, den)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _links(members: DataFrame, texts: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that pass the exact check.  members: block, doc_id, partners, each partner being in the same block too."""
    both = members.join(texts, "doc_id").select("block", "doc_id", "partners", "text")
    dealt = both.repartition("block").sortWithinPartitions("block")
    return common.materialize(dealt.mapInArrow(_confirm(num, den), "a long, b long"), "links")


def _texts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted nodes' texts, as doc_id, fetched once.  The ids grow with the input, so this is never a broadcast; texts needn't be sorted."""
    rows = wanted.select(F.col("holder").alias("doc_id"), "row", F.col("doc_id").alias("node"))
    found = texts.join(rows.hint("shuffle_hash"), ["doc_id", "row"]).groupBy("node").agg(F.first("text").alias("text"))
    return common.materialize(found.withColumnRenamed("node", "doc_id"), "texts")


def _classes(full: DataFrame) -> DataFrame:
    """n_shingles, f1, f2, rep, node: the smallest doc_id of each set, and what stands for the set."""
    classes = full.groupBy(*SET).agg(F.min("doc_id").alias("rep"))
    first = classes.groupBy("rep").agg(F.max(F.struct(*SET)).alias("first"))
    # Larger than rep, so that the smallest node of a component is a doc_id: a set's rep is linked with it.
    above = F.least(F.greatest("rep", F.lit(0)), F.lit((1 << 63) - 2))
    other = above + 1 + F.pmod(F.xxhash64(*SET), F.lit((1 << 63) - 1) - above)
    node = F.when(F.struct(*SET) == F.col("first"), F.col("rep")).otherwise(other)
    return common.materialize(classes.join(first, "rep").select(*SET, "rep", node.alias("node")), "classes")


def _repeated(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between the sets of one doc_id; nodes: doc_id, node."""
    several = nodes.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("doc_id", "a")
    return nodes.join(several, "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct()


def _around(near: DataFrame, block: int) -> DataFrame:
    """Pairs (a, b) and the one of them that is a centre, as blocks of a centre and some of its members."""
    blocks = near.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("blocks"))
    other = F.when(F.col("a") == F.col("c"), F.col("b")).otherwise(F.col("a"))
    dealt = near.join(blocks, "c").select(F.xxhash64("c", F.pmod(F.xxhash64(other), F.col("blocks"))).alias("block"), other.alias("doc_id"), "c")
    centres = dealt.select("block", F.col("c").alias("doc_id"), F.array().cast("array<bigint>").alias("partners")).distinct()
    return dealt.select("block", "doc_id", F.array("c").alias("partners")).unionByName(centres)


def near_duplicates(docs: DataFrame, num: int = 85, den: int = 100, bands: int = BANDS, rows: int = ROWS, n_hashes: int = HASHES, floor: float = 0.74, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that similarity links of num / den or more reach."""
    spark = docs.sparkSession
    common.small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).where("doc_id is not null").withColumn("row", F.xxhash64("text"))
    sigs = common.materialize(texts.mapInArrow(_signatures(n_hashes, bands, rows), "doc_id long, row long, n_shingles long, f1 long, f2 long, sig binary, keys binary"), "signatures")
    full = sigs.where("n_shingles > 0")
    classes = _classes(full)
    reps = full.join(classes.withColumnRenamed("rep", "doc_id"), [*SET, "doc_id"])
    reps = reps.groupBy(F.col("node").alias("doc_id")).agg(F.max_by(F.struct("sig", "keys", F.col("doc_id").alias("holder"), "row"), "row").alias("r")).select("doc_id", "r.*")
    keys = reps.select("doc_id", "keys").mapInArrow(_explode_keys(bands), "key long, band int, doc_id long")
    keys = common.materialize(_shared(keys), "bands")
    # A document of a band key that repeats is rare: only those signatures are kept at hand.
    reps = common.materialize(reps.join(keys.select("doc_id").distinct(), "doc_id", "left_semi"), "candidates")
    texts = _texts(texts, reps)
    held = reps
    reps = reps.drop("holder", "row")
    weight = keys.join(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key").groupBy("doc_id").agg(F.sum("n").alias("weight"))
    centre = keys.join(weight, "doc_id").groupBy("key").agg(F.max_by("doc_id", F.struct("weight", (-F.col("doc_id")).alias("o"))).alias("c"))
    pairs = keys.join(centre, "key").where("doc_id <> c").groupBy(F.least("doc_id", "c").alias("a"), F.greatest("doc_id", "c").alias("b")).agg(F.max("c").alias("c"))
    s = reps.select("doc_id", "sig")
    near = pairs.join(s.withColumnsRenamed({"doc_id": "a", "sig": "sig_a"}), "a").join(s.withColumnsRenamed({"doc_id": "b", "sig": "sig_b"}), "b").mapInArrow(_agreeing(n_hashes, floor), "a long, b long, c long")
    near = common.materialize(near, "pairs")
    repeated = _repeated(full.join(classes, SET).select("doc_id", "node"))
    found = _links(_around(near, block), texts, num, den)
    edges, comp = _grow(repeated, found)
    common.discard(near, found)

    members = common.materialize(_open_members(keys, comp), "open")
    blocks = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    dealt = (
        members.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", "band", "doc_id", "component", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        .join(reps, "doc_id")
    )
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    near = common.materialize(dealt.mapInArrow(_block_pairs(n_hashes, floor), "key long, i int, j int, doc_id long, partners array<long>"), "partners")
    apart = near.select(F.xxhash64("key", "i", "j").alias("block"), "doc_id", "partners")
    found = _links(apart, texts, num, den)
    last, (_, comp) = comp, _grow(edges, found)
    common.discard(last, near, found, members, keys, held, texts)
    merged = classes.join(comp, "node", "left").select(*SET, F.coalesce("component", "rep").alias("component"))
    out = sigs.select("doc_id", *SET).join(merged, SET, "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _shared(keys: DataFrame) -> DataFrame:
    """Rows of buckets with two members or more."""
    return keys.join(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "key", "left_semi")


def _open_members(keys: DataFrame, comp: DataFrame) -> DataFrame:
    """Members of buckets that still hold several components."""
    now = keys.join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    mixed = now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    return now.join(mixed, "key", "left_semi")


def _grow(edges: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components with more edges; and edges that stand for them."""
    edges = edges.unionByName(more)
    comp = common.materialize(components.connected(edges), "components")
    return comp.select(F.col("node").alias("a"), F.col("component").alias("b")), comp


def op8_minhash_near_dedup(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def drop_near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id.  Rows with a null doc_id stay."""
    gone = near_duplicates(docs, **settings).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, w.doc_id = m.c AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a) m USING (doc_id)"""
