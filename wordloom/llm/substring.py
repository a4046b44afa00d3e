"""Substring dedup by fixed-block anchors.

Every document is cut into non-overlapping blocks of ``(window + 1) // 2`` words, which form the index; a run of
``window`` shared words holds at least one whole block of either side.  All rolling block-sized windows of all
documents probe that index.  Around the hits, runs of ``window`` words are compared across documents by a
128-bit hash of the whole run, and overlapping repeated runs join into maximal exact repeats.

Documents are dealt to chunks by doc_id.  Each step sends one compressed blob for a pair of chunk and hash
bucket, with what occurs often in a chunk sent once, so a passage that a third of the documents hold costs a
bucket one entry for each chunk.  Nothing is collected, and a lost executor costs the tasks it had.  All work is linear
in the words of a chunk; blobs hold ``chunk_bytes * bucket_bytes / bytes of text`` bytes' worth of keys, so from some
10 TB on raise both sizes with the executors' memory, or blobs shrink to single keys.

Nulls: a null text has no words.  Rows with a null doc_id are dropped, since order among them is undefined.
Repeated rows of one doc_id count as one document (they never remove each other's words).  Empty tables give
empty results.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, kernels
from .kernels import U64

CHUNK_BYTES = 10 << 20
BUCKET_BYTES = 6 << 20
MASK32 = U64(0xFFFFFFFF)

OUT = "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start: long, end: long>>"


def _group(values: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the buckets present in values sorted by bucket, however many there are in all."""
    cuts = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return list(zip(values[cuts].tolist(), cuts.tolist(), np.append(cuts[1:], len(values)).tolist(), strict=False))


def _keys(h: np.ndarray, buckets: int) -> np.ndarray:
    """What a block is known by: its bucket, and 30 bits within that."""
    return ((h % U64(buckets)) << U64(32)) | ((h >> U64(34)) << U64(2))


def _block_keys(words: kernels.Words, block: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, owner, first = kernels.windows(words, block)
    return _keys(h, buckets), owner, first


def _index_and_probes(block: int, buckets: int):
    def run(key, table):
        """Keys of a chunk with two flags: 1, it starts a block of some document; 2, several documents hold it."""
        keys, docs, aligned = [], [], []
        for part in kernels.slices(table):
            words = kernels.Words(part.column("text"))
            k, owner, first = _block_keys(words, block, buckets)
            keys.append(k)
            docs.append(np.asarray(part.column("doc_id"))[owner])
            aligned.append((first - words.off[owner]) % block == 0)
        k = np.concatenate(keys) if keys else np.zeros(0, U64)
        if not len(k):
            return pa.table({"bucket": pa.array([], pa.int64()), "chunk": pa.array([], pa.int64()), "blob": pa.array([], pa.binary())})
        d, a = np.concatenate(docs), np.concatenate(aligned)
        order = np.argsort(k, kind="stable")
        k, d, a = k[order], d[order], a[order]
        new = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        flags = np.logical_or.reduceat(a, new).astype(U64) | ((np.minimum.reduceat(d, new) != np.maximum.reduceat(d, new)).astype(U64) << U64(1))
        k = k[new] | flags
        rows = _group(k >> U64(32))
        return pa.table({"bucket": pa.array([b for b, _, _ in rows], pa.int64()), "chunk": pa.array([key[0].as_py()] * len(rows), pa.int64()), "blob": pa.array([kernels.pack_sorted((k[x:y] & MASK32).astype(np.uint32)) for _, x, y in rows], pa.binary())})

    return run


def _match(key, table):
    """Keys of one bucket that are indexed and held by two documents, to each chunk that has them."""
    parts = [kernels.unpack_sorted(b) for b in table.column("blob").to_pylist()]
    flat = np.concatenate(parts)
    order = np.argsort(flat >> np.uint32(2), kind="stable")
    sorted_keys, flags = flat[order] >> np.uint32(2), flat[order] & np.uint32(3)
    new = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1]))
    seen = np.bitwise_or.reduceat(flags, new)
    many = np.diff(np.append(new, len(flat))) > 1
    good = sorted_keys[new][((seen & 1) > 0) & (many | ((seen & 2) > 0))]
    chunks, blobs = [], []
    bucket = U64(key[0].as_py()) << U64(32)
    for chunk, part in zip(table.column("chunk").to_pylist(), parts, strict=True):
        own = part >> np.uint32(2)
        hit = own[np.isin(own, good, assume_unique=True)]
        if len(hit):
            chunks.append(chunk)
            blobs.append(kernels.pack_sorted(hit << np.uint32(2)))
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "bucket": pa.array([int(bucket >> U64(32))] * len(chunks), pa.int64()), "blob": pa.array(blobs, pa.binary())})


def _run_hashes(words: kernels.Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both halves of the 128-bit hash of every run, with its document and first word."""
    a, owner, first = kernels.windows(words, window, seed=1)
    return a, kernels.windows(words, window, seed=2)[0], owner, first


def _runs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal 128-bit hashes lie together, and the places in it where another one begins."""
    order = np.argsort(a, kind="stable")
    x, y = a[order], b[order]
    if np.any((x[1:] == x[:-1]) & (y[1:] != y[:-1])):  # two runs share 64 bits: tell them apart by the others
        order = np.lexsort((b, a))
        x, y = a[order], b[order]
    return order, np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))) if len(a) else np.zeros(0, np.int64)


class Known:
    """The smallest document of each known run, by all 128 bits."""

    def __init__(self, a: np.ndarray, b: np.ndarray, least: np.ndarray):
        order = np.lexsort((b, a))
        self.a, self.b, self.least = a[order], b[order], least[order]
        self.lookup = kernels.Lookup(self.a)
        self.first = np.searchsorted(self.a, self.lookup.keys)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of known runs among those asked for, and their smallest documents."""
        at, key = self.lookup.find(a)
        place = self.first[key]
        while True:  # on to the next run of the same first half, as long as one differs in the second
            other = np.flatnonzero(self.b[place] != b[at])
            on = place[other] + 1
            more = (on < len(self.a)) & (self.a[np.minimum(on, len(self.a) - 1)] == a[at[other]])
            place[other[more]] += 1
            keep = np.ones(len(at), bool)
            keep[other[~more]] = False
            at, place = at[keep], place[keep]
            if not more.any():
                return at, self.least[place]


def _extend(block: int, window: int, buckets: int, run_buckets: int):
    def run(key, docs, hits):
        """Whole runs of ``window`` words around the hits: their 128-bit hash and smallest document."""
        empty = {"bucket": pa.array([], pa.int64()), "chunk": pa.array([], pa.int64()), "h": pa.array([], pa.binary()), "h2": pa.array([], pa.binary()), "doc": pa.array([], pa.binary()), "many": pa.array([], pa.binary())}
        if not hits.num_rows or not docs.num_rows:
            return pa.table(empty)
        known = kernels.Lookup(np.concatenate([(U64(b) << U64(32)) | kernels.unpack_sorted(x).astype(U64) for b, x in zip(hits.column("bucket").to_pylist(), hits.column("blob").to_pylist(), strict=True)]))
        h1, h2, doc = [], [], []
        for part in kernels.slices(docs):
            words = kernels.Words(part.column("text"))
            k, _, first = _block_keys(words, block, buckets)
            hit = np.zeros(len(words.hash) + 1, np.int32)
            hit[first[known.find(k)[0]] + 1] = 1
            before = np.cumsum(hit, dtype=np.int32)
            a, b, owner, start = _run_hashes(words, window)
            near = before[start + window - block + 1] > before[start]
            h1.append(a[near])
            h2.append(b[near])
            doc.append(np.asarray(part.column("doc_id"))[owner[near]])
        a, b, d = np.concatenate(h1), np.concatenate(h2), np.concatenate(doc).astype(np.int64)
        if not len(a):
            return pa.table(empty)
        order, new = _runs(a, b)
        a, b, d = a[order], b[order], d[order]
        low, high = np.minimum.reduceat(d, new), np.maximum.reduceat(d, new)
        a, b = a[new], b[new]
        bucket = (a % U64(run_buckets)).astype(np.int64)
        order = np.lexsort((low, bucket))
        a, b, low, many, bucket = a[order], b[order], low[order], (high != low)[order], bucket[order]
        rows = _group(bucket)
        return pa.table({
            "bucket": pa.array([r[0] for r in rows], pa.int64()),
            "chunk": pa.array([key[0].as_py()] * len(rows), pa.int64()),
            "h": pa.array([a[x:y].tobytes() for _, x, y in rows], pa.binary()),
            "h2": pa.array([b[x:y].tobytes() for _, x, y in rows], pa.binary()),
            "doc": pa.array([pa.compress(np.diff(low[x:y], prepend=0).tobytes(), codec="zstd", asbytes=True) for _, x, y in rows], pa.binary()),
            "many": pa.array([np.packbits(many[x:y]).tobytes() for _, x, y in rows], pa.binary()),
        })

    return run


def _first_holder(key, table):
    """For runs of one bucket the smallest document of all chunks, to the chunks where another one holds it."""
    h = [np.frombuffer(x, U64) for x in table.column("h").to_pylist()]
    sizes = [len(x) for x in h]
    flat, flat2 = np.concatenate(h), np.concatenate([np.frombuffer(x, U64) for x in table.column("h2").to_pylist()])
    low = np.concatenate([np.cumsum(np.frombuffer(pa.decompress(x, decompressed_size=8 * n, codec="zstd", asbytes=True), np.int64)) for x, n in zip(table.column("doc").to_pylist(), sizes, strict=True)])
    many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x, n in zip(table.column("many").to_pylist(), sizes, strict=True)])
    order, new = _runs(flat, flat2)
    least = np.empty(len(flat), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(low[order], new), np.diff(np.append(new, len(flat))))
    tell = many | (low > least)
    chunks, hs, h2s, docs, at = [], [], [], [], 0
    for chunk, n in zip(table.column("chunk").to_pylist(), sizes, strict=True):
        pick = np.flatnonzero(tell[at : at + n]) + at
        if len(pick):
            chunks.append(chunk)
            hs.append(flat[pick].tobytes())
            h2s.append(flat2[pick].tobytes())
            docs.append(pa.compress(least[pick].tobytes(), codec="zstd", asbytes=True))
        at += n
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "h": pa.array(hs, pa.binary()), "h2": pa.array(h2s, pa.binary()), "doc": pa.array(docs, pa.binary())})


def _cut(window: int):
    def run(key, docs, runs):
        out: dict[str, list] = {c: [] for c in ("doc_id", "n_words", "n_removed", "kept_text", "spans")}
        if runs.num_rows:
            h = [np.frombuffer(x, U64) for x in runs.column("h").to_pylist()]
            least = np.concatenate([np.frombuffer(pa.decompress(x, decompressed_size=8 * len(y), codec="zstd", asbytes=True), np.int64) for x, y in zip(runs.column("doc").to_pylist(), h, strict=True)])
            known = Known(np.concatenate(h), np.concatenate([np.frombuffer(x, U64) for x in runs.column("h2").to_pylist()]), least)
        for part in kernels.slices(docs):
            words = kernels.Words(part.column("text"), hashed=bool(runs.num_rows))
            ids = np.asarray(part.column("doc_id"))
            n = len(words.start)
            gone = np.zeros(n, bool)
            if runs.num_rows and n:
                a, b, owner, first = _run_hashes(words, window)
                at, least = known.find(a, b)
                late = at[least < ids[owner[at]]]
                edges = np.zeros(n + 1, np.int64)
                np.add.at(edges, first[late], 1)
                np.add.at(edges, first[late] + window, -1)
                gone = np.cumsum(edges[:-1]) > 0
            for d, doc_id in enumerate(ids):
                a, b = int(words.off[d]), int(words.off[d + 1])
                lost = gone[a:b]
                kept = np.flatnonzero(~lost) + a
                steps = np.flatnonzero(np.diff(lost.astype(np.int8), prepend=0, append=0))
                out["doc_id"].append(int(doc_id))
                out["n_words"].append(b - a)
                out["n_removed"].append(int(lost.sum()))
                out["kept_text"].append(joined(words, kept))
                out["spans"].append([{"start": int(x), "end": int(y)} for x, y in steps.reshape(-1, 2)])
        return pa.table({"doc_id": pa.array(out["doc_id"], pa.int64()), "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "kept_text": pa.array(out["kept_text"], pa.binary()).cast(pa.string()), "spans": pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})

    return run


def joined(words: kernels.Words, at: np.ndarray) -> bytes:
    """The words at these places, joined by one space: one gather of bytes."""
    if not len(at):
        return b""
    start, size = words.start[at], words.end[at] - words.start[at]
    ends = np.cumsum(size + 1)
    src = np.arange(ends[-1]) - np.repeat(ends - size - 1, size + 1) + np.repeat(start, size + 1)
    src[ends - 1] = 0
    out = words.buf[src]
    out[ends - 1] = 0x20
    return out[:-1].tobytes()


def remove_repeats(docs: DataFrame, window: int = 13, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Drop each word that lies in a run of ``window`` words which a document with a smaller doc_id also holds.

    Runs are judged on the input.  Gives doc_id, n_words, n_removed, kept_text (words joined by one space) and
    the removed maximal repeats as word spans.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    block = (window + 1) // 2
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).where("doc_id is not null")
    total, _ = common.text_size(rows)
    chunks = max(1, -(-total // chunk_bytes))
    buckets = max(1, -(-total // (5 * bucket_bytes // 4)))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)))
    probes = dealt.groupBy("chunk").applyInArrow(_index_and_probes(block, buckets), "bucket long, chunk long, blob binary")
    hits = probes.groupBy("bucket").applyInArrow(_match, "chunk long, bucket long, blob binary")
    runs = dealt.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(_extend(block, window, buckets, buckets), "bucket long, chunk long, h binary, h2 binary, doc binary, many binary")
    first = runs.groupBy("bucket").applyInArrow(_first_holder, "chunk long, h binary, h2 binary, doc binary")
    return dealt.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(_cut(window), OUT)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def op2_substring_dedup(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS h FROM w, unnest(range(1, len(w) - 11)) AS t(i)),
m AS (SELECT h, min(doc_id) AS d FROM s GROUP BY h HAVING min(doc_id) <> max(doc_id)),
g AS (SELECT DISTINCT doc_id, i + o AS p FROM s JOIN m USING (h), range(0, 13) AS r(o) WHERE d < doc_id),
k AS (SELECT doc_id, list(p) AS ps FROM g GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)"""
