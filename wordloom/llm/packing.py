"""Packing along a space-filling curve.

Each document's hashed token vector is projected to DIMS dimensions (a random sign of each token for each dimension,
scaled by the square root of its length), quantised, and mapped to its Hilbert key.  Documents are range-sorted by
(key, doc_id), so those with like tokens are neighbours, and packed with their neighbours.

Documents over ``capacity`` tokens are cut every ``capacity`` tokens from their start; others stay whole.  So pieces
are known when a text has been tokenised, once, and only small rows move afterwards: a range sort, then best-fit
decreasing over windows of ``window`` neighbouring pieces, with sequences that still have room carried on to the
next window.  Ranges' numbers of sequences (one number each, MAX_RANGES at most) are added up on the driver.

Null and empty texts are just the end token.  Rows with a null doc_id are dropped.  Rows that repeat a doc_id
are packed once each, whether their texts are equal or not.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, kernels
from .kernels import U64

CAPACITY = 4096
END_ID = 2
DIMS, KEY_BITS = 3, 10
CACHE_WORDS = 1_200_000
#: Bytes of the longest word that is remembered.
CACHED_BYTES = 64
#: Pieces of a range, and ranges at most: the driver adds up one number for each, and sends one row for each.
ROWS_PER_RANGE, MAX_RANGES = 20_000, 10_000
#: The same with token ids, which take up to 4 * CAPACITY bytes a piece: long documents have neighbouring keys, so a range
#: can be all long pieces (80 MB), and one task sorts it.
WIDE_ROWS_PER_RANGE = 5_000
#: Parquet's row groups of pieces with ids. Spark's reader decodes up to 4,096 rows at once, each id as three integers
#: (value and two levels), but never past a row group; one of 128 MB of long pieces could take 200 MB of a task (reckoned).
GROUP_BYTES = 4 << 20
WINDOW, OPEN = 2048, 64
#: Rows that a worker sends back at a time: at most 4 MB of token ids.
SENT_ROWS = 256

STOPS, WORDY = np.zeros(256, bool), np.zeros(256, bool)
STOPS[list(b".,")] = True
WORDY[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes, by way of a bounded cache of words.

    The tokenizer lower-cases, drops white space and splits there, so a text's ids are its words' ids one after
    another.  It also splits between a letter or digit and a mark, so full stops and commas that end a word are
    words of their own here, and the cache holds each word once.  Texts in which a special token may be spelt
    keep their case, and texts with other marks before such a stop or comma are split at white space alone.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.cache_words = cache_words
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads cost it memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        spread = [self.spaced(t.encode("utf-8", "surrogatepass")) if t else b"" for t in texts]
        buf = np.frombuffer(b"".join(spread), np.uint8)
        inside = ~kernels.SPACE[buf]
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        start, end = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
        at = np.append(0, np.cumsum(end - start)).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(buf[inside])]).dictionary_encode()
        value = self.lookup(coded.dictionary.to_pylist())
        place = np.asarray(coded.indices)
        # Ids of each word, one after another, then cut into documents.
        size = np.array([len(v) // 4 for v in value], np.int64)
        first, flat = np.cumsum(size) - size, np.frombuffer(b"".join(value), "<u4")
        n = size[place]
        stop = np.append(0, np.cumsum(n))
        ids = flat[np.arange(stop[-1]) + np.repeat(first[place] - stop[:-1], n)].tobytes()
        cut = (4 * stop[np.searchsorted(start, np.cumsum([0] + [len(t) for t in spread]))]).tolist()
        last = END_ID.to_bytes(4, "little")
        return [ids[x:y] + last for x, y in zip(cut, cut[1:], strict=False)]

    def lookup(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words."""
        if len(self.known) + len(words) > self.cache_words // 2:  # what is used again comes back from the older half
            self.known, self.older = {}, self.known
        known, older, long = self.known, self.older, {}
        new = []
        for w in words:
            if w not in known:
                if w in older:
                    known[w] = older[w]
                elif len(w) <= CACHED_BYTES:
                    new.append(w)
                elif w not in long:
                    long[w] = np.array(self.tokenizer.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
        plain = [w for w in new if w.isascii() and b"<" not in w]  # encoded together: a blank always parts two words
        for at in range(0, len(plain), 5_000):
            some = plain[at : at + 5_000]
            coded = self.tokenizer.encode(b" ".join(some).decode("ascii"), add_special_tokens=False)
            ids = np.array(coded.ids, "<u4").tobytes()
            begin = np.array(coded.offsets, np.int64).reshape(-1, 2)[:, 0]
            cut = (4 * np.searchsorted(begin, np.cumsum([0] + [len(w) + 1 for w in some]))).tolist()
            known.update((w, ids[x:y]) for w, x, y in zip(some, cut, cut[1:], strict=False))
        other = [w for w in new if w not in known]
        for at in range(0, len(other), 5_000):
            some = other[at : at + 5_000]
            encoded = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in some], add_special_tokens=False)
            known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(some, encoded, strict=True))
        return [known[w] if len(w) <= CACHED_BYTES else long[w] for w in words]

    @staticmethod
    def spaced(text: bytes) -> bytes:
        """The text with white space between its words and at its end."""
        if b"<|" in text:
            return text + b" "
        text = text.lower() + b" "
        buf = np.frombuffer(text, np.uint8)
        at = np.flatnonzero(STOPS[buf])
        at = at[kernels.SPACE[buf[np.minimum(at + 1, len(buf) - 1)]]]
        before = buf[at - 1]
        fine = WORDY[before] | (buf[at - 2] == 0xC3) & (before != 0x97) & (before != 0xB7)
        if len(at) and at[0] > 1 and fine.all():
            text = text.replace(b". ", b" . ").replace(b", ", b" , ").replace(b".\n", b" . ").replace(b",\n", b" , ")
        return text


_encoders: dict[str, Encoder] = {}


def encoder(path: str, cache_words: int = CACHE_WORDS) -> Encoder:
    """One for each worker process."""
    if path not in _encoders or _encoders[path].cache_words != cache_words:
        _encoders.clear()
        _encoders[path] = Encoder(path, cache_words)
    return _encoders[path]


def release() -> None:
    """Gives a worker's tokenizer and words back; workers live on for other stages."""
    _encoders.clear()
    kernels.give_back()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (n x d, coordinates under 2 ** bits), by the transpose method."""
    x = points.T.astype(np.uint32).copy()
    d = len(x)
    q = np.uint32(1 << (bits - 1))
    while q > 1:
        p = np.uint32(q - 1)
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint32(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= np.uint32(1)
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = np.uint32(1 << (bits - 1))
    while q > 1:
        t = np.where((x[d - 1] & q) != 0, t ^ np.uint32(q - 1), t)
        q >>= np.uint32(1)
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> np.uint32(b)) & np.uint32(1)).astype(np.int64)
    return key


def document_keys(ids: list[bytes]) -> np.ndarray:
    flat = np.frombuffer(b"".join(ids), "<u4")
    sizes = np.array([len(x) // 4 for x in ids])
    at = np.cumsum(sizes) - sizes
    bits = kernels.mix(flat.astype(U64), 11)
    vec = np.zeros((len(ids), DIMS))
    for k in range(DIMS if len(ids) else 0):
        sign = ((bits >> U64(7 + k)) & U64(1)).astype(np.int32) * 2 - 1
        vec[:, k] = np.add.reduceat(sign, at) / np.sqrt(sizes)
    grid = np.clip((np.tanh(vec / 2) + 1) / 2 * (1 << KEY_BITS), 0, (1 << KEY_BITS) - 1).astype(np.int64)
    return hilbert_keys(grid, KEY_BITS)


def _tokenised(path: str, capacity: int, with_ids: bool, cache_words: int, slice_bytes: int = kernels.SLICE_BYTES, keep: bool = True):
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "key") + (("ids",) if with_ids else ())
    kinds = {"ids": pa.list_(pa.int32())}

    def run(batches):
        encode = encoder(path, cache_words)
        for batch in batches:
            for part in kernels.slices(batch, limit=slice_bytes):
                out: dict[str, list] = {c: [] for c in names}
                ids = encode(part.column("text").to_pylist())
                for doc_id, key, doc in zip(part.column("doc_id").to_pylist(), document_keys(ids).tolist(), ids, strict=True):
                    total = len(doc) // 4
                    for start in range(0, total, capacity):
                        piece = doc[4 * start : 4 * (start + capacity)]
                        for c, v in zip(names, (doc_id, start, len(piece) // 4, zlib.crc32(piece), total, key, np.frombuffer(piece, "<u4")), strict=False):
                            out[c].append(v)
                yield pa.RecordBatch.from_pydict({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})

    return run if keep else kernels.tidied(run, release)


class Bins:
    """Best-fit decreasing: a piece goes to the fullest sequence that has room for it."""

    def __init__(self, capacity: int):
        self.capacity, self.used, self.room = capacity, 0, []  # room: sorted (tokens left, sequence)

    def place(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for i in np.argsort(-lengths, kind="stable").tolist():
            size = int(lengths[i])
            at = bisect_left(self.room, (size, -1))
            if at < len(self.room):
                left, s = self.room.pop(at)
            else:
                left, s = self.capacity, self.used
                self.used += 1
            seq[i], off[i] = s, self.capacity - left
            if left > size:
                insort(self.room, (left - size, s))
        self.room = self.room[-OPEN:]
        return seq, off


def _packed(capacity: int, window: int, columns: tuple[str, ...]):
    def run(batches):
        release()
        part, bins, held = TaskContext.get().partitionId(), Bins(capacity), []

        def flush(rows):
            seq, off = bins.place(np.asarray(rows.column("length")))
            out = pa.table({c: rows.column(c) for c in columns} | {"range": pa.array([part] * rows.num_rows, pa.int32()), "seq": pa.array(seq), "offset": pa.array(off)})
            for at in range(0, out.num_rows, SENT_ROWS):  # only what is sent is copied
                yield from out.slice(at, SENT_ROWS).combine_chunks().to_batches()

        for batch in batches:
            held.append(batch)
            rows = pa.Table.from_batches(held)
            at = 0
            while rows.num_rows - at >= 2 * window:
                yield from flush(rows.slice(at, window))
                at += window
            held = rows.slice(at).to_batches()
        if held and (rows := pa.Table.from_batches(held)).num_rows:
            yield from flush(rows)

    return kernels.tidied(run)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, window: int = WINDOW, with_ids: bool = False, cache_words: int = CACHE_WORDS, slice_bytes: int = kernels.SLICE_BYTES, keep: bool = True) -> DataFrame:
    """Pieces of documents and their places in sequences; ``with_ids`` adds the token ids of each piece.

    A worker holds ``cache_words`` words at most, about 200 bytes each, and tokens of ``slice_bytes`` of text: fewer cost time, never a result.
    Without ``keep`` it gives tokenizer and words back after each task, which costs time too, instead of holding them beside the next stage.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    path = tokenizer or default_tokenizer()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    more, group = (", ids array<int>", GROUP_BYTES) if with_ids else ("", None)
    small = common.materialize(rows.mapInArrow(_tokenised(path, capacity, with_ids, cache_words, slice_bytes, keep), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, key long" + more), "pieces", group)
    ranges = min(max(1, small.count() // (WIDE_ROWS_PER_RANGE if with_ids else ROWS_PER_RANGE)), MAX_RANGES)
    ordered = small.repartitionByRange(ranges, "key", "doc_id", "ids_crc32", "start").sortWithinPartitions("key", "doc_id", "ids_crc32", "start")
    columns = ("doc_id", "start", "length", "ids_crc32", "doc_tokens") + (("ids",) if with_ids else ())
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + more + ", range int, seq long, offset long"
    placed = common.materialize(ordered.mapInArrow(_packed(capacity, window, columns), schema), "placed", group)
    counts = sorted((r["range"], r["n"] + 1) for r in placed.groupBy("range").agg(F.max("seq").alias("n")).collect())
    # From Arrow: a list of rows would pass through Python workers of another kind, which stay as long as the others.
    first = list(accumulate((n for _, n in counts[:-1]), initial=0)) if counts else []
    base = spark.createDataFrame(pa.table({"range": pa.array([r for r, _ in counts], pa.int32()), "base": pa.array(first, pa.int64())}))
    return placed.join(F.broadcast(base), "range").select(*columns[:5], (F.col("base") + F.col("seq")).alias("sequence_id"), "offset", *columns[5:])


def op5_hilbert_packing(docs: DataFrame) -> DataFrame:
    return pack(docs)
