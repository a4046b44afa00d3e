"""Phrase collocation mining with word-id suffix arrays.

Texts are lower-cased (A-Z), cut into pieces at marks and line ends and into words at blanks.  A shard is a few megabytes of
whole texts.  Its words get ids from its own dictionary, its positions are sorted as suffixes by prefix doubling (ranks of
1, 2, 4, 5 words), and the longest common prefixes of neighbours part that order into intervals: one interval at depth k is
one phrase of k words and its length the phrase's count.  Spark adds the shards' counts up by language and phrase.

A phrase is frequent only if all its parts are, so texts are read three times: for words, for pairs of frequent words,
and for phrases of 3 to ``longest`` words all of whose pairs are frequent.  What is frequent reaches the tasks as a bitmap
of FILTER_BITS hash slots (16 MB at every size), filled by an aggregate.  A slot that is set by chance lets a phrase be
counted that then falls under the threshold: the bitmap saves work and never decides.

Scores are whole numbers of 38 digits.  A language's first phrases come from SALTS lists of it, so no task ranks a language.

Null texts are empty, a null language is ``und``; languages without a frequent phrase give no row.  Rows that repeat count each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, kernels
from .kernels import U64

SHARD_BYTES = 8 << 20
FILTER_BITS = 27
MIN_COUNT, LONGEST, FIRST = 100, 5, 2000
SALTS = 32
CUT, BLANK = np.zeros(256, bool), np.zeros(256, bool)
CUT[list(b".,;:!?\n\x0b\x0c\r")] = True
BLANK[list(b" \t")] = True
COUNTS = "lang string, size int, phrase string, n long"


class Shard:
    """Words of some texts: ``ids`` index (language, word) entries, ``edge`` tells whether the next word is of the same piece."""

    def __init__(self, part: pa.Table):
        buf, off = kernels.text_bytes(part.column("text"))
        buf = kernels.LOWER[buf]
        n, cut = len(buf), CUT[buf]
        inside = ~(cut | BLANK[buf])
        fresh = np.zeros(n + 1, bool)
        fresh[off] = True
        start = np.flatnonzero(inside & (np.append(True, ~inside[:-1]) | fresh[:n])) if n else np.zeros(0, np.int64)
        end = np.flatnonzero(inside & (np.append(~inside[1:], True) | fresh[1:])) + 1 if n else np.zeros(0, np.int64)
        doc = np.searchsorted(off, start, "right") - 1
        piece = np.cumsum(cut)[start] + doc if n else doc
        spans = np.concatenate([[0], np.cumsum(end - start)])
        words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(spans), pa.py_buffer(np.ascontiguousarray(buf[inside])))
        coded = words.dictionary_encode()
        langs = part.column("lang").combine_chunks().dictionary_encode()
        entry = np.asarray(langs.indices).astype(np.int64)[doc] * max(len(coded.dictionary), 1) + np.asarray(coded.indices).astype(np.int64)
        entries, self.ids = np.unique(entry, return_inverse=True)
        self.langs, self.words = langs.dictionary, coded.dictionary
        self.lang, self.word = np.divmod(entries, max(len(coded.dictionary), 1))
        self.edge = np.append(piece[1:] == piece[:-1], False) if len(piece) else np.zeros(0, bool)
        self.hash, self.mark = hashes(self.words)[self.word], _marks(self.langs)[self.lang]

    def known(self, singles: np.ndarray) -> np.ndarray:
        """Edges between two frequent words."""
        known = _set(singles, self.hash + self.mark)[self.ids]
        return self.edge & known & np.append(known[1:], False)

    def rows(self, at: np.ndarray, size: int, n: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        """The phrases of ``size`` words from places ``at`` of ids, with their counts."""
        parts = [self.words.take(pa.array(self.word[ids[at + j]])) for j in range(size)]
        text = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if size > 1 else parts[0]
        return _rows(self.langs.take(pa.array(self.lang[ids[at]])), size, text, n)


def _rows(lang: pa.Array, size: int, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"lang": lang.cast(pa.string()), "size": pa.array(np.full(len(n), size, np.int32)), "phrase": phrase.cast(pa.string()), "n": pa.array(n.astype(np.int64))})


def hashes(phrases: pa.Array) -> np.ndarray:
    """A hash of each phrase's words in order."""
    words = kernels.Words(phrases)
    out, place = np.zeros(len(phrases), U64), np.arange(len(words.hash)) - np.repeat(words.off[:-1], words.counts)
    doc = words.doc()
    for k in range(int(words.counts.max(initial=0))):
        here = place == k
        out[doc[here]] = _then(out[doc[here]], words.hash[here]) if k else words.hash[here]
    return out


def _marks(langs: pa.Array) -> np.ndarray:
    words = kernels.Words(langs, hashed=False)
    return kernels.mix(words.range_hash(words.text_off[:-1], words.text_off[1:]), 77)


def _then(first: np.ndarray, word: np.ndarray) -> np.ndarray:
    return kernels.mix(first * U64(0xC2B2AE3D27D4EB4F) + word, 5)


def slots(keys: np.ndarray) -> np.ndarray:
    return (kernels.mix(keys, 6) >> U64(64 - FILTER_BITS)).astype(np.int64)


def _set(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = slots(keys)
    return (bitmap[at >> 3] >> (at & 7) & 1).astype(bool)


def chains(ids: np.ndarray, edge: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of at least ``least`` words along edges: places in ids, the ids, and the words from each to its run's end."""
    if not len(ids):
        return np.zeros(0, np.int64), ids, np.zeros(0, np.int64)
    last = np.flatnonzero(~edge)
    size = np.diff(last, prepend=-1)
    left = np.repeat(last, size) - np.arange(len(ids)) + 1
    keep = np.flatnonzero(np.repeat(size, size) >= least)
    return keep, ids[keep], left[keep]


def suffix_array(ids: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Places in order of their next ``depth`` words (fewer at a run's end, which sorts first), by prefix doubling."""
    rank, h = ids + 1, 1
    order = np.argsort(rank, kind="stable") if depth == 1 else np.zeros(0, np.int64)
    while h < depth and len(ids):
        step = min(h, depth - h)
        after = np.zeros(len(ids), rank.dtype)
        far = np.flatnonzero(left > step)
        after[far] = rank[far + step]
        key = rank * (rank.max() + 1) + after
        order = np.argsort(key, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.cumsum(np.append(True, key[order[1:]] != key[order[:-1]]))
        h += step
    return order


def intervals(ids: np.ndarray, left: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, first places, counts) of the phrases of k words, for k up to ``depth``: runs of common prefixes of the suffix array."""
    order = suffix_array(ids, left, depth)
    a, b = order[:-1], order[1:]
    alike = np.ones(len(a), bool)
    for k in range(1, depth + 1):
        alike &= (left[a] >= k) & (left[b] >= k)
        at = np.flatnonzero(alike)
        alike[at] = ids[a[at] + k - 1] == ids[b[at] + k - 1]  # the common prefix is k words or more
        there = left[order] >= k
        first = there & np.append(True, ~alike)[: len(order)]
        starts = np.flatnonzero(first[there])
        yield k, order[first], np.diff(np.append(starts, int(there.sum())))


def _shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[Shard]:
    """Shards of about ``limit`` bytes of whole texts; a longer text is a shard of its own."""
    held, size = [], 0

    def cut():
        for part in kernels.slices(pa.Table.from_batches(held), limit=limit):
            yield Shard(part)

    for batch in batches:
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= limit:
            yield from cut()
            held, size = [], 0
    if held:
        yield from cut()


def _words(shard: Shard) -> Iterator[pa.RecordBatch]:
    """Each word's count, and under size 0 all words of each language."""
    n = np.bincount(shard.ids, minlength=len(shard.word))
    at = np.unique(shard.ids, return_index=True)[1]
    yield shard.rows(at, 1, n, shard.ids)
    total = np.bincount(shard.lang, weights=n, minlength=len(shard.langs)).astype(np.int64) if len(n) else np.zeros(len(shard.langs), np.int64)
    yield _rows(shard.langs, 0, pa.array([""] * len(total)), total)


def _pairs(shard: Shard, singles: np.ndarray) -> Iterator[pa.RecordBatch]:
    _, ids, left = chains(shard.ids, shard.known(singles), 2)
    _, at, n = list(intervals(ids, left, 2))[1]
    yield shard.rows(at, 2, n, ids)


def _longer(shard: Shard, singles: np.ndarray, pairs: np.ndarray, longest: int) -> Iterator[pa.RecordBatch]:
    edge = shard.known(singles)
    at = np.flatnonzero(edge)
    first, second = shard.ids[at], shard.ids[at + 1]
    edge[at] = _set(pairs, _then(shard.hash[first], shard.hash[second]) + shard.mark[first])
    _, ids, left = chains(shard.ids, edge, 3)
    for k, at, n in intervals(ids, left, longest):
        if k > 2:
            yield shard.rows(at, k, n, ids)


def _bitmap(frequent: DataFrame) -> np.ndarray:
    """The hash slots of a table's phrases; 2^FILTER_BITS bits, in pages of 4 KB."""

    def place(batches):
        for b in batches:
            langs = b.column("lang").dictionary_encode()
            key = hashes(b.column("phrase")) + _marks(langs.dictionary)[np.asarray(langs.indices)]
            yield pa.RecordBatch.from_pydict({"slot": pa.array(slots(key) + 1)})

    marked = frequent.select("lang", "phrase").mapInArrow(place, "slot long")
    pages = marked.groupBy(F.bitmap_bucket_number("slot").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()
    out = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    for r in pages:
        bits = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[(r["page"] - 1) * len(bits) : r["page"] * len(bits)] = bits
    return out


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, size, phrase, n of the phrases up to ``longest`` words that occur ``min_count`` times; all words of a language at size 0."""
    spark = docs.sparkSession
    common.small_batches(spark)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))

    def counted(name, kernel):
        def run(batches):
            for shard in _shards(batches, shard_bytes):
                yield from kernel(shard)

        sums = texts.mapInArrow(run, COUNTS).groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
        return common.materialize(sums.where((F.col("n") >= min_count) | (F.col("size") == 0)), name)

    words = counted("words", _words)
    singles = spark.sparkContext.broadcast(_bitmap(words.where("size = 1")))
    pairs = counted("pairs", lambda shard: _pairs(shard, singles.value))
    if longest == 2:
        return words.unionByName(pairs)
    doubles = spark.sparkContext.broadcast(_bitmap(pairs))
    longer = counted("longer", lambda shard: _longer(shard, singles.value, doubles.value, longest))
    return words.unionByName(pairs).unionByName(longer)


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, first: int = FIRST, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The ``first`` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    ``a`` counts the phrase, ``l`` and ``r`` the two parts of its lowest-scoring cut, ``n`` the language's words; the score
    is 1000 a n / (l r), rounded down.  A phrase that only occurs within one longer candidate is left out: since
    all between them then have its count, candidates of one more word tell.
    """
    every = frequent_phrases(docs, min_count, longest, shard_bytes)
    total = every.where("size = 0").select("lang", F.col("n").alias("n"))
    counts = every.where("size > 0").select("lang", "phrase", F.col("n").alias("f"))
    found = every.where("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"))
    part = lambda i, k: F.array_join(F.slice(F.split("phrase", " "), i, k), " ")
    inside = found.where("size > 2").select("lang", F.explode(F.array(part(F.lit(1), F.col("size") - 1), part(F.lit(2), F.col("size") - 1))).alias("phrase"), F.col("a").alias("f"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    found = common.materialize(found.join(inside, ["lang", "phrase"], "left").where("longer is null or longer < a").drop("longer").join(total, "lang"), "candidates")
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({"left": part(F.lit(1), F.col("k")), "right": part(F.col("k") + 1, F.col("size") - F.col("k"))})
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr("(CAST(a AS DECIMAL(38,0)) * CAST(n AS DECIMAL(38,0)) * CAST(1000 AS DECIMAL(38,0))) div (CAST(l AS DECIMAL(38,0)) * CAST(r AS DECIMAL(38,0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "n", "c.score", "c.l", "c.r")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    some = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", place("lang", "salt")).where(F.col("rank") <= first)
    return some.withColumn("rank", place("lang").cast("long")).where(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(docs: DataFrame) -> DataFrame:
    return collocations(docs)


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS x FROM d)),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM p, unnest(range(1, 6)) AS x(k), unnest(range(1, len(w) - k + 2)) AS y(i)),
t AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
o AS (SELECT DISTINCT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, a AS longer FROM c, unnest(range(2, k)) AS x(j), unnest(range(1, k - j + 2)) AS y(i)),
e AS (SELECT c.* FROM c ANTI JOIN o ON c.lang = o.lang AND c.phrase = o.phrase AND o.longer >= c.a),
u AS (SELECT e.lang, e.phrase, e.a, l.a AS l, r.a AS r, t.n, q AS cut, (1000::HUGEINT * e.a * t.n) // (l.a::HUGEINT * r.a) AS score
      FROM e JOIN t USING (lang), unnest(range(1, k)) AS x(q) JOIN f AS l ON l.lang = e.lang AND l.phrase = array_to_string(e.w[1:q], ' ') JOIN f AS r ON r.lang = e.lang AND r.phrase = array_to_string(e.w[q + 1:], ' ')),
v AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM u),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM v WHERE o = 1)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM z WHERE rank <= 2000"""
