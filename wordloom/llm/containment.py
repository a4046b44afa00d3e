"""Size-partitioned MinHash containment search, in DataFrame functions only.

Short reference texts (benchmark items, licence templates) are looked for inside long documents.  A set's elements are its
overlapping windows of five words (shingles), hashed; a reference of fewer words is one shingle of that width.

A reference's sketch is a weighted bottom-k MinHash: the k least of its shingles by -ln(u) f, where u is uniform by the
shingle's hash and f the number of references that hold it, so a shingle weighs 1 / f and a stem that thousands of
items share is hardly ever in a sketch.  References are partitioned by size, and the size sets k: a text that holds at least t n of n shingles lacks n - t n of
them at most, so it holds one of any k = n - t n + 1 (rounded down): 1 for n = 1, 3 for 10, 7 for 30 at t = 0.8.  Each sketch
value is a band of its own, so a match meets its reference in a band with probability 1, however its shingles are scattered.

Every window of every text probes the shingles of references.  Hits on bands give candidates (text, reference), one row
each; a candidate's shingles are then joined with the text's hits and counted, which is exact containment in time linear
in candidates times their sizes, whatever one document holds.  Sets are compared by 64-bit hashes of shingles.

There is one plan for every size.  Up to ``max_broadcast`` shingles of references, both small tables are broadcast.
Beyond, the same joins shuffle, with both keys salted, so a shingle or reference that a third of all texts
hold is spread over SALTS tasks; texts themselves never move, only their hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WORDS, LEAST_WORDS = 5, 3
SALTS = 16
MAX_BROADCAST = 200_000
_BETWEEN = r"(?:(?<!\p{Punct})\p{Punct}++)?+[ \t-\r]++\p{Punct}*+|^\p{Punct}++|(?<!\p{Punct})\p{Punct}++\z"


def normal_words(text: Column) -> Column:
    """Lower-cased words; punctuation at their ends is not part of them.

    A run of punctuation is read once, from its first character: the pattern is linear in the text.
    """
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _BETWEEN, -1), lambda w: w != F.lit(""))


def shingle_hashes(words: Column, width: int = WORDS) -> Column:
    """64-bit hashes of the runs of ``width`` words of an array of words, in order."""
    return F.when(
        F.size(words) >= width,
        F.transform(F.sequence(F.lit(1), F.size(words) - F.lit(width - 1)), lambda i: F.xxhash64(*[F.get(words, i + F.lit(k - 1)) for k in range(width)])),
    ).otherwise(F.array().cast("array<bigint>"))


def _hashed(text: Column, widths: list[int]) -> Column:
    """The shingles of all these widths."""
    return common.let(normal_words(text), lambda w: F.concat(*[shingle_hashes(w, n) for n in widths]) if len(widths) > 1 else shingle_hashes(w, *widths))


def _set(text: Column, least_words: int) -> Column:
    """A reference's width and its shingles: runs of five words, or all its words if they are fewer."""
    of_width = lambda w: F.coalesce(*[F.when(F.size(w) == n, shingle_hashes(w, n)) for n in range(least_words, WORDS)], shingle_hashes(w))
    return common.let(normal_words(text), lambda w: F.struct(F.least(F.size(w), F.lit(WORDS)).alias("width"), F.array_sort(F.array_distinct(of_width(w))).alias("ref_shingles")))


def references(refs: DataFrame, ref_id: str, threshold: float, least_words: int = LEAST_WORDS) -> tuple[DataFrame, DataFrame]:
    """(ref, set, ref_n, ref_shingles, bands, width) of the references that have a shingle, and (value, refs): for each of their
    shingles the references of which it is a band.  Rows that repeat an id are one reference for each distinct set."""
    sets = refs.where(F.col(ref_id).isNotNull()).select(F.col(ref_id).alias("ref"), _set(F.col("text"), least_words).alias("s")).select("ref", "s.*").where(F.size("ref_shingles") > 0).distinct()
    n = F.size("ref_shingles")
    k = (n - F.ceil(F.lit(threshold) * n) + 1).cast("int")
    each = sets.select("*", F.explode("ref_shingles").alias("value"))
    held = each.groupBy("value").agg(F.count(F.lit(1)).alias("f"))
    u = (F.shiftrightunsigned("value", 12) + F.lit(0.5)) / F.lit(float(1 << 52))
    least = F.transform(F.array_sort(F.collect_list(F.struct((-F.ln(u) * F.col("f")).alias("key"), "value"))), lambda x: x["value"])
    sketches = each.join(held, "value").groupBy("ref", "width", "ref_shingles").agg(least.alias("o"))
    sketches = sketches.select("ref", F.xxhash64("ref_shingles").alias("set"), n.alias("ref_n"), "ref_shingles", F.slice("o", F.lit(1), k).alias("bands"), "width")
    sketches = common.materialize(sketches, "references")
    banded = sketches.select(F.explode("bands").alias("value"), F.struct("ref", "set").alias("r"))
    unbanded = sketches.select(F.explode("ref_shingles").alias("value"), F.lit(None).cast(banded.schema["r"].dataType).alias("r"))
    return sketches, banded.unionByName(unbanded).groupBy("value").agg(F.collect_set("r").alias("refs"))


def _salted(big: DataFrame, small: DataFrame, on: list[str], spread: str) -> DataFrame:
    """An inner join whose keys are dealt over SALTS tasks each: by ``spread`` on the big side, copied on the small one."""
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(copies, [*on, "_salt"]).drop("_salt")


def search(docs: DataFrame, refs: DataFrame, ref_id: str, threshold: float = 0.8, max_broadcast: int = MAX_BROADCAST, doc_id: str = "doc_id", least_words: int = LEAST_WORDS) -> DataFrame:
    """Pairs (doc_id, ref, n_shared, ref_n, containment) with containment of at least ``threshold``.

    Nulls: a null text has no words; null ids are dropped on either side.  References under ``least_words`` words are in too many
    texts to tell anything and match nothing.  Rows that repeat an id are texts of their own: a pair is found if one
    text of doc_id holds enough of one text of ref, and the pair of texts with the highest containment (then the longest
    reference) counts.
    """
    sketches, index = references(refs, ref_id, threshold, least_words)
    fits = int(sketches.agg(F.coalesce(F.sum("ref_n"), F.lit(0))).first()[0]) <= max_broadcast
    widths = sorted(r[0] for r in sketches.select("width").distinct().collect()) or [WORDS]  # five at most
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    windows = rows.select("doc_id", F.xxhash64("text").alias("row"), F.explode(_hashed(F.col("text"), widths)).alias("value"))
    hits = windows.join(F.broadcast(index), "value") if fits else _salted(windows, index, ["value"], "row")
    hits = common.materialize(hits.dropDuplicates(["doc_id", "row", "value"]), "hits")
    candidates = hits.select("doc_id", "row", F.explode("refs").alias("r")).select("doc_id", "row", "r.*").distinct()
    checks = sketches.select("ref", "set", "ref_n", "ref_shingles")
    retrieved = candidates.join(F.broadcast(checks), ["ref", "set"]) if fits else _salted(candidates, checks, ["ref", "set"], "row")
    wanted = retrieved.select("doc_id", "row", "ref", "set", "ref_n", F.explode("ref_shingles").alias("value"))
    shared = wanted.join(hits.select("doc_id", "row", "value"), ["doc_id", "row", "value"]).groupBy("doc_id", "row", "ref", "set", "ref_n").agg(F.count(F.lit(1)).cast("int").alias("n_shared"))
    found = shared.where(F.col("n_shared") >= F.lit(threshold) * F.col("ref_n"))
    best = F.max(F.struct((F.col("n_shared") / F.col("ref_n")).alias("containment"), "ref_n", "n_shared")).alias("b")
    return found.groupBy("doc_id", "ref").agg(best).select("doc_id", "ref", "b.n_shared", "b.ref_n", "b.containment")
