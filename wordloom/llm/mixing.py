"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words: its share by weight of ``share`` times all words, at most ``most`` times its own; what a
capped source can't take is shared anew by weight until none is above its cap.  A document's expected copies are
target / source size (times its own ``weight`` against its source's, where one is given, at most ``most``).  Their whole part
is certain; the rest is its inclusion probability p.  Documents are ranked by random odds divided by inclusion odds,
u / (1 - u) / (p / (1 - p)), and a source takes the first of them as far as they fit into the words that are left.

The sample's size is fixed in words.  A prefix of whole documents misses it by less than the next document, so up to
``touches`` documents of a source, each the one that brings its words nearest, are then put in or taken out.

``u`` is a hash of the seed and doc_id, so reruns agree and no order of rows matters.  A rank is cut without sorting a
source: its documents are dealt by rank to about sqrt(n) buckets, bucket sums find the one in which the words run out, and only
that bucket is sorted.  Sources may be any number and one may hold all rows.

Null texts have no words; documents without words are taken 0 words of.  A null source is one of its own, last in order.
Rows that repeat are documents of their own; of equal ones any may be taken.  Null doc_ids share one ``u``
and are ranked by size.  Null or negative weights of documents count as 0.  An empty table gives an empty mix.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS, SHARE, MOST, TOUCHES = (5, 2, 1), Fraction(3, 2), 2, 4
BROADCAST_SOURCES, SALTS = 200_000, 16
WORD = r"[^ \t-\r]+"


def _whole(x: int) -> Column:
    return F.lit(Decimal(x)).cast("decimal(38,0)")


def _with_source(rows: DataFrame, facts: DataFrame, n_sources: int) -> DataFrame:
    """Rows with their source's facts: broadcast up to BROADCAST_SOURCES, beyond that dealt over SALTS tasks a source."""
    facts = facts.withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if n_sources <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(facts), same).drop("_source")
    facts = facts.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", (F.col("id") % SALTS).cast("int")).join(facts, same & (F.col("_salt") == F.col("_copy"))).drop("_source", "_salt", "_copy")


def _ordered(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Sources with their weights, which repeat in order of code points: ranges are ranked apart and then moved on."""
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = common.materialize(sources.repartitionByRange(tasks, F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()), "sources")
    before = F.sum("n_sources").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    moved = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n_sources")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source"))) - 1 + F.col("before")
    weight = F.get(F.array(*map(F.lit, weights)), (place % len(weights)).cast("int"))
    return ranged.join(F.broadcast(moved), "part").withColumn("w", weight.cast("decimal(38,0)")).drop("part", "before")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> DataFrame:
    """sources(source, source_size, ...) with ``target``: one pass over sources for each round of resharing."""
    sources = common.materialize(_ordered(sources, weights), "weighed")
    size = F.col("source_size").cast("decimal(38,0)")
    cap = size * _whole(most)
    all_words, all_weights = (int(x or 0) for x in sources.agg(F.sum(size), F.sum("w")).first())
    # A share is w * num / den, in whole numbers.
    num, den = all_words * share.numerator, max(all_weights, 1) * share.denominator
    while True:
        above = F.col("w") * _whole(num) > cap * _whole(den)
        capped, rest = (int(x or 0) for x in sources.agg(F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("w")))).first())
        last, (num, den) = (num, den), (all_words * share.numerator - capped * share.denominator, max(rest, 1) * share.denominator)
        if (num, den) == last:
            return sources.withColumn("target", F.when(above, cap.cast("double")).otherwise((F.col("w") * _whole(num)).cast("double") / F.lit(float(den)))).drop("w")


def _expected(sized: DataFrame, facts: DataFrame, n_sources: int, most: int) -> DataFrame:
    """Facts with ``per``: copies for each unit of a document's weight, so that their words come to the target."""
    facts = facts.withColumn("per", F.col("target") / F.col("units"))
    while True:
        full = F.col("weight") * F.col("per") >= most
        sums = _with_source(sized, facts, n_sources).groupBy("source").agg(F.sum(F.when(full, F.col("size"))).alias("full"), F.sum(F.when(~full, F.col("weight") * F.col("size"))).alias("open"))
        back = sums.select(F.struct("source").alias("s"), "full", "open")
        after = facts.join(back, F.struct(facts["source"]) == F.col("s"), "left").drop("s")
        per = F.when(F.coalesce("open", F.lit(0)) == 0, F.col("per")).otherwise((F.col("target") - most * F.coalesce("full", F.lit(0))) / F.col("open"))
        after = common.materialize(after.withColumn("now", F.greatest(per, F.col("per"))).withColumn("moved", F.col("now") > F.col("per") * (1 + 1e-12)).drop("full", "open"), "expected")
        moved = after.where("moved").limit(1).count()
        facts = after.withColumn("per", F.col("now")).drop("now", "moved")
        if not moved:
            return facts


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MOST, seed: int = 0, source: str = "source", weight: str | None = None, touches: int = TOUCHES) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (words: copies times size) of each document.

    ``weight`` names a column of whole numbers: copies expected of a document against others of its source.
    """
    unit = F.greatest(F.coalesce(F.col(weight).cast("long"), F.lit(0)), F.lit(0)) if weight else F.lit(1)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), unit.cast("long").alias("weight"))
    sized = common.materialize(own.withColumn("id", F.monotonically_increasing_id()), "sized")
    sums = common.materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("weight") * F.col("size")).alias("units"), F.count(F.lit(1)).alias("n")), "sums")
    n_sources = sums.count()
    facts = common.materialize(targets(sums, weights, share, most), "targets")
    if weight:
        facts = _expected(sized, facts, n_sources, most)
        copies = F.coalesce(F.least(F.lit(float(most)), F.col("weight") * F.col("per")), F.lit(0.0))
    else:
        copies = F.coalesce(F.col("target") / F.nullif("source_size", F.lit(0)), F.lit(0.0))
    p = F.col("m") - F.col("whole")
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    ranked = _with_source(sized, facts, n_sources).withColumn("m", copies).withColumn("whole", F.floor("m"))
    ranked = ranked.withColumn("p", p).withColumn("u", u).withColumn("q", F.when(F.col("p") > 0, F.col("u") / (1 - F.col("u")) / (F.col("p") / (1 - F.col("p")))))
    # Ranks as a share of 1, evenly spread where documents of a source have like odds.
    even = F.col("q") * (F.col("mid") / (1 - F.col("mid")))
    ranked = common.materialize(ranked.select("id", "doc_id", "source", "size", "source_size", "target", "n", "whole", "p", "q"), "ranked")
    left = ranked.groupBy("source").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("rest"), F.avg(F.when(F.col("p") > 0, F.col("p"))).alias("mid"))
    facts = common.materialize(left, "rest")
    order = F.struct("q", "doc_id", "size", "id")
    spread = F.ceil(F.sqrt("n")).cast("int")
    bucket = F.least(F.floor((1 - 1 / (1 + even)) * spread).cast("int"), spread - 1)
    dealt = _with_source(ranked.where("p > 0"), facts, n_sources).withColumn("bucket", bucket)
    summed = dealt.groupBy("source", "bucket", "rest").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
    crossed = summed.withColumn("upto", upto).where("upto > rest").groupBy("source", "rest").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("c"))
    cut = common.materialize(crossed.select("source", "c.bucket", "c.before"), "cut")
    there = _with_source(dealt.withColumnRenamed("bucket", "own"), cut, n_sources).where("own = bucket")
    fits = F.sum("size").over(Window.partitionBy("source").orderBy(order)) + F.col("before") <= F.col("rest")
    last = there.withColumn("fits", fits).where("fits").groupBy("source").agg(F.max(order).alias("last"), F.sum("size").alias("more"))
    same = lambda a, b: a["source"].eqNullSafe(b["s"])
    cut, last, every = cut.withColumnRenamed("source", "s"), last.withColumnRenamed("source", "s2"), dealt.groupBy("source").agg(F.sum("size").alias("words"))
    facts = facts.join(cut, same(facts, cut), "left").drop("s")
    facts = facts.join(last, facts["source"].eqNullSafe(last["s2"]), "left").drop("s2")
    every = every.withColumnRenamed("source", "s")
    facts = facts.join(every, same(facts, every), "left").drop("s")
    taken = F.when(F.col("bucket").isNull(), F.coalesce("words", F.lit(0))).otherwise(F.col("before") + F.coalesce("more", F.lit(0)))
    facts = common.materialize(facts.select("source", "rest", "mid", "bucket", "last", taken.alias("words"), F.array().cast("array<bigint>").alias("turned")), "cuts")
    own_bucket = F.when(F.col("p") > 0, bucket)
    first = F.coalesce(F.col("bucket").isNull() | (own_bucket < F.col("bucket")) | ((own_bucket == F.col("bucket")) & (order <= F.col("last"))), F.lit(False)) & (F.col("p") > 0)
    chosen = first != F.array_contains("turned", F.col("id"))
    for _ in range(touches):
        gain = F.when(F.col("chosen"), -F.col("size")).otherwise(F.col("size"))
        miss = F.col("rest") - F.col("words")
        near = F.struct(F.abs(miss - F.col("gain")).alias("miss"), "q", "doc_id", "size", "id", "gain")
        open_ = _with_source(ranked.where("p > 0"), facts, n_sources).withColumn("chosen", chosen).withColumn("gain", gain)
        best = open_.where(F.abs(miss - F.col("gain")) < F.abs(miss)).groupBy("source").agg(F.min(near).alias("best")).withColumnRenamed("source", "s")
        after = facts.join(best, same(facts, best), "left").drop("s")
        turned = F.when(F.col("best").isNull(), F.col("turned")).otherwise(F.concat("turned", F.array("best.id")))
        facts = common.materialize(after.withColumns({"words": F.col("words") + F.coalesce("best.gain", F.lit(0)), "turned": turned}).drop("best"), "turned")
    out = _with_source(ranked, facts, n_sources).withColumn("copies", (F.col("whole") + chosen.cast("int")).cast("int"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op11_source_mixing(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


_TOUCH = """
n{0} AS (SELECT *, CASE WHEN ch THEN -size ELSE size END AS gain, rest - sum(CASE WHEN ch THEN size ELSE 0 END) OVER (PARTITION BY k) AS miss FROM c{0}),
b{0} AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN p > 0 AND abs(miss - gain) < abs(miss) THEN 0 ELSE 1 END, abs(miss - gain), q, doc_id) AS o FROM n{0}),
c{1} AS (SELECT doc_id, size, source_size, target, k, whole, p, q, rest, CASE WHEN o = 1 AND p > 0 AND abs(miss - gain) < abs(miss) THEN NOT ch ELSE ch END AS ch FROM b{0}),"""
OP11_SQL = (
    r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, sum(source_size) OVER () AS t FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY source_size / w, k) AS i FROM w),
r AS (SELECT *, coalesce(sum(2 * source_size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c, sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM o),
f AS (SELECT 3 * t - 2 * c AS num, 2 * r AS den FROM r WHERE w * (3 * t - 2 * c) <= 4 * source_size * r ORDER BY i LIMIT 1),
g AS (SELECT source, source_size, k, CASE WHEN w * num > 2 * source_size * den THEN 2 * source_size::DOUBLE ELSE (w * num)::DOUBLE / den::DOUBLE END AS target FROM r, f),
m AS (SELECT doc_id, size, source_size, target, k, coalesce(target / nullif(source_size, 0)::DOUBLE, 0) AS m, (('0x' || left(md5('0:' || doc_id), 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
h AS (SELECT *, floor(m) AS whole, m - floor(m) AS p FROM m),
q AS (SELECT *, CASE WHEN p > 0 THEN u / (1 - u) / (p / (1 - p)) END AS q, target - sum(whole * size) OVER (PARTITION BY k) AS rest FROM h),
c0 AS (SELECT *, p > 0 AND sum(size) OVER (PARTITION BY k ORDER BY q NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) <= rest AS ch FROM q),"""
    + "".join(_TOUCH.format(i, i + 1) for i in range(TOUCHES))
    + f"""
z AS (SELECT * FROM c{TOUCHES})
SELECT doc_id, size, source_size, target, CAST(size * (whole + ch::INT) AS BIGINT) AS taken FROM z"""
)
