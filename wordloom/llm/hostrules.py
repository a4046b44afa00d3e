"""Quality rules with host verdicts.

Each document gets base counts and a base verdict; failures are added up by host (``source``), each host's rate is
shrunk towards an empirical beta prior, and the hosts' verdicts are joined back to the documents.

The prior comes from all hosts' rates by moments: mean m, and variance v less what counting alone gives,
m (1 - m) times the mean of 1 / documents; its strength m (1 - m) / v - 1 is held within [1, 10000], and is 10000 where
nothing is left of v.  A host fails if (failures + m * strength) / (documents + strength) exceeds ``max_host_rate``;
then none of its documents is kept.  Documents without a host (null) share one.  Null texts have no words and fail the
base rules.  Rows with a null doc_id keep that null; rows that repeat are counted, and judged, each.

The counts are written once to the shared folder and read for both uses.  Hosts' rates are broadcast up to
BROADCAST_HOSTS of them (counted first); beyond that the join is dealt over SALTS tasks for each host.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, kernels
from .kernels import U64

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT, MAX_HOST_RATE = 10, 20, 0.5
BROADCAST_HOSTS, SALTS = 200_000, 16
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def _repeated(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Flags of the hashes that occur twice or more in their document."""
    key = kernels.mix(h + owner.astype(U64) * U64(0x9E3779B97F4A7C15), 3)
    order = np.argsort(key)
    s = key[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(h), bool)
    out[order] = np.append(same, False) | np.append(False, same) if len(h) else False
    return out


def base_counts(text) -> dict[str, np.ndarray]:
    words = kernels.Words(text)
    buf, off = words.buf, words.text_off
    n = len(buf)
    inside = ~kernels.SPACE[buf]
    chars = _per_doc(inside & ((buf & 0xC0) != 0x80), off)
    # Lines: cut at \n and at the ends of documents.
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    newline = np.flatnonzero(buf == 10)
    start = np.unique(np.concatenate([np.flatnonzero(cut[:n]), newline + 1]))
    start = start[start < n]
    end = np.append(start[1:], n)
    end = np.where((end > start) & (buf[np.maximum(end - 1, 0)] == 10), end - 1, end) if n else end
    doc = np.searchsorted(off, start, "right") - 1
    filled = np.concatenate([[0], np.cumsum(inside)])
    worded = filled[end] > filled[start]
    start, end, doc = start[worded], end[worded], doc[worded]
    line = words.range_hash(start, end)
    key = kernels.mix(line + doc.astype(U64) * U64(0x9E3779B97F4A7C15), 4)
    _, first = np.unique(key, return_index=True)
    later = np.ones(len(key), bool)
    later[first] = False
    n_docs = len(off) - 1
    dup = np.bincount(doc[later], minlength=n_docs)
    h, owner, at = kernels.windows(words, WINDOW)
    again = at[_repeated(h, owner)]
    edges = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(edges, again, 1)
    np.add.at(edges, again + WINDOW, -1)
    covered = np.cumsum(edges[:-1]) > 0
    return {"n_words": words.counts, "word_chars": chars, "n_symbols": _per_doc(SYMBOLS[buf], off), "n_dup_lines": dup, "n_repeat_words": _per_doc(covered, words.off)}


def _base(batches):
    for batch in batches:
        for part in kernels.slices(batch):
            got = base_counts(part.column("text"))
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "host": part.column("host")} | {c: pa.array(got[c].astype(np.int64)) for c in COUNTS})


def judge(docs: DataFrame, host: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """doc_id, host, the base counts, base_failed, host_rate (shrunk) and kept for each document."""
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), "text")
    base = rows.mapInArrow(_base, "doc_id long, host string, " + ", ".join(f"{c} long" for c in COUNTS))
    failed = (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words"))
    base = common.materialize(base.withColumn("base_failed", failed), "base")
    hosts = common.materialize(base.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("f")), "hosts")
    rate = F.col("f") / F.col("n")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), F.avg(F.lit(1.0) / F.col("n")).alias("k"), F.count(F.lit(1)).alias("hosts")).first()
    m = prior["m"] or 0.0
    v = (prior["v"] or 0.0) - m * (1 - m) * (prior["k"] or 0.0)
    strength = min(max(m * (1 - m) / v - 1, 1.0), 10_000.0) if v > 0 else 10_000.0
    rates = hosts.select(F.col("host").alias("_host"), ((F.col("f") + F.lit(m * strength)) / (F.col("n") + F.lit(strength))).alias("host_rate"))
    same = base["host"].eqNullSafe(rates["_host"])
    if prior["hosts"] <= BROADCAST_HOSTS:
        out = base.join(F.broadcast(rates), same, "left")
    else:
        rates = rates.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = base.withColumn("_salt", F.pmod(F.xxhash64("doc_id", *COUNTS), F.lit(SALTS)).cast("int")).join(rates, base["host"].eqNullSafe(rates["_host"]) & (F.col("_salt") == F.col("_copy")), "left").drop("_salt", "_copy")
    return out.drop("_host").withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= max_host_rate))


def op6_host_quality_rules(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", *COUNTS, "base_failed", "kept")


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
s AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS h FROM w, unnest(range(1, len(w) - 3)) AS t(i)),
g AS (SELECT r, h FROM s GROUP BY ALL HAVING count(*) > 1),
c AS (SELECT r, count(DISTINCT i + o) AS n FROM s JOIN g USING (r, h), range(0, 5) AS x(o) GROUP BY r),
b AS (SELECT r, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN c USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM f GROUP BY source),
o AS (SELECT avg(f / n) AS m, var_pop(f / n) AS u, avg(1.0 / n::DOUBLE) AS k FROM h),
p AS (SELECT m, u - m * (1 - m) * k AS v FROM o),
q AS (SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1), 10000) ELSE 10000 END AS k FROM p),
v AS (SELECT source, (f + m * k) / (n + k) <= 0.5 AS good FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND good AS kept FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source"""
