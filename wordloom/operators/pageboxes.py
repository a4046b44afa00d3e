"""Where on a page a wording stands: boxes of its characters, joined along each line.

A page's characters are gathered in order without blanks, as a search key has them, and the wording's places are compared
as slices of that array.  Each occurrence's boxes are then folded: a character whose top is within 0.7 of its height of
the run's is joined to the run, any other begins a new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: How far from a run's top a character may be, in its own heights.
SAME_LINE = 0.7
_RUN = "array<struct<x:double,y:double,w:double,h:double>>"


def _joined(runs: Column, b: Column) -> Column:
    last = F.get(runs, F.size(runs) - 1)
    left = F.least(last["x"], b["x"])
    wider = F.struct(left.alias("x"), last["y"].alias("y"), (F.greatest(last["x"] + last["w"], b["x"] + b["w"]) - left).alias("w"), F.greatest(last["h"], b["h"]).alias("h"))
    own = F.struct(*[b[c].alias(c) for c in "xywh"])
    same = F.coalesce(F.abs(b["y"] - last["y"]) < b["h"] * SAME_LINE, F.lit(False))
    return F.when(same, F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(wider))).otherwise(F.concat(runs, F.array(own)))


def boxes(chars: DataFrame, query: str, page: str = "page_id") -> DataFrame:
    """Runs of boxes of each occurrence, overlapping ones too: page, occurrence, run (both from 0), x, y, w, h.

    chars: page, pos, ch (one character), x, y, w, h.  Rows with a null in any of them are no characters; an empty query is
    nowhere.
    """
    key = [*text.query_key(query)]
    kept = chars.where(~F.col("ch").rlike(f"^[{text.BLANK}{text.OBJECT}]$")).dropna(subset=[page, "pos", "ch", "x", "y", "w", "h"])
    one = F.struct("pos", text.key(F.col("ch")).alias("ch"), *[F.col(c).cast("double").alias(c) for c in "xywh"])
    pages = kept.groupBy(page).agg(F.array_sort(F.collect_list(one)).alias("cs"))
    if not key:
        pages = pages.limit(0)
    wanted, n = F.array(*map(F.lit, key)) if key else F.array().cast("array<string>"), len(key)
    pages = pages.withColumn("keys", F.transform("cs", lambda c: c["ch"])).where(F.size("keys") >= n)
    at = F.filter(F.sequence(F.lit(1), F.size("keys") - n + 1), lambda i: F.slice(F.col("keys"), i, n) == wanted)
    hits = pages.select(page, "cs", F.posexplode(at).alias("occurrence", "at"))
    runs = F.aggregate(F.slice("cs", F.col("at"), n), F.array().cast(_RUN), _joined)
    return hits.select(page, "occurrence", F.posexplode(runs).alias("run", "b")).select(page, "occurrence", "run", "b.*")
