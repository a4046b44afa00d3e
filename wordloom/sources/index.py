"""Where wordings can be: postings of key trigrams by segment, and which short grams a file of segments holds.

A posting is the list of one file's segments that hold a gram, so no list is longer than a file has segments and a gram that
all segments hold has one list for each file.  Postings are sorted by gram, so a lookup reads the pages of its grams
alone.  Both tables are made of the segments of one change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

POSTINGS, PRESENCE = "gram string, slot int, ids array<long>", "gram string, slot int"
SIZE = 3
#: Grams of a wording that are looked up, at most: Parquet's readers skip by as many values of a filter.
PROBES = 10
#: Files of segments for each file of postings.
FILES = 8


def _grams(key: Column, size: int) -> Column:
    """The distinct grams of a key, in time linear in it."""
    chars = F.split(key, "", -1)
    whole = lambda c: F.transform(c, lambda x, i: F.concat(x, *[F.get(c, i + k) for k in range(1, size)]))
    return F.array_distinct(F.filter(F.get(F.transform(F.array(chars), whole), F.lit(0)), lambda g: g.isNotNull() & (F.length(g) == size)))


def postings(segments: DataFrame) -> DataFrame:
    """gram, slot, ids of segments(segment_id, slot, text)."""
    rows = segments.where("text is not null").select("slot", "segment_id", F.explode(_grams(text.key("text"), SIZE)).alias("gram"))
    lists = rows.groupBy("gram", "slot").agg(F.array_sort(F.collect_list("segment_id")).alias("ids"))
    files = -(-segments.select("slot").distinct().count() // FILES)
    return lists.repartitionByRange(max(1, files), "gram", "slot").sortWithinPartitions("gram", "slot").select("gram", "slot", "ids")


def presence(segments: DataFrame, postings: DataFrame) -> DataFrame:
    """gram, slot of grams of one and two characters: those of the trigrams, and of keys too short to have one."""
    part = lambda a, n: F.substring("gram", a, n)
    inner = postings.select("gram", "slot").distinct().select("slot", F.explode(F.array(part(1, 1), part(2, 1), part(3, 1), part(1, 2), part(2, 2))).alias("gram"))
    keys = segments.select("slot", text.key("text").alias("gram")).where(F.length("gram").between(1, SIZE - 1)).distinct()
    short = keys.select("slot", F.explode(F.array("gram", part(1, 1), part(2, 1))).alias("gram")).where("gram <> ''")
    return inner.unionByName(short).distinct().repartitionByRange(1, "gram").sortWithinPartitions("gram").select("gram", "slot")


def candidates(postings: DataFrame, key: str) -> DataFrame:
    """lot (a part's id), slot, ids: a file's segments that hold as many of the key's trigrams as are looked up."""
    grams = list(dict.fromkeys(key[i : i + SIZE] for i in range(len(key) - SIZE + 1)))
    if len(grams) > PROBES:  # evenly from all of them; the exact check is the search's
        grams = [grams[i * len(grams) // PROBES] for i in range(PROBES)]
    lists = postings.where(F.col("gram").isin(grams)).groupBy("lot", "slot").agg(F.array_sort(F.collect_list(F.struct(F.size("ids").alias("n"), "ids"))).alias("lists"))
    shared = F.aggregate(F.slice("lists", 2, len(grams)), F.get("lists", F.lit(0))["ids"], lambda a, x: F.array_intersect(a, x["ids"]))
    return lists.where(F.size("lists") == len(grams)).select("lot", "slot", shared.alias("ids")).where(F.size("ids") > 0)
