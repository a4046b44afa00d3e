"""Many wordings at once: the queries are a table, and each text is read once for all of them.

An automaton of the queries' keys runs over each text's key, so the time doesn't grow with the number of queries but with what
they find.  Queries come to the tasks in rounds of QUERY_CHARS characters of keys, one for nearly every table of queries;
what a task finds is added up there, by query, before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from . import concordance

QUERY_CHARS = 4_000_000
_FOLD = {ord(a): ord(b) for a, b in text.FOLDS.items()}


@F.pandas_udf(T.StringType())
def _key(query: pd.Series) -> pd.Series:
    return query.map(lambda q: None if q is None else text.query_key(q))


class Finder:
    """Occurrences of the keys of a round in texts."""

    def __init__(self, keys: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, k in enumerate(keys):
            self.automaton.add_word(k, (i, len(k)))
        self.automaton.make_automaton()

    def occurrences(self, t: str) -> Iterator[tuple[int, bool, bool]]:
        """(key, whether no other blank than the key drops stands in it, whether a line or object mark does)."""
        code = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        mark, line = np.isin(code, _MARKS), np.isin(code, _LINES)
        at = np.flatnonzero(~(mark | np.isin(code, _BLANKS)))
        kept = code[at]
        for c in np.intersect1d(kept, _FOLDED):
            kept[kept == c] = _FOLD[int(c)]
        odd = np.concatenate([[0], np.cumsum(np.isin(code, _BLANKS) & ~mark)])
        broken = np.concatenate([[0], np.cumsum(line)])
        for end, (i, n) in self.automaton.iter(kept.tobytes().decode("utf-32-le", "surrogatepass")):
            a, b = at[end - n + 1], at[end] + 1
            yield i, odd[a] == odd[b], broken[a] != broken[b]


_FOLDED = np.array(sorted(_FOLD), np.uint32)
_MARKS = np.array([ord(c) for c in text.DROPPED], np.uint32)
_LINES = np.array([10, ord(text.OBJECT)], np.uint32)
_BLANKS = np.array([c for c in range(0x3001) if chr(c).isspace()], np.uint32)


def compare_table(segments: DataFrame, exams: DataFrame, queries: DataFrame, **filters) -> DataFrame:
    """queries(qid, query) with hits, total (occurrences that can be decided) and undecided, as ``compare`` gives them.

    A query whose key is empty or null is found nowhere; queries of one key share what is found; a repeated qid counts for each.
    """
    spark = queries.sparkSession
    keyed = queries.select("qid", "query", _key("query").alias("key"))
    distinct = keyed.where("key <> ''").select("key").distinct()
    size = distinct.agg(F.coalesce(F.sum(F.length("key")), F.lit(0))).first()[0]
    rounds = max(1, -(-size // QUERY_CHARS))
    rows = concordance.corpus(segments, exams).where(concordance.predicates(**filters)).where("text is not null").select("text")
    found = None
    for r in range(rounds):
        keys = sorted(x[0] for x in distinct.where(F.pmod(F.xxhash64("key"), F.lit(rounds)) == r).collect())  # bounded by QUERY_CHARS
        if not keys:
            continue
        sent = spark.sparkContext.broadcast(keys)

        def run(batches, sent=sent):
            finder, names = Finder(sent.value), sent.value
            for batch in batches:
                sums: dict[int, list[int]] = {}
                for t in batch["text"]:
                    here: dict[int, list] = {}
                    for i, plain, broken in finder.occurrences(t):
                        n = here.setdefault(i, [False, 0, 0])
                        n[0] |= bool(plain)
                        n[1 + bool(broken)] += 1
                    for i, (held, total, undecided) in here.items():
                        if held:
                            n = sums.setdefault(i, [0, 0, 0])
                            n[0], n[1], n[2] = n[0] + 1, n[1] + total, n[2] + undecided
                yield pd.DataFrame([(names[i], *n) for i, n in sums.items()], columns=["key", "hits", "total", "undecided"])

        one = rows.mapInPandas(run, "key string, hits long, total long, undecided long")
        found = one if found is None else found.unionByName(one)
    counts = ("hits", "total", "undecided")
    if found is None:
        return keyed.select("qid", "query", *[F.lit(0).cast("long").alias(c) for c in counts])
    sums = found.groupBy("key").agg(*[F.sum(c).alias(c) for c in counts])
    return keyed.join(sums, "key", "left").select("qid", "query", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts])
