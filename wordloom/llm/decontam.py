"""Benchmark decontamination: benchmark items found inside documents by size-partitioned MinHash containment search.

Every stage is a DataFrame function; see containment.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import containment
from .licenses import _WORDS


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs (doc_id, item_id, n_shared, n_shingles): the document holds at least ``threshold`` of the item's shingles.

    Items of three or four words are one shingle, and shorter ones match nothing.  Null ids and texts match nothing; an empty table
    on either side gives no pair.  Rows that repeat a doc_id are texts of their own; the best of them counts.
    """
    found = containment.search(docs, benchmark, "item_id", threshold)
    return found.select("doc_id", F.col("ref").alias("item_id"), F.col("n_shared").cast("long"), F.col("ref_n").cast("long").alias("n_shingles"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of docs that hold no benchmark item; rows with a null doc_id stay.  Where one row of a doc_id holds one, all go."""
    leaks = find_leaks(docs, benchmark, threshold).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(leaks, docs["doc_id"] == leaks["_leak"], "left_anti")


def op10_benchmark_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find_leaks(docs, benchmark)


OP10_SQL = (
    f"WITH tw AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark WHERE item_id IS NOT NULL),\n"
    "ts AS (SELECT DISTINCT item_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s FROM tw, unnest(range(1, greatest(len(w) - 3, 2))) AS r(i) WHERE len(w) >= 3),\n"
    "tn AS (SELECT item_id, count(*) AS n FROM ts GROUP BY ALL),\n"
    f"dw AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format('text')} AS w FROM documents WHERE doc_id IS NOT NULL),\n"
    "ds AS (SELECT DISTINCT dw.r, doc_id, array_to_string(w[i:i + k - 1], ' ') AS s FROM dw, (SELECT DISTINCT least(5, len(w)) AS k FROM tw WHERE len(w) >= 3), unnest(range(1, len(w) - k + 2)) AS x(i)),\n"
    "m AS (SELECT r, doc_id, item_id, count(*) AS c FROM ds JOIN ts USING (s) GROUP BY ALL)\n"
    "SELECT doc_id, item_id, CAST(max(c) AS BIGINT) AS n_shared, CAST(n AS BIGINT) AS n_shingles FROM m JOIN tn USING (item_id) WHERE c >= 0.8 * n GROUP BY ALL"
)
