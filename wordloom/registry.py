"""All queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import meta, text
from .operators import concordance as c
from .operators import layout, maintenance, pageboxes, segmenting, wordings
from .plans import schemas
from .plans import views as v
from .sources import archive, page

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql.replace("$A", v.SQL)


def _hits(s, d, q, **f):
    return c.matches(v.segments_a(s, d), v.exams_a(s, d), q, **f)


def _search(q, **f):
    return lambda s, d: c.search(v.segments_a(s, d), v.exams_a(s, d), q, **({"limit": None} | f)).select("segment_id", "exam_id", "source", "year", "exam", "number", "matches")


def _search_sql(q: str, where: str = "", tail: str = "") -> str:
    return f"WITH $A SELECT segment_id, exam_id, source_label AS source, CAST(year AS INT) AS year, exam, number, CAST(len(list_filter(range(1, length(key) - {len(q) - 1} + 1), lambda i: substr(key, i, {len(q)}) = '{q}')) AS BIGINT) AS matches FROM ex WHERE contains(key, '{q}') {where} {tail}"


_add("search_basic", _search("of the"), _search_sql("ofthe"))
_add("search_short", _search("ß"), _search_sql("ß"))
_add("search_filtered", _search("ofthe", subject="en", year=2017, exam="수능"), _search_sql("ofthe", "AND subject = 'en' AND year = 2017 AND exam LIKE '%수능%'"))
_add("search_topk", _search("theand", limit=50), _search_sql("theand", "", "ORDER BY year DESC NULLS LAST, subject NULLS FIRST, number NULLS FIRST, segment_id LIMIT 50"))
_add("overlap_count", _search("haha"), _search_sql("haha"))

_forms = lambda q: "(" + "[ \\n\\t￼]*".join(q.replace(".", "[.]") if len(q) == 1 else [ch if ch != "." else "[.]" for ch in q]) + ")"


def _variants_sql(q: str) -> str:
    return f"WITH $A, f AS (SELECT unnest(regexp_extract_all(text, '{_forms(q)}')) AS raw FROM ex WHERE contains(key, '{q}')) SELECT regexp_replace(raw, '[ \\t]+', ' ', 'g') AS form, CAST(count(*) AS BIGINT) AS n FROM f WHERE NOT regexp_matches(raw, '[\\n￼]') GROUP BY 1"


_add("variants", lambda s, d: c.variants(_hits(s, d, "of the")).select("form", "n"), _variants_sql("ofthe"))
_add("variants_share", lambda s, d: c.with_share(c.variants(_hits(s, d, "the and"))).select("form", "n", "total", "percent", "percent_down", "percent_up"), "WITH f AS (" + _variants_sql("theand").replace("WITH $A, f AS", "WITH $A, f AS") + "), t AS (SELECT *, CAST(sum(n) OVER () AS BIGINT) AS total FROM f) SELECT form, n, total, CAST(round_even(100 * n / total, 0) AS INT) AS percent, CAST(100 * n // total AS INT) AS percent_down, CAST((200 * n + total) // (2 * total) AS INT) AS percent_up FROM t")
_add("variants_ambiguous", lambda s, d: c.occurrence_totals(_hits(s, d, "e.Th")), f"WITH $A, f AS (SELECT segment_id, regexp_extract_all(text, '{_forms('e.Th')}') AS s FROM ex WHERE contains(key, 'e.Th')) SELECT CAST(count(*) AS BIGINT) AS hits, CAST(sum(len(s)) AS BIGINT) AS occurrences, CAST(sum(len(list_filter(s, lambda x: NOT contains(x, chr(10))))) AS BIGINT) AS decided, CAST(sum(len(list_filter(s, lambda x: contains(x, chr(10))))) AS BIGINT) AS undecided FROM f")
_add(
    "variants_sources",
    lambda s, d: c.variants(_hits(s, d, "of the")).select("form", "n", F.array_join("sources", "|").alias("sources")),
    f"WITH $A, f AS (SELECT year, subject, number, segment_id, source_label, unnest(regexp_extract_all(text, '{_forms('ofthe')}')) AS raw FROM ex WHERE contains(key, 'ofthe')), g AS (SELECT raw AS form, source_label AS source, count(*) AS n, min((-year, subject, number, segment_id)) AS first_at FROM f WHERE NOT contains(raw, chr(10)) GROUP BY ALL) SELECT form, CAST(sum(n) AS BIGINT) AS n, array_to_string(list_slice(list(source ORDER BY first_at), 1, 3), '|') AS sources FROM g GROUP BY form",
)
_add("surface_forms", lambda s, d: _hits(s, d, "ofthe").select("segment_id", F.array_join("surface", "|").alias("surface")), f"WITH $A SELECT segment_id, array_to_string(regexp_extract_all(text, '{_forms('ofthe')}'), '|') AS surface FROM ex WHERE contains(key, 'ofthe')")

def _asked(s, d):
    """Wordings from a table: every benchmark item's text."""
    return s.read.parquet(f"{d}/benchmark.parquet").where("item_id is not null").select(F.col("item_id").cast("long").alias("qid"), F.col("text").alias("query"))


_add(
    "compare_table",
    lambda s, d: wordings.compare_table(v.segments_a(s, d), v.exams_a(s, d), _asked(s, d)).select("qid", "hits", (F.col("total") + F.col("undecided")).alias("occurrences")),
    f"WITH $A, q AS (SELECT CAST(item_id AS BIGINT) AS qid, {v.KEY_SQL} AS q FROM benchmark WHERE item_id IS NOT NULL),"
    " h AS (SELECT qid, len(list_filter(range(1, length(key) - length(q) + 2), lambda i: substr(key, i, length(q)) = q)) AS n FROM q JOIN ex ON contains(key, q) AND q <> '') SELECT q.qid, CAST(count(h.n) AS BIGINT) AS hits, CAST(coalesce(sum(h.n), 0) AS BIGINT) AS occurrences FROM q LEFT JOIN h ON q.qid = h.qid GROUP BY q.qid",
)

_BOXED = "the"


def _characters(s, d):
    """Characters of conversations on a page of their own: 6 wide and 10 high, lines 12 apart."""
    lines = s.read.parquet(f"{d}/conversations.parquet").where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min("text").alias("text")).select((F.col("conv_id") * 1000 + F.col("turn")).alias("page_id"), F.posexplode(F.split("text", "\n")).alias("line", "t"))
    chars = lines.select("page_id", "line", F.posexplode(F.split("t", "")).alias("col", "ch")).where("ch <> ''")
    return chars.select("page_id", (F.col("line") * 100000 + F.col("col")).alias("pos"), "ch", (F.col("col") * 6.0).alias("x"), (F.col("line") * 12.0).alias("y"), F.lit(6.0).alias("w"), F.lit(10.0).alias("h"))


_add(
    "page_boxes",
    lambda s, d: pageboxes.boxes(_characters(s, d), _BOXED).select("page_id", "occurrence", "run", *[F.col(x).cast("int").alias(x) for x in ("x", "y", "w", "h")]),
    f"""WITH p AS (SELECT conv_id * 1000 + turn AS page_id, min(text) AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
l AS (SELECT page_id, string_split(text, chr(10)) AS ls FROM p), m AS (SELECT page_id, j, ls[j] AS t FROM l, unnest(range(1, len(ls) + 1)) AS x(j)),
c AS (SELECT page_id, j, i, t[i] AS ch FROM m, unnest(range(1, length(t) + 1)) AS x(i) WHERE t[i] NOT IN (' ', chr(9))),
k AS (SELECT *, row_number() OVER w AS n, ch || coalesce(lead(ch) OVER w, '') || coalesce(lead(ch, 2) OVER w, '') AS s FROM c WINDOW w AS (PARTITION BY page_id ORDER BY j, i)),
o AS (SELECT page_id, n, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS o FROM k WHERE s = '{_BOXED}'),
r AS (SELECT o.page_id, o, j, min(i) AS a, max(i) AS b FROM o JOIN k ON k.page_id = o.page_id AND k.n BETWEEN o.n AND o.n + 2 GROUP BY ALL)
SELECT page_id, CAST(o AS INT) AS occurrence, CAST(row_number() OVER (PARTITION BY page_id, o ORDER BY j) - 1 AS INT) AS run, CAST((a - 1) * 6 AS INT) AS x, CAST((j - 1) * 12 AS INT) AS y, CAST((b - a + 1) * 6 AS INT) AS w, 10 AS h FROM r""",
)

_WORDINGS = ["of the", "the and", "is and"]
_add(
    "compare",
    lambda s, d: c.compare(v.segments_a(s, d), v.exams_a(s, d), _WORDINGS),
    "WITH $A, f AS (" + " UNION ALL ".join(f"SELECT {i} AS ord, '{q}' AS query, regexp_extract_all(text, '{_forms(q.replace(' ', ''))}') AS s FROM ex WHERE contains(key, '{q.replace(' ', '')}')" for i, q in enumerate(_WORDINGS)) + ") SELECT CAST(ord AS INT) AS ord, query, CAST(count(*) AS BIGINT) AS hits, CAST(sum(len(list_filter(s, lambda x: NOT contains(x, chr(10))))) AS BIGINT) AS total, CAST(sum(len(list_filter(s, lambda x: contains(x, chr(10))))) AS BIGINT) AS undecided FROM f GROUP BY ALL",
)
_add("multi_term_union", lambda s, d: c.multi_term(v.segments_a(s, d), v.exams_a(s, d), "of the, is and"), f"WITH $A, f AS (SELECT segment_id, len(regexp_extract_all(text, '{_forms('ofthe')}')) AS a, len(regexp_extract_all(text, '{_forms('isand')}')) AS b FROM ex) SELECT segment_id, CAST((a > 0)::INT + (b > 0)::INT AS BIGINT) AS n_terms, CAST(a + b AS BIGINT) AS occurrences FROM f WHERE a + b > 0")
_P1, _P2 = "ofthe", "isand"
_span_sql = lambda q, i: f"list_transform(list_filter(range(1, length(key) - {len(q) - 1} + 1), lambda j: substr(key, j, {len(q)}) = '{q}'), lambda j: (pos[j], {i}, pos[j + {len(q) - 1}] + 1))"
_add(
    "multi_term_spans",
    lambda s, d: c.multi_term_spans(v.segments_a(s, d), v.exams_a(s, d), "of the, is and").select("segment_id", F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["term"], x["end"])), " ").alias("spans")),
    f"WITH $A, k AS (SELECT segment_id, key, list_filter(range(0, length(text)), lambda i: substr(text, i + 1, 1) NOT IN (' ', chr(10), chr(65532))) AS pos FROM ex WHERE contains(key, '{_P1}') OR contains(key, '{_P2}')), m AS (SELECT segment_id, list_sort(list_concat({_span_sql(_P1, 0)}, {_span_sql(_P2, 1)})) AS s FROM k) SELECT segment_id, array_to_string(list_transform(s, lambda x: x[1] || ':' || x[2] || ':' || x[3]), ' ') AS spans FROM m",
)
_add("snippet", lambda s, d: _hits(s, d, "ofthe").select("segment_id", text.snippet(F.col("text"), "ofthe").alias("snippet")), f"WITH $A, f AS (SELECT segment_id, text, regexp_extract(text, '{_forms('ofthe')}') AS hit FROM ex WHERE contains(key, 'ofthe')), g AS (SELECT *, strpos(text, hit) - 1 AS a, length(hit) AS m, length(text) AS n FROM f) SELECT segment_id, replace(CASE WHEN a > 60 THEN '…' ELSE '' END || substr(text, greatest(a - 60, 0) + 1, least(a, 60)) || '《' || hit || '》' || substr(text, a + m + 1, 60) || CASE WHEN a + m + 60 < n THEN '…' ELSE '' END, chr(10), ' ') AS snippet FROM g")
_add("subjects", lambda s, d: c.subjects(v.exams_a(s, d)), "WITH $A SELECT subject, CAST(count(*) AS BIGINT) AS n_exams, CAST(sum(n_questions) AS BIGINT) AS n_questions FROM exams GROUP BY subject")
_add("stats", lambda s, d: c.stats(v.segments_a(s, d), v.exams_a(s, d)), "WITH $A SELECT (SELECT count(*) FROM exams) AS exams, (SELECT CAST(4 * count(*) AS BIGINT) FROM exams) AS pages, (SELECT count(*) FROM ex) AS questions")
_add("coverage", lambda s, d: c.coverage(v.exams_a(s, d)), "WITH $A SELECT CAST(year AS INT) AS year, exam, subject, CAST(sum(n_questions) AS BIGINT) AS n_questions FROM exams GROUP BY ALL")
_add("coverage_pivot", lambda s, d: c.coverage_pivot(v.exams_a(s, d), ["de", "en", "es", "fr"]), "WITH $A SELECT CAST(year AS INT) AS year, exam, " + ", ".join(f"CAST(sum(n_questions) FILTER (subject = '{x}') AS BIGINT) AS {x}" for x in ("de", "en", "es", "fr")) + " FROM exams GROUP BY year, exam")
_add("missing_numbers", lambda s, d: c.missing_numbers(v.segments_a(s, d)).select("exam_id", F.array_join(F.col("missing").cast("array<string>"), ",").alias("missing")), "WITH $A, q AS (SELECT exam_id, max(number) AS m, list(DISTINCT number) AS s FROM ex GROUP BY exam_id) SELECT exam_id, array_to_string(list_filter(range(1, m + 1), lambda i: NOT list_contains(s, i)), ',') AS missing FROM q")
_add("segment_labels", lambda s, d: v.segments_b(s, d).select("segment_id", meta.segment_label(F.col("kind"), F.col("part"), F.col("number"), F.col("number_end")).alias("label")), "SELECT conv_id * 1000 + turn AS segment_id, CASE role WHEN 'user' THEN turn || '번' WHEN 'assistant' THEN turn || '~' || turn || '번 지문' ELSE '표지/안내' END AS label FROM conversations")
_DIRTY = "replace(replace(text, ', ', ' –  '), 'th', 't' || chr(8203) || 'h' || chr(57345) || chr(57346))"
_add("clean_text", lambda s, d: v.documents(s, d).select("doc_id", text.clean_text(F.expr("replace(replace(text, ', ', ' –  '), 'th', concat('t', unhex('E2808B'), 'h', unhex('EE8081'), unhex('EE8082')))").cast("string")).alias("cleaned")), f"SELECT doc_id, array_to_string(list_transform(string_split(replace(regexp_replace(nfc_normalize({_DIRTY}), '[\\x{{E000}}-\\x{{F8FF}}]+', '￼', 'g'), chr(8203), ''), chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), chr(10)) AS cleaned FROM documents")
_add("fold_key", lambda s, d: v.documents(s, d).select("doc_id", F.md5(text.key(F.replace("text", F.lit(", "), F.lit(" – ")))).alias("key_md5")), "SELECT doc_id, md5(translate(replace(text, ', ', ' – '), '– ' || chr(10), '-')) AS key_md5 FROM documents")
_add("unreadable_count", lambda s, d: v.documents(s, d).select("doc_id", text.unreadable_count(F.replace("text", F.lit("th"), F.expr("cast(unhex('EE8081') as string)"))).cast("long").alias("n_broken")), "SELECT doc_id, CAST(length(text) - length(replace(text, 'th', 't')) AS BIGINT) AS n_broken FROM documents")
_add("dedup_sha1", lambda s, d: v.documents(s, d).groupBy(F.sha1("text").alias("sha1")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")), "SELECT sha1(text) AS sha1, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")


def _papers(s, d):
    return v.documents(s, d).groupBy(F.sha1("text").alias("sha1")).agg(F.min("doc_id").alias("exam_id"), F.min("source").alias("source"))


# Papers in store, and papers that come in: two ranges of sources that overlap.
_STORED, _NEW = "source < 'src5'", "source > 'src11'"
_P = "p AS (SELECT sha1(text) AS sha1, min(doc_id) AS exam_id, min(source) AS source FROM documents GROUP BY 1)"
for _name, _force in (("upsert_skip", False), ("upsert_force", True)):
    _add(
        _name,
        lambda s, d, force=_force: maintenance.upsert(_papers(s, d).where(_STORED).withColumn("v", F.lit("old")), _papers(s, d).where(_NEW).withColumn("v", F.lit("new")), force).select("sha1", "exam_id", "v"),
        f"WITH {_P} SELECT sha1, exam_id, CASE WHEN NOT {_NEW} THEN 'old' WHEN NOT {_STORED} THEN 'new' ELSE '{'new' if _force else 'old'}' END AS v FROM p WHERE {_STORED} OR {_NEW}",
    )
_add("ingest_status", lambda s, d: maintenance.ingest_status(_papers(s, d).where(_STORED), _papers(s, d)), f"WITH {_P} SELECT sha1, CASE WHEN {_STORED} THEN 'skipped' ELSE 'added' END AS status FROM p")


def _shelf(s, d):
    i = F.col("doc_id")
    return v.documents(s, d).select(i.alias("exam_id"), F.concat(F.lit("/p/"), i % 50).alias("path"), (2015 + i % 7).cast("int").alias("year"), F.when(i % 4 > 0, F.concat(F.lit("x"), i % 4)).alias("exam"), F.col("lang").alias("subject"), F.when(i % 5 == 0, 0).otherwise(i % 30).cast("long").alias("n_questions"), (i % 4).cast("int").alias("parser"))


_S = "s AS (SELECT doc_id AS exam_id, '/p/' || doc_id % 50 AS path, 2015 + doc_id % 7 AS year, CASE WHEN doc_id % 4 > 0 THEN 'x' || doc_id % 4 END AS exam, lang AS subject, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE doc_id % 30 END AS n_questions, doc_id % 4 AS parser FROM documents)"
_add("replace_scanned", lambda s, d: maintenance.superseded(_shelf(s, d)).select("exam_id"), f"WITH {_S} SELECT exam_id FROM s a WHERE n_questions = 0 AND year IS NOT NULL AND subject IS NOT NULL AND EXISTS (SELECT 1 FROM s b WHERE b.n_questions > 0 AND b.exam_id <> a.exam_id AND b.year = a.year AND b.subject = a.subject AND b.exam IS NOT DISTINCT FROM a.exam)")
_add("existing_files", lambda s, d: maintenance.present(_shelf(s, d), _shelf(s, d).where("subject in ('de', 'fr')").select("path")).select("exam_id"), f"WITH {_S} SELECT exam_id FROM s WHERE path IN (SELECT path FROM s WHERE subject IN ('de', 'fr'))")
_add("reparse_targets", lambda s, d: maintenance.targets(s.read.parquet(f"{d}/pages.parquet").select("page_id", F.col("url").alias("path")), "fr").select("page_id"), "SELECT page_id FROM pages WHERE list_contains(string_split(url, '/')[:-2], 'fr') OR starts_with(string_split(url, '/')[-1], 'fr')")
_add("year_span", lambda s, d: s.createDataFrame([(page.year_span(v.exams_a(s, d)),)], "span string"), "WITH $A SELECT CASE WHEN min(year) = max(year) THEN min(year) || '' ELSE min(year) || '–' || max(year) END AS span FROM exams")
_add("prune_missing", lambda s, d: maintenance.vanished(_shelf(s, d), _shelf(s, d).where("exam_id % 50 < 30").select("path").distinct()).select("exam_id"), f"WITH {_S} SELECT exam_id FROM s WHERE exam_id % 50 >= 30 AND n_questions = 0")
_add("stale_parser", lambda s, d: maintenance.stale(_shelf(s, d), 2).select("exam_id"), f"WITH {_S} SELECT exam_id FROM s WHERE parser < 2")

_NAMES = ["2026_6월모평_생명과학1.pdf", "2014_수능_생명과학1.pdf", "2025_9월_경제.pdf", "2024_3학평_고2_확통.pdf", "2019학년도-수능-사회·문화.pdf", "메모.pdf", unicodedata.normalize("NFD", "2026_9월모평_생명 과학Ⅱ.pdf"), "2020_수능_" + "x_" * 120 + "한국사.PDF"]
_META = [(2026, "6월 모평", None, "생명과학I", True), (2014, "수능", None, "생명과학I", True), (2025, "9월 모평", None, "경제", True), (2024, "3월 학평", "고2", "확률과통계", True), (2019, "수능", None, "사회문화", True), (None, None, None, None, False), (2026, "9월 모평", None, "생명과학II", True), (2020, "수능", None, "한국사", True)]
_q = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, bool)) else f"'{x}'"
_add("meta_from_filename", lambda s, d: s.createDataFrame([(x,) for x in _NAMES], "name string").select("name", meta.from_filename(F.col("name")).alias("m")).select("name", "m.*").withColumn("year", F.coalesce("year", F.lit(0))), "SELECT name, CAST(coalesce(year, 0) AS INT) AS year, exam, grade, subject, explicit FROM (VALUES " + ", ".join(f"('{n}', " + ", ".join(map(_q, m)) + ")" for n, m in zip(_NAMES, _META, strict=True)) + ") t(name, year, exam, grade, subject, explicit)")
_RAW = [("생명 과학Ⅰ", "생명과학I"), ("생명과학1", "생명과학I"), ("물리학 Ⅱ", "물리학II"), ("사회·문화", "사회문화"), ("국어 영역", "국어"), (unicodedata.normalize("NFD", "[지구 과학 1]"), "지구과학I")]
_add("canon_subject", lambda s, d: s.createDataFrame(_RAW, "raw string, x string").select("raw", meta.canon_subject(F.col("raw")).alias("subject")), "SELECT raw, subject FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _RAW) + ") t(raw, subject)")
_add("directory_year", lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", meta.directory_year(F.concat(F.lit("/x/2011/"), (F.col("page_id") % 9 + 2010).cast("string"), F.lit("/a.pdf"))).alias("year")), "SELECT page_id, CAST(page_id % 9 + 2010 AS INT) AS year FROM pages")


def _blocks(s, d):
    i = F.col("doc_id")
    x0 = F.when(i % 11 == 0, 40.0).when(i % 2 == 0, 40.0).otherwise(310.0)
    return v.documents(s, d).select((i.cast("long") / F.lit(40)).cast("long").alias("doc_id"), (i % 40 / F.lit(20)).cast("int").alias("page"), x0.alias("x0"), ((i * 37 % 101) * 8.0).alias("y0"), (x0 + F.when(i % 11 == 0, 515.0).otherwise(240.0)).alias("x1"), F.lit(0.0).alias("y1"), F.lit("t").alias("text"), F.lit(595.0).alias("width"), i.alias("block_no"))


_B = "b AS (SELECT doc_id // 40 AS doc_id, CAST((doc_id % 40) // 20 AS INT) AS page, doc_id AS block_no, (doc_id * 37 % 101) * 8.0 AS y0, doc_id % 11 = 0 AS f, doc_id % 2 = 0 AND doc_id % 11 > 0 AS l, CASE WHEN doc_id % 11 = 0 OR doc_id % 2 = 0 THEN 40 ELSE 310 END AS x0 FROM documents)"
_add("reading_order", lambda s, d: layout.reading_order(_blocks(s, d)).select("block_no", "col", "pos"), f"WITH {_B}, c AS (SELECT *, count(*) FILTER (l) OVER p >= 2 AND count(*) FILTER (NOT l AND NOT f) OVER p >= 2 AS two, row_number() OVER r AS raw, sum(f::INT) OVER r AS band FROM b WINDOW p AS (PARTITION BY doc_id, page), r AS (PARTITION BY doc_id, page ORDER BY y0, x0, block_no)), e AS (SELECT *, CAST(CASE WHEN f OR NOT two THEN -1 WHEN l THEN 0 ELSE 1 END AS INT) AS col FROM c) SELECT block_no, col, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE WHEN two THEN band ELSE 0 END, CASE WHEN two THEN col ELSE 0 END, CASE WHEN two THEN y0 ELSE raw END, raw) AS INT) AS pos FROM e")
_add("running_heads", lambda s, d: layout.strip_running_heads(_pages(s, d)).select("doc_id", "page", "pos"), "WITH l AS (SELECT doc_id // 100 AS doc_id, doc_id % 100 // 10 AS page, doc_id % 10 AS pos, CASE WHEN doc_id % 10 = 0 THEN 'head' ELSE text || doc_id END AS text FROM documents) SELECT doc_id, page, pos FROM l WHERE text <> 'head'")


def _pages(s, d):
    i = F.col("doc_id")
    return v.documents(s, d).select(F.expr("doc_id div 100").alias("doc_id"), F.expr("doc_id % 100 div 10").alias("page"), (i % 10).alias("pos"), F.when(i % 10 == 0, "head").otherwise(F.concat("text", i.cast("string"))).alias("text"))


# Papers of 50 documents, a line each: their texts behind the heads of papers with passages, elective parts that start
# again with and without a header, parts named late, cover lines, and numbers that are out of place.
_PARTED = [f"{i}. " for i in range(1, 9)] + ["[9~11] ", "9. ", "3. ", "10. 2024 ", "4. 15. ", "12. ", "(확률과 통계)"]
_HEADS = [
    ["", *_PARTED, *[f"{i}. " for i in range(13, 18)], "(미적분)", "13. ", *[f"{i}. " for i in range(14, 18)], "(기하)", "[12~14] ", *[f"{i}. " for i in range(12, 17)], "40. "],
    ["", *[f"{i}. " for i in range(1, 13)], "제1교시 ", "[13~15] ", "13. ", "(화법과 작문)", *[f"{i}. " for i in range(14, 20)], "제1교시 ", "13. ", "", "(언어와 매체)", *[f"{i}. " for i in range(14, 19)], "", "제 2 교시 ", "12. ", "(기하)", *[f"{i}. " for i in range(13, 17)]],
    ["[1~3] ", "[5-2] ", *[f"{i}. " for i in (1, 2, 3, 5, 7, 20, 8)], "(미적분)", "(미적분)", "9. ", "11. ", "", *[""] * 9, "8. ", "(기하)", "6. ", "7. ", "(확률과 통계)", "(미적분)", "7. ", "8. ", "[9～10] ", "9．", "1.5 "],
]
_HEADS = [h + [""] * (50 - len(h)) for h in _HEADS]


def _numbered(s, d):
    i = F.col("doc_id")
    head = F.get(F.get(F.array(*[F.array(*map(F.lit, h)) for h in _HEADS]), F.expr("cast(doc_id div 50 % 3 as int)")), (i % 50).cast("int"))
    line = F.when(head.startswith("("), head).otherwise(F.concat(head, F.lit("x "), F.translate("text", "\n", " ")))
    return v.documents(s, d).select(F.expr("doc_id div 50").alias("doc_id"), (i % 50).cast("int").alias("line_no"), F.lit(1).alias("page"), F.when(head.startswith("제"), F.concat(line, F.lit(" 문제지"))).otherwise(line).alias("text"))


def _segmented(s, d):
    rows = segmenting.segment(_numbered(s, d))
    return rows.select("doc_id", "seg_no", "kind", F.coalesce("number", F.lit(0)).alias("number"), F.coalesce("number_end", F.lit(0)).alias("number_end"), F.coalesce("part", F.lit("")).alias("part"), F.md5("text").alias("text_md5"), F.size("line_nos").cast("long").alias("n_lines"))


_NUM = "regexp_extract(t, '^([0-9]{1,2})\\s*[.．]', 1)"
_SEGMENT_SQL = f"""WITH RECURSIVE h AS (SELECT {_HEADS} AS hs),
l0 AS (SELECT doc_id // 50 AS doc_id, doc_id % 50 AS pos, hs[CAST(doc_id // 50 % 3 AS INT) + 1][CAST(doc_id % 50 AS INT) + 1] AS hd, replace(text, chr(10), ' ') AS body FROM documents, h),
l AS (SELECT doc_id, pos, CASE WHEN hd LIKE '(%' THEN hd WHEN hd LIKE '제%' THEN hd || 'x ' || body || ' 문제지' ELSE hd || 'x ' || body END AS t FROM l0),
p AS (SELECT *, regexp_matches(trim(t), '문제지$|^제 *[0-9] *교시') AS cover, regexp_extract(t, '^[(]([가-힣 ]+)[)]$', 1) AS name,
  TRY_CAST(regexp_extract(t, '^\\[([0-9]+)[~～-]([0-9]+)\\]', 1) AS INT) AS pa, TRY_CAST(regexp_extract(t, '^\\[([0-9]+)[~～-]([0-9]+)\\]', 2) AS INT) AS pb,
  CASE WHEN regexp_matches(t, '^[0-9]{{1,2}}\\s*[.．]\\s*[^0-9 ]') OR regexp_matches(t, '^[0-9]{{1,2}}[.．] +[0-9]') AND NOT regexp_matches(t, '^[0-9]{{1,2}}[.．] +[0-9]{{1,2}} *[.．]') THEN TRY_CAST({_NUM} AS INT) END AS q FROM l),
e AS (SELECT doc_id, pos, name, coalesce(pa, q) AS n, coalesce(pb, q) AS m, pa IS NULL AS asks, pos - coalesce(max(CASE WHEN cover THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos), -99) AS near,
  row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM p WHERE name <> '' OR pa IS NOT NULL OR q IS NOT NULL),
e2 AS (SELECT * EXCLUDE (k, near), row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k, pos - coalesce((SELECT max(c.pos) FROM p c WHERE c.doc_id = e.doc_id AND c.cover AND c.pos <= e.pos), -99) AS near FROM e),
f AS (SELECT doc_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS pos, 0 AS last, -1 AS border, CAST('' AS VARCHAR) AS now, CAST('' AS VARCHAR) AS prev, FALSE AS due, CAST('' AS VARCHAR) AS act, 0 AS n, 0 AS m, TRUE AS asks, 0 AS ln, CAST('' AS VARCHAR) AS lp FROM (SELECT DISTINCT doc_id FROM l)
UNION ALL
SELECT doc_id, k, pos, CASE act WHEN 'turn' THEN border WHEN 'take' THEN CASE WHEN asks THEN n ELSE last END WHEN 'again' THEN CASE WHEN asks THEN n ELSE n - 1 END ELSE last END,
  CASE WHEN act = 'first' THEN last WHEN act = 'again' AND n <= border THEN n - 1 ELSE border END,
  CASE WHEN act IN ('first', 'turn', 'name') THEN name WHEN act = 'again' AND NOT due THEN '?' ELSE now END,
  CASE WHEN act = 'turn' THEN now ELSE prev END, CASE WHEN act = 'turn' THEN TRUE WHEN act IN ('take', 'again') THEN FALSE ELSE due END, act, n, m, asks,
  CASE WHEN act = 'name' THEN border + 1 WHEN act = 'again' AND n <= border THEN n ELSE 0 END, CASE WHEN act = 'name' THEN name WHEN act = 'again' AND n <= border THEN CASE WHEN due THEN prev ELSE now END ELSE '' END
FROM (SELECT f.doc_id, e.k, e.pos, f.last, f.border, f.now, f.prev, f.due, e.name, e.n, e.m, e.asks,
  CASE WHEN e.name <> '' THEN CASE WHEN f.last = 0 OR e.name = f.now THEN '' WHEN f.border < 0 THEN 'first' WHEN f.now = '?' THEN 'name' ELSE 'turn' END
    WHEN e.n > e.m THEN '' WHEN e.n > f.last AND e.n <= f.last + CASE WHEN e.asks THEN 3 ELSE 4 END THEN 'take'
    WHEN f.border >= 0 AND abs(e.n - f.border) <= 3 AND (f.due OR f.now <> '?' AND e.n <= f.last AND e.near <= 8) THEN 'again' ELSE '' END AS act
  FROM f JOIN e2 e ON e.doc_id = f.doc_id AND e.k = f.k + 1)),
s AS (SELECT *, act IN ('take', 'again') AS numbered FROM f WHERE act IN ('first', 'turn', 'take', 'again')),
c AS (SELECT s.doc_id, s.pos, min_by(r.lp, r.k) AS lp FROM s JOIN f r ON r.doc_id = s.doc_id AND r.ln > 0 AND r.k > s.k AND s.numbered AND s.n >= r.ln AND s.now IN ('', '?') GROUP BY ALL),
g AS (SELECT l.doc_id, l.pos, l.t, max(CASE WHEN s.pos IS NOT NULL THEN l.pos END) OVER (PARTITION BY l.doc_id ORDER BY l.pos) AS own FROM l LEFT JOIN s USING (doc_id, pos)),
x AS (SELECT doc_id, coalesce(own, -1) AS own, trim(string_agg(t, chr(10) ORDER BY pos)) AS text, count(*) AS n_lines FROM g GROUP BY ALL)
SELECT x.doc_id, CAST(row_number() OVER (PARTITION BY x.doc_id ORDER BY x.own) - 1 AS INT) AS seg_no, CASE WHEN s.numbered THEN CASE WHEN s.asks THEN 'question' ELSE 'passage' END ELSE 'front' END AS kind,
  CAST(CASE WHEN s.numbered THEN s.n ELSE 0 END AS INT) AS number, CAST(CASE WHEN s.numbered THEN s.m ELSE 0 END AS INT) AS number_end, CASE WHEN NOT coalesce(s.numbered, FALSE) THEN '' WHEN s.now NOT IN ('', '?') THEN s.now ELSE coalesce(c.lp, '') END AS part, md5(x.text) AS text_md5, n_lines
FROM x LEFT JOIN s ON s.doc_id = x.doc_id AND s.pos = x.own LEFT JOIN c ON c.doc_id = x.doc_id AND c.pos = x.own"""
_add("segment_lines", _segmented, _SEGMENT_SQL)
_add("compare_by_subject", lambda s, d: c.compare_by_subject(v.segments_a(s, d), v.exams_a(s, d), _WORDINGS), "WITH $A, f AS (" + " UNION ALL ".join(f"SELECT subject, '{q}' AS query, len(regexp_extract_all(text, '{_forms(q.replace(' ', ''))}')) AS n FROM ex WHERE contains(key, '{q.replace(' ', '')}')" for q in _WORDINGS) + ") SELECT subject, query, CAST(count(*) AS BIGINT) AS hits, CAST(sum(n) AS BIGINT) AS occurrences FROM f GROUP BY ALL")
_add("compare_dominant", lambda s, d: c.with_dominant(c.compare(v.segments_a(s, d), v.exams_a(s, d), _WORDINGS)).select("query", "occurrences", "dominant"), "WITH $A, f AS (" + " UNION ALL ".join(f"SELECT '{q}' AS query, CAST(coalesce(sum(len(regexp_extract_all(text, '{_forms(q.replace(' ', ''))}'))), 0) AS BIGINT) AS occurrences FROM ex" for q in _WORDINGS) + ") SELECT query, occurrences, occurrences = max(occurrences) OVER () AND count(*) OVER (PARTITION BY occurrences) = 1 AND occurrences > 0 AS dominant FROM f")
_add("search_turns", lambda s, d: v.segments_b(s, d).where(c.predicates(kinds=("question",)) & text.held("text", "the")).select("segment_id", F.size(text.surface_forms("text", "the")).cast("long").alias("matches")), f"SELECT conv_id * 1000 + turn AS segment_id, CAST(len(regexp_extract_all(text, '{_forms('the')}')) AS BIGINT) AS matches FROM conversations WHERE role = 'user' AND contains(translate(text, ' ' || chr(10) || chr(65532), ''), 'the')")
_add("source_labels", lambda s, d: v.segments_a(s, d).join(v.exams_a(s, d), "exam_id").select("segment_id", meta.source_label(F.col("year"), F.col("exam"), F.col("grade"), F.col("subject"), meta.segment_label(F.col("kind"), F.col("part"), F.col("number"), F.col("number_end"))).alias("source")), "WITH $A SELECT segment_id, source_label AS source FROM ex")
_EXAMS = [("2014학년도 대학수학능력시험", "수능"), ("2026학년도 6월 모의평가", "6월 모평"), ("2024년 3월 고2 전국연합학력평가", "3월 학평"), ("모의평가 문제지", "모의평가"), ("09월 학력평가와 수능", "9월 학평"), ("중간고사", None)]
_add("detect_exam", lambda s, d: s.createDataFrame(_EXAMS, "cover string, x string").select("cover", meta.detect_exam(F.col("cover")).alias("exam")), "SELECT cover, exam FROM (VALUES " + ", ".join(f"({_q(a)}, {_q(b)})" for a, b in _EXAMS) + ") t(cover, exam)")


def _merged(s, d):
    i = F.col("doc_id")
    given = F.struct(F.when(i % 3 == 0, 2000 + i % 20).otherwise(0).cast("int").alias("year"), F.when(i % 2 == 0, "").otherwise("a").alias("subject"))
    found = F.struct(F.when(i % 5 > 0, 1990).cast("int").alias("year"), F.col("lang").alias("subject"))
    return v.documents(s, d).select("doc_id", F.coalesce(meta.merge("year", given, found), F.lit(-1)).alias("year"), meta.merge("subject", given, found).alias("subject"))


_add("meta_merge", _merged, "SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 0 THEN 2000 + doc_id % 20 WHEN doc_id % 5 > 0 THEN 1990 ELSE -1 END AS INT) AS year, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'a' END AS subject FROM documents")


def _repaired(s, d):
    i = F.col("exam_id")
    stored = _shelf(s, d).select("exam_id", i.cast("string").alias("sha1"), "path", F.lit("f").alias("filename"), F.when(i % 2 == 0, F.col("year")).alias("year"), "exam", F.lit("고3").alias("grade"), F.when(i % 3 > 0, F.col("subject")).alias("subject"))
    named = _shelf(s, d).where("exam_id % 4 < 3").select(i.cast("string").alias("sha1"), F.concat(F.lit("/q/"), i.cast("string")).alias("path"), F.lit("g").alias("filename"), F.lit(1999).alias("year"), F.lit("y").alias("exam"), F.lit("고1").alias("grade"), F.lit("z").alias("subject"), (i % 5 == 0).alias("explicit"))
    return maintenance.repair(stored, named).select("exam_id", "path", "filename", F.coalesce("year", F.lit(0)).alias("year"), "exam", "grade", "subject")


_add("repair_meta", _repaired, f"WITH {_S}, r AS (SELECT *, exam_id % 4 < 3 AS f FROM s) SELECT exam_id, CASE WHEN f THEN '/q/' || exam_id ELSE path END AS path, CASE WHEN f THEN 'g' ELSE 'f' END AS filename, CAST(CASE WHEN exam_id % 2 = 0 THEN year WHEN f THEN 1999 ELSE 0 END AS INT) AS year, CASE WHEN exam IS NULL AND f THEN 'y' ELSE exam END AS exam, '고3' AS grade, CASE WHEN f AND exam_id % 5 = 0 THEN 'z' WHEN exam_id % 3 > 0 THEN subject WHEN f THEN 'z' END AS subject FROM r")


def _placed(s, d):
    """Lines with a box, three to a segment and ten segments to a document."""
    i = F.col("doc_id")
    x0 = (i % 7).cast("double")
    return v.documents(s, d).select(F.expr("doc_id div 30").alias("doc_id"), F.expr("cast(doc_id % 30 div 3 as int)").alias("seg_no"), F.expr("cast(doc_id % 30 div 15 as int)").alias("page"), (i % 2).cast("int").alias("col"), x0.alias("x0"), (i % 30 * 10).cast("double").alias("y0"), (x0 + 100).alias("x1"), (i % 30 * 10 + 8).cast("double").alias("y1"), F.lit(1.0).alias("cx0"), F.lit(104.0).alias("cx1"))


_L = "l AS (SELECT doc_id // 30 AS doc_id, CAST(doc_id % 30 // 3 AS INT) AS seg_no, CAST(doc_id % 30 // 15 AS INT) AS page, doc_id % 2 AS col, least(doc_id % 7, 1) AS x0, doc_id % 30 * 10 AS y0, greatest(doc_id % 7 + 100, 104) AS x1, doc_id % 30 * 10 + 8 AS y1 FROM documents), r AS (SELECT doc_id, seg_no, page, col, min(x0) AS x0, min(y0) - 4 AS y0, max(x1) AS x1, max(y1) + 4 AS y1 FROM l GROUP BY ALL)"
_add("rects_union", lambda s, d: layout.regions(_placed(s, d)).select("doc_id", "seg_no", F.posexplode("rects").alias("i", "r")).select("doc_id", "seg_no", "i", *[F.col(f"r.{x}").cast("int").alias(x) for x in ("page", "x0", "y0", "x1", "y1")]), f"WITH {_L} SELECT doc_id, seg_no, CAST(row_number() OVER (PARTITION BY doc_id, seg_no ORDER BY page, y0, x0, x1, y1) - 1 AS INT) AS i, page, CAST(x0 AS INT) AS x0, CAST(y0 AS INT) AS y0, CAST(x1 AS INT) AS x1, CAST(y1 AS INT) AS y1 FROM r")


def _drawn_tables(s, d):
    i = F.col("doc_id")
    return v.documents(s, d).select(F.expr("doc_id div 30").alias("doc_id"), i.alias("table_no"), F.expr("cast(doc_id % 30 div 15 as int)").alias("page"), F.lit(10.0).alias("x0"), (i * 7 % 300).cast("double").alias("y0"), F.lit(30.0).alias("x1"), (i * 7 % 300 + 6).cast("double").alias("y1"))


_add("attach_tables", lambda s, d: layout.attach_tables(_drawn_tables(s, d), layout.regions(_placed(s, d))), f"WITH {_L}, t AS (SELECT doc_id // 30 AS doc_id, doc_id AS table_no, doc_id % 30 // 15 AS page, doc_id * 7 % 300 + 3 AS cy FROM documents) SELECT t.doc_id, table_no, CAST(min(seg_no) AS INT) AS seg_no FROM t JOIN r ON t.doc_id = r.doc_id AND t.page = r.page AND cy BETWEEN r.y0 AND r.y1 AND 20 BETWEEN r.x0 AND r.x1 GROUP BY ALL")
_add("column_bounds", lambda s, d: layout.column_bounds(layout.reading_order(_blocks(s, d))).select("doc_id", "page", "col", (F.col("cx0") * 2).cast("int").alias("cx0"), (F.col("cx1") * 2).cast("int").alias("cx1")), f"WITH {_B}, c AS (SELECT *, x0 + CASE WHEN f THEN 515 ELSE 240 END AS x1, count(*) FILTER (l) OVER p >= 2 AND count(*) FILTER (NOT l AND NOT f) OVER p >= 2 AS two FROM b WINDOW p AS (PARTITION BY doc_id, page)), e AS (SELECT *, CASE WHEN NOT two OR f THEN -1 WHEN l THEN 0 ELSE 1 END AS col FROM c) SELECT doc_id, page, CAST(col AS INT) AS col, CAST(2 * min(x0) AS INT) AS cx0, CAST(2 * max(x1) AS INT) AS cx1 FROM e GROUP BY ALL")


def _archived(s, d):
    exams = v.exams_a(s, d).withColumns({"sha1": F.sha1(F.col("exam_id").cast("string")), "filename": F.lit("f"), "path": F.lit("/f"), "parser": F.lit(2), "scanned_pages": F.lit("")})
    back = archive.lines(exams, v.segments_a(s, d)).select(F.from_json("value", schemas.ARCHIVE).alias("r")).select("r.*")
    return archive.segments(back).join(archive.papers(back).select("sha1", "subject", "n_questions"), "sha1").select("sha1", "seg_no", "number", "subject", "n_questions", F.md5("text").alias("text_md5"))


_add("archive_roundtrip", _archived, "WITH $A SELECT sha1(CAST(exam_id AS VARCHAR)) AS sha1, CAST(row_number() OVER (PARTITION BY exam_id ORDER BY segment_id) - 1 AS INT) AS seg_no, number, subject, count(*) OVER (PARTITION BY exam_id) AS n_questions, md5(text) AS text_md5 FROM ex")
_GRID = [(0, [["a", "b"], ["c"]], 2, 2), (1, [["a", "b"], ["", None]], 0, 0), (2, [["a"], ["b"]], 0, 0), (3, [["a", "b", "c"], ["d", "", ""]], 2, 3), (4, [["a", "", "", ""], ["b", "", "", ""]], 0, 0)]


def _grids(s, d):
    rows = s.createDataFrame([(1, 1, n, 0.0, 0.0, 9.0, 9.0, 1000.0, g) for n, g, _, _ in _GRID], "doc_id int, page int, table_no int, x0 double, y0 double, x1 double, y1 double, page_area double, rows array<array<string>>")
    return layout.accepted_tables(rows).select("table_no", F.size("rows").alias("n_rows"), F.size(F.element_at(layout.padded("rows"), -1)).alias("n_cols"))


_add("accepted_tables", _grids, "SELECT n AS table_no, r AS n_rows, k AS n_cols FROM (VALUES " + ", ".join(f"({n}, {r}, {k})" for n, _, r, k in _GRID) + ") t(n, r, k) WHERE r > 0")


def _subject_names(s, d):
    """Names of subjects made of a stem by the host's number, a level by the language, and all of a text."""
    n = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    level = F.when(F.col("lang") == "en", "Ⅰ").when(F.col("lang") == "de", "2").when(F.col("lang") == "fr", " Ⅱ").otherwise("1")
    stem = F.get(F.array(*map(F.lit, meta.STEMS)), n % len(meta.STEMS))
    return v.documents(s, d).select("doc_id", F.concat(F.lit(" ["), stem, level, F.lit("] · 영역")).alias("name"), F.concat(F.lit("("), stem, F.lit(" "), F.col("text"), level, F.lit(")과목")).alias("long"))


def _canon_sql(name: str) -> str:
    """The rules one after another: Roman signs, blanks, outer brackets, dots, area words, levels."""
    for sign, letters in meta.ROMAN.items():
        name = f"replace({name}, '{sign}', '{letters}')"
    name = f"regexp_replace(regexp_replace(nfc_normalize({name}), '[ \\t\\n\\x0B\\f\\r\\x{{A0}}\\x{{3000}}]+', '', 'g'), '^[()\\[\\]<>]+|[()\\[\\]<>]+$', '', 'g')"
    name = f"regexp_replace(regexp_replace({name}, '[·‧・･.．]', '', 'g'), '영역|과목', '', 'g')"
    for digit, letters in (("1", "I"), ("2", "II")):
        name = f"regexp_replace({name}, '^({'|'.join(meta.STEMS)}){digit}$', '\\1{letters}')"
    return f"nullif({name}, '')"


_add(
    "canon_subject_documents",
    lambda s, d: _subject_names(s, d).select("doc_id", meta.canon_subject(F.col("name")).alias("subject"), F.md5(meta.canon_subject(F.col("long")).cast("binary")).alias("long_md5")),
    f"WITH n AS (SELECT doc_id, text, CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) % {len(meta.STEMS)} AS k, CASE lang WHEN 'en' THEN 'Ⅰ' WHEN 'de' THEN '2' WHEN 'fr' THEN ' Ⅱ' ELSE '1' END AS level FROM documents), s AS (SELECT *, list_extract({list(meta.STEMS)}, k + 1) AS stem FROM n) "
    f"SELECT doc_id, {_canon_sql(chr(39) + ' [' + chr(39) + ' || stem || level || ' + chr(39) + '] · 영역' + chr(39))} AS subject, md5({_canon_sql(chr(39) + '(' + chr(39) + ' || stem || ' + chr(39) + ' ' + chr(39) + ' || text || level || ' + chr(39) + ')과목' + chr(39))}) AS long_md5 FROM s",
)


def _covers(s, d):
    """Covers made of the host's number, a sitting by the language, and all of a text."""
    n = F.regexp_extract("source", r"(\d+)$", 1)
    sitting = F.when(F.col("lang") == "en", "전국연합학력평가").when(F.col("lang") == "de", "모의평가").when(F.col("lang") == "fr", "대학수학능력시험").otherwise("시험")
    month = F.when(n.cast("int") % 3 > 0, F.concat(n, F.lit(" 월 "))).otherwise("")
    return v.documents(s, d).select("doc_id", F.concat(F.lit("20"), F.lpad(n, 2, "0"), F.lit("학년도 "), month, sitting, F.lit("\n"), F.col("text")).alias("cover"))


_add(
    "detect_exam_documents",
    lambda s, d: _covers(s, d).select("doc_id", meta.from_cover(F.col("cover")).alias("m")).select("doc_id", "m.year", "m.exam"),
    "WITH n AS (SELECT doc_id, text, lang, regexp_extract(source, '(\\d+)$', 1) AS n FROM documents), c AS (SELECT doc_id, '20' || lpad(n, 2, '0') || '학년도 ' || CASE WHEN n::INT % 3 > 0 THEN n || ' 월 ' ELSE '' END || CASE lang WHEN 'en' THEN '전국연합학력평가' WHEN 'de' THEN '모의평가' WHEN 'fr' THEN '대학수학능력시험' ELSE '시험' END || chr(10) || text AS t FROM n),"
    " m AS (SELECT *, CAST(nullif(regexp_extract(t, '(\\d{1,2})\\s*월', 1), '') AS INT) AS month FROM c)"
    " SELECT doc_id, CAST(nullif(regexp_extract(t, '((?:19|20)\\d{2})\\s*학년도', 1), '') AS INT) AS year, CASE WHEN contains(t, '학력평가') THEN coalesce(month || '월 학평', '학력평가') WHEN contains(t, '모의평가') THEN coalesce(month || '월 모평', '모의평가') WHEN contains(t, '대학수학능력시험') OR contains(t, '수능') THEN '수능' END AS exam FROM m",
)
