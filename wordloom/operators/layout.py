"""From positioned blocks to ordered lines: reading order, running heads, regions and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

FULL_WIDTH = 0.62
EDGE_LINES, EDGE_CHARS = 2, 24
SCANNED_BELOW = 40
WIDEST_RULE = 0.95
TABLE_AREA, TABLE_FILL = 0.5, 0.4


def reading_order(blocks: DataFrame) -> DataFrame:
    """blocks(doc_id, page, x0, y0, x1, y1, text, width, block_no) with col (-1 full, 0 left, 1 right) and pos.

    A page has two columns if each half holds two narrow blocks or more; full-width blocks then part it in bands, and
    within a band the left column comes before the right one.
    """
    page = Window.partitionBy("doc_id", "page")
    raw = page.orderBy(F.round("y0", 1), "x0", "block_no")
    full, left = (F.col("x1") - F.col("x0")) > FULL_WIDTH * F.col("width"), (F.col("x0") + F.col("x1")) / 2 < F.col("width") / 2
    b = blocks.where(F.trim("text") != "").withColumns({"_full": full, "_left": left})
    b = b.withColumns({"_l": F.count_if(~F.col("_full") & F.col("_left")).over(page), "_r": F.count_if(~F.col("_full") & ~F.col("_left")).over(page), "_raw": F.row_number().over(raw), "_band": F.sum(F.col("_full").cast("int")).over(raw)})
    two = (F.col("_l") >= 2) & (F.col("_r") >= 2)
    b = b.withColumn("col", F.when(~two | F.col("_full"), -1).when(F.col("_left"), 0).otherwise(1))
    order = page.orderBy(F.when(two, F.col("_band")).otherwise(0), F.when(two, F.col("col")).otherwise(0), F.when(two, F.col("y0")).otherwise(F.col("_raw")), "_raw")
    return b.withColumn("pos", F.row_number().over(order)).drop("_full", "_left", "_l", "_r", "_raw", "_band")


def column_bounds(ordered: DataFrame, drawings: DataFrame | None = None) -> DataFrame:
    """doc_id, page, col, cx0 and cx1: how far each column reaches, by its blocks and drawings (doc_id, page, x0, x1).

    On a page of two columns no column crosses the gap between the narrow blocks of the other; without a clear gap the
    middle is the border.  Rules nearly as wide as the page are frames and do not count.
    """
    wide = F.col("x1") - F.col("x0") > FULL_WIDTH * F.col("width")
    mid = F.col("width") / 2
    on_left = (F.col("x0") + F.col("x1")) / 2 < mid
    page = ordered.groupBy("doc_id", "page").agg(F.max("width").alias("width"), (F.max("col") >= 0).alias("two"), F.max(F.when(~wide & on_left, F.col("x1"))).alias("ml"), F.min(F.when(~wide & ~on_left, F.col("x0"))).alias("mr"))
    clear = F.coalesce(F.col("ml") < F.col("mr"), F.lit(False))
    page = page.select("doc_id", "page", "width", "two", F.when(clear, (F.col("ml") + F.col("mr")) / 2).otherwise(mid).alias("gap"), F.when(clear, F.col("mr") - 1).otherwise(mid).alias("left_end"), F.when(clear, F.col("ml") + 1).otherwise(mid).alias("right_start"))
    spans = ordered.select("doc_id", "page", "x0", "x1", F.lit(False).alias("drawn"))
    if drawings is not None:
        spans = spans.unionByName(drawings.select("doc_id", "page", "x0", "x1", F.lit(True).alias("drawn")))
    spans = spans.join(page, ["doc_id", "page"]).where(~F.col("drawn") | (F.col("x1") - F.col("x0") <= WIDEST_RULE * F.col("width")))
    col = F.when(~F.col("two") | wide, -1).when((F.col("x0") + F.col("x1")) / 2 < F.col("gap"), 0).otherwise(1)
    cut = spans.withColumn("col", col).withColumns({"x0": F.when(F.col("col") == 1, F.greatest("x0", "right_start")).otherwise(F.col("x0")), "x1": F.when(F.col("col") == 0, F.least("x1", "left_end")).otherwise(F.col("x1"))})
    return cut.where("x1 > x0").groupBy("doc_id", "page", "col").agg(F.min("x0").alias("cx0"), F.max("x1").alias("cx1"))


def lines(ordered: DataFrame, bounds: DataFrame) -> DataFrame:
    """The cleaned lines of ordered blocks, with pos, their block's box and their column's ends."""
    one = ordered.select("doc_id", "page", "col", "x0", "y0", "x1", "y1", "width", "pos", F.posexplode(F.split(text.clean_text("text"), "\n", -1)).alias("_i", "text")).where("text != ''")
    out = one.join(bounds, ["doc_id", "page", "col"], "left").withColumns({"cx0": F.coalesce("cx0", F.lit(0.0)), "cx1": F.coalesce("cx1", "width")})
    return out.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("pos", "_i"))).drop("_i", "width")


def page_stats(ordered: DataFrame, cleaned: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, n_pages, scanned_pages, n_chars, n_broken; a page with hardly any text was scanned.

    pages(doc_id, page) lists every page, those without a block too.
    """
    raw = ordered.groupBy("doc_id").agg(F.sum(F.length("text")).cast("long").alias("n_chars"), F.sum(text.unreadable_count("text")).cast("long").alias("n_broken"))
    read = cleaned.groupBy("doc_id", "page").agg(F.sum(F.length("text")).alias("_n"))
    per = pages.select("doc_id", "page").distinct().join(read, ["doc_id", "page"], "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"), F.array_sort(F.collect_list(F.when(F.coalesce("_n", F.lit(0)) < SCANNED_BELOW, F.col("page").cast("int")))).alias("scanned_pages"))
    return per.join(raw, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_chars", "n_broken")})


def accepted_tables(tables: DataFrame) -> DataFrame:
    """tables(doc_id, page, table_no, x0, y0, x1, y1, page_area, rows) with clean rows; frames and empty grids go.

    A table covers half of its page at most, has two rows or more with text, two columns, and 40 % of its cells filled.
    """
    small = tables.where((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) <= TABLE_AREA * F.col("page_area"))
    cells = small.select("doc_id", "table_no", F.posexplode("rows").alias("i", "r")).select("doc_id", "table_no", "i", F.posexplode("r").alias("j", "c"))
    clean = cells.withColumn("c", F.trim(F.replace(text.clean_text(F.coalesce("c", F.lit(""))), F.lit("\n"), F.lit(" "))))
    rows = clean.groupBy("doc_id", "table_no", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "c"))), lambda x: x["c"]).alias("r")).where(F.exists("r", lambda x: x != ""))
    whole = rows.groupBy("doc_id", "table_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "r"))), lambda x: x["r"]).alias("rows"))
    flat = F.flatten("rows")
    good = whole.where((F.size("rows") >= 2) & (F.array_max(F.transform("rows", F.size)) >= 2) & (F.size(F.filter(flat, lambda x: x != "")) >= TABLE_FILL * F.size(flat)))
    return small.drop("rows").join(good, ["doc_id", "table_no"])


def padded(rows: Column | str) -> Column:
    """A ragged table's rows, all as long as its longest."""
    rows = F.col(rows) if isinstance(rows, str) else rows
    most = F.array_max(F.transform(rows, F.size))
    return F.transform(rows, lambda r: F.concat(F.transform(r, lambda x: F.coalesce(x, F.lit(""))), F.array_repeat(F.lit(""), most - F.size(r))))


def strip_running_heads(lines: DataFrame) -> DataFrame:
    """lines(doc_id, page, pos, text) without texts that recur at the edges of half of a document's pages or more."""
    page = Window.partitionBy("doc_id", "page")
    short = F.length(F.trim("text")).between(1, EDGE_CHARS)
    ranked = lines.withColumns({"_a": F.row_number().over(page.orderBy("pos")), "_z": F.row_number().over(page.orderBy(F.desc("pos")))})
    edge = ranked.where(short & ((F.col("_a") <= EDGE_LINES) | (F.col("_z") <= EDGE_LINES))).groupBy("doc_id", F.trim("text").alias("_t")).agg(F.countDistinct("page").alias("_n"))
    pages = lines.groupBy("doc_id").agg(F.countDistinct("page").alias("_pages"))
    noise = edge.join(pages, "doc_id").where((F.col("_pages") >= 3) & (F.col("_n") >= F.greatest(F.lit(2), F.floor(F.col("_pages") / 2)))).select("doc_id", "_t")
    return lines.withColumn("_t", F.trim("text")).join(noise, ["doc_id", "_t"], "left_anti").drop("_t")


def regions(lines: DataFrame, pad: float = 4.0) -> DataFrame:
    """doc_id, seg_no and rects: what each segment covers in each column of each page, widened to the column."""
    box = lines.groupBy("doc_id", "seg_no", "page", "col").agg(F.min(F.least("x0", "cx0")).alias("x0"), (F.min("y0") - pad).alias("y0"), F.max(F.greatest("x1", "cx1")).alias("x1"), (F.max("y1") + pad).alias("y1"))
    ordered = F.array_sort(F.collect_list(F.struct("page", F.col("y0").alias("_y"), "x0", "y0", "x1", "y1")))
    return box.groupBy("doc_id", "seg_no").agg(F.transform(ordered, lambda r: F.struct(*[r[c].alias(c) for c in ("page", "x0", "y0", "x1", "y1")])).alias("rects"))


def attach_tables(tables: DataFrame, rects: DataFrame) -> DataFrame:
    """Each table with the first segment (smallest seg_no) one of whose rects holds its centre."""
    t = tables.withColumns({"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2}).alias("t")
    r = rects.select("doc_id", "seg_no", F.explode("rects").alias("r")).select("doc_id", "seg_no", "r.*").alias("r")
    inside = (F.col("t.doc_id") == F.col("r.doc_id")) & (F.col("t.page") == F.col("r.page")) & F.col("cx").between(F.col("r.x0"), F.col("r.x1")) & F.col("cy").between(F.col("r.y0"), F.col("r.y1"))
    return t.join(r, inside).groupBy(F.col("t.doc_id").alias("doc_id"), F.col("t.table_no").alias("table_no")).agg(F.min("r.seg_no").alias("seg_no"))
