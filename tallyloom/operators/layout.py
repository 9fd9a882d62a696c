"""Reading order and headings of laid-out pages, from tables of positioned lines and of the pages' tables.

Lines: doc_id, page, ordinal (as in the file), text, size, bold, form, x0, y0, x1, y1 (their block's box) and top (the
line's own).  Tables: doc_id, page, item, x0, y0, x1, y1, markdown, ruled.

Defined results: a line without visible text is none; a box without an area overlaps nothing; a null coordinate
overlaps nothing and comes last on its page; of equally frequent sizes the one that comes first is the body's; a
document without sizes has BODY; tables come before lines at the same height, and lines in the file's order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators import sections as S

c = F.col
# How much of a line may lie in a table, how much larger a heading is, the share of figures that a table
# without rules needs, the size where none is known, and the pages that show a document's body.
OVERLAP, HEADING, FIGURES, BODY, BODY_PAGES = 0.5, 1.15, 0.15, 10.0, 25
GRID = 16
PAGE = ["doc_id", "page"]
_BOX = ("x0", "y0", "x1", "y1")


def body_size(lines: DataFrame) -> DataFrame:
    """(doc_id, body): the size that most characters of the first pages have."""
    shown = lines.filter((c("page") < BODY_PAGES) & (F.trim("text") != "") & c("size").isNotNull())
    sums = shown.groupBy("doc_id", F.round("size", 1).alias("size")).agg(F.sum(F.length("text")).alias("n"), F.min(F.struct("page", "ordinal")).alias("first"))
    best = F.min_by("size", F.struct((-c("n")).alias("n"), c("first"))).alias("best")
    return lines.select("doc_id").distinct().join(sums.groupBy("doc_id").agg(best), "doc_id", "left").select("doc_id", F.coalesce("best", F.lit(BODY)).alias("body"))


def kept_tables(tables: DataFrame) -> DataFrame:
    """Ruled tables, and others if enough of their cells are figures."""
    return tables.filter(c("ruled") | (S.numeric_ratio(c("markdown")) >= FIGURES))


def _cell(v: Column, axis: str) -> Column:
    """The grid's column or row of a coordinate, clipped to the grid."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(GRID - 1.0), (v - c(f"{axis}_from")) / c(f"{axis}_step")))).cast("int")


def _cells(low: str, high: str, axis: str) -> Column:
    """The grid's columns (or rows) that a box touches."""
    return F.sequence(_cell(c(low), axis), F.greatest(_cell(c(low), axis), _cell(c(high), axis)))


def inside_tables(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc_id, page, ordinal) of the lines of which more than OVERLAP lies in one table.

    Boxes meet in cells of a grid over the page's tables, so a line meets the tables near it only, and a pair
    counts in the one cell in which their common part begins.
    """
    whole = tables.filter((c("x1") > c("x0")) & (c("y1") > c("y0")))
    grid = whole.groupBy(*PAGE).agg(*(f(v).alias(n) for f, v, n in ((F.min, "x0", "x_from"), (F.min, "y0", "y_from"), (F.max, "x1", "x_to"), (F.max, "y1", "y_to"))))
    grid = grid.withColumns({f"{a}_step": (c(f"{a}_to") - c(f"{a}_from")) / GRID for a in "xy"})

    def dealt(rows: DataFrame) -> DataFrame:
        near = rows.join(grid, PAGE).filter((c("x0") < c("x_to")) & (c("x1") > c("x_from")) & (c("y0") < c("y_to")) & (c("y1") > c("y_from")))
        return near.withColumn("cx", F.explode(_cells("x0", "x1", "x"))).withColumn("cy", F.explode(_cells("y0", "y1", "y"))).drop("x_to", "y_to")

    ours = dealt(lines.filter((c("x1") > c("x0")) & (c("y1") > c("y0"))).select(*PAGE, "ordinal", *_BOX))
    theirs = dealt(whole.select(*PAGE, *_BOX)).select(*PAGE, "cx", "cy", *(c(k).alias(f"t_{k}") for k in _BOX))
    both = ours.join(theirs, [*PAGE, "cx", "cy"])
    left, top, right, bottom = F.greatest("x0", "t_x0"), F.greatest("y0", "t_y0"), F.least("x1", "t_x1"), F.least("y1", "t_y1")
    first = (c("cx") == _cell(left, "x")) & (c("cy") == _cell(top, "y"))
    common = F.greatest(right - left, F.lit(0.0)) * F.greatest(bottom - top, F.lit(0.0))
    return both.filter(first & (common > OVERLAP * (c("x1") - c("x0")) * (c("y1") - c("y0")))).select(*PAGE, "ordinal").distinct()


def blocks(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc_id, page, place, ordinal, kind, text, section) in reading order; tables have no ordinal."""
    shown = lines.filter(F.trim("text") != "")
    kept = kept_tables(tables)
    text = F.trim("text")
    prose = shown.join(inside_tables(shown, kept), [*PAGE, "ordinal"], "left_anti").join(body_size(lines), "doc_id")
    prose = prose.withColumns({"item": S.item_heading(text, c("form")), "narrative": S.narrative_heading(text)})
    typographic = (F.coalesce(c("size") >= c("body") * HEADING, F.lit(False)) | F.coalesce("bold", F.lit(False))) & T.looks_like_heading(text)
    heading = c("item").isNotNull() | (c("form").isNull() & c("narrative").isNotNull()) | typographic
    label = F.when(c("heading"), F.coalesce("item", "narrative", text))
    rows = prose.withColumn("heading", heading).select(*PAGE, c("top").alias("y"), F.lit(1).alias("layer"), "ordinal", F.when(c("heading"), "heading").otherwise("text").alias("kind"), text.alias("text"), label.alias("label"))
    none = F.lit(None)
    rows = rows.unionByName(kept.select(*PAGE, c("y0").alias("y"), F.lit(0).alias("layer"), none.cast("int").alias("ordinal"), F.lit("table").alias("kind"), c("markdown").alias("text"), none.cast("string").alias("label")))
    order = [F.col("y").asc_nulls_last(), "layer", "ordinal", "text"]
    on_page = rows.withColumn("place", F.row_number().over(Window.partitionBy(*PAGE).orderBy(*order)))
    # A heading counts to the end of its page by place, and its page's last one for the pages after it.
    so_far = Window.partitionBy(*PAGE).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    own = on_page.withColumn("own", F.last("label", ignorenulls=True).over(so_far))
    last = own.groupBy(*PAGE).agg(F.max_by("own", "place").alias("last"))
    before = F.last("last", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    return own.join(last.select(*PAGE, before.alias("before")), PAGE).select(*PAGE, "place", "ordinal", "kind", "text", F.coalesce("own", "before").alias("section"))
