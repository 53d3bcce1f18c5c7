"""Reading order, headings, columns and tables from positioned text, as a plan over items.

One aggregation per page gathers what its rules need (the body size, the column edges, the rows that
tables and lines snap to); items are then spread again and every result is a grouping of items. All of
it stays partitioned by document and page, so a long document is shared out by its pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What counts as a heading, a column, a line and a table.
HEADING_RATIO, MAX_LEVELS, CLUSTER = 1.2, 4, 1.2
HEADING_CHARS = (2, 120)
COLUMN_SHARE, COLUMN_WIDTHS, COLUMN_SLACK = 0.12, 1.5, 2
LINE_REACH, BAND = 3, 3
TABLE_REACH, TABLE_BODY, BIN, CELL_REACH, LABEL_CHARS = 3, 0.3, 5, 7.5, 40

PAGE = ["doc_id", "page"]
SPACE = r"(?U)\s+"
EDGE_SPACE = r"(?U)^\s+|\s+$"

RESULT = (
    "doc_id long, body_size double, headings array<struct<text:string,level:int,page:int,y:double,font_size:double>>, "
    "tables array<struct<id:string,columns:array<string>,rows:array<array<string>>,page:int,y_start:double>>, "
    "columns array<struct<page:int,column:int,x_min:double,x_max:double,n_items:int>>, text string"
)


def font_size(scale_y: Column) -> Column:
    """The size from a text matrix's vertical scale, 12 if there is none."""
    size = F.floor(F.abs(scale_y) * 10 + 0.5) / 10
    return F.when(F.abs(scale_y) > 0, size).otherwise(12.0)


def _snap(values: str, near: str) -> str:
    """SQL: the values, in their order, that no earlier one kept is ``near`` (a condition on k and v)."""
    return f"aggregate({values}, cast(array() as array<double>), (kept, v) -> if(exists(kept, k -> {near}), kept, concat(kept, array(v))))"


def pages(items: DataFrame) -> DataFrame:
    """One row per page: its items in order of arrival and what its rules go by.

    ``body`` is the median size (12 without items). ``edges`` bound the columns: they lie in the wide gaps
    between x positions that at least two items share; null means one column. ``lines`` and ``rows`` are
    the heights that text lines and table rows snap to; ``row_of`` gives each height of ``heights`` its row.
    """
    shown = F.regexp_replace(F.coalesce("str", F.lit("")), EDGE_SPACE, "")
    size, wide = F.col("font_size"), F.col("width")
    one = F.struct("seq", F.coalesce("str", F.lit("")).alias("str"), shown.alias("shown"), "x", "y", "width", "font_size", F.floor(F.col("y") + 0.5).cast("double").alias("level"))
    filled = shown != ""
    p = items.groupBy(*PAGE).agg(
        F.coalesce(F.nullif(F.median(F.when(filled, size)), F.lit(0.0)), F.lit(12.0)).alias("body"),
        F.coalesce(F.median(F.when(filled & (wide > 0), wide)), F.lit(20.0)).alias("wide"),
        F.min_by("page_width", "seq").cast("double").alias("page_width"),
        F.array_sort(F.collect_list(F.when(filled, one))).alias("items"),
    )
    p = p.withColumn("xs", F.expr("array_sort(transform(items, i -> floor(i.x * 10 + 0.5) / 10))"))
    p = p.withColumn("xs", F.expr("array_distinct(filter(xs, (v, k) -> coalesce(get(xs, k + 1) = v, false) or coalesce(get(xs, k - 1) = v, false)))"))
    gap = f"greatest(page_width * {COLUMN_SHARE}, wide * {COLUMN_WIDTHS})"
    p = p.withColumn("cuts", F.expr(f"filter(transform(xs, (v, k) -> if(get(xs, k + 1) - v >= {gap}, v + (get(xs, k + 1) - v) / 2, null)), v -> v is not null)"))
    reached = f"exists(items, i -> i.x >= -{COLUMN_SLACK} and i.x < page_width + {COLUMN_SLACK})"
    p = p.withColumn("edges", F.expr(f"if(size(cuts) > 0 and {reached}, concat(array(0D), cuts, array(page_width)), null)"))
    stands = f"edges is null or (i.x >= -{COLUMN_SLACK} and i.x < page_width + {COLUMN_SLACK})"
    down = f"array_sort(array_distinct(transform(filter(items, i -> {stands}), i -> i.level)), (a, b) -> cast(sign(b - a) as int))"
    p = p.withColumn("down", F.expr(down)).withColumn("lines", F.expr(_snap("down", f"abs(k - v) < {LINE_REACH}")))
    p = p.withColumn("bands", F.expr(f"array_distinct(transform(filter(items, i -> {stands}), i -> floor(i.y / {BAND} + 0.5) * {BAND}))"))
    p = p.withColumn("plain", F.expr(f"filter(items, i -> not (length(i.shown) > 1 and i.font_size >= body * {HEADING_RATIO}))"))
    reach = f"greatest({TABLE_REACH}, body * {TABLE_BODY})"
    p = p.withColumn("heights", F.expr("array_distinct(transform(plain, i -> i.level))")).withColumn("rows", F.expr(_snap("heights", f"abs(k - v) <= {reach}")))
    p = p.withColumn("row_of", F.expr(f"transform(heights, v -> filter(transform(rows, (k, n) -> if(abs(k - v) <= {reach}, n, null)), n -> n is not null)[0])"))
    return p.drop("wide", "xs", "cuts", "down")


def standing(p: DataFrame) -> DataFrame:
    """Items by the columns they stand in; one within two points of an edge stands in both."""
    inside = f"filter(sequence(0, size(edges) - 2), k -> i.x >= edges[k] - {COLUMN_SLACK} and i.x < edges[k + 1] + {COLUMN_SLACK})"
    each = p.select(*PAGE, "edges", "lines", "bands", F.explode("items").alias("i"))
    return each.select(*PAGE, "lines", "bands", "i.*", F.explode(F.expr(f"if(edges is null, array(0), {inside})")).alias("column"))


def column_table(stood: DataFrame) -> DataFrame:
    return stood.groupBy(*PAGE, "column").agg(F.min("x").alias("x_min"), F.max(F.col("x") + F.col("width")).alias("x_max"), F.count("*").cast("int").alias("n_items"))


def page_texts(stood: DataFrame) -> DataFrame:
    """``(doc_id, page, text)`` of pages with text, in reading order.

    In one column an item belongs to the highest line less than three points away. Across columns lines
    are bands of three points; a band also takes its neighbours' items, so text may repeat.
    """
    several = F.size(F.collect_set("column").over(Window.partitionBy(*PAGE))) > 1
    high = F.expr("if(array_contains(lines, level + 2), level + 2, if(array_contains(lines, level + 1), level + 1, level))")
    near = F.expr(f"filter(array(floor(y / {BAND} + 0.5) * {BAND} - {BAND}, floor(y / {BAND} + 0.5) * {BAND}, floor(y / {BAND} + 0.5) * {BAND} + {BAND}), b -> array_contains(bands, b))").cast("array<double>")
    order = F.struct(F.when(F.col("several"), F.col("x")).otherwise(0.0).alias("a"), (-F.col("y")).alias("b"), F.col("seq").alias("c"), "str")
    put = stood.withColumn("several", several).withColumn("at", F.explode(F.when(F.col("several"), near).otherwise(F.array(high))))
    squeezed = lambda c: F.regexp_replace(F.regexp_replace(c, SPACE, " "), "^ | $", "")
    parts = put.groupBy(*PAGE, "at", "column").agg(squeezed(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda o: o["str"]), " ")).alias("part"))
    lines = parts.where("part <> ''").groupBy(*PAGE, "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("column", "part"))), lambda o: o["part"]), "  ").alias("line"))
    return lines.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("at")).alias("k"), "line"))), lambda o: o["line"]), "\n").alias("text"))


def heading_table(p: DataFrame) -> DataFrame:
    """``(doc_id, page, y, text, font_size)``: items well above the body size, the largest of each line of a page."""
    least, most = HEADING_CHARS
    each = p.select(*PAGE, "body", F.explode("items").alias("i")).select(*PAGE, "body", "i.*")
    fit = each.where(F.length("shown").between(least, most) & (F.col("font_size") >= F.col("body") * HEADING_RATIO) & ~F.col("shown").rlike(r"^\d+(\.\d+)*$"))
    best = fit.groupBy(*PAGE, "level").agg(F.max_by(F.struct("y", F.col("shown").alias("text"), "font_size"), F.struct(F.col("font_size"), -F.col("seq"))).alias("h"))
    return best.select(*PAGE, "h.*")


def levels_of(sizes: Column) -> Column:
    """Distinct sizes, largest first -> array of (size, level).

    Sizes within a fifth of a larger one that leads a cluster do not lead. Leaders are numbered, by four
    equal ranges if there are more; every other size then takes the level of the nearest that has one.
    """
    lead = F.aggregate(sizes, F.array().cast("array<double>"), lambda kept, v: F.when((F.size(kept) == 0) | (v < F.try_element_at(kept, F.lit(-1)) / CLUSTER), F.concat(kept, F.array(v))).otherwise(kept))

    def number(found: Column) -> Column:
        top, low = F.get(found, F.lit(0)), F.try_element_at(found, F.lit(-1))
        ranged = lambda v: F.least(F.lit(MAX_LEVELS), F.greatest(F.lit(1), F.ceil((top - v) * MAX_LEVELS / (top - low)).cast("int") + 1))
        return F.transform(found, lambda v, k: F.struct(v.alias("size"), F.when(F.size(found) <= MAX_LEVELS, k + 1).otherwise(ranged(v)).cast("int").alias("level")))

    def join(known: Column, v: Column) -> Column:
        away = F.array_min(F.transform(known, lambda e, k: F.struct(F.abs(e["size"] - v).alias("d"), k.alias("k"), e["level"].alias("level"))))
        return F.when(away["d"] == 0, known).otherwise(F.concat(known, F.array(F.struct(v.alias("size"), away["level"].alias("level")))))

    numbered = F.get(F.transform(F.array(lead), number), F.lit(0))
    return F.aggregate(sizes, numbered, join)


def document_headings(found: DataFrame) -> DataFrame:
    """``(doc_id, headings)`` from top to bottom, with levels over all pages."""
    d = found.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("page", (-F.col("y")).alias("up"), "y", "text", "font_size"))).alias("hs"), F.sort_array(F.collect_set("font_size"), asc=False).alias("sizes")
    )
    d = d.withColumn("known", levels_of(F.col("sizes")))
    level = lambda h: F.get(F.transform(F.filter("known", lambda e: e["size"] == h["font_size"]), lambda e: e["level"]), F.lit(0))
    made = F.transform("hs", lambda h: F.struct(h["text"].alias("text"), level(h).alias("level"), h["page"].alias("page"), h["y"].alias("y"), h["font_size"].alias("font_size")))
    return d.select("doc_id", made.alias("headings"))


def table_grids(p: DataFrame) -> DataFrame:
    """``(doc_id, page, run, labels, grid, y_start)``: runs of rows whose items align in at least two x positions.

    Rows follow each other in order of arrival; a run goes on while the positions that all of its rows
    share stay two or more. Cells take the items nearest to a shared position.
    """
    spread = p.where("size(plain) >= 4").select(*PAGE, "rows", F.posexplode("plain").alias("n", "i"), "heights", "row_of")
    cells = spread.select(*PAGE, "rows", "i.seq", "i.x", "i.shown", F.expr("get(row_of, cast(array_position(heights, i.level) - 1 as int))").alias("row"), F.expr(f"cast(floor(i.x / {BIN} + 0.5) * {BIN} as int)").alias("bin"))
    rows = cells.groupBy(*PAGE, "row").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("bin")).alias("bins"), F.first("rows").alias("rows")).where("n >= 2 and size(bins) >= 2")
    run = "named_struct('rows', array({row}), 'shared', {shared})"
    fold = (
        f"aggregate(found, cast(array() as array<struct<rows:array<int>,shared:array<int>>>), (runs, r) -> if(size(array_intersect(element_at(runs, -1).shared, r.bins)) >= 2,"
        f" concat(slice(runs, 1, size(runs) - 1), array(named_struct('rows', concat(element_at(runs, -1).rows, array(r.row)), 'shared', array_intersect(element_at(runs, -1).shared, r.bins)))),"
        f" concat(runs, array({run.format(row='r.row', shared='r.bins')}))))"
    ).replace("element_at(", "try_element_at(")
    runs = rows.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("row", "bins"))).alias("found"), F.first("rows").alias("rows")).withColumn("runs", F.filter(F.expr(fold), lambda r: F.size(r["rows"]) >= 2))
    runs = runs.select(*PAGE, "rows", F.posexplode("runs").alias("run", "r")).select(*PAGE, "run", F.expr("get(rows, r.rows[0])").alias("y_start"), F.col("r.shared").alias("shared"), F.explode("r.rows").alias("row"))
    near = F.expr("array_min(transform(shared, (s, k) -> struct(abs(bin - s) as d, k as k)))")
    placed = cells.drop("rows").join(runs, [*PAGE, "row"]).withColumn("near", near).where(F.col("near.d") <= CELL_REACH)
    cell = placed.groupBy(*PAGE, "run", "y_start", "shared", "row", F.col("near.k").alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "seq", "shown"))), lambda o: o["shown"]), " ").alias("text"))
    line = cell.groupBy(*PAGE, "run", "y_start", "shared", "row").agg(F.map_from_entries(F.collect_list(F.struct("k", "text"))).alias("m"))
    line = line.withColumn("cells", F.expr("transform(shared, (s, k) -> coalesce(try_element_at(m, k), ''))"))
    grid = line.groupBy(*PAGE, "run", "y_start", F.size("shared").alias("width")).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda o: o["cells"]).alias("grid")).where("size(grid) >= 2")
    labelled = F.expr(f"forall(grid[0], c -> length(c) <= {LABEL_CHARS}) and size(filter(grid[0], c -> c <> '')) >= 2")
    grid = grid.withColumn("labelled", labelled)
    labels = F.expr("transform(sequence(0, width - 1), k -> if(labelled and grid[0][k] <> '', grid[0][k], concat('Column ', k + 1)))")
    return grid.select(*PAGE, "run", "y_start", labels.alias("labels"), F.expr("if(labelled, slice(grid, 2, size(grid) - 1), grid)").alias("grid"))


def layout(items: DataFrame) -> DataFrame:
    """``items(doc_id, page, seq, str, x, y, width, height, font_size, page_width)`` -> one row per document.

    ``seq`` is the order of arrival within a page. Blank items are dropped; a page of blank items counts
    as an empty page.
    """
    need = [*PAGE, "seq", "str", "x", "y", "width", "font_size", "page_width"]
    p = pages(items.select(*need).repartition(*PAGE))
    stood = standing(p)
    ordered = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    body = p.join(page_texts(stood), PAGE, "left").groupBy("doc_id").agg(F.median("body").alias("body_size"), F.array_join(F.transform(ordered("page", F.coalesce("text", F.lit("")).alias("text")), lambda o: o["text"]), "\n\n").alias("text"))
    heads = document_headings(heading_table(p))
    grids = table_grids(p).groupBy("doc_id").agg(ordered("page", "run", "y_start", "labels", "grid").alias("ts"))
    table = F.transform("ts", lambda t, n: F.struct(F.concat(F.lit("layout-table-"), n).alias("id"), t["labels"].alias("columns"), t["grid"].alias("rows"), t["page"].alias("page"), t["y_start"].alias("y_start")))
    cols = column_table(stood).groupBy("doc_id").agg(ordered("page", "column", "x_min", "x_max", "n_items").alias("columns"))
    whole = body.join(heads, "doc_id", "left").join(grids.select("doc_id", table.alias("tables")), "doc_id", "left").join(cols, "doc_id", "left")
    kinds = {f.split(" ")[0]: f.split(" ", 1)[1] for f in RESULT.split(", ")}
    none = lambda c: F.coalesce(F.col(c), F.array().cast(kinds[c])).alias(c)
    return whole.select("doc_id", "body_size", none("headings"), none("tables"), none("columns"), "text")


def heading_rows(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.posexplode("headings").alias("pos", "h")).select("doc_id", "pos", "h.*")


def table_rows(found: DataFrame) -> DataFrame:
    """One row per cell: ``doc_id, table_id, page, row_idx, col_idx, col_label, value``."""
    t = found.select("doc_id", F.explode("tables").alias("t"))
    r = t.select("doc_id", "t.id", "t.page", "t.columns", F.posexplode("t.rows").alias("row_idx", "cells"))
    c = r.select("doc_id", F.col("id").alias("table_id"), "page", "columns", "row_idx", F.posexplode("cells").alias("col_idx", "value"))
    return c.withColumn("col_label", F.get("columns", F.col("col_idx"))).drop("columns")


def column_rows(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.explode("columns").alias("c")).select("doc_id", "c.*")


def needs_ocr(pages: DataFrame) -> DataFrame:
    """``pages(doc_id, page, text)`` -> whether a document has no page with more than eighty characters."""
    return pages.groupBy("doc_id").agg((~F.bool_or(F.length(F.trim(F.coalesce("text", F.lit("")))) > 80)).alias("needs_ocr"))


def image_pages(ops: DataFrame, scanned: int = 6, keep: int = 2) -> DataFrame:
    """``ops(doc_id, page, n_images)`` -> the pages richest in images among the first ones."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("n_images"), "page")
    return ops.where((F.col("page") <= scanned) & (F.col("n_images") > 0)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def ocr_pages(pages: DataFrame, most: int = 8) -> DataFrame:
    """The pages of a scanned document that are recognised."""
    return pages.where(F.col("page") <= most)
