"""Tables as cells: lookups, grids with spans, alignment, Markdown and HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import cell_text, is_blank, strip

TABLE = ["doc_id", "page_number", "table_no"]


def cells_from_rows(tables: DataFrame) -> DataFrame:
    """Cells of tables given as ``rows array<array<string>>``; null texts become empty, spans are 1."""
    rows = tables.select(*TABLE, F.posexplode("rows").alias("row", "cells"))
    cells = rows.select(*TABLE, "row", F.posexplode("cells").alias("col", "text"))
    return cells.select(*TABLE, "row", "col", F.coalesce("text", F.lit("")).alias("text"), F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"))


def dimensions(cells: DataFrame) -> DataFrame:
    """Rows and columns of each table, spans included, and whether it has a header (text in row 0) or is blank throughout."""
    return cells.groupBy(*TABLE).agg(
        (F.max(F.col("row") + F.col("rowspan"))).alias("num_rows"), (F.max(F.col("col") + F.col("colspan"))).alias("num_cols"),
        F.bool_or((F.col("row") == 0) & ~is_blank("text")).alias("has_header"), F.bool_and(is_blank("text")).alias("is_empty"),
    )


def cell(cells: DataFrame, row: int, col: int) -> DataFrame:
    return cells.where((F.col("row") == row) & (F.col("col") == col))


def row_cells(cells: DataFrame, row: int) -> DataFrame:
    return cells.where(F.col("row") == row)


def col_cells(cells: DataFrame, col: int) -> DataFrame:
    return cells.where(F.col("col") == col)


def column_widths(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*TABLE, "col").agg(F.max(F.length("text")).alias("width"))


def grid(cells: DataFrame) -> DataFrame:
    """Every place of each table with its text: a cell's own at its first place, empty where it spans or nothing is; of several the last one counts."""
    spans = cells.select(
        *TABLE, "text", F.col("row").alias("r0"), F.col("col").alias("c0"), F.explode(F.sequence(F.col("row"), F.col("row") + F.col("rowspan") - 1)).alias("row"), "colspan"
    ).select(*TABLE, "text", "r0", "c0", "row", F.explode(F.sequence(F.col("c0"), F.col("c0") + F.col("colspan") - 1)).alias("col"))
    own = spans.withColumn("value", F.when((F.col("row") == F.col("r0")) & (F.col("col") == F.col("c0")), F.col("text")).otherwise(""))
    own = own.groupBy(*TABLE, "row", "col").agg(F.max_by("value", F.struct("r0", "c0")).alias("value"))
    size = dimensions(cells)
    places = size.select(*TABLE, "num_cols", F.explode(F.sequence(F.lit(0), F.col("num_rows") - 1)).alias("row")).select(*TABLE, "row", F.explode(F.sequence(F.lit(0), F.col("num_cols") - 1)).alias("col"))
    return places.join(own, [*TABLE, "row", "col"], "left").select(*TABLE, "row", "col", F.coalesce("value", F.lit("")).alias("text"))


def alignments(cells: DataFrame) -> DataFrame:
    """center, right or left for each column: by whether short numbers, marked numbers or other texts prevail."""
    t = strip("text")
    some = t != ""
    short = some & t.rlike(r"^[0-9]+$") & (F.length(t) <= 5)
    marked = some & ~short & t.rlike("[0-9]") & t.rlike(r"[.,%$€£¥]")
    n = cells.groupBy(*TABLE, "col").agg(F.count_if(short).alias("c"), F.count_if(marked).alias("r"), F.count_if(some & ~short & ~marked).alias("l"))
    kind = F.when((F.col("c") > 0) & (F.col("c") >= F.col("l")) & (F.col("c") >= F.col("r")), "center").when(F.col("r") > F.col("l"), "right").otherwise("left")
    return n.select(*TABLE, "col", kind.alias("alignment"))


def _row_lines(rows: DataFrame) -> DataFrame:
    line = F.concat(F.lit("| "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda e: e["text"]), " | "), F.lit(" |"))
    return rows.groupBy(*TABLE, "row").agg(line.alias("line"))


def to_markdown(cells: DataFrame) -> DataFrame:
    """Each table as a plain grid with a separator after the first row."""
    size = dimensions(cells).select(*TABLE, "num_cols")
    lines = _row_lines(grid(cells).withColumn("text", strip("text"))).join(size, TABLE)
    sep = lines.where("row = 0").select(*TABLE, F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("num_cols").cast("int")), " | "), F.lit(" |")).alias("sep"))
    both = lines.select(*TABLE, F.col("row").cast("double").alias("row"), "line").unionByName(sep.select(*TABLE, F.lit(0.5).alias("row"), F.col("sep").alias("line")))
    return both.groupBy(*TABLE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda e: e["line"]), "\n").alias("markdown"))


def to_aligned_markdown(cells: DataFrame, width: int = 100, twice: bool = True) -> DataFrame:
    """Each table with alignment marks in the separator. Cell texts are formatted when laid out and again when written, so a pipe has two backslashes; twice=False formats once."""
    text = cell_text(cell_text("text", width), width) if twice else cell_text("text", width)
    lines = _row_lines(grid(cells).withColumn("text", text)).select(*TABLE, F.col("row").cast("double").alias("row"), "line")
    mark = F.when(F.col("alignment") == "center", ":---:").when(F.col("alignment") == "right", "---:").otherwise("---")
    columns = grid(cells).where("row = 0").select(*TABLE, "col").join(alignments(cells), [*TABLE, "col"], "left")
    sep = _row_lines(columns.select(*TABLE, F.lit(0).alias("row"), "col", mark.alias("text"))).select(*TABLE, F.lit(0.5).alias("row"), "line")
    both = lines.unionByName(sep)
    return both.groupBy(*TABLE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda e: e["line"]), "\n").alias("markdown"))


def listed(cells: DataFrame) -> DataFrame:
    """The tables of each page under ``### Table i`` headings; empty tables are left out but counted."""
    some = dimensions(cells).where("not is_empty").select(*TABLE)
    part = to_aligned_markdown(cells).join(some, TABLE).withColumn("block", F.concat(F.lit("### Table "), (F.col("table_no") + 1).cast("string"), F.lit("\n\n"), F.col("markdown"), F.lit("\n")))
    return part.groupBy("doc_id", "page_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table_no", "block"))), lambda e: e["block"]), "\n").alias("markdown"))


def as_text(tables: DataFrame, separator: str = " | ") -> DataFrame:
    """Rows of ``rows array<array<string>>`` joined as text; null cells are empty."""
    return tables.select(*TABLE, F.array_join(F.transform("rows", lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), separator)), "\n").alias("text"))


def to_html(cells: DataFrame, caption: str | None = None) -> DataFrame:
    """Each table as HTML, a tag a line: header cells in row 0, alignment, spans; places without a cell of their own get an empty tag."""
    first = cells.groupBy(*TABLE, "row", "col").agg(F.first("text").alias("text"), F.first("rowspan").alias("rowspan"), F.first("colspan").alias("colspan"))
    places = grid(cells).drop("text").join(first, [*TABLE, "row", "col"], "left").join(alignments(cells), [*TABLE, "col"], "left")
    tag = F.when(F.col("row") == 0, "th").otherwise("td")
    span = lambda c: F.when(F.col(c) > 1, F.concat(F.lit(f' {c}="'), F.col(c).cast("string"), F.lit('"'))).otherwise("")
    own = F.concat(F.lit("<"), tag, F.lit(' align="'), F.coalesce("alignment", F.lit("left")), F.lit('"'), span("colspan"), span("rowspan"), F.lit(">"), cell_text("text"), F.lit("</"), tag, F.lit(">"))
    html = F.when(F.col("text").isNull(), F.concat(F.lit("<"), tag, F.lit("></"), tag, F.lit(">"))).otherwise(own)
    rows = places.withColumn("html", html).groupBy(*TABLE, "row").agg(F.concat(F.lit("<tr>\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "html"))), lambda e: e["html"]), "\n"), F.lit("\n</tr>")).alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda e: e["line"]), "\n")
    head = f"<table>\n<caption>{caption}</caption>\n" if caption else "<table>\n"
    return rows.groupBy(*TABLE).agg(F.concat(F.lit(head), body, F.lit("\n</table>")).alias("html"))
