"""Edge text: positions, removal of repeats, formats, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalise_edge, strip
from .elements import PAGE

POSITIONS = ("left", "right", "top", "bottom")


def position(width="width", height="height") -> Column:
    """The side that a box is nearest to; of equal distances left, right, top, bottom in this order."""
    l, r, t, b = F.col("x0"), F.col(width) - F.col("x1"), F.col("y0"), F.col(height) - F.col("y1")
    m = F.least(l, r, t, b)
    return F.when(l == m, "left").when(r == m, "right").when(t == m, "top").otherwise("bottom")


def extracted(edges: DataFrame, pages: DataFrame, deduplicate: bool = True) -> DataFrame:
    """Edge regions as edge texts; with deduplicate, of one normalised text and position only the first of a document."""
    sized = edges if {"width", "height"} <= set(edges.columns) else edges.join(pages.select(*PAGE, "width", "height"), PAGE)
    rows = sized.withColumn("position", position()).withColumn("text", strip("text"))
    rows = rows.select(*PAGE, "seq", "text", "position", "x0", "y0", "x1", "y1")
    return deduplicated(rows) if deduplicate else rows


def deduplicated(texts: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id", "_norm", "position").orderBy("page_number", "seq")
    return texts.withColumn("_norm", normalise_edge("text")).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_norm", "_k")


def rank(name: str = "position") -> Column:
    return F.array_position(F.array(*map(F.lit, POSITIONS)), F.col(name))


def _listed(rows: DataFrame, line: Column, order: list) -> DataFrame:
    items = F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))), lambda e: e["line"])
    return rows.groupBy("doc_id").agg(F.array_join(items, "\n").alias("text"))


def formatted(texts: DataFrame, format: str = "markdown") -> DataFrame:
    """A document's edge texts as Markdown sections, as plain lines or as a bare list; unknown formats count as plain."""
    page = F.col("page_number").cast("string")
    if format == "list":
        return _listed(texts, F.col("text"), ["page_number", "seq"])
    if format != "markdown":
        return _listed(texts, F.concat(F.lit("["), F.col("position"), F.lit("] Page "), page, F.lit(": "), F.col("text")), ["page_number", "seq"])
    line = F.concat(F.lit("- Page "), page, F.lit(": "), F.col("text"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("page_number", "seq", line.alias("line")))), lambda e: e["line"])
    part = texts.groupBy("doc_id", "position").agg(F.concat(F.lit("### "), F.initcap("position"), F.lit("\n"), F.array_join(items, "\n"), F.lit("\n")).alias("part"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(rank().alias("r"), "part"))), lambda e: e["part"])
    return part.groupBy("doc_id").agg(F.array_join(parts, "\n").alias("text"))


def removed(regions: DataFrame, texts: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Regions of a page that are no edge text: an anti join on equal pages and corners nearer than `tolerance`."""
    r, t = regions.alias("r"), texts.alias("t")
    on = (F.col("r.doc_id") == F.col("t.doc_id")) & (F.col("r.page_number") == F.col("t.page_number")) & (F.abs(F.col("r.x0") - F.col("t.x0")) < tolerance) & (F.abs(F.col("r.y0") - F.col("t.y0")) < tolerance)
    return r.join(t, on, "left_anti")


def summary(texts: DataFrame) -> DataFrame:
    """Counts of each document: in all, by position and by page, as grouping sets (position and page_number null where not grouped by)."""
    rows = texts.select("doc_id", "position", "page_number")
    return rows.groupingSets([["doc_id"], ["doc_id", "position"], ["doc_id", "page_number"]], "doc_id", "position", "page_number").agg(F.count("*").alias("n"))


def described() -> Column:
    return F.concat(F.lit("["), F.col("position"), F.lit(" page "), F.col("page_number").cast("string"), F.lit("]: "), F.col("text"))
