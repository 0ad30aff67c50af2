"""Chapter boundaries: from an outline, from page elements, from layout changes; ranges and the chapter of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_chapter_pattern, strip
from .elements import PAGE, is_centered, upper_median

MIN_FONT, LARGE_FONT, TOP = 14.0, 16.0, 0.8
#: Shares by which a page's side or density differs from the one before when its layout counts as changed.
LAYOUT_CHANGE, DENSITY_CHANGE = 0.1, 0.3
PRIORITY = {"outline": 6, "pattern": 5, "font_position": 4, "structure": 3, "density": 2, "position": 1}
_FOUND = ["doc_id", "page_number", "title", "heading", "is_detected_by"]


def _of_document() -> Window:
    return Window.partitionBy("doc_id").orderBy("page_number")


def near_top(height="height", y="y1") -> Column:
    """In the fifth of the page that counts as its top: heights are taken as rising from the page's foot, as documents of this kind state them."""
    return F.col(y) >= TOP * F.col(height)


def likely_heading() -> Column:
    """Large, bold, centred, near the top and 1.3 times the page's middle size; needs width, height and median_size."""
    return (F.col("font_size") >= LARGE_FONT) & F.col("is_bold") & is_centered("width") & near_top() & (F.col("font_size") >= 1.3 * F.col("median_size"))


def from_outline(outline: DataFrame, pages: DataFrame) -> DataFrame:
    """Outline entries (doc_id, title, page) on pages that the document has."""
    known = pages.select("doc_id", "page_number").where("page_number > 0")
    rows = outline.withColumnRenamed("page", "page_number").join(known, PAGE)
    return rows.select("doc_id", "page_number", "title", F.col("title").alias("heading"), F.lit("outline").alias("is_detected_by"))


def from_pages(elements: DataFrame, pages: DataFrame, min_font_size: float = MIN_FONT) -> DataFrame:
    """The best candidate of each page among elements of min_font_size or more: chapter patterns before likely headings before large type near the top; the first of equals."""
    size = elements.where("font_size > 0").groupBy(*PAGE).agg(upper_median(F.collect_list(F.col("font_size").cast("double"))).alias("median_size"))
    rows = elements.where(F.col("font_size") >= min_font_size).join(pages.select(*PAGE, "width", "height"), PAGE).join(size, PAGE, "left")
    score = F.when(is_chapter_pattern("text"), 100).when(likely_heading(), 50).when((F.col("font_size") >= LARGE_FONT) & near_top(), 20)
    by = F.when(F.col("score") == 100, "pattern").when(F.col("score") == 50, "font_position").otherwise("position")
    w = Window.partitionBy(*PAGE).orderBy(F.desc("score"), "seq")
    best = rows.withColumn("score", score).where("score is not null").withColumn("k", F.row_number().over(w)).where("k = 1")
    return best.select("doc_id", "page_number", strip("text").alias("title"), F.col("text").alias("heading"), by.alias("is_detected_by"))


def candidates_in(array: str = "lines", min_font_size: float = MIN_FONT) -> Column:
    """The elements of an array that a chapter may begin with."""
    return F.filter(array, lambda e: e["font_size"] >= min_font_size)


def best_in(candidates: str, median_size: Column) -> Column:
    """:func:`from_pages` for a page that holds its candidates in an array: struct(heading, is_detected_by), null without one; needs width and height."""
    width, height = F.col("width"), F.col("height")

    def scored(e: Column) -> Column:
        large, top = e["font_size"] >= LARGE_FONT, e["y1"] >= TOP * height
        likely = large & e["is_bold"] & (F.abs((e["x0"] + e["x1"]) / 2 - width / 2) < width * 0.1) & top & (e["font_size"] >= 1.3 * median_size)
        score = F.when(is_chapter_pattern(e["text"]), 100).when(likely, 50).when(large & top, 20)
        return F.struct((-score).alias("k"), e["seq"].alias("seq"), e["text"].alias("text"))

    best = F.array_min(F.filter(F.transform(candidates, scored), lambda e: e["k"].isNotNull()))
    by = F.when(best["k"] == -100, "pattern").when(best["k"] == -50, "font_position").otherwise("position")
    return F.when(best.isNotNull(), F.struct(best["text"].alias("heading"), by.alias("is_detected_by")))


def largest_in(candidates: str) -> Column:
    """Text of the largest element of an array, the first of equals."""
    return F.array_min(F.transform(candidates, lambda e: F.struct((-e["font_size"]).alias("k"), e["seq"].alias("seq"), e["text"].alias("text"))))["text"]


def medians_in(array: str = "lines") -> Column:
    return upper_median(F.filter(F.transform(array, lambda e: e["font_size"].cast("double")), lambda v: v > 0))


def numbered(pages: DataFrame, layout_change: float = LAYOUT_CHANGE, density_change: float = DENSITY_CHANGE) -> DataFrame:
    """Pages with ``found``, the boundary struct(title, heading, is_detected_by) on them or null, and ``chapter``, how many boundaries their document has up to them.

    :func:`boundaries` for pages that carry what was found on them (``best``,
    ``largest``) beside their measures, a row each: one shuffle by document.
    """
    rows = changes(pages, layout_change, density_change, [c for c in pages.columns if c not in PAGE])
    by = F.when(F.col("layout_change"), "structure").when(F.col("density_change"), "density")
    choice = lambda heading, by: F.when(heading.isNotNull() & by.isNotNull(), F.struct((-_rank(by)).alias("k"), heading.alias("heading"), by.alias("is_detected_by")))
    one = F.array_min(F.array_compact(F.array(choice(F.col("best.heading"), F.col("best.is_detected_by")), choice(F.col("largest"), by))))
    rows = rows.withColumn("_one", one).withColumn("chapter", F.count("_one").over(_of_document().rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int"))
    found = F.struct(strip(F.col("_one.heading")).alias("title"), F.col("_one.heading").alias("heading"), F.col("_one.is_detected_by").alias("is_detected_by"))
    return rows.withColumn("found", F.when(F.col("_one").isNotNull(), found)).drop("_one", "best", "largest", "layout_change", "density_change")


def begun(numbered: DataFrame) -> DataFrame:
    """The boundaries among numbered pages."""
    return numbered.where("found is not null and doc_id is not null").select("doc_id", F.col("chapter").alias("chapter_number"), "page_number", "found.*")


def changes(layouts: DataFrame, layout_change: float = LAYOUT_CHANGE, density_change: float = DENSITY_CHANGE, keep: list[str] | None = None) -> DataFrame:
    """Each page against the one before: ``layout_change`` (paragraph count, or a side by more than that share) and ``density_change`` (that share of the greater, or between none and some); keep: further columns."""
    w = _of_document()
    before = lambda c: F.lag(c).over(w)
    own = dict.fromkeys(["n_body", "width", "height", "text_density", *(keep or [])])
    rows = layouts.select("doc_id", "page_number", *own, before("n_body").alias("pn"), before("width").alias("pw"), before("height").alias("ph"), before("text_density").alias("pd"))
    far = lambda a, b: F.coalesce(F.try_divide(F.abs(F.col(a) - F.col(b)), F.col(b)) > layout_change, F.lit(False))
    layout = F.col("pn").isNotNull() & ((F.col("n_body") != F.col("pn")) | far("width", "pw") | far("height", "ph"))
    a, b = F.col("text_density"), F.col("pd")
    density = b.isNotNull() & (((a == 0) != (b == 0)) | F.coalesce(F.try_divide(F.abs(a - b), F.greatest(a, b)) > density_change, F.lit(False)))
    return rows.select("doc_id", "page_number", *(keep or []), F.coalesce(layout, F.lit(False)).alias("layout_change"), F.coalesce(density, F.lit(False)).alias("density_change"))


def changed(pages: DataFrame, layout_change: float = LAYOUT_CHANGE, density_change: float = DENSITY_CHANGE) -> DataFrame:
    """:func:`from_structure` for pages that carry their ``largest`` heading beside their measures."""
    by = F.when(F.col("layout_change"), "structure").when(F.col("density_change"), "density")
    rows = changes(pages, layout_change, density_change, ["largest"]).withColumn("is_detected_by", by).where("is_detected_by is not null and largest is not null and doc_id is not null")
    return rows.select("doc_id", "page_number", strip("largest").alias("title"), F.col("largest").alias("heading"), "is_detected_by")


def from_structure(elements: DataFrame, layouts: DataFrame, min_font_size: float = MIN_FONT, layout_change: float = LAYOUT_CHANGE, density_change: float = DENSITY_CHANGE) -> DataFrame:
    """Pages with a heading whose layout changes, or else whose density changes: their largest heading, the first of equals."""
    w = Window.partitionBy(*PAGE).orderBy(F.desc("font_size"), "seq")
    top = elements.where(F.col("font_size") >= min_font_size).withColumn("k", F.row_number().over(w)).where("k = 1").select(*PAGE, strip("text").alias("title"), F.col("text").alias("heading"))
    by = F.when(F.col("layout_change"), "structure").when(F.col("density_change"), "density")
    return changes(layouts, layout_change, density_change).join(top, PAGE).withColumn("is_detected_by", by).where("is_detected_by is not null").select(*_FOUND)


def _rank(by: Column) -> Column:
    return F.coalesce(*(F.when(by == k, v) for k, v in PRIORITY.items()), F.lit(0))


def deduplicated(found: DataFrame) -> DataFrame:
    """One boundary a page, by priority of how it was found; boundaries numbered from 1 in each document."""
    rank = _rank(F.col("is_detected_by"))
    w = Window.partitionBy(*PAGE).orderBy(F.desc("rank"), "heading")
    one = found.withColumn("rank", rank).withColumn("k", F.row_number().over(w)).where("k = 1")
    return one.select("doc_id", F.row_number().over(_of_document()).alias("chapter_number"), "page_number", "title", "heading", "is_detected_by")


def boundaries(
    elements: DataFrame, pages: DataFrame, layouts: DataFrame, outline: DataFrame | None = None, min_font_size: float = MIN_FONT, layout_change: float = LAYOUT_CHANGE, density_change: float = DENSITY_CHANGE
) -> DataFrame:
    """Chapter boundaries of all documents. A document with outline entries takes these (chapter_number 0); others combine page and structure findings."""
    found = deduplicated(from_pages(elements, pages, min_font_size).unionByName(from_structure(elements, layouts, min_font_size, layout_change, density_change)))
    if outline is None:
        return found
    return outlined(found, outline, pages)


def outlined(found: DataFrame, outline: DataFrame, pages: DataFrame) -> DataFrame:
    """Boundaries in which documents with an outline have its entries."""
    listed = from_outline(outline, pages).select("doc_id", F.lit(0).alias("chapter_number"), *_FOUND[1:])
    return listed.unionByName(found.join(outline.select("doc_id").distinct(), "doc_id", "left_anti").select(listed.columns))


def ranges(found: DataFrame, pages: DataFrame) -> DataFrame:
    """First and last page of each chapter; one chapter of all pages for documents without boundaries."""
    total = pages.groupBy("doc_id").agg(F.count("*").alias("total"))
    w = Window.partitionBy("doc_id").orderBy("page_number")
    rows = found.select("doc_id", F.row_number().over(w).alias("chapter"), F.col("page_number").alias("first_page"), (F.lead("page_number").over(w) - 1).alias("next"))
    rows = total.join(rows, "doc_id", "left")
    return rows.select("doc_id", F.coalesce("chapter", F.lit(1)).alias("chapter"), F.coalesce("first_page", F.lit(1)).cast("long").alias("first_page"), F.coalesce("next", "total").cast("long").alias("last_page"))


def ranges_of(numbered: DataFrame) -> DataFrame:
    """:func:`ranges` of numbered pages."""
    per = numbered.groupBy("doc_id").agg(F.count("*").alias("total"), F.array_sort(F.collect_list(F.when(F.col("found").isNotNull(), F.col("page_number")))).alias("firsts"))
    rows = per.select("doc_id", "total", "firsts", F.posexplode_outer("firsts").alias("at", "first"))
    last = F.coalesce(F.get("firsts", F.col("at") + 1) - 1, F.col("total"))
    return rows.select("doc_id", F.coalesce(F.col("at") + 1, F.lit(1)).alias("chapter"), F.coalesce("first", F.lit(1)).cast("long").alias("first_page"), last.cast("long").alias("last_page"))


def page_chapter(pages: DataFrame, found: DataFrame) -> DataFrame:
    """``chapter`` of each page: the latest boundary at or before it, null before the first. One window over documents, no range join."""
    numbered = found.select("doc_id", "page_number", F.row_number().over(_of_document()).alias("own"))
    w = _of_document().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return pages.select(*PAGE).join(numbered, PAGE, "left").select(*PAGE, F.last("own", ignorenulls=True).over(w).alias("chapter"))


def has_chapters(pages: DataFrame, found: DataFrame) -> DataFrame:
    some = found.select("doc_id").distinct().withColumn("some", F.lit(True))
    return pages.select("doc_id").distinct().join(some, "doc_id", "left").select("doc_id", F.coalesce("some", F.lit(False)).alias("has_chapters"))


def described() -> Column:
    """``Chapter n: title (page p)``, without the number where it is 0."""
    head = F.when(F.col("chapter_number") > 0, F.concat(F.lit("Chapter "), F.col("chapter_number").cast("string"), F.lit(": "))).otherwise("")
    return F.concat(head, F.col("title"), F.lit(" (page "), F.col("page_number").cast("string"), F.lit(")"))
