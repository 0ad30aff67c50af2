"""Markdown rendering: links, page blocks, documents as one file or as many."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import _c, anchor, stem
from . import summary, tables
from .elements import PAGE

#: Documents without images and with fewer pages than this are rendered as one file.
SINGLE_FILE_PAGES = 10
CLOSING = "\n---\n\n*This document was generated by docgrid.*"


def title_case(text) -> Column:
    """Underscores and hyphens as spaces, then str.title (``2nd`` becomes ``2Nd``): an Arrow function, as no built-in one cuts words so."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda t: None if t is None else t.title())

    return F.pandas_udf(run, "string")(F.translate(_c(text), "_-", "  "))


def relative_path(target, base) -> Column:
    """Path of target as seen from the folder base, both given from one root."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([posixpath.relpath(x, y or ".") for x, y in zip(a, b)])

    return F.pandas_udf(run, "string")(_c(target), _c(base))


def image_link(path, relative, title: Column | None = None) -> Column:
    """``![alt](relative)``; alt is the file's name as a title."""
    return F.concat(F.lit("!["), title if title is not None else title_case(stem(path)), F.lit("]("), _c(relative), F.lit(")"))


def image_link_with_size(path, relative, max_width: int | None, title: Column | None = None) -> Column:
    """An img tag of the given width, or a plain link without one."""
    if not max_width:
        return image_link(path, relative, title)
    alt = title if title is not None else title_case(stem(path))
    return F.concat(F.lit('<img src="'), _c(relative), F.lit('" alt="'), alt, F.lit(f'" width="{max_width}">'))


def section_link(title, file: Column | None = None, name: Column | None = None) -> Column:
    target = F.concat(F.coalesce(file, F.lit("")) if file is not None else F.lit(""), F.lit("#"), name if name is not None else anchor(title))
    return F.concat(F.lit("["), _c(title), F.lit("]("), target, F.lit(")"))


def toc_link(title, file, page: Column | None = None) -> Column:
    """``- [title](file#anchor)``, with the page where it isn't null."""
    after = F.coalesce(F.concat(F.lit(" (page "), page.cast("string"), F.lit(")")), F.lit("")) if page is not None else F.lit("")
    return F.concat(F.lit("- "), section_link(title, _c(file)), after)


def gallery(images: DataFrame) -> DataFrame:
    """``## Images`` and a numbered list of each document's images; images: doc_id, page_number, image_no, link."""
    w = Window.partitionBy("doc_id").orderBy("page_number", "image_no")
    rows = images.withColumn("k", F.row_number().over(w)).withColumn("line", F.concat(F.col("k").cast("string"), F.lit(". "), F.col("link"), F.lit("\n")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda e: e["line"])
    return rows.groupBy("doc_id").agg(F.concat(F.lit("## Images\n\n"), F.array_join(lines, "\n")).alias("text"))


def with_links(markdown, mapping: Column) -> Column:
    """Markdown with each key of a map replaced by its value, entries in order."""
    return F.aggregate(F.map_entries(mapping), _c(markdown), lambda acc, e: F.replace(acc, e["key"], e["value"]))


def output_format(pages: DataFrame) -> DataFrame:
    """multi for documents with images or SINGLE_FILE_PAGES pages or more, else single."""
    per = pages.groupBy("doc_id").agg(F.bool_or(F.coalesce("n_images", F.lit(0)) > 0).alias("some"), F.count("*").alias("n"))
    return per.select("doc_id", F.when(F.col("some") | (F.col("n") >= SINGLE_FILE_PAGES), "multi").otherwise("single").alias("output_format"))


def _page_head() -> Column:
    return F.concat(F.lit("\n## Page "), F.col("page_number").cast("string"), F.lit("\n"))


def _page_body() -> Column:
    return F.when(F.coalesce("body_text", F.lit("")) != "", F.concat("body_text", F.lit("\n")))


def body_blocks(bodies: DataFrame) -> DataFrame:
    """:func:`page_blocks` of pages that have nothing but their body."""
    return bodies.select(*PAGE, F.concat_ws("\n", _page_head(), _page_body()).alias("block"))


def page_blocks(pages: DataFrame, bodies: DataFrame, cells: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """``block`` of each page: heading, body, image links, tables, recognised text; what is missing is left out."""
    out = pages.select(*PAGE, F.coalesce("ocr_text", F.lit("")).alias("ocr")).join(bodies, PAGE, "left")
    if cells is not None:
        out = out.join(tables.listed(cells), PAGE, "left")
    else:
        out = out.withColumn("markdown", F.lit(None).cast("string"))
    if links is not None:
        own = links.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("image_no", "link"))), lambda e: F.concat(e["link"], F.lit("\n"))), "\n").alias("images"))
        out = out.join(own, PAGE, "left")
    else:
        out = out.withColumn("images", F.lit(None).cast("string"))
    table = F.when(F.coalesce("markdown", F.lit("")) != "", F.concat(F.lit("\n### Tables\n\n"), F.col("markdown"), F.lit("\n")))
    ocr = F.when(F.col("ocr") != "", F.concat(F.lit("\n### OCR Extracted Text\n\n"), F.col("ocr"), F.lit("\n")))
    return out.select(*PAGE, F.concat_ws("\n", _page_head(), _page_body(), F.col("images"), table, ocr).alias("block"))


def complete_content(blocks: DataFrame) -> DataFrame:
    """All page blocks of each document."""
    return blocks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "block"))), lambda e: e["block"]), "\n").alias("content"))


def _chapter_page() -> Column:
    return F.concat(F.lit("\n## Page "), F.col("page_number").cast("string"), F.lit("\n\n"), F.coalesce(F.nullif("body_text", F.lit("")), F.lit("*No text*")), F.lit("\n"))


def _titled(title: Column, number: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.concat(F.lit("Chapter "), number.cast("string")))


def chapter_pages(numbered: DataFrame) -> DataFrame:
    """:func:`chapter_content` without ranges for numbered pages that carry their body: each boundary's page by itself."""
    rows = numbered.where("found is not null and doc_id is not null")
    content = F.concat(F.lit("# "), _titled(F.col("found.title"), F.col("chapter")), F.lit("\n\n"), _chapter_page())
    return rows.select("doc_id", F.col("chapter").alias("chapter_number"), content.alias("content"))


def chapter_wholes(numbered: DataFrame) -> DataFrame:
    """:func:`chapter_content` with ranges for numbered pages that carry their body: as they lie by document, chapters need no further shuffle."""
    rows = numbered.where("chapter > 0 and doc_id is not null").withColumn("part", F.struct("page_number", _chapter_page().alias("b")))
    parts = F.transform(F.array_sort(F.collect_list("part")), lambda e: e["b"])
    own = rows.groupBy("doc_id", F.col("chapter").alias("chapter_number")).agg(F.max("found.title").alias("title"), F.array_join(parts, "\n").alias("b"))
    return own.select("doc_id", "chapter_number", F.concat(F.lit("# "), _titled(F.col("title"), F.col("chapter_number")), F.lit("\n\n"), F.col("b")).alias("content"))


def chapter_content(bodies: DataFrame, found: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """Each chapter's title and page bodies. Without ranges a chapter holds its first page only; with them all pages up to the next chapter."""
    heads = found.select("doc_id", "chapter_number", "page_number", _titled(F.col("title"), F.col("chapter_number")).alias("title"))
    if ranges is None:
        rows = heads.join(bodies, PAGE)
    else:
        span = heads.withColumnRenamed("page_number", "first_page").join(ranges.select("doc_id", "first_page", "last_page"), ["doc_id", "first_page"])
        pages = span.select("doc_id", "chapter_number", "title", F.explode(F.sequence("first_page", F.greatest("first_page", "last_page"))).alias("page_number")).withColumn("page_number", F.col("page_number").cast("int"))
        rows = pages.join(bodies, PAGE)
    block = _chapter_page()
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page_number", block.alias("b")))), lambda e: e["b"])
    return rows.groupBy("doc_id", "chapter_number", "title").agg(F.array_join(parts, "\n").alias("b")).select("doc_id", "chapter_number", F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.col("b")).alias("content"))


def header_block(path) -> Column:
    return F.concat(F.lit("# "), title_case(stem(path)), F.lit("\n\n*Generated from: `"), _c(path), F.lit("`*\n"))


def toc_block() -> Column:
    """Contents of a summary row, or links to the fixed sections where it has none."""
    fixed = "- [Introduction](./docs/complete_content.md)\n\n- [Summary](#summary)\n\n- [Images](#images)\n\n- [Edge Text](#edge-text)\n"
    return F.concat(F.lit("## Table of Contents\n\n"), F.when(F.size("toc") > 0, F.concat(F.array_join(summary.toc_lines(), "\n"), F.lit("\n"))).otherwise(fixed))


def summary_block() -> Column:
    """The summary section of a summary row."""
    head = F.concat(
        F.lit("\n## Summary\n\n**Title**: "), F.col("title"), F.lit("\n\n**Page Count**: "), F.col("page_count").cast("string"), F.lit("\n\n**Word Count**: "), F.col("word_count").cast("string"), F.lit("\n")
    )
    return F.concat_ws(
        "\n", head, summary.section("\n### Key Points", summary.dashed("key_points")), summary.section("\n### Headings", summary.dashed("headings")),
        summary.section("\n### Footnotes", summary.numbered("footnotes")), summary.section("\n### Annotations", summary.dashed("annotations")),
    )


def statistics_block(pages: DataFrame, statistics: DataFrame) -> DataFrame:
    """The summary section of documents without a summary: totals, and a table of pages."""
    rows = pages.select(*PAGE, F.coalesce("n_images", F.lit(0)).alias("i"), F.coalesce("n_tables", F.lit(0)).alias("t"), F.when(F.coalesce("ocr_text", F.lit("")) != "", "Yes").otherwise("No").alias("o")).join(statistics.select(*PAGE, "word_count"), PAGE, "left")
    w = F.coalesce("word_count", F.lit(0)).cast("string")
    line = F.concat(F.lit("| "), F.col("page_number").cast("string"), F.lit(" | "), w, F.lit(" | "), F.col("i").cast("string"), F.lit(" | "), F.col("t").cast("string"), F.lit(" | "), F.col("o"), F.lit(" |"))
    per = rows.withColumn("line", line).groupBy("doc_id").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("word_count", F.lit(0))).alias("w"), F.sum("i").alias("i"), F.sum("t").alias("t"), F.transform(F.array_sort(F.collect_list(F.struct("page_number", "line"))), lambda e: e["line"]).alias("lines")
    )
    total = lambda name, c: F.concat(F.lit(f"- **{name}**: "), F.col(c).cast("string"))
    head = F.lit("| Page | Words | Images | Tables | OCR Used |"), F.lit("|------|-------|--------|--------|----------|")
    return per.select("doc_id", F.concat_ws("\n", F.lit("\n## Summary\n"), total("Total Pages", "n"), total("Total Words", "w"), total("Images", "i"), total("Tables", "t"), F.lit(""), *head, F.array_join("lines", "\n")).alias("block"))


def documents(files: DataFrame, pages: DataFrame, summaries: DataFrame, contents: DataFrame, edge_markdown: DataFrame, chapters: DataFrame | None = None) -> DataFrame:
    """Output files: ``doc_id, path, content``, paths as seen from a document's own folder.

    Documents of the single format get one file with everything; those of the
    multi format a main file and, under docs/, a file for each chapter or, without
    chapters, one for the whole content.
    """
    rows = files.select("doc_id", "path").join(output_format(pages), "doc_id").join(summaries, "doc_id").join(contents, "doc_id", "left").join(edge_markdown.withColumnRenamed("text", "edge"), "doc_id", "left")
    edge = F.when(F.col("edge").isNotNull(), F.concat(F.lit("\n## Edge Text\n\n"), F.col("edge")))
    head, name = header_block("path"), F.concat(stem("path"), F.lit(".md"))
    one = F.concat_ws("\n", head, summary_block(), F.lit("\n## Content\n"), F.coalesce("content", F.lit("")), edge, F.lit(CLOSING))
    main = F.concat_ws("\n", head, toc_block(), summary_block(), F.lit("\n## Content\n\n*Full content available in the docs/ directory.*\n"), edge, F.lit(CLOSING))
    out = rows.select("doc_id", name.alias("path"), F.when(F.col("output_format") == "single", one).otherwise(main).alias("content"))
    multi = files.select("doc_id").join(output_format(pages).where("output_format = 'multi'"), "doc_id", "left_semi")
    whole = multi if chapters is None else multi.join(chapters.select("doc_id").distinct(), "doc_id", "left_anti")
    whole = whole.join(contents, "doc_id", "left")
    out = out.unionByName(whole.select("doc_id", F.lit("docs/complete_content.md").alias("path"), F.coalesce("content", F.lit("")).alias("content")))
    if chapters is not None:
        own = chapters.join(multi, "doc_id", "left_semi")
        out = out.unionByName(own.select("doc_id", F.concat(F.lit("docs/chapter_"), F.col("chapter_number").cast("string"), F.lit(".md")).alias("path"), "content"))
    return out
