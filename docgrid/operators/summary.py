"""Document summaries by rule: headings, footnotes, captions, annotations, key points, contents."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_annotation_marker, heading_level, is_caption_pattern, is_footnote_pattern, is_heading_pattern, strip, stem, title_case_simple, truncate_words
from .elements import PAGE, is_centered

TYPES = ("heading", "annotation", "footnote", "caption")
_ITEM = [*PAGE, "kind_rank", "seq", "item_type", "text", "position", "confidence", "context"]


def element_position() -> Column:
    """header if centred or within 50 of the top, footer if its end is beyond the page's width less 50, else body."""
    return F.when(is_centered("width"), "header").when(F.col("y0") < 50, "header").when(F.col("y1") > F.col("width") - 50, "footer").otherwise("body")


def _item(rows: DataFrame, kind: str, rank: int, confidence: float, text: Column, position: Column, context: Column) -> DataFrame:
    return rows.select(*PAGE, F.lit(rank).alias("kind_rank"), "seq", F.lit(kind).alias("item_type"), text.alias("text"), position.alias("position"), F.lit(confidence).alias("confidence"), context.alias("context"))


def headings(elements: DataFrame, pages: DataFrame, min_font_size: float = 14.0) -> DataFrame:
    rows = elements.where((F.col("font_size") >= min_font_size) & is_heading_pattern("text"))
    if "width" not in elements.columns:
        rows = rows.join(pages.select(*PAGE, "width"), PAGE)
    return _item(rows, "heading", 0, 0.9, strip("text"), element_position(), F.concat(F.lit("Font size: "), F.col("font_size").cast("string"), F.lit("pt")))


def _lines(bodies: DataFrame) -> DataFrame:
    return bodies.select(*PAGE, F.posexplode(F.split("body_text", "\n", -1)).alias("seq", "line")).withColumn("line", strip("line"))


def footnotes(bodies: DataFrame) -> DataFrame:
    """Body lines that begin like footnotes; bodies: doc_id, page_number, body_text."""
    return _item(_lines(bodies).where(is_footnote_pattern("line")), "footnote", 1, 0.8, F.col("line"), F.lit("body"), F.lit(None).cast("string"))


def captions(bodies: DataFrame) -> DataFrame:
    return _item(_lines(bodies).where(is_caption_pattern("line")), "caption", 2, 0.85, F.col("line"), F.lit("body"), F.lit(None).cast("string"))


def annotations(edges: DataFrame) -> DataFrame:
    """Edge regions with an annotation mark."""
    return _item(edges.where(has_annotation_marker("text")), "annotation", 3, 0.7, strip("text"), F.lit("edge"), F.lit("Edge text"))


def items(elements: DataFrame, pages: DataFrame, bodies: DataFrame, edges: DataFrame, min_font_size: float = 14.0) -> DataFrame:
    """All summary items; their order is page, kind_rank, seq."""
    return headings(elements, pages, min_font_size).unionByName(footnotes(bodies)).unionByName(captions(bodies)).unionByName(annotations(edges))


def of_type(rows: DataFrame, item_type: str) -> DataFrame:
    return rows.where(F.col("item_type") == item_type)


def in_pages(rows: DataFrame, first: int, last: int) -> DataFrame:
    return rows.where(F.col("page_number").between(first, last))


def confident(rows: DataFrame, least: float = 0.7) -> DataFrame:
    return rows.where(F.col("confidence") >= least)


def described() -> Column:
    return F.concat(F.lit("["), F.col("item_type"), F.lit("] Page "), F.col("page_number").cast("string"), F.lit(": "), F.col("text"))


def _ordered(order: list, value: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda e: e[value])


def headings_by_level(found: DataFrame, max_level: int = 3) -> DataFrame:
    """The headings of each level from 1 to max_level of each document, empty where it has none."""
    levels = found.select("doc_id").distinct().withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(max_level))))
    own = found.withColumn("level", heading_level("text")).groupBy("doc_id", "level").agg(_ordered(["page_number", "seq"], "text").alias("headings"))
    return levels.join(own, ["doc_id", "level"], "left").withColumn("headings", F.coalesce("headings", F.array().cast("array<string>")))


def index(rows: DataFrame) -> DataFrame:
    """``## Index`` of each document, grouped by type."""
    line = F.concat(F.lit("- "), F.col("text"), F.lit(" (page "), F.col("page_number").cast("string"), F.lit(")"))
    part = rows.withColumn("line", line).groupBy("doc_id", "item_type").agg(F.array_join(_ordered(["page_number", "kind_rank", "seq"], "line"), "\n").alias("lines"))
    part = part.withColumn("r", F.array_position(F.array(*map(F.lit, TYPES)), F.col("item_type"))).withColumn("block", F.concat(F.lit("### "), F.initcap("item_type"), F.lit("\n\n"), F.col("lines"), F.lit("\n")))
    return part.groupBy("doc_id").agg(F.concat(F.lit("## Index\n\n"), F.array_join(_ordered(["r"], "block"), "\n")).alias("text"))


def key_points(bodies: DataFrame, max_points: int = 10) -> DataFrame:
    """First sentences of paragraphs, longer than 20 characters, the first max_points of each document."""
    rows = bodies.select(*PAGE, F.posexplode(F.split("body_text", "\n\n", -1)).alias("seq", "paragraph"))
    rows = rows.withColumn("sentence", strip(F.substring_index("paragraph", ". ", 1))).where(F.length("sentence") > 20)
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number", "seq"))).where(F.col("k") <= max_points)
    return rows.select("doc_id", "k", F.concat("sentence", F.lit(".")).alias("point"))


def toc(found: DataFrame) -> DataFrame:
    """Contents: ``level, title, page_number`` of the headings of each document with its place ``k``, by level and page."""
    w = Window.partitionBy("doc_id").orderBy("level", "page_number", "seq")
    return found.withColumn("level", heading_level("text")).select("doc_id", F.row_number().over(w).alias("k"), "level", F.col("text").alias("title"), "page_number")


def toc_markdown(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Indented links to the pages of headings; documents without headings say so."""
    line = F.concat(F.expr("repeat('  ', level - 1)"), F.lit("- ["), F.col("text"), F.lit("](#page-"), F.col("page_number").cast("string"), F.lit(")"))
    own = found.withColumn("level", heading_level("text")).withColumn("line", line).groupBy("doc_id").agg(F.concat(F.lit("## Table of Contents\n\n"), F.array_join(_ordered(["page_number", "seq"], "line"), "\n")).alias("lines"))
    return docs.select("doc_id").distinct().join(own, "doc_id", "left").select("doc_id", F.coalesce("lines", F.lit("*No headings found.*")).alias("toc"))


def titles(found: DataFrame, files: DataFrame) -> DataFrame:
    """The first heading of level 1 of each document, or else its file name as a title; files: doc_id, path."""
    first = found.where(heading_level("text") == 1).groupBy("doc_id").agg(F.min_by("text", F.struct("page_number", "seq")).alias("first"))
    return files.join(first, "doc_id", "left").select("doc_id", F.coalesce("first", title_case_simple(stem("path"))).alias("title"))


def summaries(rows: DataFrame, bodies: DataFrame, statistics: DataFrame, files: DataFrame) -> DataFrame:
    """One row a document: title, headings, key points, footnotes, annotations, page and word counts."""
    empty = F.array().cast("array<string>")
    per = statistics.groupBy("doc_id").agg(F.count("*").alias("page_count"), F.sum("word_count").alias("word_count"))
    lists = rows.groupBy("doc_id").agg(*(F.transform(F.array_sort(F.collect_list(F.when(F.col("item_type") == k, F.struct("page_number", "seq", "text")))), lambda e: e["text"]).alias(f"{k}s") for k in TYPES))
    points = key_points(bodies).groupBy("doc_id").agg(_ordered(["k"], "point").alias("key_points"))
    found = of_type(rows, "heading")
    contents = toc(found).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "level", "title", "page_number"))).alias("toc"))
    out = per.join(titles(found, files), "doc_id").join(lists, "doc_id", "left").join(points, "doc_id", "left").join(contents, "doc_id", "left")
    none = F.array().cast("array<struct<k:int,level:int,title:string,page_number:int>>")
    return out.select("doc_id", "title", *(F.coalesce(c, empty).alias(c) for c in ("headings", "key_points", "footnotes", "annotations")), F.coalesce(F.col("toc"), none).alias("toc"), "page_count", "word_count")


def statistics(docs: DataFrame) -> DataFrame:
    """Counts of a summary's lists, and words a page (0 without pages)."""
    n = lambda c, name: F.size(c).cast("long").alias(name)
    return docs.select(
        "doc_id", n("headings", "heading_count"), n("key_points", "key_point_count"), n("footnotes", "footnote_count"), n("annotations", "annotation_count"), n("toc", "toc_entries"),
        F.coalesce(F.try_divide("word_count", "page_count"), F.lit(0.0)).cast("double").alias("avg_words_per_page"),
    )


def section(name: str, lines: Column) -> Column:
    """``## name`` and a list; null if there is nothing to list."""
    return F.when(F.size(lines) > 0, F.concat(F.lit(f"{name}\n\n"), F.array_join(lines, "\n"), F.lit("\n")))


def dashed(c: str) -> Column:
    return F.transform(F.col(c), lambda x: F.concat(F.lit("- "), x))


def numbered(c: str) -> Column:
    return F.transform(F.col(c), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))


def toc_lines() -> Column:
    return F.transform(F.col("toc"), lambda x: F.concat(F.repeat(F.lit("#"), x["level"]), F.lit(" "), x["title"], F.lit(" (page "), x["page_number"].cast("string"), F.lit(")")))


def to_markdown() -> Column:
    """A summary row as Markdown; sections that are empty are left out."""
    head = F.concat(F.lit("# "), F.col("title"), F.lit("\n\n**Page Count**: "), F.col("page_count").cast("string"), F.lit("\n\n**Word Count**: "), F.col("word_count").cast("string"), F.lit("\n"))
    parts = (section("## Headings", dashed("headings")), section("## Key Points", dashed("key_points")), section("## Table of Contents", toc_lines()), section("## Footnotes", numbered("footnotes")), section("## Annotations", dashed("annotations")))
    return F.concat_ws("\n", head, *parts)


def prompt(title: Column, content: Column, context: Column, max_words: int = 2000) -> Column:
    """What an assistant is asked: title, content cut to max_words, context lines, the three parts wanted."""
    lines = F.array_join(F.transform(context, lambda x: F.concat(F.lit("- "), x)), "\n")
    known = F.when(F.size(context) > 0, F.concat(F.lit("\nKnown items:\n"), lines, F.lit("\n"))).otherwise("")
    return F.concat(F.lit("Document: "), title, F.lit("\n\n"), truncate_words(content, max_words), F.lit("\n"), known, F.lit("\nGive a summary, key points and a table of contents.\n"))


def parse_headings(reply: Column) -> Column:
    """Heading lines of an assistant's reply, hashes taken off."""
    return F.transform(F.filter(F.split(reply, "\n", -1), lambda x: strip(x).startswith("##")), lambda x: strip(F.replace(x, F.lit("#"), F.lit(""))))


def parse_key_points(reply: Column, n: int = 5) -> Column:
    """The first n lines that begin with a hyphen or star, without it."""
    lines = F.filter(F.transform(F.split(reply, "\n", -1), strip), lambda x: x.startswith("-") | x.startswith("*"))
    return F.slice(F.transform(lines, lambda x: strip(F.regexp_replace(x, r"^[-*]+", ""))), 1, n)


def fallback(rows: DataFrame) -> DataFrame:
    """What stands in for an assistant's summary: the headings of each document."""
    return of_type(rows, "heading").groupBy("doc_id").agg(_ordered(["page_number", "seq"], "text").alias("headings"))


class Assistant(Protocol):
    """What answers a prompt; made once a worker."""

    def reply(self, prompt: str) -> str: ...


def assisted(prompts: DataFrame, make_assistant: Callable[[], Assistant], column: str = "prompt") -> DataFrame:
    """prompts with ``reply`` and ``reply_error``: what the assistant says, or what went wrong; null prompts aren't sent."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        assistant = make_assistant()
        for b in batches:
            rows = []
            for p in b:
                try:
                    rows.append((None if p is None else assistant.reply(p), None))
                except Exception as e:
                    rows.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["reply", "error"])

    got = prompts.withColumn("_got", F.pandas_udf(run, "reply string, error string")(column))
    return got.withColumn("reply", F.col("_got.reply")).withColumn("reply_error", F.col("_got.error")).drop("_got")


def assistant_summaries(prompts: DataFrame, items: DataFrame, make_assistant: Callable[[], Assistant] | None = None, max_points: int = 5) -> DataFrame:
    """``doc_id, headings, key_points, by, reply_error`` for prompts (doc_id, prompt): the assistant's, or the rules' headings where there is no assistant or it fails."""
    said = prompts.withColumn("reply", F.lit(None).cast("string")).withColumn("reply_error", F.lit(None).cast("string")) if make_assistant is None else assisted(prompts, make_assistant)
    rows = said.join(fallback(items).withColumnRenamed("headings", "own"), "doc_id", "left")
    empty = F.array().cast("array<string>")
    ok = F.col("reply").isNotNull()
    return rows.select(
        "doc_id", F.when(ok, parse_headings(F.col("reply"))).otherwise(F.coalesce("own", empty)).alias("headings"), F.when(ok, parse_key_points(F.col("reply"), max_points)).otherwise(empty).alias("key_points"),
        F.when(ok, "assistant").otherwise("rules").alias("by"), "reply_error",
    )
