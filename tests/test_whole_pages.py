"""Orders, merging and summaries of pages that hold their elements in arrays: nothing but what belongs to a document is shuffled."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from docgrid.operators import elements
from docgrid.plans import catalog

BOX = "doc_id long, page_number int, seq int, text string, x0 double, y0 double, x1 double, y1 double, font_size double, is_bold boolean"


def rows(df):
    return sorted(map(repr, df.collect()))


def shuffles(name, spark, sf):
    return __spark_entry__.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def made(spark, seed):
    """Elements of odd texts and heights, sidebars and bodies of three pages, as rows and in the arrays of a page."""
    r = random.Random(seed)
    texts = ["word", "End.", "Next", "9", " ", "a ", ".", "中文", "", "x! ", "Figure 1", "note: this", "Table  2 "]
    one = []
    for page in (1, 2, 3):
        for seq in range(40):
            x, y = 30.0 * r.randrange(9), r.choice([0.0, 3.0, 9.0, 10.0, 11.0]) + 40 * r.randrange(3)
            one.append((7, page, seq, r.choice(texts), x, y, x + 25, y + 10, r.choice([0.0, 10.0, 12.0, 12.5, 15.0]), r.random() < 0.2))
    area = lambda: (7, r.choice([1, 2]), r.choice([None, 100.0 * r.random()]), 60 * r.random(), 250.0, r.choice([None, 100.0]))
    e = spark.createDataFrame(one, BOX)
    side, body = (spark.createDataFrame([area() for _ in range(3)], "doc_id long, page_number int, x0 double, y0 double, x1 double, y1 double") for _ in range(2))
    page = ["doc_id", "page_number"]
    held = lambda df, name, *c: df.groupBy(*page).agg(F.collect_list(F.struct(*c)).alias(name))
    sheets = held(e, "lines", *e.columns[2:])
    for name, df in (("edges", side), ("bodies", body)):
        own = held(df, name, "x0", "y0", "x1", "y1")
        sheets = sheets.join(own, page, "left").withColumn(name, F.coalesce(name, F.array().cast(own.schema[name].dataType)))
    return e, side, body, sheets


def test_complex_layouts_are_merged_page_by_page(spark, sf):
    assert shuffles("merge_complex_layout", spark, sf) == 0
    e, side, body, sheets = made(spark, 1)
    assert rows(elements.merge_complex_of(sheets)) == rows(elements.merge_complex(e, side, body))


def test_regions_order_page_by_page(spark, sf):
    assert shuffles("region_order", spark, sf) == 0
    e, side, body, sheets = made(spark, 2)
    assert rows(elements.region_order_of(sheets)) == rows(elements.region_order(e, side, body).select("doc_id", "page_number", "seq", "bucket", "order_no"))


def test_adaptive_order_page_by_page(spark, sf):
    assert shuffles("adaptive_order", spark, sf) == 0
    e, _, _, sheets = made(spark, 3)
    assert rows(elements.adaptive_order_of(sheets, "lines")) == rows(elements.adaptive_order(e).select("doc_id", "page_number", "seq", "order_no"))


def test_adjacent_elements_are_merged_page_by_page(spark, sf):
    assert shuffles("merge_adjacent", spark, sf) == 0
    e, _, _, sheets = made(spark, 4)
    columns = ["doc_id", "page_number", "merged_no", "seq", "text", "x0", "y0", "x1", "y1"]
    assert rows(elements.merge_adjacent_of(sheets, "lines").select(columns)) == rows(elements.merge_adjacent(elements.reading_order(e)).select(columns))


def test_page_lines_of_whole_pages(spark, sf):
    assert shuffles("sql_page_lines", spark, sf) == 0
    words = [(1, p, s, None if s == 5 else f"w{s}", float(s * 7 % 50), None if s == 3 else float(s * 5 % 41)) for p in (1, 2) for s in range(20)]
    df = spark.createDataFrame(words, "doc_id long, page_number int, seq int, text string, x0 double, top double")
    held = df.groupBy("doc_id", "page_number").agg(F.collect_list(F.struct("seq", "text", "x0", "top")).alias("w")).select("doc_id", "page_number", "w.seq", "w.text", "w.x0", "w.top")
    catalog.register(spark, {"whole_words": df, "whole_sheets": held})
    lines = lambda name, gap: rows(spark.sql(f"SELECT * FROM page_lines(TABLE({name}){gap})"))
    for gap in ("", ", gap => 2.5"):
        assert lines("whole_sheets", gap) == lines("whole_words", gap)
