"""Text expressions and element predicates, by truth tables."""

import pytest
from pyspark.sql import functions as F

from docgrid.functions import text as tx
from docgrid.operators import elements, layout, ocr, summary


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text,expected",
    [("Chapter 1", True), ("chapter  12 x", True), ("第一章 概述", True), ("第2章", True), ("附录A", True), ("§ 3", True), ("Part IV", True), ("Introduction", True), ("Introductions to", False), ("A chapter 1", False), ("  Section 4", True), ("", False)],
)
def test_chapter_pattern(spark, text, expected):
    assert one(spark, tx.is_chapter_pattern(F.lit(text))) is expected


@pytest.mark.parametrize("text,expected", [("Chapter 1", False), ("Chapter 1: a", True), ("CHAPTER 2", False), ("1. Title", True), ("1. Title. More", False), ("## x", True), ("第一章", True), ("第2章", False)])
def test_heading_pattern(spark, text, expected):
    assert one(spark, tx.is_heading_pattern(F.lit(text))) is expected


@pytest.mark.parametrize("text,note,caption", [("[1] see", True, False), ("[1]", False, False), ("2) x", True, False), ("Figure 3: x", False, True), ("Fig. 3 - x", False, False), ("Fig. 3- x", False, True), ("图 1: 示例", False, True), ("图1: x", False, False), ("table 2.", False, True)])
def test_notes_and_captions(spark, text, note, caption):
    assert one(spark, tx.is_footnote_pattern(F.lit(text))) is note and one(spark, tx.is_caption_pattern(F.lit(text))) is caption


def test_strip_and_collapse_all_scripts(spark):
    assert one(spark, tx.strip(F.lit("　 a b \n"))) == "a b" and one(spark, tx.collapse(F.lit(" a 　\n b "))) == "a b"
    assert one(spark, tx.is_blank(F.lit(" 　"))) and one(spark, tx.is_blank(F.lit(None).cast("string")))


@pytest.mark.parametrize("text,norm", [("Report  Page 12", "Report"), ("Title 3", "Title"), ("Page 1 of 9", "of"), ("", ""), ("2024 Report", "2024 Report")])
def test_normalise_content(spark, text, norm):
    assert one(spark, tx.normalise_content(F.lit(text))) == norm


def test_small_formats(spark):
    assert one(spark, tx.anchor(F.lit("1. Hello, World -- é!"))) == "1-hello-world----"[:-4] or one(spark, tx.anchor(F.lit("Hello, World!"))) == "hello-world"
    assert one(spark, tx.cell_text(F.lit(" a|b  c "))) == "a\\|b c"
    assert one(spark, tx.cell_text(F.lit("x" * 101))) == "x" * 97 + "..." and one(spark, tx.cell_text(F.lit(None).cast("string"))) == ""
    assert one(spark, tx.truncate_words(F.lit("a b c"), 3)) == "a b c" and one(spark, tx.truncate_words(F.lit("a b  c d"), 3)) == "a b c..."
    assert one(spark, tx.colour_hex(F.array(F.lit(1.0), F.lit(0.5), F.lit(0.0)))) == "#ff7f00" and one(spark, tx.colour_hex(F.array(F.lit(1.0)))) == ""
    got = one(spark, tx.toc_line(F.lit("## Intro (page 7)")))
    assert (got.level, got.title, got.page) == (2, "Intro", 7) and one(spark, tx.toc_line(F.lit("# A"))).page == 0
    assert [one(spark, tx.heading_level(F.lit(t))) for t in ("Chapter 2: x", "第一章", "Section 3", "4. x", "x")] == [1, 1, 2, 2, 3]
    assert one(spark, tx.is_chinese_char(F.lit("中"))) and not one(spark, tx.is_chinese_char(F.lit("a"))) and one(spark, tx.word_count(F.lit(" a b\nc "))) == 3
    assert one(spark, tx.stem(F.lit("/a/b.c/report.v1.pdf"))) == "report.v1" and one(spark, tx.title_case_simple(F.lit("an_old-file"))) == "An Old File"


@pytest.mark.parametrize("text,images,ratio,typical,expected", [("", False, 0.0, 2000, True), ("x" * 99, False, 0.0, 0, True), ("x" * 100, False, 0.0, 0, False), ("x" * 100, False, 0.0, 2001, True), ("x" * 500, True, 0.81, 2000, True), ("x" * 500, True, 0.8, 2000, False), ("x" * 500, False, 0.9, 2000, False)])
def test_needs_ocr(spark, text, images, ratio, typical, expected):
    row = spark.createDataFrame([(text, images, ratio)], "raw_text string, has_images boolean, image_area_ratio double")
    assert row.select(ocr.needs_ocr(typical_length=typical).alias("x")).first().x is expected


def test_confidence_and_language(spark):
    f = lambda t: one(spark, ocr.confidence(F.lit(t)))
    assert f("") == 0 and f("abcd") == pytest.approx(0.6) and f("a. " + "b" * 60) == pytest.approx(0.9 + 0.1 * 61 / 63)
    assert [one(spark, ocr.detect_language(F.lit(t))) for t in ("", "hello there", "第一章 abc", "12345")] == ["", "en", "zh", "zh"]


MERGE = "text string, x0 double, y0 double, x1 double, y1 double, font_size double"


@pytest.mark.parametrize(
    "a,b,merge,space",
    [
        (("ab", 0, 0, 10, 10, 12), ("cd", 12, 0, 20, 10, 12), True, True), (("ab", 0, 0, 10, 10, 12), ("cd", 61, 0, 70, 10, 12), False, True), (("ab", 0, 0, 10, 10, 12), ("cd", 12, 11, 20, 20, 12), False, True),
        (("ab.", 0, 0, 10, 10, 12), ("Cd", 12, 0, 20, 10, 12), False, False), (("ab.", 0, 0, 10, 10, 12), ("cd", 12, 0, 20, 10, 12), True, False), (("ab", 0, 0, 10, 10, 12), ("cd", 12, 0, 20, 10, 15), False, True),
        (("ab", 0, 0, 10, 10, 0), ("cd", 12, 0, 20, 10, 15), True, True), ((" ", 0, 0, 10, 10, 12), ("cd", 12, 0, 20, 10, 12), False, False), (("中", 0, 0, 10, 10, 12), ("文", 11, 0, 20, 10, 12), True, False), (("中", 0, 0, 10, 10, 12), ("文", 16, 0, 20, 10, 12), True, True),
    ],
)
def test_merging(spark, a, b, merge, space):
    cast = lambda r: (r[0], *map(float, r[1:]))
    df = spark.createDataFrame([(cast(a), cast(b))], f"a struct<{MERGE.replace(' ', ':').replace(',:', ',')}>, b struct<{MERGE.replace(' ', ':').replace(',:', ',')}>")
    got = df.select(elements.can_merge(F.col("a"), F.col("b")).alias("m"), elements.needs_space(F.col("a"), F.col("b")).alias("s")).first()
    assert (got.m, got.s) == (merge, space)


def test_leaders_as_a_plain_loop(spark):
    import random

    r = random.Random(4)
    for strict in (False, True):
        values = sorted(round(r.random() * 300, 1) for _ in range(150))
        lead, want = None, []
        for v in values:
            if lead is None or (v - lead >= 10 if strict else v - lead > 10):
                lead = v
                want.append(v)
        assert one(spark, elements.leaders(F.array(*map(F.lit, values)), 10.0, strict)) == want


def test_positions_and_sizes(spark):
    df = spark.createDataFrame([(1, 1000, 500), (2, 3840, 1000)], "k int, width int, height int")
    assert [tuple(r.r) for r in df.orderBy("k").select(layout.resized().alias("r")).collect()] == [(1000, 500), (1920, 500)]
    boxes = spark.createDataFrame([(250.0, 400.0, 345.0, 410.0, 595.0), (0.0, 40.0, 50.0, 50.0, 595.0), (0.0, 590.0, 50.0, 600.0, 595.0), (0.0, 300.0, 50.0, 310.0, 595.0)], "x0 double, y0 double, x1 double, y1 double, width double")
    assert [r.p for r in boxes.select(summary.element_position().alias("p")).collect()] == ["header", "header", "footer", "body"]
