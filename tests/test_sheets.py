"""Pages that hold their words in an array, against the forms that bring rows together, and texts that share a doc_id."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from docgrid import queries
from docgrid.operators import elements, layout
from docgrid.plans import convert, synth
from docgrid.queries import Tables
from docgrid.sources import pdf


def rows(df):
    return sorted(map(repr, df.collect()))


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


@pytest.mark.parametrize("name", ["element_predicates", "line_leaders_strict", "reading_order", "standard_order", "joined_lines", "page_layouts", "edge_words"])
def test_no_word_is_shuffled(spark, sf, name):
    assert shuffles(__spark_entry__.queries()[name](spark, sf)) == 0


@pytest.mark.parametrize("name, most", [("hf_normalize", 0), ("unique_headers", 1), ("unique_footers", 1)])
def test_only_distinct_headers_and_footers_are_shuffled(spark, sf, name, most):
    assert shuffles(__spark_entry__.queries()[name](spark, sf)) == most


def test_arrays_as_rows(spark, sf):
    t = Tables(spark, sf)
    assert rows(layout.measured(t.sheets)) == rows(layout.analyze(t.words, t.pages))
    by_rows = layout.body_lines(t.words, t.pages)
    assert rows(layout.body_lines_of(t.sheets)) == rows(by_rows)
    assert rows(elements.reading_order_of(t.token_sheets)) == rows(elements.reading_order(t.tokens).select("doc_id", "page_number", "seq", "order_no"))
    assert rows(elements.standard_order_of(t.token_sheets)) == rows(elements.standard_order(t.tokens).select("doc_id", "page_number", "seq", "order_no"))
    assert rows(elements.joined_lines_of(t.token_sheets)) == rows(elements.joined_lines(t.tokens))


@pytest.fixture(scope="module")
def shared_ids(spark, tmp_path_factory):
    """Two texts of one id, an empty and a null one, one that fills its page."""
    out = str(tmp_path_factory.mktemp("ids"))
    texts = [(1, "one two " * 400), (1, "three"), (2, ""), (3, None), (4, "x " * 300), (5, "\n a  b\n")]
    spark.createDataFrame([(i, x, "en", "s", 1) for i, x in texts], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{out}/documents.parquet")
    return out


@pytest.mark.parametrize("name", ["element_predicates", "region_geometry", "page_text_statistics", "page_layouts", "line_leaders"])
def test_texts_of_one_id_share_their_pages(spark, shared_ids, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{shared_ids}/documents.parquet/*.parquet'")
    con.sql("CREATE TABLE supplier (s_nationkey INT, s_suppkey INT, s_name VARCHAR, s_acctbal DOUBLE)")
    got = __spark_entry__.queries()[name](spark, shared_ids)
    want = con.sql(__spark_entry__.oracle_sql()[name])
    columns = [c for c in sorted(want.columns) if "text" not in c or "density" in c]  # words of one place are in no order
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.select(*columns).fetchall()))


@pytest.mark.parametrize("name", ["body_text_excluding_edges", "elements_outside_regions", "overlap_pairs", "overlap_groups", "page_text_statistics"])
def test_pages_meet_their_regions_and_boxes_where_they_are_read(spark, sf, name):
    assert shuffles(__spark_entry__.queries()[name](spark, sf)) == 0


def test_boxes_in_arrays_as_in_rows(spark):
    import random

    r, nan = random.Random(3), float("nan")
    box = lambda: (x := r.choice([0.0, 5.0, 40 * r.random()]), y := 40 * r.random(), x + r.choice([0.0, 4.0, 30.0]), y + r.choice([0.0, 3.0, 20.0]))
    lines = [(d, p, s, f"w{s}", *box()) for d in range(4) for p in (1, 2) for s in range(0, 60, 2)] + [(0, 1, 61, "n", nan, 0.0, 50.0, 50.0), (0, 1, 63, "n", None, 0.0, 50.0, 50.0), (0, 1, 65, "n", 0.0, 0.0, float("inf"), 50.0)]
    edges = [(d, 1, *box()) for d in range(3) for _ in range(4)] + [(3, 2, 0.0, 0.0, nan, 99.0)]
    one = spark.createDataFrame(lines, "doc_id long, page_number int, seq int, text string, x0 double, y0 double, x1 double, y1 double")
    regions = spark.createDataFrame(edges, "doc_id long, page_number int, x0 double, y0 double, x1 double, y1 double")
    pages = one.select("doc_id", "page_number").distinct().selectExpr("*", "'raw' AS raw_text")
    held = one.groupBy("doc_id", "page_number").agg(F.collect_list(F.struct("seq", "text", "x0", "y0", "x1", "y1")).alias("lines"))
    at = regions.groupBy("doc_id", "page_number").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("edges"))
    sheets = pages.join(held, ["doc_id", "page_number"]).join(at, ["doc_id", "page_number"], "left").withColumn("edges", F.coalesce("edges", F.array().cast(at.schema["edges"].dataType)))
    assert rows(elements.overlap_pairs_of(sheets, "lines")) == rows(elements.overlap_pairs(one))
    assert rows(elements.overlap_groups_of(sheets, "lines")) == rows(elements.overlap_groups(one))
    assert rows(elements.body_text_of(sheets)) == rows(elements.body_text(pages, one, regions))
    assert rows(sheets.select("doc_id", "page_number", F.explode(elements.outside_of()["seq"]).alias("seq"))) == rows(elements.outside_regions(one, regions).select("doc_id", "page_number", "seq"))


@pytest.mark.parametrize("name", ["elements_outside_regions", "overlap_pairs", "pdf_words"])
def test_boxes_of_texts_of_one_id(spark, shared_ids, name):
    test_texts_of_one_id_share_their_pages(spark, shared_ids, name)


def test_pdf_words_in_a_page(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id % 5 = 0")
    assert rows(synth.pdf_files_of(docs)) == rows(synth.pdf_files(synth.words(synth.sheets(docs))))
    files = synth.pdf_files_of(docs).withColumn("doc_id", F.xxhash64("path"))
    again = files.unionByName(files.selectExpr("'/in/broken.pdf' AS path", "CAST('no file' AS BINARY) AS content", "1L AS doc_id").limit(1))
    own = pdf.read_words(again).withColumn("doc_id", F.xxhash64("path"))
    want = convert.words_of(pdf.with_doc_ids(pdf.read_pages(again)))
    assert rows(own.select(*want.columns)) == rows(want)


def test_pdf_words_shuffle_no_character(spark, sf):
    plan = __spark_entry__.queries()["pdf_words"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "chars" not in plan


def test_words_in_characters():
    char = lambda i, text, x0, x1, top=0.0: {"seq": i, "text": text, "x0": x0, "x1": x1, "top": top, "bottom": top + 10, "fontname": "Bold" if i else "", "size": 10.0}
    chars = [char(0, "a", 0.0, 5.0), char(1, "b", 5.0, 9.0), char(2, " ", 9.0, 12.0), char(3, "c", 12.0, 17.0), char(4, "d", 20.0, 25.0), char(5, "e", 25.0, 30.0, 4.0)]
    assert [(w["seq"], w["text"], w["x0"], w["x1"], w["is_bold"]) for w in pdf.words_in(chars)] == [(0, "ab", 0.0, 9.0, False), (3, "c", 12.0, 17.0, True), (4, "d", 20.0, 25.0, True), (5, "e", 25.0, 30.0, True)]


ONCE = ["chapter_content", "chapter_content_whole", "complete_content", "chapter_boundaries", "chapter_from_structure", "chapter_ranges", "page_chapter_asof", "has_chapters", "chapter_labels"]


@pytest.mark.parametrize("name", ONCE)
def test_pages_go_to_their_document_once(spark, sf, name):
    assert shuffles(__spark_entry__.queries()[name](spark, sf)) == 1


@pytest.mark.parametrize("name", ["chapter_boundaries", "chapter_ranges", "page_chapter_asof", "has_chapters", "chapter_from_structure"])
def test_chapters_of_texts_of_one_id(spark, shared_ids, name):
    test_texts_of_one_id_share_their_pages(spark, shared_ids, name)


def test_paragraphs_in_a_page(spark, sf):
    t = Tables(spark, sf)
    assert rows(layout.paragraphs_in(t.sheets)) == rows(layout.body_paragraphs(t.words, t.pages))
    assert shuffles(__spark_entry__.queries()["region_geometry"](spark, sf)) == 0


def test_words_are_cut_alike_wherever_they_part(spark):
    texts = ["", None, " \n ", "a", "\n a  b\n", "x " * 299 + "y", "x " * 300, "x " * 301, "tab\tstays one\n\ntwo " * 250, "é😀 漢字 " * 400]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.page_number): [tuple(w) for w in r.words] for r in synth.sheets(docs).collect()}
    want = {}
    for i, text in enumerate(texts):
        for seq, w in enumerate(w for w in (text or "").replace("\n", " ").split(" ") if w):
            want.setdefault((i, seq // 300 + 1), []).append((seq, w))
    assert got == want
    sheets = synth.sheets(docs)
    assert rows(synth.elements_of(sheets)) == rows(synth.elements(synth.words(sheets)))
    assert rows(synth.pages_of(sheets)) == rows(synth.pages(synth.elements(synth.words(sheets))))


def test_documents_bring_bodies_together_once(spark, sf, monkeypatch):
    """All that is read later comes from the table of pages: its plan cuts the texts once and has one exchange."""
    kept = []
    monkeypatch.setattr(queries, "materialised", lambda df, name: kept.append((name, shuffles(df))) or df.limit(0))
    __spark_entry__.queries()["documents"](spark, sf)
    assert kept == [("pages", 1)]


def test_files_of_texts_of_one_id(spark, shared_ids):
    t = Tables(spark, shared_ids)
    one = lambda df: sorted(map(repr, map(tuple, df.collect())))
    assert one(t.whole_pages.select("doc_id", "page_number", "n_images", "word_count", F.coalesce(F.size("headed"), F.lit(0)))) == one(
        t.pages.join(t.statistics, ["doc_id", "page_number"]).join(t.elements.where("font_size >= 14").groupBy("doc_id", "page_number").count(), ["doc_id", "page_number"], "left").select("doc_id", "page_number", "n_images", "word_count", F.coalesce(F.col("count").cast("int"), F.lit(0)))
    )
