"""Chapters, headers, edges, tables, rendering, files: small documents from end to end."""

import time
import zlib

import pytest
from pyspark.sql import functions as F

from docgrid import cli, schemas
from docgrid.operators import chapters, checkpoints, edges, elements, headers, layout, manifest, ocr, render, sinks, summary, tables
from docgrid.plans import catalog, convert
from docgrid.plans.progress import Progress, StreamProgress
from docgrid.sources import files, pdf
from docgrid.streaming import new_files


def pdf_bytes(pages, compress=True):
    """A small PDF: pages of lines (x, y from the foot, size, text)."""
    out, offsets = bytearray(b"%PDF-1.4\n"), []

    def obj(body):
        offsets.append(len(out))
        out.extend(b"%d 0 obj\n" % len(offsets) + body + b"\nendobj\n")

    n = len(pages)
    obj(b"<< /Type /Catalog /Pages 2 0 R >>")
    obj(b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(n)) + b"] /Count %d /MediaBox [0 0 595 842] >>" % n)
    obj(b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica-Bold >>")
    for i, lines in enumerate(pages):
        obj(b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (5 + 2 * i))
        data = b"\n".join(b"BT /F1 %d Tf %d %d Td (%s) Tj ET" % (size, x, y, text.encode("cp1252").replace(b"(", b"\\(").replace(b")", b"\\)")) for x, y, size, text in lines)
        data = zlib.compress(data) if compress else data
        obj(b"<< /Length %d%s >>\nstream\n" % (len(data), b" /Filter /FlateDecode" if compress else b"") + data + b"\nendstream")
    return bytes(out) + b"trailer << /Root 1 0 R >>\n%%EOF"


BOOK = [[(60, 700, 18, "Chapter 1: Start"), (60, 600, 12, "The first page has words (all of them).")], [(60, 700, 12, "Second page here.")], [(60, 700, 18, "Chapter 2: End"), (60, 500, 12, "Last words.")]]


@pytest.fixture
def books(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "my_book.pdf").write_bytes(pdf_bytes(BOOK))
    (d / "plain.pdf").write_bytes(pdf_bytes(BOOK[:1], compress=False))
    (d / "broken.pdf").write_bytes(b"no pdf at all")
    (d / "UPPER.PDF").write_bytes(b"%PDF-1.4")
    (d / "sub").mkdir()
    (d / "sub" / "deep.pdf").write_bytes(b"%PDF-1.4")
    return str(d)


def test_files(spark, books):
    got = files.scan_directory(spark, books)
    assert [r.path.rsplit("/", 1)[-1] for r in got.collect()] == ["broken.pdf", "my_book.pdf", "plain.pdf"] and "content" not in got.columns
    assert files.scan_directory(spark, books + "/missing").count() == 0
    df = spark.createDataFrame([("a.PDF", 5), ("a.txt", 5), ("b.pdf", 201 * 1024 * 1024)], "path string, length long")
    assert [r.x for r in df.select(files.is_valid().alias("x")).collect()] == [True, False, False]


def test_pdf_pages(spark, books):
    rows = pdf.read_pages(files.scan_directory(spark, books, True)).collect()
    book = sorted((r for r in rows if r.path.endswith("my_book.pdf")), key=lambda r: r.page_number)
    assert [r.raw_text for r in book] == ["Chapter 1: Start\nThe first page has words (all of them).", "Second page here.", "Chapter 2: End\nLast words."]
    c = book[0].chars[0]
    assert (c.text, c.x0, c.size, c.fontname, book[0].width) == ("C", 60.0, 18.0, "Helvetica-Bold", 595.0) and 842 - 700 - 18 < c.top < 842 - 700
    assert [r.raw_text for r in rows if r.path.endswith("plain.pdf")] == [book[0].raw_text]
    assert [(r.page_number, bool(r.error)) for r in rows if r.path.endswith("broken.pdf")] == [(0, True)]


def test_conversion_resume_and_cli(spark, books, tmp_path):
    out = str(tmp_path / "out")
    counts = Progress()
    got = {r.path.rsplit("/", 1)[-1]: r for r in convert.convert(spark, books, out, progress=counts).collect()}
    assert (counts.pages_done, counts.pages_failed, counts.files_failed) == (sum(r.processed_pages for r in got.values()), 0, 1) == (4, 0, 1)
    assert got["my_book.pdf"].success and got["my_book.pdf"].processed_pages == 3 and not got["broken.pdf"].success
    main = (tmp_path / "out" / "my_book_md" / "my_book.md").read_text()
    assert main.startswith("# My Book\n") and "## Page 2" in main and "Second page here." in main and "Chapter 1: Start" in main
    again = [r.path.rsplit("/", 1)[-1] for r in convert.convert(spark, books, out, resume=True).collect()]
    assert again == ["broken.pdf"]
    found = {r.name: r for r in checkpoints.read(spark, f"{out}/_checkpoints").collect()}
    assert (found["my_book.pdf"].total_pages, found["my_book.pdf"].processed_pages, found["my_book.pdf"].failed_pages) == (3, [1, 2, 3], []) and found["broken.pdf"].total_pages == 0
    assert cli.main([books, "--output", str(tmp_path / "out2"), "--boundary-page-only"]) == 1


def test_stream_of_new_files_is_idempotent(spark, books, tmp_path):
    listener, counts = StreamProgress(), Progress()
    spark.streams.addListener(listener)
    for _ in range(2):
        new_files.watch(spark, books, str(tmp_path / "t"), str(tmp_path / "c"), progress=counts).awaitTermination(120)
    for _ in range(100):
        if listener.ended < 2:
            time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert listener.files == 3 and listener.bytes > 0 and (counts.pages_done, counts.files_failed) == (4, 1)
    rows = spark.read.parquet(str(tmp_path / "t" / "pages"))
    assert rows.where("page_number > 0").count() == 4 and manifest.read(spark, str(tmp_path / "t" / "manifest")).select("path").distinct().count() == 3 and manifest.read(spark, str(tmp_path / "t" / "manifest")).count() == 5


def test_stream_batch_that_runs_again_loses_and_adds_nothing(spark, books, tmp_path):
    import shutil

    for _ in range(2):  # the second time as after a crash before the commit
        new_files.watch(spark, books, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(120)
        shutil.rmtree(tmp_path / "c" / "commits")
    rows = spark.read.parquet(str(tmp_path / "t" / "pages"))
    assert rows.where("page_number > 0").count() == 4 and manifest.read(spark, str(tmp_path / "t" / "manifest")).select("path").distinct().count() == 3 and manifest.read(spark, str(tmp_path / "t" / "manifest")).count() == 5
    assert manifest.remove(spark, str(tmp_path / "t" / "manifest")) and manifest.read(spark, str(tmp_path / "t" / "manifest")).count() == 0


def test_stream_reads_a_path_once_and_keeps_to_its_checkpoint(spark, books, tmp_path):
    import os
    from pathlib import Path

    run = lambda: new_files.watch(spark, books, str(tmp_path / "t"), str(tmp_path / "c"), max_files=1).awaitTermination(120)
    count = lambda: sorted((r.path.rsplit("/", 1)[-1], r["count"]) for r in spark.read.parquet(str(tmp_path / "t" / "pages")).groupBy("path").count().collect())
    run()
    first = count()
    assert first == [("broken.pdf", 1), ("my_book.pdf", 3), ("plain.pdf", 1)] and len(list((tmp_path / "t" / "pages").glob("batch=*"))) == 3
    book = Path(books) / "my_book.pdf"
    book.write_bytes(book.read_bytes())
    os.utime(book, (time.time() + 9, time.time() + 9))
    (Path(books) / "later.pdf").write_bytes(book.read_bytes())
    run()
    assert count() == sorted([*first, ("later.pdf", 3)])
    with pytest.raises(ValueError, match="another checkpoint"):
        new_files.watch(spark, books, str(tmp_path / "t"), str(tmp_path / "other"))


def test_needs_ocr_counts_stripped_text(spark):
    rows = [("x" * 120 + " " * 5000, 2000, False, 0.0), ("x" * 99, 10, False, 0.0), ("x" * 120, 2401, False, 0.0), ("x" * 120, 0, True, 0.81), ("x" * 120, 300, True, 0.8), ("", 0, False, 0.0), (None, 0, None, None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, raw_text string, usual int, has_images boolean, image_area_ratio double")
    got = [r.x for r in df.orderBy("k").select(ocr.needs_ocr(typical_length=F.col("usual")).alias("x")).collect()]
    assert got == [len((t or "").strip()) < 100 or (u > 0 and len(t.strip()) / u < 0.05) or bool(i and a > 0.8) for t, u, i, a in rows] and got[0] is False


def test_tenths_are_rounded_as_binary_values(spark):
    import random

    r = random.Random(1)
    values = [0.15, 0.25, 0.35, 0.45, 2.675, 1.05, -0.15, -0.25, 0.05, 842.0, 100.25, 100.75] + [r.choice([round(r.uniform(0, 900), 2), r.uniform(-5, 900), r.randrange(9000) / 8]) for _ in range(3000)]
    got = [x.k for x in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(elements.tenths("v").alias("k")).collect()]
    assert got == [round(v, 1) for v in values]


def test_merging_is_a_fold(spark):
    import random

    r = random.Random(2)
    texts = ["word", "End.", "Next", "9", " ", "a ", ".", "中文", "", "x! "]
    rows = []
    for page in range(40):
        x = 0.0
        for k in range(30):
            x += r.choice([0.0, 2.0, 6.0, 40.0])
            rows.append((1, page, k, k, r.choice(texts), x, 10.0 + r.choice([0.0, 0.0, 1.0, 4.0, 9.0]), x + 5, 20.0, r.choice([0.0, 12.0, 12.0, 15.0]), False))
            x += 5
    df = spark.createDataFrame(rows, "doc_id long, page_number int, order_no int, seq int, text string, x0 double, y0 double, x1 double, y1 double, font_size double, is_bold boolean")
    got = sorted((g.page_number, g.merged_no, g.text, g.x0, g.y0, g.x1, g.y1, g.font_size, g.seq) for g in elements.merge_adjacent(df).collect())
    want = []
    for page in range(40):
        done = []
        for _, _, k, _, t, x0, y0, x1, y1, size, _ in (x for x in rows if x[1] == page):
            a = done[-1] if done else None
            if a:
                stop = a[0].strip()[-1:] in tuple(".!?。！？;；：") and (t.strip()[:1].isupper() or t.strip()[:1].isdigit())
                sizes = a[5] > 0 and size > 0 and abs(a[5] - size) > elements.SIZE_GAP
                if a[0].strip() and t and abs(a[2] - y0) <= elements.LINE_GAP and x0 - a[3] <= elements.MERGE_GAP and not stop and not sizes:
                    latin = lambda c: c.isascii() and c.isalnum()
                    space = x0 - a[3] > elements.SPACE_GAP or (latin(a[0][-1]) and latin(t[0]))
                    done[-1] = [a[0] + " " * space + t, min(a[1], x0), min(a[2], y0), max(a[3], x1), max(a[4], y1), a[5], a[6]]
                    continue
            done.append([t, x0, y0, x1, y1, size, k])
        want += [(page, n, *d) for n, d in enumerate(done)]
    assert got == sorted(want)


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, page_number int, width double, height double, raw_text string, n_images int, n_tables int, ocr_text string")


def test_likely_headings_and_ranges(spark):
    e = spark.createDataFrame(
        [(1, 1, 0, "Big one", 250.0, 690.0, 345.0, 700.0, 20.0, True), (1, 1, 1, "x", 0.0, 10.0, 5.0, 20.0, 12.0, False), (1, 1, 2, "y", 0.0, 30.0, 5.0, 40.0, 12.0, False), (1, 3, 0, "Part IV", 0.0, 10.0, 5.0, 20.0, 14.0, False)],
        "doc_id long, page_number int, seq int, text string, x0 double, y0 double, x1 double, y1 double, font_size double, is_bold boolean",
    )
    p = pages_of(spark, [(1, i, 595.0, 842.0, "", 0, 0, None) for i in (1, 2, 3, 4)] + [(2, 1, 595.0, 842.0, "", 0, 0, None)])
    found = chapters.deduplicated(chapters.from_pages(e, p))
    assert [(r.page_number, r.is_detected_by, r.chapter_number) for r in found.orderBy("page_number").collect()] == [(1, "font_position", 1), (3, "pattern", 2)]
    assert sorted(tuple(r) for r in chapters.ranges(found, p).collect()) == [(1, 1, 1, 2), (1, 2, 3, 4), (2, 1, 1, 1)]
    assert [r.chapter for r in chapters.page_chapter(p, found).orderBy("doc_id", "page_number").collect()] == [1, 1, 2, 2, None]
    assert chapters.from_outline(spark.createDataFrame([(1, "a", 2), (1, "b", 9)], "doc_id long, title string, page int"), p).count() == 1


def test_header_groups_and_their_first_pages(spark):
    lay = spark.createDataFrame(
        [(1, 1, "Annual Report 2024 Overview Page 1", "x"), (1, 2, "Annual Report 2024 Overview Page 2", ""), (1, 3, "Other", ""), (1, 4, "Annual Report 2024 Overviev Page 4", "")], "doc_id long, page_number int, header_text string, footer_text string"
    )
    exact = headers.exact_groups(lay).collect()
    assert [(r.norm, r.frequency, r.first_page) for r in exact] == [("Annual Report 2024 Overview", 2, 1)]
    fuzzy = headers.fuzzy_groups(lay)
    assert headers.is_similar("abcd", "abcd") and not headers.is_similar("abcd", "bcda") and headers.is_similar("", "") and not headers.is_similar("", "a")
    once = {r.page_number: r.header for r in headers.first_occurrences(lay, headers.fuzzy_groups(lay, 1)).collect()}
    assert fuzzy.count() <= 1 and once[1].startswith("Annual") and once[3] == "Other"
    assert [r.norm for r in headers.unique(lay, "footer").collect()] == ["x"]


def test_edges(spark):
    e = spark.createDataFrame([(1, 1, 0, "Note: a", 0.0, 300.0, 40.0, 310.0), (1, 2, 0, "note:  A", 0.0, 300.0, 40.0, 310.0), (1, 2, 1, "r", 560.0, 300.0, 590.0, 310.0), (1, 2, 2, "t", 250.0, 5.0, 300.0, 15.0)], "doc_id long, page_number int, seq int, text string, x0 double, y0 double, x1 double, y1 double")
    p = pages_of(spark, [(1, i, 595.0, 842.0, "", 0, 0, None) for i in (1, 2)])
    got = edges.extracted(e, p)
    assert sorted((r.page_number, r.position) for r in got.collect()) == [(1, "left"), (2, "right"), (2, "top")]
    assert edges.formatted(got).first().text == "### Left\n- Page 1: Note: a\n\n### Right\n- Page 2: r\n\n### Top\n- Page 2: t\n"
    assert edges.formatted(got, "odd").first().text.startswith("[left] Page 1: Note: a") and edges.removed(e, got).count() == 1
    assert {(r.position, r.page_number): r.n for r in edges.summary(got).collect()} == {(None, None): 3, ("left", None): 1, ("right", None): 1, ("top", None): 1, (None, 1): 1, (None, 2): 2}
    assert summary.annotations(e).count() == 1


def test_tables(spark):
    cells = spark.createDataFrame([(1, 1, 0, 0, 0, "A", 1, 2), (1, 1, 0, 1, 0, "12", 1, 1), (1, 1, 0, 1, 1, "$3.50", 1, 1), (1, 1, 1, 0, 0, " ", 1, 1)], schemas.TABLE_CELLS)
    one = lambda df, c: df.where("table_no = 0").first()[c]
    assert one(tables.to_markdown(cells), "markdown") == "| A |  |\n| --- | --- |\n| 12 | $3.50 |"
    assert one(tables.to_aligned_markdown(cells), "markdown") == "| A |  |\n| :---: | ---: |\n| 12 | $3.50 |"
    assert one(tables.to_html(cells, "T"), "html").splitlines()[:5] == ["<table>", "<caption>T</caption>", "<tr>", '<th align="center" colspan="2">A</th>', "<th></th>"]
    assert tables.listed(cells).first().markdown.startswith("### Table 1\n\n| A |") and {r.is_empty for r in tables.dimensions(cells).collect()} == {True, False}
    assert tables.cell(cells, 1, 1).first().text == "$3.50" and tables.row_cells(cells, 1).count() == 2 and tables.col_cells(cells, 0).count() == 3


def test_links_and_blocks(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(render.title_case(F.lit("2nd_o'neil"))) == "2Nd O'Neil" and one(render.relative_path(F.lit("out/assets/a.png"), F.lit("out/docs"))) == "../assets/a.png"
    assert one(render.image_link(F.lit("x/my_pic.png"), F.lit("my_pic.png"))) == "![My Pic](my_pic.png)" and 'width="9"' in one(render.image_link_with_size(F.lit("a.png"), F.lit("a.png"), 9))
    assert one(render.section_link(F.lit("A b"))) == "[A b](#a-b)" and one(render.toc_link(F.lit("A"), F.lit("f.md"), F.lit(0))) == "- [A](f.md#a) (page 0)"
    p = pages_of(spark, [(1, 1, 595.0, 842.0, "t", 0, 0, "seen")])
    block = render.page_blocks(p, spark.createDataFrame([(1, 1, "body")], "doc_id long, page_number int, body_text string")).first().block
    assert block == "\n## Page 1\n\nbody\n\n\n### OCR Extracted Text\n\nseen\n"
    assert p.select(elements.has_content().alias("x")).first().x and p.withColumn("body_text", F.lit("b")).select(elements.all_text().alias("x")).first().x == "b\n\n[OCR]\nseen"


def test_ocr_engine_sees_only_pages_that_need_it(spark):
    class Engine:
        def recognise(self, image):
            if image == b"bad":
                raise ValueError
            return "text", 0.85, "en", [[[0.0, 1.0]]]

    rows = spark.createDataFrame([(1, True, b"x"), (2, True, b"bad"), (3, False, b"x"), (4, True, None)], "k int, needs_ocr boolean, image binary")
    found = ocr.recognised(rows, lambda: Engine()).collect()
    assert {r.k: r.ocr_error for r in found} == {1: None, 2: "ValueError: ", 3: None, 4: None}
    got = {r.k: r.ocr for r in found}
    assert got[1].text == "text" and got[1].boxes == [[[0.0, 1.0]]] and got[2] is None and got[3] is None and got[4] is None


def test_manifest(spark, tmp_path):
    path = str(tmp_path / "m")
    pages = spark.createDataFrame([("a", "h", n, 3, e) for n, e in ((1, None), (2, "bad"), (3, None))] + [("b", "k", 0, 0, "unreadable")], "path string, sha256 string, page_number int, total_pages int, error string")
    done = lambda m: {r.path: (r.total_pages, r.processed_pages, r.failed_pages) for r in manifest.progress(m).collect()}
    for _ in range(2):  # an action that is repeated puts its rows in place of its own
        manifest.write(manifest.rows(pages), path, 0)
    m = manifest.read(spark, path)
    assert m.count() == 4 and manifest.next_version(spark, path) == 1 and done(m) == {"a": (3, [1, 3], [2]), "b": (0, [], [])}
    assert sorted((r.path, r.page_number) for r in manifest.pending_pages(pages, m).collect()) == [("a", 2), ("b", 0)] == sorted((r.path, r.page_number) for r in manifest.failed_pages(pages, m).collect())
    again = pages.where("page_number = 2").withColumn("error", F.lit(None).cast("string"))
    manifest.write(manifest.rows(again), path, 1)
    m = manifest.read(spark, path)
    assert done(m)["a"] == (3, [1, 2, 3], []) and [r.path for r in manifest.progress(m).where(manifest.is_whole()).collect()] == ["a"]
    assert [r.path for r in manifest.failed_pages(pages, m).collect()] == ["b"] == [r.path for r in manifest.pending_pages(pages, m).collect()]
    assert [(r.page_number, r.version) for r in manifest.superseded(m).collect()] == [(2, 0)] and manifest.read(spark, path, without=1).count() == 4
    manifest.write(manifest.rows(again.withColumn("error", F.lit("worse"))), path, 2)  # read anew and failed: the newest counts
    assert done(manifest.read(spark, path))["a"] == (3, [1, 3], [2])
    before = done(manifest.read(spark, path))
    manifest.merge(spark, path)
    assert done(manifest.read(spark, path)) == before and manifest.read(spark, path).count() == 4 and manifest.next_version(spark, path) == 3
    assert manifest.known_files(spark.createDataFrame([("a", "other")], "path string, sha256 string"), manifest.read(spark, path)).count() == 0
    assert manifest.read(spark, str(tmp_path / "none")).count() == 0 == manifest.next_version(spark, str(tmp_path / "none"))
    with pytest.raises(Exception, match="outside"):
        sinks.write_files(spark.createDataFrame([("../x", "y")], "path string, content string"), str(tmp_path / "o"))


def test_a_broken_off_conversion_resumes_at_its_pages(spark, books, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    write, calls = manifest.write, []

    def breaks(rows, path, version):
        calls.append(version)
        if version == 1:
            raise OSError("no space")
        write(rows, path, version)

    monkeypatch.setattr(manifest, "write", breaks)
    options = convert.Options(pages_a_wave=1)
    with pytest.raises(OSError):
        convert.convert(spark, books, out, options=options)
    assert calls == [0, 1]  # the second page of each file was read, but isn't known to be
    monkeypatch.setattr(manifest, "write", write)
    kept = lambda: sorted((r.path.rsplit("/", 1)[-1], r.page_number) for r in convert.kept_pages(spark, out).select("path", "page_number").collect())
    assert kept() == [("broken.pdf", 0), ("my_book.pdf", 1), ("plain.pdf", 1)]
    got = {r.path.rsplit("/", 1)[-1]: r for r in convert.convert(spark, books, out, resume=True, options=options).collect()}
    assert set(got) == {"my_book.pdf", "broken.pdf"} and got["my_book.pdf"].success and got["my_book.pdf"].processed_pages == 3
    versions = {(r.path.rsplit("/", 1)[-1], r.page_number): r.version for r in manifest.read(spark, f"{out}/_manifest").collect()}
    assert versions[("my_book.pdf", 1)] == 0 and versions[("my_book.pdf", 2)] == 1 and versions[("my_book.pdf", 3)] == 2  # no page was read twice
    main = (tmp_path / "out" / "my_book_md" / "my_book.md").read_text()
    assert all(x in main for x in ("The first page has words", "Second page here.", "Last words."))


def test_a_page_that_failed_is_tried_again(spark, books, tmp_path):
    out = str(tmp_path / "out")
    convert.convert(spark, books, out)
    m = manifest.read(spark, f"{out}/_manifest")
    bad = m.where("path like '%my_book.pdf' and page_number = 2").drop("version").withColumn("error", F.lit("engine was down"))
    manifest.write(convert.materialised(bad, "bad"), f"{out}/_manifest", 7)
    assert [r.page_number for r in manifest.failed_pages(m, manifest.read(spark, f"{out}/_manifest")).where("page_number > 0").collect()] == [2]
    got = {r.path.rsplit("/", 1)[-1]: r for r in convert.convert(spark, books, out, resume=True).collect()}
    assert got["my_book.pdf"].success and "plain.pdf" not in got
    assert manifest.failed_pages(m, manifest.read(spark, f"{out}/_manifest")).where("page_number > 0").count() == 0
    assert [(r.page_number, r.version) for r in convert.kept_pages(spark, out).where("path like '%my_book.pdf'").orderBy("page_number").collect()] == [(1, 0), (2, 8), (3, 0)]


def test_files_are_written_to_folders_and_addresses(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.md", "one"), ("c.md", "é")], "path string, content string")
    sinks.write_files(rows, str(tmp_path / "o"))
    sinks.write_files(rows.withColumn("content", F.lit("two")), f"file://{tmp_path}/o", overwrite=False)
    assert (tmp_path / "o" / "a" / "b.md").read_text() == "one" and (tmp_path / "o" / "c.md").read_text() == "é"
    sinks.write_files(rows.withColumn("content", F.lit("two")), f"file://{tmp_path}/o")
    assert sorted(p.name for p in (tmp_path / "o").rglob("*") if p.is_file()) == ["b.md", "c.md"] and (tmp_path / "o" / "c.md").read_text() == "two"


def test_ruled_tables_and_images(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    grid = b"100 500 200 100 re S 200 500 m 200 600 l S 100 550 m 300 550 l S "
    text = b"".join(b"BT /F1 10 Tf %d %d Td (%s) Tj ET " % (x, y, t) for x, y, t in ((110, 570, b"Name"), (210, 570, b"Value"), (110, 520, b"abc"), (210, 520, b"$1.50")))
    body = grid + text + b"q 50 0 0 40 300 700 cm /I1 Do Q"
    parts = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /MediaBox [0 0 595 842] /Resources << /Font << /F1 5 0 R >> /XObject << /I1 6 0 R >> >> /Contents 4 0 R >>"]
    parts += [b"<< /Length %d >>\nstream\n" % len(body) + body + b"\nendstream", b"<< /Type /Font /BaseFont /Times >>", b"<< /Subtype /Image /Width 5 /Height 4 /Filter /DCTDecode /Length 4 >>\nstream\nJPEG\nendstream"]
    (d / "t.pdf").write_bytes(b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, p) for i, p in enumerate(parts)) + b"%%EOF")
    page = pdf.read_pages(files.scan_directory(spark, str(d), True)).first()
    assert page.tables == [[["Name", "Value"], ["abc", "$1.50"]]] and page.n_tables == 1 and page.n_images == 1
    i = page.images[0]
    assert (i.x0, i.x1, i.y0, i.y1, i.width, i.format, bytes(i.data)) == (300.0, 350.0, 102.0, 142.0, 5, "jpeg", b"JPEG")
    convert.convert(spark, str(d), str(tmp_path / "out")).collect()
    whole = (tmp_path / "out" / "t_md" / "docs" / "complete_content.md").read_text()
    assert "| Name | Value |\n| --- | --- |\n| abc | $1.50 |" in whole and "![Page 1 Image 1](../assets/page_1_image_1.jpg)" in whole
    assert (tmp_path / "out" / "t_md" / "assets" / "page_1_image_1.jpg").read_bytes() == b"JPEG"


def picture_pdf(entries, data, text=b""):
    """A page with one image of 5 by 4 samples that covers nearly all of it."""
    body = b"q 590 0 0 840 0 0 cm /I1 Do Q" + text
    parts = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /MediaBox [0 0 595 842] /Resources << /XObject << /I1 5 0 R >> >> /Contents 4 0 R >>"]
    parts += [b"<< /Length %d >>\nstream\n" % len(body) + body + b"\nendstream", b"<< /Subtype /Image /Width 5 /Height 4 %s /Length %d >>\nstream\n" % (entries, len(data)) + data + b"\nendstream"]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, p) for i, p in enumerate(parts)) + b"%%EOF"


def samples(png):
    """Scan lines of a PNG file."""
    at, out = 8, b""
    while at < len(png):
        n, kind = int.from_bytes(png[at : at + 4], "big"), png[at + 4 : at + 8]
        body = png[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + body) == int.from_bytes(png[at + 8 + n : at + 12 + n], "big")
        out += body if kind == b"IDAT" else b""
        at += 12 + n
    return zlib.decompress(out)


def test_images_of_plain_samples_become_png():
    rgb, grey = bytes(range(60)), bytes(range(20))
    rows = lambda data, n: b"".join(b"\0" + data[i : i + n] for i in range(0, len(data), n))
    image = lambda entries, data: pdf.page_chars(f := pdf.File(picture_pdf(entries, data)), f.pages()[0])[3][0]
    flate = b"/Filter /FlateDecode"
    got = image(b"/BitsPerComponent 8 /ColorSpace /DeviceRGB " + flate, zlib.compress(rgb))
    assert got["format"] == "png" and samples(got["data"]) == rows(rgb, 15) and got["data"][16:26] == b"\0\0\0\5\0\0\0\4\x08\2"
    assert samples(image(b"/BitsPerComponent 8 /ColorSpace /DeviceGray", grey)["data"]) == rows(grey, 5)
    lines = b"".join(b"\2" + rgb[i : i + 15] for i in range(0, 60, 15))
    assert samples(image(b"/BitsPerComponent 8 /ColorSpace /DeviceRGB /DecodeParms << /Predictor 15 /Colors 3 /Columns 5 >> " + flate, zlib.compress(lines))["data"]) == lines
    assert samples(image(b"/BitsPerComponent 8 /ColorSpace /DeviceCMYK " + flate, zlib.compress(b"\0\0\0\0" * 19 + b"\xff\0\0\0"))["data"])[-3:] == b"\0\xff\xff"
    assert b"PLTE" in image(b"/BitsPerComponent 8 /ColorSpace [/Indexed /DeviceRGB 1 <000000ffffff>]", b"\0\1" * 10)["data"]
    assert image(b"/BitsPerComponent 8 /ColorSpace /DeviceRGB", b"short")["format"] == "raw" and image(b"/Filter /JPXDecode", b"x")["format"] == "jp2"


def test_conversion_recognises_scanned_pages(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "scan.pdf").write_bytes(picture_pdf(b"/BitsPerComponent 8 /ColorSpace /DeviceGray", bytes(range(20))))
    (d / "bad.pdf").write_bytes(picture_pdf(b"/Filter /DCTDecode", b"JPEG"))

    class Engine:
        def recognise(self, image):
            if not image.startswith(b"\x89PNG"):
                raise ValueError("no picture")
            return "What the scan says.", 0.9, "en", []

    out = tmp_path / "out"
    got = {r.path.rsplit("/", 1)[-1]: r for r in convert.convert(spark, str(d), str(out), options=convert.Options(make_engine=lambda: Engine())).collect()}
    assert got["scan.pdf"].success and got["bad.pdf"].success
    content = (out / "scan_md" / "docs" / "complete_content.md").read_text()
    assert "### OCR Extracted Text\n\nWhat the scan says." in content and "page_1_image_1.png" in content
    assert (out / "scan_md" / "assets" / "page_1_image_1.png").read_bytes().startswith(b"\x89PNG")
    errors = {r.path.rsplit("/", 1)[-1]: r.ocr_error for r in spark.read.parquet(str(out / "_pages")).collect()}
    assert errors == {"scan.pdf": None, "bad.pdf": "ValueError: no picture"}
    plain = convert.Options(make_engine=lambda: Engine(), include_images=False, include_ocr_text=False, include_tables=False)
    convert.convert(spark, str(d), str(tmp_path / "out2"), options=plain).collect()
    content = (tmp_path / "out2" / "scan_md" / "docs" / "complete_content.md").read_text()
    assert "What the scan says" not in content and "image" not in content and not (tmp_path / "out2" / "scan_md" / "assets").exists()


def test_parameters_of_chapters_and_layout(spark):
    rows = [(1, 1, 0, "Chapter 1", 0.0, 10.0, 50.0, 20.0, 13.0, True), (1, 2, 0, "Chapter 2", 0.0, 10.0, 50.0, 20.0, 15.0, True)]
    e = spark.createDataFrame(rows, "doc_id long, page_number int, seq int, text string, x0 double, y0 double, x1 double, y1 double, font_size double, is_bold boolean")
    p = pages_of(spark, [(1, i, 595.0, 842.0, "", 0, 0, None) for i in (1, 2)])
    assert chapters.from_pages(e, p).count() == 1 and chapters.from_pages(e, p, min_font_size=12.0).count() == 2
    lay = spark.createDataFrame([(1, 1, 1, 100.0, 100.0, 0.50), (1, 2, 1, 108.0, 100.0, 0.60)], "doc_id long, page_number int, n_body int, width double, height double, text_density double")
    flags = lambda **k: chapters.changes(lay, **k).where("page_number = 2").select("layout_change", "density_change").first()
    assert tuple(flags()) == (False, False) and tuple(flags(layout_change=0.05, density_change=0.1)) == (True, True)
    words = spark.createDataFrame([(1, 1, 0, "head", 100.0, 140.0, 55.0, 65.0), (1, 1, 1, "side", 60.0, 70.0, 300.0, 310.0)], "doc_id long, page_number int, seq int, text string, x0 double, x1 double, top double, bottom double")
    assert layout.header(words).count() == 0 and layout.header(words, 60.0).count() == 1
    assert layout.edge_words(words, p).count() == 0 and layout.edge_words(words, p, 80.0).count() == 1
    assert layout.analyze(words, p, header_height=60.0, margin=80.0).orderBy("page_number").first().n_edge == 1


def test_assistant_or_rules(spark):
    class Helper:
        def reply(self, prompt):
            if "bad" in prompt:
                raise TimeoutError("no answer")
            return f"## About {prompt}\ntext\n- one\n* two"

    prompts = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None)], "doc_id long, prompt string")
    items = spark.createDataFrame([(d, 1, 0, 0, "heading", f"Own {d}", "body", 0.9, None) for d in (1, 2)], schemas.SUMMARY_ITEMS)
    got = {r.doc_id: r for r in summary.assistant_summaries(prompts, items, lambda: Helper()).collect()}
    assert (got[1].headings, got[1].key_points, got[1].by) == (["About a"], ["one", "two"], "assistant")
    assert (got[2].headings, got[2].by, got[2].reply_error) == (["Own 2"], "rules", "TimeoutError: no answer") and got[3].headings == []
    assert {r.by for r in summary.assistant_summaries(prompts, items).collect()} == {"rules"}


def test_free_space_progress_and_sizes(spark, tmp_path, caplog):
    import logging

    from docgrid.operators import images
    from docgrid.plans.progress import reported

    assert sinks.has_space(spark, str(tmp_path / "not" / "there"), 1) and not sinks.has_space(spark, str(tmp_path), 10**9)
    with caplog.at_level(logging.INFO), reported("work", logging.getLogger("docgrid")) as progress:
        pages = spark.createDataFrame([(1, None), (2, "bad"), (3, None), (0, "unreadable")], "page_number int, error string")
        progress.write(pages, str(tmp_path / "p"))
        progress.write(pages.where("page_number = 2"), str(tmp_path / "q"))
    assert (progress.pages_done, progress.pages_failed, progress.files_failed, progress.waves) == (2, 2, 1, 2) and spark.read.parquet(str(tmp_path / "p")).count() == 4
    said = [r.message for r in caplog.records]
    assert said[0] == "work: started" and said[-1].startswith("work: ") and any("2 pages done, 1 failed" in m for m in said)
    df = spark.createDataFrame([(4000, 1000, b"no image"), (100, 50, b"x")], "width int, height int, data binary")
    assert [tuple(r.s) for r in df.select(images.recognition_size().alias("s")).collect()] == [(2000, 500), (100, 50)]
    assert [bytes(r.data) for r in images.for_recognition(df).collect()] == [b"no image", b"x"]


def test_checkpoints_as_json(spark, tmp_path):
    rows = [("/in/a.pdf", "h", 3, [1, 3], [2]), ("/in/b.pdf", "k", 0, None, None), ("/in/c.pdf", "changed", 1, [1], [])]
    progress = spark.createDataFrame(rows, "path string, sha256 string, total_pages int, processed_pages array<int>, failed_pages array<int>").withColumn("timestamp", F.timestamp_seconds(F.lit(5)))
    folder = tmp_path / "checks"
    checkpoints.write(progress, str(folder))
    for name, text in (("cut", '{"file_hash":"h","total_pa'), ("empty", ""), ("kind", '{"file_hash":"h","total_pages":"many","processed_pages":[],"failed_pages":[],"version":"1.0"}'), ("less", '{"file_hash":"h","total_pages":1}'), ("list", "[1, 2]"), ("null", "null")):
        (folder / f"{name}.pdf.checkpoint.json").write_text(text)
    found = {r.name: r for r in checkpoints.read(spark, str(folder)).collect()}
    assert (found["a.pdf"].file_hash, found["a.pdf"].total_pages, found["a.pdf"].processed_pages, found["a.pdf"].failed_pages, found["a.pdf"].version, found["a.pdf"].damaged) == ("h", 3, [1, 3], [2], "1.0", None)
    assert found["b.pdf"].processed_pages == [] and found["cut.pdf"].damaged.startswith("{") and {n for n, r in found.items() if r.damaged is not None} == {f"{n}.pdf" for n in ("cut", "kind", "less", "list", "null")}
    assert [r.d for r in spark.createDataFrame([("",), (None,), ("{}",)], "t string").select(checkpoints.parsed("t")["damaged"].alias("d")).collect()] == ["", "", "{}"]
    files_ = spark.createDataFrame([("/in/a.pdf", "h"), ("/in/c.pdf", "other"), ("/in/cut.pdf", "h")], "path string, sha256 string")
    assert [r.path for r in checkpoints.valid(checkpoints.read(spark, str(folder)), files_).collect()] == ["/in/a.pdf"]
    assert checkpoints.read(spark, str(tmp_path / "none")).count() == 0


def test_table_functions_in_sql(spark, books):
    words = [(1, 1, 0, "b", 50.0, 100.0), (1, 1, 1, "a", 10.0, 104.0), (1, 1, 2, "c", 10.0, 110.5), (1, 2, 0, None, 1.0, 1.0), (2, 1, 0, "x", 1.0, None), (None, 1, 0, "n", 1.0, 2.0)]
    catalog.register(spark, {"own_words": spark.createDataFrame(words, "doc_id long, page_number int, seq int, text string, x0 double, top double"), "own_files": files.scan_directory(spark, books, True)})
    ask = lambda q: sorted((tuple(r) for r in spark.sql(q).collect()), key=repr)
    assert ask("SELECT * FROM page_lines(TABLE(own_words))") == sorted([(1, 1, 1, 100.0, 2, "a b"), (1, 1, 2, 110.5, 1, "c"), (1, 2, 1, 1.0, 1, ""), (None, 1, 1, 2.0, 1, "n")], key=repr)
    assert ask("SELECT text FROM page_lines(TABLE(own_words), gap => 20.0) WHERE doc_id = 1 AND page_number = 1") == [("a c b",)]
    assert ask("SELECT count(*) FROM page_lines(TABLE(SELECT * FROM own_words WHERE doc_id = 9))") == [(0,)]
    pages = ask("SELECT regexp_extract(path, '[^/]*$', 0), page_number, total_pages, text, error IS NULL FROM pdf_text(TABLE(own_files))")
    assert [p[:3] for p in pages] == [("broken.pdf", 0, 0), ("my_book.pdf", 1, 3), ("my_book.pdf", 2, 3), ("my_book.pdf", 3, 3), ("plain.pdf", 1, 1)] and pages[2][3] == "Second page here." and not pages[0][4]
    for bad in ("page_lines(TABLE(own_files))", "page_lines(1)", "pdf_text(TABLE(own_words))"):
        with pytest.raises(Exception, match="needs the columns|takes TABLE"):
            spark.sql(f"SELECT * FROM {bad}").collect()
    assert ask("SELECT heading_level('Chapter 3 x'), heading_level('2. Title'), heading_level('Other'), heading_level(NULL), share_done(1, 4), share_done(1, 0), boxes_meet(0, 0, 1, 1, 1, 1, 2, 2), boxes_meet(0, 0, 1, 1, 1.1, 1, 2, 2)") == [(1, 2, 3, 3, 0.25, 0.0, True, False)]
