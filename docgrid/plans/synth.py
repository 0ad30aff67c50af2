"""A synthetic layout of plain texts: words on lines and pages by rule, with fonts, headings and notes put in at fixed places.

It gives text tables the shape of extracted pages, so that every operator can
run over them. Coordinates are whole numbers or multiples of 1/32, so sums are exact;
tokens of a line differ by less than a tenth in height, and on every third page
words stand in three columns.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.elements import once

WORDS_A_LINE, LINES_A_PAGE, WIDTH, HEIGHT = 10, 30, 595.0, 842.0


def words_in(text):
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \n]+"), lambda w: w != "")


#: What parts words.
GAP = "[ \n]+"


def _runs(text, size: int):
    """The words of a text in strings of `size` words, the last with what is left: one pass without steps back, and no array of all words."""
    return F.regexp_extract_all(text, F.lit(rf"[^ \n]++(?:[ \n]++[^ \n]++){{0,{size - 1}}}+"), F.lit(0))


def sheets(docs: DataFrame) -> DataFrame:
    """``doc_id, page_number, said, words``: the pages of each text with what it says there and with their words (seq, text) in order, cut out of the text where it is read; nothing is shuffled."""
    whole = WORDS_A_LINE * LINES_A_PAGE
    # outer: the inner form would cut the text once more to look for empty arrays
    rows = docs.select("doc_id", F.posexplode_outer(_runs("text", whole)).alias("p", "said")).where("said is not null")
    words = F.transform(F.split("said", GAP), lambda w, i: F.struct((F.col("p") * whole + i).alias("seq"), w.alias("text")))
    return rows.select("doc_id", (F.col("p") + 1).alias("page_number"), "said", words.alias("words"))


def together(sheets: DataFrame) -> DataFrame:
    """One sheet for each page that texts of one doc_id share, their words side by side."""
    return sheets.groupBy("doc_id", "page_number").agg(F.array_sort(F.flatten(F.collect_list("words"))).alias("words"))


def x_of(ln, at):
    """Left edge of a line's word; needs doc_id."""
    columns = F.when((F.col("doc_id") + F.floor(ln / LINES_A_PAGE)) % 3 == 1, 12 * ((at >= 4).cast("int") + (at >= 7).cast("int"))).otherwise(0)
    return (F.when((ln % 7 == 3) & (at == 0), 40).otherwise(55 + 50 * at) + columns).cast("double")


def top_of(ln):
    k = ln % LINES_A_PAGE
    return (20 + 26 * k + 5 * F.floor(k / 5)).cast("double")


def words(sheets: DataFrame) -> DataFrame:
    """Ten words a line, thirty lines a page; a wider gap after each fifth line; some lines begin in the left margin."""
    rows = sheets.select("doc_id", "page_number", F.inline_outer("words"))
    rows = rows.withColumn("ln", F.floor(F.col("seq") / WORDS_A_LINE).cast("int"))
    rows = rows.withColumn("x0", x_of(F.col("ln"), F.col("seq") % WORDS_A_LINE)).withColumn("top", top_of(F.col("ln")))
    x1, bottom = F.col("x0") + 4 * F.length("text"), F.col("top") + 10
    return rows.select("doc_id", "page_number", "seq", "text", "x0", x1.alias("x1"), "top", bottom.alias("bottom"), "ln", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))


def _table(values):
    return F.array(*(F.lit(float(v)) for v in values))


def _columns(spread):
    """Left edges of a line's words, but for those in the left margin; spread: whether the page has three columns."""
    line = range(WORDS_A_LINE)
    return F.when(spread, _table(55 + 50 * i + 12 * ((i >= 4) + (i >= 7)) for i in line)).otherwise(_table(55 + 50 * i for i in line))


def placed(sheets: DataFrame) -> DataFrame:
    """Sheets whose words have their boxes, as :func:`words` gives them.

    Functions of array elements aren't compiled, so places come from tables of a
    line's words and a page's lines rather than from :func:`x_of` and :func:`top_of`.
    """
    columns = _columns((F.col("doc_id") + F.col("page_number") - 1) % 3 == 1)
    tops = [20 + 26 * k + 5 * (k // 5) for k in range(LINES_A_PAGE)]

    def word(w):
        seq, k = w["seq"], (w["seq"] % (WORDS_A_LINE * LINES_A_PAGE) / WORDS_A_LINE).cast("int")
        x0 = F.when(seq % (7 * WORDS_A_LINE) == 3 * WORDS_A_LINE, 40.0).otherwise(F.get("_columns", seq % WORDS_A_LINE))
        return F.struct(seq.alias("seq"), w["text"].alias("text"), x0.alias("x0"), (x0 + 4 * F.length(w["text"])).alias("x1"), F.get(_table(tops), k).alias("top"), F.get(_table(v + 10 for v in tops), k).alias("bottom"))

    return sheets.withColumn("_columns", columns).select("doc_id", "page_number", F.transform("words", word).alias("words"))


def font_size(k=None):
    """Of a page's line k, or of a line ``ln``."""
    k = F.col("ln") % 30 if k is None else k
    return F.when(k == 1, 18.0).when(k == 28, 16.0).when(k == 12, 10.0).otherwise(12.0)


def tokens(w: DataFrame) -> DataFrame:
    """Words as elements, each third one 4 and each next 8 lower, and up to 3/32 lower besides, with fonts."""
    y0 = F.col("top") + 4 * (F.col("seq") % 3) + (F.col("seq") % 4) * 0.03125
    return w.select("doc_id", "page_number", "seq", "text", "x0", y0.alias("y0"), "x1", (y0 + 10).alias("y1"), font_size().alias("font_size"), (F.col("ln") % 30 == 1).alias("is_bold"))


def token_sheets(sheets: DataFrame) -> DataFrame:
    """Placed sheets whose words have the heights of :func:`tokens`."""

    def token(w):
        y0 = w["top"] + 4 * (w["seq"] % 3) + (w["seq"] % 4) * 0.03125
        return F.struct(w["seq"].alias("seq"), w["text"].alias("text"), w["x0"].alias("x0"), y0.alias("y0"), w["x1"].alias("x1"), (y0 + 10).alias("y1"))

    return sheets.select("doc_id", "page_number", F.transform("words", token).alias("words"))


def font_sheets(sheets: DataFrame) -> DataFrame:
    """Sheets of :func:`sheets` whose words have the places and font sizes of :func:`tokens`, in one pass."""
    whole = LINES_A_PAGE * WORDS_A_LINE
    columns = _columns((F.col("doc_id") + F.col("page_number") - 1) % 3 == 1)
    tops = _table(20 + 26 * k + 5 * (k // 5) for k in range(LINES_A_PAGE))
    sizes = _table({1: 18, 28: 16, 12: 10}.get(k, 12) for k in range(LINES_A_PAGE))

    def token(w, columns):
        seq = w["seq"]
        k = (seq % whole / WORDS_A_LINE).cast("int")
        x0 = F.when(seq % (7 * WORDS_A_LINE) == 3 * WORDS_A_LINE, 40.0).otherwise(F.get(columns, seq % WORDS_A_LINE))
        y0 = F.get(tops, k) + 4 * (seq % 3) + (seq % 4) * 0.03125
        return F.struct(seq.alias("seq"), w["text"].alias("text"), x0.alias("x0"), y0.alias("y0"), (x0 + 4 * F.length(w["text"])).alias("x1"), (y0 + 10).alias("y1"), F.get(sizes, k).alias("font_size"))

    return sheets.select("doc_id", "page_number", once(columns, lambda c: F.transform("words", lambda w: token(w, c))).alias("words"))


def prefix_of(ln):
    n, k = ln % 90, ln % 30
    return (
        F.when(n == 1, F.concat(F.lit("Chapter "), (F.floor(ln / 90) + 1).cast("string"), F.lit(": ")))
        .when(n == 31, "Section 2: ").when(k == 20, "[1] ").when(k == 21, "Figure 3: ").when(k == 22, "Note: ").otherwise("")
    )


def elements(w: DataFrame) -> DataFrame:
    """Lines as elements, with chapter, section, note and caption prefixes at fixed lines; words of any rows meet in their line."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda e: e["text"]), " ")
    lines = w.groupBy("doc_id", "page_number", "ln").agg(text.alias("t"), F.min("x0").alias("x0"), F.min("top").alias("y0"), F.max("x1").alias("x1"), F.max("bottom").alias("y1"))
    return _element(lines)


def _element(lines: DataFrame) -> DataFrame:
    return lines.select("doc_id", "page_number", F.col("ln").alias("seq"), F.concat(prefix_of(F.col("ln")), "t").alias("text"), "x0", "y0", "x1", "y1", font_size().alias("font_size"), (F.col("ln") % 30 == 1).alias("is_bold"))


def _lines_of():
    """The lines of a sheet of one text as an array of (k, words)."""
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size("words") / WORDS_A_LINE).cast("int") - 1), lambda k: F.struct(k.alias("k"), F.slice("words", k * WORDS_A_LINE + 1, WORDS_A_LINE).alias("words")))


def elements_of(sheets: DataFrame) -> DataFrame:
    """:func:`elements` of sheets of one text each, line by line where the text is read."""
    ln = (LINES_A_PAGE * (F.col("page_number") - 1) + F.col("k")).alias("ln")
    rows = sheets.select("doc_id", "page_number", F.posexplode_outer(_runs("said", WORDS_A_LINE)).alias("k", "line")).select("doc_id", "page_number", ln, F.split("line", GAP).alias("ws"))
    left = _columns((F.col("doc_id") + F.col("page_number") - 1) % 3 == 1)
    right = F.array_max(F.transform("ws", lambda w, i: F.when((i == 0) & (F.col("ln") % 7 == 3), 40.0).otherwise(F.get(left, i)) + 4 * F.length(w)))
    y0 = top_of(F.col("ln"))
    return _element(rows.select("doc_id", "page_number", "ln", F.array_join("ws", " ").alias("t"), x_of(F.col("ln"), F.lit(0)).alias("x0"), y0.alias("y0"), right.alias("x1"), (y0 + 10).alias("y1")))


def pages(e: DataFrame) -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n")
    return _page(e.groupBy("doc_id", "page_number").agg(text.alias("raw_text")))


def marked(rows: DataFrame) -> DataFrame:
    """rows with the size of their page and the numbers of its images and tables."""
    some, tables = (F.col("doc_id") + F.col("page_number")) % 4 == 0, (F.col("doc_id") + 2 * F.col("page_number")) % 5 == 0
    return rows.withColumns({"width": F.lit(WIDTH), "height": F.lit(HEIGHT), "n_images": some.cast("int"), "n_tables": tables.cast("int")})


def _page(rows: DataFrame) -> DataFrame:
    return marked(rows).select("doc_id", "page_number", "width", "height", "raw_text", "n_images", "n_tables", F.lit(None).cast("string").alias("ocr_text"))


def pages_of(sheets: DataFrame) -> DataFrame:
    """:func:`pages` of sheets of one text each."""
    line = lambda t, k: F.concat(prefix_of(LINES_A_PAGE * (F.col("page_number") - 1) + k), F.regexp_replace(t, GAP, " "))
    return _page(sheets.select("doc_id", "page_number", F.array_join(F.transform(_runs("said", WORDS_A_LINE), line), "\n").alias("raw_text")))


def line_sheets(sheets: DataFrame) -> DataFrame:
    """Sheets of one text each with their size, the text of their page, and the lines of :func:`elements` (seq, text, box, font size and weight) in an array; their words have their boxes."""

    def line(e):
        ln = LINES_A_PAGE * (F.col("page_number") - 1) + e["k"]
        top, right = top_of(ln), F.array_max(e["words"]["x1"])
        return F.struct(ln.alias("seq"), F.concat(prefix_of(ln), F.array_join(e["words"]["text"], " ")).alias("text"), x_of(ln, F.lit(0)).alias("x0"), top.alias("y0"), right.alias("x1"), (top + 10).alias("y1"), font_size(e["k"]).alias("font_size"), (e["k"] == 1).alias("is_bold"))

    rows = marked(placed(sheets)).withColumn("lines", F.transform(_lines_of(), line))
    return rows.withColumn("raw_text", F.array_join("lines.text", "\n"))


def images(p: DataFrame) -> DataFrame:
    """An image on each page that has one, its size by rule."""
    side = F.col("doc_id") % 5
    return p.where("n_images > 0").select(
        "doc_id", "page_number", F.lit(0).alias("image_no"), F.lit(50.0).alias("x0"), F.lit(100.0).alias("y0"), (50.0 + 100 * side).alias("x1"), F.lit(700.0).alias("y1"),
        (F.lit(1000) + 400 * (F.col("doc_id") % 7)).cast("int").alias("width"), F.lit(800).alias("height"), F.concat(F.lit("assets/page_"), F.col("page_number").cast("string"), F.lit("_image.png")).alias("path"),
    )


def outline(docs: DataFrame) -> DataFrame:
    """Outline entries of every fifth document: pages 1 and 3."""
    return docs.where("doc_id % 5 = 0").select("doc_id", F.explode(F.array(F.struct(F.lit("Start").alias("title"), F.lit(1).alias("page")), F.struct(F.lit("Later").alias("title"), F.lit(3).alias("page")))).alias("o")).select("doc_id", "o.title", "o.page")


def files(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.concat(F.lit("/in/annual_report-"), F.col("source"), F.lit(".pdf")).alias("path"))


def table_cells(suppliers: DataFrame) -> DataFrame:
    """A table for each nation of suppliers: a header and a row for each, in the order of their keys."""
    from pyspark.sql import Window

    row = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    rows = suppliers.select("s_nationkey", row.alias("row"), F.array(F.col("s_name"), F.col("s_suppkey").cast("string"), F.concat(F.lit("$"), F.floor("s_acctbal").cast("string"), F.lit(".00")), F.lit("a|b")).alias("c"))
    head = suppliers.select("s_nationkey").distinct().select("s_nationkey", F.lit(0).alias("row"), F.array(*map(F.lit, ("Name", "Key", "Balance", "Mark"))).alias("c"))
    cells = head.unionByName(rows).select("s_nationkey", "row", F.posexplode("c").alias("col", "text"))
    return cells.select(
        F.lit(1).cast("long").alias("doc_id"), F.lit(1).alias("page_number"), F.col("s_nationkey").alias("table_no"), "row", "col", "text", F.lit(1).alias("rowspan"), F.lit(1).alias("colspan")
    )


def pdf_bytes(pages: list[list[str]]) -> bytes:
    """A PDF file of plain text lines: 12 points high, 24 apart, with a rectangle around the first line and an image on every fourth page."""
    out, offsets = bytearray(b"%PDF-1.4\n"), []

    def add(body: bytes) -> None:
        offsets.append(len(out))
        out.extend(b"%d 0 obj\n" % len(offsets) + body + b"\nendobj\n")

    first = 5
    add(b"<< /Type /Catalog /Pages 2 0 R >>")
    add(b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (first + 2 * i) for i in range(len(pages))) + b"] /Count %d /MediaBox [0 0 595 842] >>" % len(pages))
    add(b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>")
    dots = zlib.compress(bytes(range(0, 48)))
    add(b"<< /Subtype /Image /Width 4 /Height 4 /BitsPerComponent 8 /ColorSpace /DeviceRGB /Filter /FlateDecode /Length %d >>\nstream\n" % len(dots) + dots + b"\nendstream")
    for n, lines in enumerate(pages):
        text = b"\n".join(
            b"BT /F1 12 Tf 50 %d Td (%s) Tj ET" % (800 - 24 * i, line.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")) for i, line in enumerate(lines)
        )
        text += b"\n40 790 500 30 re S" + (b"\nq 100 0 0 50 50 20 cm /I1 Do Q" if n % 4 == 3 else b"")
        text = zlib.compress(text)
        add(b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> /XObject << /I1 4 0 R >> >> /Contents %d 0 R >>" % (first + 1 + 2 * n))
        add(b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(text) + text + b"\nendstream")
    return bytes(out) + b"trailer << /Root 1 0 R >>\n%%EOF"


def pdf_files_of(docs: DataFrame) -> DataFrame:
    """:func:`pdf_files` for texts whose doc_id no other has: each file is made where its text is read, nothing is shuffled."""
    lines = _cut("ws", WORDS_A_LINE, lambda ws: F.array_join(ws, " "))
    rows = docs.select("doc_id", words_in("text").alias("ws")).where(F.size("ws") > 0).select("doc_id", lines.alias("lines"))
    return _made(rows.select("doc_id", _cut("lines", LINES_A_PAGE, lambda x: x).alias("pages")))


def _cut(array: str, size: int, then):
    """An array that isn't empty in parts of a size, as `then` gives them."""
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(array) / size).cast("int") - 1), lambda i: then(F.slice(array, i * size + 1, size)))


def pdf_files(w: DataFrame) -> DataFrame:
    """``path, content``: a PDF file for each document, its words ten a line and thirty lines a page."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda e: e["text"]), " ")
    lines = w.groupBy("doc_id", "page_number", "ln").agg(line.alias("line"))
    sheets = lines.groupBy("doc_id", "page_number").agg(F.transform(F.array_sort(F.collect_list(F.struct("ln", "line"))), lambda e: e["line"]).alias("lines"))
    whole = sheets.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "lines"))), lambda e: e["lines"]).alias("pages"))
    return _made(whole)


def _made(whole: DataFrame) -> DataFrame:
    @F.pandas_udf("binary")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda sheets: pdf_bytes([list(x) for x in sheets]))

    return whole.select(F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), made("pages").alias("content"))


#: The same tables as DuckDB SQL.
SQL = """
w0 AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\n]+'), lambda x: x <> '') AS ws FROM documents),
w1 AS (SELECT doc_id, unnest(ws) AS text, CAST(generate_subscripts(ws, 1) - 1 AS INTEGER) AS seq FROM w0),
w2 AS (SELECT *, seq // 10 AS ln, seq % 10 AS pos, (seq // 10) % 30 AS k FROM w1),
w3 AS (SELECT *, CAST(CASE WHEN ln % 7 = 3 AND pos = 0 THEN 40 ELSE 55 + 50 * pos END + CASE WHEN (doc_id + ln // 30) % 3 <> 1 OR pos < 4 THEN 0 WHEN pos < 7 THEN 12 ELSE 24 END AS DOUBLE) AS x0, CAST(20 + 26 * k + 5 * (k // 5) AS DOUBLE) AS top FROM w2),
words AS (SELECT doc_id, ln // 30 + 1 AS page_number, seq, text, x0, x0 + 4 * length(text) AS x1, top, top + 10 AS bottom, ln, k FROM w3),
tokens AS (SELECT doc_id, page_number, seq, text, x0, top + 4 * (seq % 3) + (seq % 4) * 0.03125::DOUBLE AS y0, x1, top + 4 * (seq % 3) + (seq % 4) * 0.03125::DOUBLE + 10 AS y1, CAST(CASE k WHEN 1 THEN 18 WHEN 28 THEN 16 WHEN 12 THEN 10 ELSE 12 END AS DOUBLE) AS font_size, k = 1 AS is_bold FROM words),
elements AS (SELECT doc_id, page_number, ln AS seq,
  CASE WHEN ln % 90 = 1 THEN 'Chapter ' || CAST(ln // 90 + 1 AS VARCHAR) || ': ' WHEN ln % 90 = 31 THEN 'Section 2: ' WHEN k = 20 THEN '[1] ' WHEN k = 21 THEN 'Figure 3: ' WHEN k = 22 THEN 'Note: ' ELSE '' END
    || string_agg(text, ' ' ORDER BY seq) AS text,
  min(x0) AS x0, min(top) AS y0, max(x1) AS x1, max(bottom) AS y1, CAST(CASE k WHEN 1 THEN 18 WHEN 28 THEN 16 WHEN 12 THEN 10 ELSE 12 END AS DOUBLE) AS font_size, k = 1 AS is_bold
  FROM words GROUP BY doc_id, page_number, ln, k),
pg AS (SELECT doc_id, page_number, CAST(595 AS DOUBLE) AS width, CAST(842 AS DOUBLE) AS height, string_agg(text, chr(10) ORDER BY seq) AS raw_text, CAST((doc_id + page_number) % 4 = 0 AS INTEGER) AS n_images, CAST((doc_id + 2 * page_number) % 5 = 0 AS INTEGER) AS n_tables FROM elements GROUP BY doc_id, page_number),
images AS (SELECT doc_id, page_number, CAST(50 AS DOUBLE) AS x0, CAST(100 AS DOUBLE) AS y0, CAST(50 + 100 * (doc_id % 5) AS DOUBLE) AS x1, CAST(700 AS DOUBLE) AS y1, CAST(1000 + 400 * (doc_id % 7) AS INTEGER) AS width, 800 AS height,
  'assets/page_' || CAST(page_number AS VARCHAR) || '_image.png' AS path FROM pg WHERE n_images > 0),
outline AS (SELECT doc_id, 'Start' AS title, 1 AS page FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 'Later', 3 FROM documents WHERE doc_id % 5 = 0),
files AS (SELECT doc_id, '/in/annual_report-' || source || '.pdf' AS path FROM documents),
cells AS (SELECT s_nationkey AS table_no, r AS row, c AS col, list_extract(t, c + 1) AS text FROM (
    SELECT s_nationkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INTEGER) AS r, [s_name, CAST(s_suppkey AS VARCHAR), '$' || CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR) || '.00', 'a|b'] AS t FROM supplier
    UNION ALL SELECT DISTINCT s_nationkey, 0, ['Name', 'Key', 'Balance', 'Mark'] FROM supplier) CROSS JOIN (SELECT CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS c)),
head AS (SELECT doc_id, page_number, min(x0) AS x0, min(top) AS y0, max(x1) AS x1, max(bottom) AS y1, string_agg(text, ' ' ORDER BY seq) AS text FROM words WHERE top < 50 AND bottom > 0 GROUP BY ALL),
foot AS (SELECT doc_id, page_number, min(x0) AS x0, min(top) AS y0, max(x1) AS x1, max(bottom) AS y1, string_agg(text, ' ' ORDER BY seq) AS text FROM words WHERE top >= 792 AND bottom <= 842 GROUP BY ALL),
inner_words AS (SELECT * FROM words WHERE top >= 50 AND bottom <= 792),
body_lines AS (SELECT doc_id, page_number, top AS line_y, min(x0) AS x0, min(top) AS y0, max(x1) AS x1, max(bottom) AS y1, string_agg(text, ' ' ORDER BY x0, seq) AS text FROM inner_words GROUP BY doc_id, page_number, top),
par0 AS (SELECT *, max(y1) OVER (PARTITION BY doc_id, page_number ORDER BY line_y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM body_lines),
par1 AS (SELECT *, CAST(sum(CASE WHEN low IS NULL OR y0 - low >= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_number ORDER BY line_y ROWS UNBOUNDED PRECEDING) AS INTEGER) AS paragraph_no FROM par0),
paragraphs AS (SELECT doc_id, page_number, paragraph_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, string_agg(text, chr(10) ORDER BY line_y) AS text FROM par1 GROUP BY doc_id, page_number, paragraph_no),
margins AS (SELECT doc_id, page_number, seq, text, x0, top AS y0, x1, bottom AS y1,
  CASE WHEN x1 > 545 THEN CASE WHEN top >= 842 * CAST(0.1 AS DOUBLE) AND bottom <= 842 * CAST(0.9 AS DOUBLE) AND x1 > 570 THEN 'right' END WHEN x0 < 50 THEN 'left' END AS side
  FROM words WHERE NOT (length(text) < 2 OR (regexp_full_match(text, '[0-9]+') AND length(text) < 4) OR regexp_full_match(text, '[.,;:!?—-]+'))),
edge_words AS (SELECT * FROM margins WHERE side IS NOT NULL),
density AS (SELECT pg.doc_id, pg.page_number, coalesce(sum((x1 - x0) * (bottom - top)) / (595.0::DOUBLE * 842), 0) AS text_density FROM pg LEFT JOIN words w ON w.doc_id = pg.doc_id AND w.page_number = pg.page_number GROUP BY ALL),
layouts AS (SELECT pg.doc_id, pg.page_number, width, height, coalesce(head.text, '') AS header_text, coalesce(foot.text, '') AS footer_text, coalesce(n_body, 0) AS n_body, coalesce(n_edge, 0) AS n_edge, n_images > 0 AS has_images, n_tables > 0 AS has_tables, text_density
  FROM pg JOIN density USING (doc_id, page_number) LEFT JOIN head USING (doc_id, page_number) LEFT JOIN foot USING (doc_id, page_number)
  LEFT JOIN (SELECT doc_id, page_number, count(*) AS n_body FROM paragraphs GROUP BY ALL) USING (doc_id, page_number)
  LEFT JOIN (SELECT doc_id, page_number, count(*) AS n_edge FROM edge_words GROUP BY ALL) USING (doc_id, page_number)),
cand AS (SELECT *, CASE WHEN regexp_matches(text, '^(?i:Chapter\\s+\\d+|Section\\s+\\d+)') THEN 100 WHEN font_size >= 16 AND is_bold AND abs((x0 + x1) / 2 - 297.5) < 595 * CAST(0.1 AS DOUBLE) AND y1 >= CAST(0.8 AS DOUBLE) * 842 AND font_size >= CAST(1.3 AS DOUBLE) * med THEN 50 WHEN font_size >= 16 AND y1 >= CAST(0.8 AS DOUBLE) * 842 THEN 20 END AS score
  FROM elements JOIN (SELECT doc_id, page_number, list_sort(list(font_size))[count(*) // 2 + 1] AS med FROM elements GROUP BY ALL) USING (doc_id, page_number) WHERE font_size >= 14),
by_page AS (SELECT doc_id, page_number, trim(text) AS title, text AS heading, CASE score WHEN 100 THEN 'pattern' WHEN 50 THEN 'font_position' ELSE 'position' END AS is_detected_by FROM cand WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, page_number ORDER BY score DESC, seq) = 1),
chg0 AS (SELECT doc_id, page_number, n_body, width, height, text_density, lag(n_body) OVER w AS pn, lag(width) OVER w AS pw, lag(height) OVER w AS ph, lag(text_density) OVER w AS pd FROM layouts WINDOW w AS (PARTITION BY doc_id ORDER BY page_number)),
changes AS (SELECT doc_id, page_number, coalesce(pn IS NOT NULL AND (n_body <> pn OR abs(width - pw) / pw > 0.1 OR abs(height - ph) / ph > 0.1), false) AS layout_change,
  coalesce(pd IS NOT NULL AND ((text_density = 0) <> (pd = 0) OR abs(text_density - pd) / greatest(text_density, pd) > CAST(0.3 AS DOUBLE)), false) AS density_change FROM chg0),
tops AS (SELECT doc_id, page_number, trim(text) AS title, text AS heading FROM elements WHERE font_size >= 14 QUALIFY row_number() OVER (PARTITION BY doc_id, page_number ORDER BY font_size DESC, seq) = 1),
by_change AS (SELECT doc_id, page_number, title, heading, CASE WHEN layout_change THEN 'structure' ELSE 'density' END AS is_detected_by FROM changes JOIN tops USING (doc_id, page_number) WHERE layout_change OR density_change),
found0 AS (SELECT * FROM by_page UNION ALL SELECT * FROM by_change),
found1 AS (SELECT *, CASE is_detected_by WHEN 'pattern' THEN 5 WHEN 'font_position' THEN 4 WHEN 'structure' THEN 3 WHEN 'density' THEN 2 ELSE 1 END AS p FROM found0 QUALIFY row_number() OVER (PARTITION BY doc_id, page_number ORDER BY p DESC, heading) = 1),
boundaries AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_number) AS INTEGER) AS chapter_number, page_number, title, heading, is_detected_by FROM found1),
hf AS (SELECT doc_id, page_number, kind, content, trim(regexp_replace(regexp_replace(trim(regexp_replace(content, '\\s+', ' ', 'g')), '(?i)page\\s*\\d+', '', 'g'), '\\s*\\d+\\s*$', '')) AS norm FROM (
  SELECT doc_id, page_number, 'header' AS kind, CASE WHEN page_number % 2 = 1 THEN 'Annual report of company ' || CAST(doc_id % 7 AS VARCHAR) || ' and  all its parts for the whole year, Page ' || CAST(page_number AS VARCHAR) ELSE header_text END AS content FROM layouts UNION ALL SELECT doc_id, page_number, 'footer', footer_text FROM layouts) WHERE trim(content) <> ''),
edges0 AS (SELECT doc_id, page_number, seq, trim(text) AS text, CASE least(x0, 595 - x1, y0, 842 - y1) WHEN x0 THEN 'left' WHEN 595 - x1 THEN 'right' WHEN y0 THEN 'top' ELSE 'bottom' END AS position, x0, y0, x1, y1 FROM edge_words),
edges AS (SELECT * FROM edges0 QUALIFY row_number() OVER (PARTITION BY doc_id, lower(text), position ORDER BY page_number, seq) = 1),
el_out AS (SELECT e.* FROM elements e WHERE NOT EXISTS (SELECT 1 FROM edge_words r WHERE r.doc_id = e.doc_id AND r.page_number = e.page_number AND (e.x0 + e.x1) / 2 BETWEEN r.x0 AND r.x1 AND (e.y0 + e.y1) / 2 BETWEEN r.y0 AND r.y1)),
body_kept AS (SELECT doc_id, page_number, string_agg(text, chr(10) ORDER BY y0) AS kept FROM el_out GROUP BY ALL),
bodies AS (SELECT pg.doc_id, pg.page_number, CASE WHEN h.doc_id IS NOT NULL THEN coalesce(kept, '') ELSE raw_text END AS body_text FROM pg LEFT JOIN (SELECT DISTINCT doc_id, page_number FROM edge_words) h USING (doc_id, page_number) LEFT JOIN body_kept USING (doc_id, page_number)),
headings AS (SELECT e.doc_id, e.page_number, 0 AS kind_rank, seq, 'heading' AS item_type, trim(text) AS text,
  CASE WHEN abs((x0 + x1) / 2 - 297.5) < 595 * CAST(0.1 AS DOUBLE) THEN 'header' WHEN y0 < 50 THEN 'header' WHEN y1 > 545 THEN 'footer' ELSE 'body' END AS position, CAST(0.9 AS DOUBLE) AS confidence, 'Font size: ' || CAST(font_size AS VARCHAR) || 'pt' AS context
  FROM elements e WHERE font_size >= 14 AND regexp_matches(trim(text), '^(?i:Chapter\\s+\\d+[:\\s].*|Section\\s+\\d+[:\\s].*)')),
body_rows AS (SELECT doc_id, page_number, unnest(string_split(body_text, chr(10))) AS line, CAST(generate_subscripts(string_split(body_text, chr(10)), 1) - 1 AS INTEGER) AS seq FROM bodies),
footnotes AS (SELECT doc_id, page_number, 1 AS kind_rank, seq, 'footnote' AS item_type, trim(line) AS text, 'body' AS position, CAST(0.8 AS DOUBLE) AS confidence, CAST(NULL AS VARCHAR) AS context FROM body_rows WHERE regexp_matches(trim(line), '^(\\[\\d+\\]\\s+|\\d+\\)\\s+|\\*\\s+\\d+\\s+\\*.*$)')),
captions AS (SELECT doc_id, page_number, 2 AS kind_rank, seq, 'caption' AS item_type, trim(line) AS text, 'body' AS position, CAST(0.85 AS DOUBLE) AS confidence, CAST(NULL AS VARCHAR) AS context FROM body_rows WHERE regexp_matches(trim(line), '^(?i:(Figure|Table|Diagram|Chart)\\s+\\d+[:.-].*|(Fig|Tab|Ex)\\.?\\s+\\d+[:.-].*)')),
annotations AS (SELECT doc_id, page_number, 3 AS kind_rank, seq, 'annotation' AS item_type, trim(text) AS text, 'edge' AS position, CAST(0.7 AS DOUBLE) AS confidence, 'Edge text' AS context FROM edge_words WHERE contains(text, '†') OR contains(text, '‡') OR contains(text, '*') OR contains(text, 'Note:') OR contains(text, '注:') OR contains(text, 'Remark:')),
items AS (SELECT * FROM headings UNION ALL SELECT * FROM footnotes UNION ALL SELECT * FROM captions UNION ALL SELECT * FROM annotations),
levels AS (SELECT *, CASE WHEN regexp_matches(text, '^(?i:Chapter\\s+\\d+)') THEN 1 WHEN regexp_matches(text, '^(?i:Section\\s+\\d+|\\d+\\.\\s+)') THEN 2 ELSE 3 END AS level FROM headings),
stats AS (SELECT pg.doc_id, pg.page_number, coalesce(sum(length(text)), 0) AS char_count, CAST(len(list_filter(regexp_split_to_array(any_value(raw_text), '\\s+'), lambda x: x <> '')) AS BIGINT) AS word_count, count(DISTINCT CAST(floor(y0) AS INTEGER)) AS line_count, avg(font_size) AS avg_font_size, bool_or(font_size >= 16) AS has_large_font FROM pg JOIN elements e USING (doc_id, page_number) GROUP BY pg.doc_id, pg.page_number)
"""
