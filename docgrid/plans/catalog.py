"""Operators from SQL text: tables as views, table functions over a page's rows, and functions of columns."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from operator import itemgetter

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..operators.elements import LINE_GAP

#: Functions that SQL text can call; the planner puts their bodies in place of the calls.
FUNCTIONS = {
    "boxes_meet": "(ax0 DOUBLE, ay0 DOUBLE, ax1 DOUBLE, ay1 DOUBLE, bx0 DOUBLE, by0 DOUBLE, bx1 DOUBLE, by1 DOUBLE) RETURNS BOOLEAN RETURN ax1 >= bx0 AND bx1 >= ax0 AND ay1 >= by0 AND by1 >= ay0",
    "heading_level": r"(t STRING) RETURNS INT RETURN CASE WHEN trim(t) RLIKE r'(?iuU)^(?:Chapter\s+\d+|第[一二三四五六七八九十百千万]+章)' THEN 1 WHEN trim(t) RLIKE r'(?iuU)^(?:Section\s+\d+|\d+\.\s+)' THEN 2 ELSE 3 END",
    "share_done": "(done BIGINT, every BIGINT) RETURNS DOUBLE RETURN coalesce(try_divide(CAST(done AS DOUBLE), every), 0.0D)",
}


def _need(table: AnalyzeArgument, name: str, columns: str) -> None:
    if not table.isTable:
        raise ValueError(f"{name} takes TABLE(...)")
    if missing := [c for c in columns.split() if c not in table.dataType.fieldNames()]:
        raise ValueError(f"{name} needs the columns {', '.join(missing)}")


class PageLines:
    """``page_lines(TABLE(words), gap => 10.0)``: the lines of each page: ``doc_id, page_number, line_no, line_y, words, text``.

    words has doc_id, page_number, seq, text, x0 and top. Tops no more than gap
    below the first of a line belong to it; a line's words go by x0 and seq. The
    function itself asks for pages as partitions and for their order, and holds
    one line at a time. Words without a top are in no line.

    Where seq, text, x0 and top are arrays, a row is a whole page: its words are
    in these, and nothing is partitioned or ordered.
    """

    @staticmethod
    def analyze(words: AnalyzeArgument, gap: AnalyzeArgument | None = None) -> AnalyzeResult:
        _need(words, "page_lines", "doc_id page_number seq text x0 top")
        if gap is not None and (not gap.isConstantExpression or gap.value is None):
            raise ValueError("gap is a constant number")
        schema = StructType().add("doc_id", LongType()).add("page_number", IntegerType()).add("line_no", IntegerType()).add("line_y", DoubleType()).add("words", IntegerType()).add("text", StringType())
        if isinstance(words.dataType["top"].dataType, ArrayType):
            return AnalyzeResult(schema)
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("doc_id"), PartitioningColumn("page_number")], orderBy=[OrderingColumn("top"), OrderingColumn("x0"), OrderingColumn("seq")])

    def __init__(self) -> None:
        self.line: list[Row] = []
        self.n = 0

    def _taken(self) -> Iterator[tuple]:
        if self.line:
            self.n += 1
            first = self.line[0]
            words = sorted(self.line, key=lambda r: (r.x0, r.seq))
            yield first.doc_id, first.page_number, self.n, first.top, len(words), " ".join(r.text or "" for r in words)
        self.line = []

    @staticmethod
    def _lines(page: Row, gap: float) -> Iterator[tuple]:
        """The lines of a page whose words are in arrays."""
        words = sorted((w for w in zip(page.top, page.x0, page.seq, page.text) if w[0] is not None), key=itemgetter(0))
        starts = []
        for i, w in enumerate(words):
            if not starts or w[0] - words[starts[-1]][0] > gap:
                starts.append(i)
        for n, (i, j) in enumerate(zip(starts, [*starts[1:], len(words)]), 1):
            own = sorted(words[i:j], key=itemgetter(1, 2))
            yield page.doc_id, page.page_number, n, words[i][0], len(own), " ".join([w[3] or "" for w in own])

    def eval(self, words: Row, gap: float = LINE_GAP) -> Iterator[tuple]:
        if words.top is None:
            return
        if isinstance(words.top, list):
            yield from self._lines(words, float(gap))
            return
        if self.line and words.top - self.line[0].top > float(gap):
            yield from self._taken()
        self.line.append(words)

    def terminate(self) -> Iterator[tuple]:
        yield from self._taken()


class PdfText:
    """``pdf_text(TABLE(files))``: the pages of files (path, content): ``path, page_number, total_pages, text, error``; a file that can't be read is one row of page 0."""

    @staticmethod
    def analyze(files: AnalyzeArgument) -> AnalyzeResult:
        _need(files, "pdf_text", "path content")
        return AnalyzeResult(StructType().add("path", StringType()).add("page_number", IntegerType()).add("total_pages", IntegerType()).add("text", StringType()).add("error", StringType()))

    def eval(self, files: Row) -> Iterator[tuple]:
        from ..sources import pdf

        try:
            file = pdf.File(bytes(files.content))
            pages = file.pages()
        except Exception as e:
            yield files.path, 0, 0, "", str(e)[:200] or type(e).__name__
            return
        for n, page in enumerate(pages, 1):
            try:
                yield files.path, n, len(pages), pdf.raw_text(pdf.page_chars(file, page)[2]), None
            except Exception as e:
                yield files.path, n, len(pages), "", str(e)[:200] or type(e).__name__


TABLE_FUNCTIONS = {"page_lines": PageLines, "pdf_text": PdfText}


def register(spark: SparkSession, tables: Mapping[str, DataFrame] | None = None) -> None:
    """Makes the functions known to the session's SQL, and tables as temporary views of their names."""
    from pyspark.sql.functions import udtf

    for name, sql in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{sql}")
    for name, made in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, udtf(made))
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
