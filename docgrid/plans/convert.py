"""From files to Markdown: one plan over all files, parallel by file and page."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import word_count
from ..operators import chapters, checkpoints, edges, elements, headers, images, layout, manifest, ocr, render, sinks, summary, tables
from ..shipping import ship
from ..sources import files as file_source
from ..sources import pdf
from .materialise import materialised, temporary
from .progress import Progress


RECOGNITION = ("auto", "always", "never")


@dataclass(frozen=True)
class Options:
    """Conversion options."""

    use_words: bool = True
    whole_chapters: bool = True
    outline: DataFrame | None = None
    #: Makes the engine that recognises scanned pages, once a worker; None leaves them as they are.
    make_engine: Callable[[], ocr.OcrEngine] | None = None
    include_images: bool = True
    include_tables: bool = True
    include_ocr_text: bool = True
    #: Named parameters of :func:`docgrid.operators.chapters.boundaries` and :func:`docgrid.operators.layout.analyze`.
    chapters: dict = field(default_factory=dict)
    layout: dict = field(default_factory=dict)
    #: Of :func:`docgrid.operators.summary.items`, :func:`docgrid.operators.headers.fuzzy_groups` and :func:`docgrid.operators.edges.extracted`.
    summary: dict = field(default_factory=dict)
    headers: dict = field(default_factory=dict)
    edges: dict = field(default_factory=dict)
    #: Whether pages are recognised by need ("auto") or all that have an image ("always"), and the thresholds of :func:`docgrid.operators.ocr.needs_ocr`.
    recognition: str = "auto"
    ocr: dict = field(default_factory=dict)
    #: Pages of each file that are read before they are kept; None reads all at once.
    pages_a_wave: int | None = None


@dataclass
class Analysis:
    """The tables of a conversion."""

    files: DataFrame
    pages: DataFrame
    elements: DataFrame
    layouts: DataFrame
    bodies: DataFrame
    statistics: DataFrame
    chapters: DataFrame
    edge_texts: DataFrame
    summaries: DataFrame
    options: Options

    @property
    def header_groups(self) -> DataFrame:
        """Groups of similar headers and footers; made when asked for, since no output shows them."""
        return headers.fuzzy_groups(self.layouts, **self.options.headers)


def words_of(pages: DataFrame) -> DataFrame:
    """Words of pages with a ``chars`` array: runs of characters without white space or wide gaps, a window over each page."""
    from pyspark.sql import Window

    rows = pages.select("doc_id", "page_number", F.explode("chars").alias("c")).select("doc_id", "page_number", "c.*")
    w = Window.partitionBy("doc_id", "page_number").orderBy("seq")
    gap = (F.col("x0") - F.lag("x1").over(w) > 0.25 * F.col("size")) | (F.abs(F.col("top") - F.lag("top").over(w)) > 3) | (F.trim(F.lag("text").over(w)) == "")
    rows = rows.withColumn("new", F.when(F.coalesce(gap, F.lit(True)), 1).otherwise(0)).withColumn("word", F.sum("new").over(w)).where(F.trim("text") != "")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda e: e["text"]), "")
    out = rows.groupBy("doc_id", "page_number", "word").agg(
        F.min("seq").alias("seq"), text.alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"),
        F.min_by("size", "seq").alias("font_size"), F.min_by(F.lower("fontname").contains("bold"), "seq").alias("is_bold"),
    )
    return out.drop("word")


def analyze(files: DataFrame, pages: DataFrame, options: Options = Options()) -> Analysis:
    """All analyses of pages read by :func:`docgrid.sources.pdf.read_pages`; files: doc_id, path."""
    words = materialised(words_of(pages), "words")
    if options.use_words:
        own = words.select("doc_id", "page_number", "seq", "text", "x0", F.col("top").alias("y0"), "x1", F.col("bottom").alias("y1"), "font_size", "is_bold")
    else:
        own = elements.elements_from_chars(pages)
    own = materialised(elements.merge_adjacent(elements.adaptive_order(own)), "elements")
    sized = pages.where("width is not null")
    layouts = layout.analyze(words, sized, **options.layout)
    margin = layout.edge_words(words, sized, options.layout.get("margin", layout.EDGE_MARGIN))
    bodies = materialised(elements.body_text(pages, own, margin), "bodies")
    stats = elements.text_statistics(pages, own)
    found = chapters.boundaries(own, sized, layouts, options.outline, **options.chapters)
    texts = edges.extracted(margin, sized, **options.edges)
    items = summary.items(own, sized, bodies, margin, **options.summary)
    return Analysis(files, pages, own, layouts, bodies, stats, found, texts, summary.summaries(items, bodies, stats, files), options)


def pictures_of(pages: DataFrame) -> DataFrame:
    """Images of pages, a row each; those in a format that viewers read keep their data."""
    rows = pages.select("doc_id", "page_number", F.explode("images").alias("i")).select("doc_id", "page_number", "i.*")
    return rows.withColumn("data", F.when(F.col("format").isin("jpeg", "png", "jp2"), F.col("data")))


def with_recognised_text(pages: DataFrame, options: Options) -> DataFrame:
    """pages with ``ocr_text`` where a page is to be recognised and has an image, by its largest one, and ``ocr_error`` where the engine failed.

    By ``options.recognition`` that is where a page needs it, on every page, or
    nowhere ("never"). The usual length that a page is held against is its
    number of words.
    """
    if options.recognition not in RECOGNITION:
        raise ValueError(f"recognition is one of {', '.join(RECOGNITION)}")
    if options.make_engine is None or options.recognition == "never":
        return pages.withColumn("ocr_error", F.lit(None).cast("string"))
    area = lambda i: F.greatest(i["x1"] - i["x0"], F.lit(0.0)) * F.greatest(i["y1"] - i["y0"], F.lit(0.0))
    share = F.coalesce(F.try_divide(F.aggregate("images", F.lit(0.0), lambda acc, i: acc + area(i)), F.col("width") * F.col("height")), F.lit(0.0))
    whole = F.filter("images", lambda i: i["format"].isin("jpeg", "png", "jp2"))
    largest = F.array_max(F.transform(whole, lambda i: F.struct(area(i).alias("area"), (-i["image_no"]).alias("n"), i["data"].alias("data"))))["data"]
    need = ocr.needs_ocr(has_images=F.col("n_images") > 0, image_ratio=share, typical_length=word_count("raw_text"), **options.ocr)
    need = F.col("error").isNull() & (F.col("page_number") > 0) & (F.lit(True) if options.recognition == "always" else need)
    seen = ocr.recognised(pages.withColumn("needs_ocr", need).withColumn("image", largest), options.make_engine)
    return seen.withColumn("ocr_text", F.col("ocr.text")).select(*pages.columns, "ocr_error")


def _links(pictures: DataFrame) -> DataFrame:
    path = F.concat(F.lit("assets/"), images.filename())
    return pictures.where("data is not null").select("doc_id", "page_number", "image_no", render.image_link(path, F.concat(F.lit("../"), path)).alias("link"))


def rendered(a: Analysis, options: Options = Options()) -> DataFrame:
    """Output files of an analysis: ``doc_id, path, content``."""
    parts = render.chapter_content(a.bodies, a.chapters, chapters.ranges(a.chapters, a.pages) if options.whole_chapters else None)
    rows = a.pages.select("doc_id", "page_number", F.posexplode("tables").alias("table_no", "rows"))
    shown = a.pages if options.include_ocr_text else a.pages.withColumn("ocr_text", F.lit(None).cast("string"))
    blocks = render.page_blocks(shown, a.bodies, tables.cells_from_rows(rows) if options.include_tables else None, _links(pictures_of(a.pages)) if options.include_images else None)
    content = render.complete_content(blocks)
    return render.documents(a.files, a.pages, a.summaries, content, edges.formatted(a.edge_texts), parts)


def _read(spark: SparkSession, found: DataFrame, listed: DataFrame, output: str, first: int, resume: bool, options: Options, progress: Progress) -> None:
    """Reads the pages of files that aren't done and keeps them under ``_pages``, with manifest rows beside, ``pages_a_wave`` of each file at a time.

    A wave is a version of both tables, its manifest rows written last; a wave
    that was broken off is done again under its number. Pages that failed before
    are tried once more, those that fail in this run aren't tried again in it.
    """
    version = first
    while True:
        files = found
        if resume or version > first:
            tried = F.col("version") >= first
            skip = manifest.newest(manifest.read(spark, f"{output}/_manifest")).where(tried | F.col("error").isNull() if resume else tried)
            skip = skip.join(listed, manifest.FILE, "left_semi").groupBy(*manifest.FILE).agg(F.collect_list("page_number").alias("skip"))
            files = found.join(materialised(skip, "skip"), manifest.FILE, "left")
        pages = pdf.with_doc_ids(pdf.read_pages(files, options.pages_a_wave))
        pages = with_recognised_text(pages, options)
        progress.write(pages, f"{output}/_pages/version={version}")
        kept = spark.read.schema(pages.schema).parquet(f"{output}/_pages/version={version}")
        if kept.isEmpty():
            manifest.remove(spark, f"{output}/_pages/version={version}")
            return
        manifest.write(manifest.rows(kept), f"{output}/_manifest", version)
        if options.pages_a_wave is None:
            return
        version += 1


def convert(spark: SparkSession, source: str, output: str, resume: bool = False, options: Options = Options(), progress: Progress | None = None) -> DataFrame:
    """Converts the PDF files of a directory (or one file) to Markdown, each file into a folder of its own under output; gives a result row a file.

    Pages are read once and kept as Parquet under ``output/_pages``, by version,
    with a manifest row for each under ``output/_manifest``. With resume, files
    that the manifest lists unchanged and whole are left alone, so their output
    stays; of the others only the pages that aren't done are read, and the
    output is made from these and the pages kept before. With
    ``Options.pages_a_wave`` a run that is broken off inside long files resumes
    at its next wave. ``progress`` gets the counts of pages as they are kept.
    Checkpoint files, as JSON, lie under ``output/_checkpoints``.
    """
    ship(spark)
    with temporary(spark):
        found = file_source.scan_directory(spark, source, with_content=True).where(file_source.is_valid())
        found = found.withColumn("sha256", file_source.sha256())
        table = f"{output}/_manifest"
        if resume:
            whole = manifest.known_files(found, manifest.read(spark, table)).where(manifest.is_whole())
            found = found.join(materialised(whole.select(*manifest.FILE), "whole"), manifest.FILE, "left_anti")
        listed = materialised(found.select(*manifest.FILE), "files").withColumn("doc_id", F.xxhash64("path"))
        first = manifest.next_version(spark, table)
        _read(spark, found, listed, output, first, resume, options, progress or Progress())
        pages = kept_pages(spark, output, 0 if resume else first).join(listed.select(*manifest.FILE), manifest.FILE, "left_semi")
        a = analyze(listed.select("doc_id", "path"), pages.where("page_number > 0"), options)
        folder = listed.select("doc_id", file_source.stem("path").alias("folder"))
        out = rendered(a, options).select("doc_id", "path", F.col("content").cast("binary").alias("content"))
        if options.include_images:
            out = out.unionByName(images.output_files(pictures_of(pages)))
        out = out.join(folder, "doc_id").select(F.concat("folder", F.lit("_md/"), "path").alias("path"), "content")
        sinks.write_files(out, output)
        checkpoints.write(manifest.known_files(listed, manifest.read(spark, table)), f"{output}/_checkpoints")
        sinks.results(pages).write.mode("overwrite").parquet(f"{output}/_results")
    return spark.read.parquet(f"{output}/_results")


def kept_pages(spark: SparkSession, output: str, first: int = 0) -> DataFrame:
    """The newest version of each page that conversions into output have kept, of versions from `first` on."""
    known = manifest.read(spark, f"{output}/_manifest").where(F.col("version") >= first)
    try:
        pages = spark.read.parquet(f"{output}/_pages").where(F.col("version") >= first)
    except AnalysisException as e:
        if not any(x in str(e.getCondition() or e) for x in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
            raise
        return spark.createDataFrame([], f"{pdf.PAGE_ROWS}, doc_id BIGINT, ocr_error STRING, version BIGINT")
    done = pages.join(known.select("version").distinct(), "version", "left_semi")  # a wave without manifest rows was broken off
    return done.join(manifest.superseded(known), [*manifest.KEY, "version"], "left_anti")
