"""Command line: ``python -m docgrid.cli SOURCE --output DIR``."""

from __future__ import annotations

import argparse
import logging
from importlib import import_module

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.sinks import has_space
from .plans.convert import RECOGNITION, Options, convert
from .plans.progress import reported

log = logging.getLogger("docgrid")


def main(argv: list[str] | None = None) -> int:
    """Converts and prints totals; 1 if a file failed."""
    p = argparse.ArgumentParser(prog="docgrid", description="Convert PDF files to Markdown.")
    p.add_argument("source", help="a PDF file or a directory of PDF files")
    p.add_argument("--output", required=True, help="folder for the results")
    p.add_argument("--resume", action="store_true", help="leave files alone that were converted whole and haven't changed")
    p.add_argument("--boundary-page-only", action="store_true", help="chapter files hold the chapter's first page only")
    p.add_argument("--no-images", action="store_true", help="leave images out of the results")
    p.add_argument("--no-tables", action="store_true", help="leave tables out of the results")
    p.add_argument("--pages-a-wave", type=int, help="pages of each file that are read and kept at a time, so that a run that breaks off inside long files can be resumed there")
    p.add_argument("--engine", help="module:function that makes a text recognition engine; without one no page is recognised")
    p.add_argument("--ocr-mode", choices=RECOGNITION, default="auto", help="which pages are recognised")
    p.add_argument("--ocr-min-chars", type=int, default=100, help="pages with fewer characters are recognised")
    p.add_argument("--ocr-min-ratio", type=float, default=0.05, help="pages with less of the usual text are recognised")
    p.add_argument("--ocr-image-ratio", type=float, default=0.8, help="pages with a larger share of images are recognised")
    p.add_argument("--min-heading-size", type=float, default=14.0, help="least font size of headings in summaries")
    p.add_argument("--required-mb", type=int, default=1000, help="free space without which nothing is done")
    p.add_argument("--verbose", action="store_true")
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if a.verbose else logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    spark = SparkSession.builder.appName("docgrid").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if not has_space(spark, a.output, a.required_mb):
        log.error("less than %d MB are free at %s", a.required_mb, a.output)
        return 1
    module, _, name = (a.engine or "").partition(":")
    options = Options(
        whole_chapters=not a.boundary_page_only, include_images=not a.no_images, include_tables=not a.no_tables, make_engine=getattr(import_module(module), name) if a.engine else None, recognition=a.ocr_mode,
        ocr={"min_chars": a.ocr_min_chars, "min_ratio": a.ocr_min_ratio, "max_image_ratio": a.ocr_image_ratio}, summary={"min_font_size": a.min_heading_size}, pages_a_wave=a.pages_a_wave,
    )
    with reported(f"conversion of {a.source}", log) as progress:
        rows = convert(spark, a.source, a.output, a.resume, options, progress)
    n = rows.agg(F.count("*").alias("files"), F.count_if("success").alias("good"), F.coalesce(F.sum("processed_pages"), F.lit(0)).alias("pages")).first()
    log.info("%d files, %d without errors, %d pages", n.files, n.good, n.pages)
    return int(n.good < n.files)


if __name__ == "__main__":
    raise SystemExit(main())
