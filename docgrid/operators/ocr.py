"""When a page needs text recognition, and the interface of recognition engines."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import _c, is_blank, strip
from ..schemas import OCR_RESULT

LANGUAGES = ("en", "zh", "zh-CN", "zh-TW", "japan", "korean")


def needs_ocr(text="raw_text", has_images="has_images", image_ratio="image_area_ratio", typical_length: Column | int = 2000, min_chars: int = 100, min_ratio: float = 0.05, max_image_ratio: float = 0.8) -> Column:
    """Too little text, too little of the usual amount, or a page that is nearly all image."""
    t, usual = F.coalesce(_c(text), F.lit("")), typical_length if isinstance(typical_length, Column) else F.lit(typical_length)
    few = (t == "") | (F.length(strip(t)) < min_chars)
    little = F.coalesce((usual > 0) & (F.try_divide(F.length(strip(t)).cast("double"), usual) < min_ratio), F.lit(False))
    return few | little | (F.coalesce(_c(has_images), F.lit(False)) & (F.coalesce(_c(image_ratio), F.lit(0.0)) > max_image_ratio))


def confidence(text="text") -> Column:
    """A confidence from the text alone: 0 if empty, else half and shares for length, sentence ends and letters, 1 at most."""
    t = _c(text)
    parts = 0.5 + F.when(F.length(t) > 50, 0.2).otherwise(0.0) + F.when(t.contains(". ") | t.contains("！") | t.contains("。"), 0.2).otherwise(0.0)
    letters = F.regexp_count(t, F.lit(r"[\p{L}\p{N}]")) / F.length(t)
    return F.when(F.coalesce(t, F.lit("")) == "", 0.0).otherwise(F.least(F.lit(1.0), parts + letters * 0.1))


def detect_language(text="text") -> Column:
    """zh where more than 0.3 of the characters are Han, else en where more than half are Latin letters, else zh; empty for no text."""
    t = F.coalesce(_c(text), F.lit(""))
    n = F.length(t)
    han, latin = F.regexp_count(t, F.lit(r"[\x{4E00}-\x{9FFF}]")), F.regexp_count(t, F.lit("[A-Za-z]"))
    return F.when(n == 0, "").when(han / n > 0.3, "zh").when(latin / n > 0.5, "en").otherwise("zh")


def is_empty(text="text") -> Column:
    return is_blank(text)


class OcrEngine(Protocol):
    """What recognises an image: bytes to (text, confidence, language, boxes)."""

    def recognise(self, image: bytes) -> tuple[str, float, str, list]: ...


def recognised(pages: DataFrame, make_engine: Callable[[], OcrEngine], image: str = "image") -> DataFrame:
    """pages with ``ocr``, recognised where ``needs_ocr`` holds and there is an image, null elsewhere, and ``ocr_error``.

    The engine is made once a worker. A page that the engine fails on gets null
    and what went wrong. Only pages that need it reach Python.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        engine = make_engine()
        for b in batches:
            rows = []
            for data in b:
                try:
                    rows.append((*engine.recognise(bytes(data)), None))
                except Exception as e:
                    rows.append((None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["text", "confidence", "language", "boxes", "error"])

    need = F.col("needs_ocr") & F.col(image).isNotNull()
    found = OCR_RESULT[: OCR_RESULT.rindex(">")] + ", error: STRING>"
    got = pages.where(need).withColumn("_got", F.pandas_udf(run, found)(image))
    own = F.struct(*(F.col(f"_got.{c}").alias(c) for c in ("text", "confidence", "language", "boxes")))
    got = got.withColumn("ocr", F.when(F.col("_got.text").isNotNull(), own).cast(OCR_RESULT)).withColumn("ocr_error", F.col("_got.error")).drop("_got")
    others = pages.where(~F.coalesce(need, F.lit(False)))
    return got.unionByName(others.withColumn("ocr", F.lit(None).cast(OCR_RESULT)).withColumn("ocr_error", F.lit(None).cast("string")))
