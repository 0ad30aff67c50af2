"""Images of pages: names, crop boxes, matching with extracted objects, pixels through an optional library."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import _c
from .elements import PAGE
from .layout import resized


def filename(page="page_number", number="image_no", format="format") -> Column:
    """``page_p_image_i.ext`` counting images from 1; jpeg is written jpg."""
    ext = F.when(F.lower(_c(format)) == "jpeg", "jpg").otherwise(F.lower(_c(format)))
    return F.concat(F.lit("page_"), _c(page).cast("string"), F.lit("_image_"), (_c(number) + 1).cast("string"), F.lit("."), ext)


def base_name(path="path") -> Column:
    return F.substring_index(_c(path), "/", -1)


def asset_path(path="path") -> Column:
    return F.concat(F.lit("assets/"), base_name(path))


def crop_box(page_width: Column, page_height: Column, pixel_width: Column, pixel_height: Column) -> Column:
    """struct(left, upper, right, lower) in pixels of a box in page units, cut off to whole pixels and to the picture; null if nothing is left."""
    sx, sy = pixel_width / page_width, pixel_height / page_height
    place = lambda c, s, top: F.greatest(F.lit(0), F.least((F.col(c) * s).cast("int"), top.cast("int")))
    box = F.struct(place("x0", sx, pixel_width).alias("left"), place("y0", sy, pixel_height).alias("upper"), place("x1", sx, pixel_width).alias("right"), place("y1", sy, pixel_height).alias("lower"))
    return F.when((box["right"] > box["left"]) & (box["lower"] > box["upper"]), box)


def matched(page_images: DataFrame, objects: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Each page image with the embedded object (doc_id, page_number, object_no, x0, y0) whose corner is nearer than `tolerance`, or else the page's first object; null where the page has none."""
    o = objects.select(*PAGE, "object_no", F.col("x0").alias("ox"), F.col("y0").alias("oy"))
    near = (F.abs(F.col("x0") - F.col("ox")) < tolerance) & (F.abs(F.col("y0") - F.col("oy")) < tolerance)
    w = Window.partitionBy(*PAGE, "image_no").orderBy(F.desc("near"), "object_no")
    both = page_images.join(o, PAGE, "left").withColumn("near", F.coalesce(near, F.lit(False))).withColumn("k", F.row_number().over(w))
    return both.where("k = 1").select(*page_images.columns, "object_no", "near")


def recognition_size(max_dimension: int = 2000) -> Column:
    """struct(width, height) in which an image goes to recognition: its longer side at most max_dimension, whole numbers."""
    w, h = _c("width"), _c("height")
    ratio = F.lit(max_dimension) / F.greatest(w, h)
    large = F.greatest(w, h) > max_dimension
    side = lambda c, name: F.when(large, F.floor(c * ratio)).otherwise(c).cast("int").alias(name)
    return F.struct(side(w, "width"), side(h, "height"))


def for_recognition(images: DataFrame, max_dimension: int = 2000, contrast: float = 1.2) -> DataFrame:
    """images (width, height, data) as recognition takes them: in three colours, no larger than max_dimension, with more contrast, as PNG; as they are where the pixel library is missing or can't read them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        try:
            from PIL import Image, ImageEnhance
        except ImportError:
            Image = None
        for b in batches:
            out = []
            for data, w, h in zip(b["data"], b["w"], b["h"]):
                try:
                    picture = Image.open(io.BytesIO(bytes(data))).convert("RGB")
                    picture = picture if picture.size == (w, h) else picture.resize((int(w), int(h)))
                    to = io.BytesIO()
                    ImageEnhance.Contrast(picture).enhance(contrast).save(to, "PNG")
                    out.append(to.getvalue())
                except Exception:
                    out.append(data)
            yield pd.Series(out)

    size = recognition_size(max_dimension)
    return images.withColumn("data", F.pandas_udf(run, "binary")(F.struct(F.col("data"), size["width"].alias("w"), size["height"].alias("h"))))


def optimised(images: DataFrame, max_width: int = 1920, quality: int = 85, format: str = "png") -> DataFrame:
    """images (width, height, data) scaled down to max_width and encoded anew where the pixel library is installed; data that it can't read stays as it is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        try:
            from PIL import Image
        except ImportError:
            Image = None
        for b in batches:
            out = []
            for data, w, h in zip(b["data"], b["w"], b["h"]):
                try:
                    picture = Image.open(io.BytesIO(bytes(data)))
                    picture = picture.resize((int(w), int(h))) if picture.width > w else picture
                    picture = picture.convert("RGB") if format in ("jpeg", "jpg") or picture.mode not in ("RGB", "RGBA", "L") else picture
                    to = io.BytesIO()
                    picture.save(to, format.upper(), **({"quality": quality} if format in ("jpeg", "webp") else {}))
                    out.append(to.getvalue())
                except Exception:
                    out.append(data)
            yield pd.Series(out)

    size = resized(max_width)
    new = F.pandas_udf(run, "binary")(F.struct(F.col("data"), size["width"].alias("w"), size["height"].alias("h")))
    return images.withColumn("data", new).withColumn("_size", size).withColumn("width", F.col("_size.width")).withColumn("height", F.col("_size.height")).drop("_size")


def output_files(images: DataFrame) -> DataFrame:
    """``doc_id, path, content`` of images that have data, under assets/."""
    return images.where("data is not null").select("doc_id", F.concat(F.lit("assets/"), filename()).alias("path"), F.col("data").alias("content"))
