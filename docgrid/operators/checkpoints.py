"""A file's progress as JSON: one checkpoint file for each, written from the manifest and read back, damaged ones told apart."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import _c
from . import sinks

SUFFIX, VERSION = ".checkpoint.json", "1.0"
#: What a checkpoint file holds.
CHECKPOINT = "file_hash STRING, total_pages INT, processed_pages ARRAY<INT>, failed_pages ARRAY<INT>, timestamp TIMESTAMP, version STRING"


def as_json(sha256="sha256", total="total_pages", processed="processed_pages", failed="failed_pages", timestamp="timestamp") -> Column:
    """A checkpoint's text; null lists are empty."""
    none = F.array().cast("array<int>")
    return F.to_json(F.struct(
        _c(sha256).alias("file_hash"), _c(total).cast("int").alias("total_pages"), F.coalesce(_c(processed).cast("array<int>"), none).alias("processed_pages"),
        F.coalesce(_c(failed).cast("array<int>"), none).alias("failed_pages"), _c(timestamp).alias("timestamp"), F.lit(VERSION).alias("version"),
    ))


def parsed(text="text") -> Column:
    """A checkpoint's fields and ``damaged``: the whole text where it is no checkpoint, null where it is one.

    A text that isn't JSON, lacks a field or has one of another kind is damaged.
    """
    found = F.from_json(_c(text), f"{CHECKPOINT}, _damaged STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_damaged"})
    names = [x.split(" ")[0] for x in CHECKPOINT.split(", ")]
    lacking = F.reduce(F.array(*(found[n].isNull() for n in names if n != "timestamp")), F.lit(False), lambda a, b: a | b)
    bad = found.isNull() | found["_damaged"].isNotNull() | lacking
    return F.struct(*(F.when(~F.coalesce(bad, F.lit(True)), found[n]).alias(n) for n in names), F.when(F.coalesce(bad, F.lit(True)), F.coalesce(_c(text), F.lit(""))).alias("damaged"))


def write(progress: DataFrame, folder: str) -> None:
    """Writes :func:`docgrid.operators.manifest.progress` rows as checkpoint files under folder, named after the files."""
    name = F.concat(F.element_at(F.split("path", "/"), -1), F.lit(SUFFIX))
    sinks.write_files(progress.select(name.alias("path"), as_json().alias("content")), folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``name`` of the file that a checkpoint in folder is of, its fields, and ``damaged``; none for a missing folder, and no row for a file without a byte, which is as if it weren't there."""
    try:
        found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition() or e):
            raise
        return spark.createDataFrame([], f"name STRING, {CHECKPOINT}, damaged STRING")
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.checkpoint\.json$", "")
    return found.select(name.alias("name"), parsed(F.col("content").cast("string")).alias("c")).select("name", "c.*")


def valid(checkpoints: DataFrame, files: DataFrame) -> DataFrame:
    """Checkpoints that can be resumed from: whole, and of files (path, sha256) whose digest hasn't changed; with the files' paths."""
    known = files.select("path", "sha256", F.element_at(F.split("path", "/"), -1).alias("name"))
    found = checkpoints.where("damaged is null").join(known, "name")
    return found.where(F.col("file_hash") == F.col("sha256")).drop("file_hash", "name", "damaged")
