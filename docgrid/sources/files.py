"""Files as rows: listing, validation, digests."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import _c, stem

MAX_SIZE_MB = 200
_EMPTY = "path string, modificationTime timestamp, length long, content binary"


def scan_directory(spark: SparkSession, directory: str, with_content: bool = False) -> DataFrame:
    """The ``*.pdf`` files right in a directory (suffix in small letters); none for a missing directory.

    Contents are read only where they are asked for; the list is by path without
    them, and in no order with them, since bytes aren't shuffled for its sake.
    """
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "false").load(directory)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition() or e):
            raise
        files = spark.createDataFrame([], _EMPTY)
    columns = ["path", "length", "modificationTime", *(["content"] if with_content else [])]
    return files.select(*columns) if with_content else files.select(*columns).orderBy("path")


def is_valid(path="path", length="length", max_size_mb: int = MAX_SIZE_MB) -> Column:
    """A PDF by its suffix, in letters of any case, and no larger than max_size_mb."""
    return F.lower(_c(path)).endswith(".pdf") & (_c(length) <= max_size_mb * 1024 * 1024)


def sha256(content="content") -> Column:
    return F.sha2(_c(content), 256)


def output_dir(path="path", base: str | None = None) -> Column:
    """Where a file's output goes: a folder of its own under base, or beside the file with ``_md`` after its stem."""
    folder = F.regexp_replace(_c(path), r"/[^/]*$", "")
    return F.concat(F.lit(base) if base else folder, F.lit("/"), stem(path), F.lit("" if base else "_md"))


def single_output_path(path, directory: str) -> Column:
    return F.concat(F.lit(directory.rstrip("/") + "/"), stem(path), F.lit(".md"))
