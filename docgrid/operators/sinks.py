"""Output files and result rows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_files(documents: DataFrame, root: str, overwrite: bool = True) -> None:
    """Writes ``path, content`` rows (text or bytes) under root, each file by one task: first under another name, then renamed.

    root is a folder that all executors share, or the address of a store that
    Arrow's file systems reach. A task that runs again writes the same files
    again. With overwrite off, files that exist stay.
    """

    def write(rows: Iterator) -> None:
        import os
        import posixpath
        import uuid

        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), os.path.abspath(root))
        base = posixpath.normpath(base)
        for r in rows:
            path = posixpath.normpath(posixpath.join(base, r.path.lstrip("/")))
            if not path.startswith(base + "/"):
                raise ValueError(f"outside the output folder: {r.path}")
            if not overwrite and files.get_file_info(path).type != fs.FileType.NotFound:
                continue
            files.create_dir(posixpath.dirname(path), recursive=True)
            part = f"{path}.{uuid.uuid4().hex}.part"
            with files.open_output_stream(part) as f:
                f.write(r.content.encode() if isinstance(r.content, str) else bytes(r.content))
            files.move(part, path)

    documents.select("path", "content").foreachPartition(write)


def has_space(spark: SparkSession, path: str, required_mb: int = 1000) -> bool:
    """Whether the file system of a path, which need not exist yet, has that much room; false if it can't be asked."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    try:
        files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        while not files.exists(at) and at.getParent() is not None:
            at = at.getParent()
        return files.getStatus(at).getRemaining() >= required_mb * 1024 * 1024
    except Exception:  # whatever the file system's client throws
        return False


def success_rate(processed="processed_pages", total="total_pages") -> Column:
    """Processed by total, 0 where total is 0; both are counts."""
    return F.coalesce(F.try_divide(F.col(processed).cast("double"), F.col(total)), F.lit(0.0))


def results(pages: DataFrame) -> DataFrame:
    """A row a file: pages in all, done and failed, success, first error."""
    ok = F.col("error").isNull() & (F.col("page_number") > 0)
    per = pages.groupBy("path").agg(F.count_if(F.col("page_number") > 0).alias("total_pages"), F.count_if(ok).alias("processed_pages"), F.count_if(~ok).alias("failed_pages"), F.min("error").alias("error"))
    return per.withColumn("success", F.col("failed_pages") == 0).withColumn("success_rate", success_rate())
