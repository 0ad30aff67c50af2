"""New files as a stream: each micro-batch is converted once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import manifest
from ..plans.progress import Progress, with_file_counts
from ..sources import files as file_source
from ..sources import pdf

_FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, directory: str, tables: str, checkpoint: str, max_files: int = 1000, available_now: bool = True, progress: Progress | None = None) -> StreamingQuery:
    """Reads pages of PDF files as they appear in a directory and appends them under ``tables/pages``, with a manifest beside.

    The stream's checkpoint knows the paths that it has read, so each comes
    once, touched or written anew, and no batch looks into the manifest, however
    long that grows. Pages and manifest rows are kept by batch number, and a
    batch that runs again replaces its own, so it adds nothing twice and loses
    nothing, wherever it was broken off. tables belong to one checkpoint: with
    another one, which would know nothing of them, this raises an error. At most
    max_files files make a batch. Files and bytes are metrics of the stream, for
    :class:`docgrid.plans.progress.StreamProgress`; ``progress`` gets the counts
    of pages.
    """
    counts = progress or Progress()
    if not _exists(spark, checkpoint) and _exists(spark, f"{tables}/manifest"):
        raise ValueError(f"{tables} were written with another checkpoint than {checkpoint}")

    def batch(rows: DataFrame, number: int) -> None:
        s = rows.sparkSession
        pages = pdf.with_doc_ids(pdf.read_pages(rows.where(file_source.is_valid()).withColumn("sha256", file_source.sha256())))
        counts.write(pages, f"{tables}/pages/batch={number}")
        kept = s.read.schema(pages.schema).parquet(f"{tables}/pages/batch={number}")
        manifest.write(manifest.rows(kept), f"{tables}/manifest", number)

    stream = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*.pdf").option("maxFilesPerTrigger", max_files).load(directory)
    writer = with_file_counts(stream).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
