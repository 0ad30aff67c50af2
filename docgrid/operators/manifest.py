"""The manifest: a row for each version of a page, the newest of which counts; by it a run is resumed, page by page."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.materialise import materialised
from ..schemas import MANIFEST

FILE = ["path", "sha256"]
KEY = [*FILE, "page_number"]


def rows(pages: DataFrame) -> DataFrame:
    """Manifest rows, without a version, of pages that were tried: path, sha256, page_number, total_pages, error.

    A page with an error failed. Page 0 stands for a file that can't be read, which has no pages.
    """
    return pages.select(*KEY, F.col("total_pages").cast("int").alias("total_pages"), "error", F.current_timestamp().alias("timestamp"))


def read(spark: SparkSession, path: str, without: int | None = None) -> DataFrame:
    """All manifest rows, or those of other versions only; none if nothing has been written yet."""
    try:
        found = spark.read.schema(MANIFEST).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition() or e):
            raise
        return spark.createDataFrame([], MANIFEST)
    return found if without is None else found.where(F.col("version") != without)


def write(found: DataFrame, path: str, version: int) -> None:
    """Puts rows of one version in place of those that the version may have written before; other versions stay."""
    found.withColumn("version", F.lit(version).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def next_version(spark: SparkSession, path: str) -> int:
    return read(spark, path).agg(F.coalesce(F.max("version") + 1, F.lit(0))).first()[0]


def remove(spark: SparkSession, path: str) -> bool:
    """Deletes a manifest, so that the next run does everything anew; whether there was one."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True))


def newest(manifest: DataFrame) -> DataFrame:
    """The newest row of each page of each path and digest."""
    rest = [c for c in manifest.columns if c not in KEY]
    found = manifest.groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.struct("version", "timestamp")).alias("r"))
    return found.select(*KEY, *(F.col(f"r.{c}").alias(c) for c in rest))


def merge(spark: SparkSession, path: str) -> None:
    """Brings a manifest down to the newest row of each page, under its last version; older versions are deleted after that has been written, so a crash in between loses nothing."""
    found = read(spark, path)
    versions = sorted(r.version for r in found.select("version").distinct().collect())
    if len(versions) < 2:
        return
    write(materialised(newest(found).drop("version"), "manifest"), path, versions[-1])
    for v in versions[:-1]:
        remove(spark, f"{path}/version={v}")


def progress(manifest: DataFrame) -> DataFrame:
    """A row for each path and digest: total_pages, processed_pages and failed_pages by the newest version of each page, timestamp of the newest."""
    number = lambda ok: F.array_sort(F.collect_list(F.when((F.col("page_number") > 0) & (F.col("error").isNull() == ok), F.col("page_number"))))
    return newest(manifest).groupBy(*FILE).agg(F.max("total_pages").alias("total_pages"), number(True).alias("processed_pages"), number(False).alias("failed_pages"), F.max("timestamp").alias("timestamp"))


def known_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Progress of the files that are unchanged: path and digest agree."""
    return progress(manifest).join(files.select(*FILE).distinct(), FILE, "left_semi")


def is_whole(total="total_pages", processed="processed_pages"):
    """Whether all pages of a file that has pages are done."""
    return (F.col(total) > 0) & (F.size(processed) == F.col(total))


def pending_pages(pages: DataFrame, manifest: DataFrame) -> DataFrame:
    """Pages (path, sha256, page_number) that aren't done: never tried, or failed the last time."""
    return pages.join(newest(manifest).where("error is null").select(*KEY), KEY, "left_anti")


def failed_pages(pages: DataFrame, manifest: DataFrame) -> DataFrame:
    """Pages that failed the last time they were tried."""
    return pages.join(newest(manifest).where("error is not null").select(*KEY), KEY, "left_semi")


def superseded(manifest: DataFrame) -> DataFrame:
    """path, sha256, page_number, version of the rows that a newer version of their page replaces."""
    newer = F.max("version").over(Window.partitionBy(*KEY))
    return manifest.withColumn("_newest", newer).where(F.col("version") < F.col("_newest")).select(*KEY, "version")
