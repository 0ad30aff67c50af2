"""How far a run is: counts that the plan itself gives, and logs."""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

log = logging.getLogger("docgrid")
#: What is counted while pages are written.
COUNTS = {"pages_done": "page_number > 0 and error is null", "pages_failed": "page_number > 0 and error is not null", "files_failed": "page_number = 0"}


@dataclass
class Progress:
    """Counts of the pages that a run has kept, wave by wave."""

    pages_done: int = 0
    pages_failed: int = 0
    files_failed: int = 0
    waves: int = 0
    began: float = field(default_factory=time.time)

    def write(self, pages: DataFrame, path: str) -> None:
        """Writes pages as Parquet and adds what was counted meanwhile: no second pass over them."""
        found = Observation(f"pages-{uuid.uuid4().hex}")
        pages.observe(found, *(F.count_if(F.expr(c)).alias(n) for n, c in COUNTS.items())).write.mode("overwrite").parquet(path)
        self.add(found.get)

    def add(self, counts: dict) -> None:
        for name in COUNTS:
            setattr(self, name, getattr(self, name) + int(counts.get(name) or 0))
        self.waves += 1
        seconds = max(time.time() - self.began, 1e-9)
        log.info("%d pages done, %d failed, %d files unreadable, %.1f pages a second", self.pages_done, self.pages_failed, self.files_failed, (self.pages_done + self.pages_failed) / seconds)


FILES = "docgrid_files"


def with_file_counts(files: DataFrame) -> DataFrame:
    """A stream of files (length), whose number and bytes are metrics of its micro-batches."""
    return files.observe(FILES, F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


class StreamProgress(StreamingQueryListener):
    """Adds up files and bytes of the micro-batches of streams made by :func:`with_file_counts`; add with ``spark.streams.addListener``."""

    def __init__(self) -> None:
        self.files = self.bytes = self.ended = 0
        self.batches: set[tuple] = set()

    def onQueryStarted(self, event) -> None:
        log.info("stream %s started", event.id)

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(FILES)
        if found is not None and (event.progress.runId, event.progress.batchId) not in self.batches:
            self.batches.add((event.progress.runId, event.progress.batchId))
            self.files += found["files"]
            self.bytes += found["bytes"]
            log.info("stream %s, batch %d: %d files, %d bytes so far", event.progress.id, event.progress.batchId, self.files, self.bytes)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended += 1


@contextmanager
def reported(what: str, log: logging.Logger = log) -> Iterator[Progress]:
    """Logs the start of some work and the time that it took; gives the counts that it is to fill."""
    found = Progress()
    log.info("%s: started", what)
    try:
        yield found
    finally:
        log.info("%s: %.1f seconds", what, time.time() - found.began)
