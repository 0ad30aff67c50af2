"""WARC records and their fixity: Merkle trees over ordered offset ranges, compared from the root down."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved

#: Children of a tree node; a power of two of TIER bits.
FAN_OUT, TIER = 16, 4
#: Bits of Spark's row numbers that count rows within a partition.
ROW_BITS = 33
DATE = "2026-01-01T00:00:00Z"


def record(page_id: str = "page_id", url: str = "url", html: str = "html", date: str = DATE) -> Column:
    """A WARC/1.0 resource record as text: headers, an empty line, the body, two empty lines. Null url or html count as empty, a null id as ``-``."""
    body = F.coalesce(F.col(html), F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col(page_id).cast("string"), F.lit("-")),
        F.lit(">\r\nWARC-Date: "),
        F.lit(date),
        F.lit("\r\nWARC-Target-URI: "),
        F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"[\r\n]", ""),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def write_warc(pages: DataFrame, path: str) -> None:
    """Writes pages as WARC files, one a partition, records end to end; executors write them through Spark's own writer, whose line ends are the last two bytes of each record."""
    whole = record()
    pages.select(F.left(whole, F.length(whole) - 2).alias("value")).write.option("lineSep", "\r\n").text(path)


def parse_records(data: bytes) -> Iterator[tuple[int, int, dict, bytes, str | None]]:
    """(offset, length, headers in lower case, body, error) of each record of a WARC file.

    A record that is malformed or broken off has an error and no body; it goes
    up to the next line that begins a record, where reading goes on.
    """
    at = 0
    while at < len(data):
        if data[at : at + 1] in (b"\r", b"\n"):
            at += 1
            continue
        end = data.find(b"\r\n\r\n", at)
        head, error = {}, None
        if not data.startswith(b"WARC/", at):
            error = "no record begins here"
        elif end < 0:
            error = "headers are broken off"
        else:
            lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
            head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            size = head.get("content-length", "")
            if not (size.isascii() and size.isdigit()):
                error = "no content length"
            elif end + 4 + int(size) > len(data):
                error = "body is broken off"
            elif data[end + 4 + int(size) : end + 8 + int(size)] not in (b"\r\n\r\n", b""):
                error = "content length is wrong"
        if error:
            following = data.find(b"\nWARC/", at)
            stop = len(data) if following < 0 else following + 1
            yield at, stop - at, head, b"", error
        else:
            start, stop = end + 4, end + 4 + int(head["content-length"])
            body = data[start:stop]
            stop = min(len(data), stop + 4)
            yield at, stop - at, head, body, None
        at = stop


def read_warc(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``file, offset, length, record_id, url, body, error`` of all records of the WARC files at a path; what is no whole record is a row with an error and no body."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"]):
                rows = [(name, offset, length, head.get("warc-record-id"), head.get("warc-target-uri"), None if error else body, error) for offset, length, head, body, error in parse_records(bytes(data))]
                yield pd.DataFrame(rows, columns=["file", "offset", "length", "record_id", "url", "body", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInPandas(read, "file string, offset long, length long, record_id string, url string, body binary, error string")


def laid_out(pages: DataFrame) -> DataFrame:
    """pages with ``leaf``: the number of a page's record in an archive of one file a partition, files one after the other.

    Leaves of a file begin at a multiple of a power of FAN_OUT that holds the
    largest file, so that a file is a branch of the tree.
    """
    n = F.monotonically_increasing_id()
    most = pages.select(n.alias("n")).agg(F.max(F.col("n").bitwiseAND((1 << ROW_BITS) - 1))).first()[0] or 0
    bits = -(-most.bit_length() // TIER) * TIER
    numbered = pages.withColumn("leaf", n)
    return numbered.withColumn("leaf", F.shiftleft(F.shiftright("leaf", ROW_BITS), bits) + F.col("leaf").bitwiseAND((1 << ROW_BITS) - 1)).withColumn("file", F.spark_partition_id())


def index(pages: DataFrame) -> DataFrame:
    """The index of one replica: ``page_id, leaf, file, offset, length, digest``, a row a record.

    pages: rows of :func:`laid_out`, as this replica has them; some may be
    missing or changed.  A file's records lie end to end by leaf, offset is a
    record's first byte in its file, digest its SHA-256.  Repeated pages are a
    record each.
    """
    whole = record()
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "leaf", "file", F.octet_length(whole).cast("long").alias("length"), F.sha2(whole.cast("binary"), 256).alias("digest"))
    w = Window.partitionBy("file").orderBy("leaf").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return saved(rows.withColumn("offset", F.sum("length").over(w) - F.col("length")).select("page_id", "leaf", "file", "offset", "length", "digest"), "index")


def tree(leaves: DataFrame, top: int) -> list[DataFrame]:
    """Levels of a Merkle tree, leaves first and the root last: ``node, first, last, digest``.

    leaves: ``node long, first long, last long, digest string``, first and last
    being offsets; top: the largest leaf number of any replica.  A parent's
    digest is that of its children's numbers, offset ranges and digests in order;
    FAN_OUT children at most meet in one row.
    """
    levels = [leaves.select("node", "first", "last", "digest")]
    while top:
        top //= FAN_OUT
        part = F.array_sort(F.collect_list(F.struct("node", "first", "last", "digest")))
        up = levels[-1].groupBy(F.shiftright("node", TIER).alias("up")).agg(part.alias("c"))
        said = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["node"].cast("string"), x["first"].cast("string"), x["last"].cast("string"), x["digest"])), ",")
        up = up.select(F.col("up").alias("node"), F.array_min("c.first").alias("first"), F.array_max("c.last").alias("last"), F.sha2(said.cast("binary"), 256).alias("digest"))
        levels.append(saved(up, "level"))
    return levels


def damaged(left: list[DataFrame], right: list[DataFrame]) -> DataFrame:
    """Leaves whose records differ between two replicas' trees: ``node, first, last, digest, other_digest``.

    Equal roots end the audit; else each level is looked at below the
    mismatching nodes of the level above only.  A leaf that one side lacks has a
    null digest there.  A record that only lies elsewhere makes the nodes above
    it differ, but isn't damaged itself.
    """
    bad = None
    for a, b in reversed(list(zip(left, right))):
        if bad is not None:
            below = F.shiftright("node", TIER)
            some = bad.select(F.col("node").alias("up"))
            a, b = (x.join(some, below == F.col("up"), "left_semi") for x in (a, b))
        other = b.select("node", F.col("first").alias("f"), F.col("last").alias("l"), F.col("digest").alias("other_digest"))
        bad = a.join(other, "node", "full").where(~F.col("digest").eqNullSafe(F.col("other_digest")))
        bad = saved(bad.select("node", F.coalesce("first", "f").alias("first"), F.coalesce("last", "l").alias("last"), "digest", "other_digest"), "mismatch")
        if bad.isEmpty():
            break
    return bad


def audit(archive: DataFrame, replica: DataFrame) -> DataFrame:
    """A row a record of two replicas' indexes: ``page_id, leaf, offset, length, digest, damaged``.

    Each replica's tree is built from its own offsets, lengths and digests; the
    trees are descended from their roots.  damaged says that the replica's
    record differs or is missing.  A record that only the replica has comes with
    a null page_id and digest, and is damaged.  Empty archives give no rows.
    """
    top = archive.select("leaf").unionByName(replica.select("leaf")).agg(F.max("leaf")).first()[0] or 0
    side = lambda own: own.select(F.col("leaf").alias("node"), F.col("offset").alias("first"), (F.col("offset") + F.col("length")).alias("last"), "digest")
    bad = damaged(tree(side(archive), top), tree(side(replica), top))
    found = bad.select(F.col("node").alias("leaf"), "first", "last", F.lit(True).alias("found"))
    both = archive.join(found, "leaf", "full")
    return both.select("page_id", "leaf", F.coalesce("offset", "first").alias("offset"), F.coalesce("length", F.col("last") - F.col("first")).alias("length"), "digest", F.coalesce("found", F.lit(False)).alias("damaged"))
