"""Ranked lexical search: a join of items and documents on terms, seeded with thresholds from each term's stored best impacts."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import among, dropped, frugal, keyed, saved, small_batches
from .divergence import _separators

#: Terms are runs of ASCII letters and digits and of characters past ASCII.
TABLE = _separators(b"0123456789abcdefghijklmnopqrstuvwxyz")
#: Bits of the map of wanted terms, which is sent to all tasks: 2 MB at any size; more terms only let more through.
MAP_BITS = 1 << 24
#: Bytes of items' terms up to which they are sent to all tasks instead of being joined by a shuffle, and what a row counts besides its term.
SENT_BYTES, ROW_BYTES = 16 << 20, 64


def terms_of(text: str) -> list[bytes]:
    """The terms of a whole text in order, in UTF-8, only A-Z in small letters."""
    return text.encode().translate(TABLE).split()


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_no, item_id, term, times``: the different terms of each item; a row is an item of its own, whatever its id; null texts have none."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [Counter(terms_of(text)) for text in b["text"]]
            out = b.drop(columns="text").loc[b.index.repeat([len(f) for f in found])].reset_index(drop=True)
            if len(out):
                yield out.assign(term=[t.decode() for f in found for t in f], times=[n for f in found for n in f.values()])

    numbered = saved(keyed(items, id_col, text_col).withColumn("item_no", F.monotonically_increasing_id()), "items")
    rows = numbered.mapInPandas(split, "doc_id long, no_id boolean, item_no long, term string, times long")
    return rows.select("item_no", F.when(~F.col("no_id"), F.col("doc_id")).alias("item_id"), "term", "times")


def _map_of(terms: DataFrame) -> np.ndarray:
    """A bitmap of the checksums of terms, put together by the executors."""
    p = F.crc32("term").bitwiseAND(MAP_BITS - 1)
    words = terms.select(p.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("m"))
    found, bits = words.toArrow(), np.zeros(MAP_BITS // 64, dtype=np.uint64)
    bits[found["w"].to_numpy()] = found["m"].to_numpy().view(np.uint64)
    return bits


def index(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_no, doc_id, n, terms array, tfs array``: of each document the number of its terms, and those that may be among wanted (``term``) with their counts.

    A row is a document of its own, whatever its id; null texts have no terms.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(_map_of(wanted).view(np.uint8).tobytes())

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, mask, crc = sent.value, MAP_BITS - 1, zlib.crc32
        for b in batches:
            n, terms, tfs = [], [], []
            for text in b["text"]:
                words = terms_of(text)
                n.append(len(words))
                own, counts = [], []
                for t, k in Counter(words).items():
                    c = crc(t) & mask
                    if held[c >> 3] >> (c & 7) & 1:
                        own.append(t.decode())
                        counts.append(k)
                terms.append(own)
                tfs.append(counts)
            yield pd.DataFrame({"doc_id": b["doc_id"], "no_id": b["no_id"], "n": n, "terms": terms, "tfs": tfs})

    rows = keyed(docs, id_col, text_col).mapInPandas(frugal(read), "doc_id long, no_id boolean, n long, terms array<string>, tfs array<long>")
    return rows.select(F.monotonically_increasing_id().alias("doc_no"), F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "n", "terms", "tfs")


def gain(total_docs: int, total_terms: int, tf: str = "tf", n: str = "n") -> Column:
    """(10^9 * tf) div (1000 * tf + 12 * m) with m = 100 - 25 + ((25 * n * total_docs) div total_terms), in 64-bit whole numbers."""
    return F.expr(f"(1000000000L * {tf}) div (1000L * {tf} + 12L * (75L + (25L * {n} * {total_docs}L) div {max(total_terms, 1)}L))")


def sent_if_small(rows: DataFrame) -> DataFrame:
    """rows (with ``term``), marked to be sent to all tasks if a count of their bytes allows it."""
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    return F.broadcast(rows) if n * ROW_BYTES + size <= SENT_BYTES else rows


def _best(rows: DataFrame, by: str, value: str, k: int) -> DataFrame:
    """The k rows of each key with the highest values; tasks leave out what k of their own rows of the key surpass before anything is shuffled."""
    w = Window.partitionBy(by).orderBy(F.desc(value), "doc_no")
    return rows.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= k).drop("_place")


def _kth(rows: DataFrame, by: str, value: str, k: int) -> DataFrame:
    """Of :func:`_best` rows the k-th value of each key that has k."""
    return rows.groupBy(by).agg(F.min(value).alias("kth"), F.count("*").alias("n")).where(F.col("n") >= k).select(by, "kth")


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Each item's k best documents with a score above 0: ``item_id, rank, doc_id, score``.

    A score sums w * gain over the item's terms, repeats included, w being
    floor(1000 * ln((2 * N + 2) / (2 * df + 1))); N, L and df count over whole
    texts of all documents.  Equal scores go by rising doc_id, null ids last, and
    then as read, so ranks are unique.

    1. One pass over the documents keeps the counts of items' terms.
    2. Each term stores its k best gains and their documents.
    3. An item's k-th score is at least the k-th impact of any of its terms, and
       at least the k-th sum of its terms' stored impacts by document: its
       threshold.
    4. Its terms in order of rising df: those from which on the best impacts
       sum to less than the threshold (suffix bounds) bring no document in.
    5. The other terms' documents are joined and their impacts summed; those
       that reach neither the threshold nor the k-th of these sums with all that
       the left-out terms could add are dropped.
    6. What is left is scored anew over all terms.

    Null and empty texts have no terms, so such items have no rows and such
    documents never appear; repeated rows are documents and items of their own;
    empty tables give no rows.  Frequent terms are counted and cut to k rows in
    each task before a shuffle; items' terms are sent to all tasks only if they
    are small, and joined by shuffle otherwise.
    """
    wanted = saved(item_terms(items, item_col, text_col), "wanted")
    table = saved(index(docs, wanted, id_col, text_col), "index")
    total_docs, total_terms = table.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    own = sent_if_small(wanted.select("term").distinct())
    postings = table.select("doc_no", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("e")).select("doc_no", F.col("e.terms").alias("term"), "n", F.col("e.tfs").alias("tf"))
    postings = postings.select("doc_no", "term", gain(total_docs, total_terms).alias("gain"))
    postings, whole = postings.join(own, "term", "left_semi"), postings
    best = saved(_best(postings, "term", "gain", k), "best")
    kth = _kth(best, "term", "gain", k)
    df = postings.groupBy("term").agg(F.count("*").alias("df"), F.max("gain").alias("most"))
    w = F.floor(1000 * F.log((2 * F.lit(total_docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    terms = df.join(kth, "term", "left").select("term", "df", w.alias("w"), "most", F.coalesce("kth", F.lit(0)).alias("kth"))
    wanted_terms = wanted.join(terms, "term").select("item_no", "item_id", "term", "df", (F.col("w") * F.col("times")).alias("weight"), "most", "kth")
    wanted_terms = saved(wanted_terms, "weights")

    sums = best.join(sent_if_small(wanted_terms.select("item_no", "term", "weight")), "term").groupBy("item_no", "doc_no").agg(F.sum(F.col("weight") * F.col("gain")).alias("sum"))
    seeds = _kth(_best(sums, "item_no", "sum", k), "item_no", "sum", k)
    single = wanted_terms.groupBy("item_no").agg(F.max(F.col("weight") * F.col("kth")).alias("single"))
    floors = single.join(seeds, "item_no", "left").select("item_no", F.greatest("single", F.coalesce("kth", F.lit(0)), F.lit(1)).alias("floor"))
    after = Window.partitionBy("item_no").orderBy("df", "term").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    bounded = wanted_terms.join(floors, "item_no").withColumn("suffix", F.sum(F.col("weight") * F.col("most")).over(after))
    bounded = saved(bounded, "bounds")
    limits = bounded.groupBy("item_no").agg(F.max("floor").alias("floor"), F.coalesce(F.max(F.when(F.col("suffix") < F.col("floor"), F.col("suffix"))), F.lit(0)).alias("rest"))

    leading = sent_if_small(bounded.where("suffix >= floor").select("item_no", "term", "weight"))
    found = whole.join(leading, "term").groupBy("item_no", "doc_no").agg(F.sum(F.col("weight") * F.col("gain")).alias("sum"))
    found = saved(found.join(F.broadcast(limits) if limits.count() * ROW_BYTES <= SENT_BYTES else limits, "item_no").where("sum + rest >= floor").select("item_no", "doc_no", "sum", "rest"), "candidates")
    higher = _kth(_best(found, "item_no", "sum", k), "item_no", "sum", k)
    left = saved(found.join(higher, "item_no", "left").where("kth is null or sum + rest >= kth").select("item_no", "doc_no"), "left")
    dropped(best, found)

    some = among(table.withColumn("_hash", F.xxhash64("doc_no")), "_hash", left.select(F.xxhash64("doc_no").alias("h"))).drop("_hash")
    pairs = left.join(some, "doc_no").select("item_no", "doc_no", "doc_id", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("e"))
    pairs = pairs.select("item_no", "doc_no", "doc_id", F.col("e.terms").alias("term"), "n", F.col("e.tfs").alias("tf")).withColumn("gain", gain(total_docs, total_terms))
    scored = pairs.join(sent_if_small(wanted_terms.select("item_no", "item_id", "term", "weight")), ["item_no", "term"])
    scored = scored.groupBy("item_no", "doc_no").agg(F.first("item_id").alias("item_id"), F.first("doc_id").alias("doc_id"), F.sum(F.col("weight") * F.col("gain")).alias("score"))
    place = Window.partitionBy("item_no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "doc_no")
    return scored.where("score > 0").withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
