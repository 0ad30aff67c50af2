"""How far a language's sources differ in their words: counts by an integer dictionary of sorted kept terms, divergences from dense chunk vectors."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, frugal, saved, small_batches, spread_join

#: Documents of a language that a kept term occurs in at least, and terms reported for a group.
LEAST_DOCS, TOP = 10, 10
#: Each probability is a whole number of this many parts.
SCALE = 1_000_000_000
#: Different terms that a task counts before it hands its counts on.
HELD_TERMS = 1 << 18
#: Occurrences that a task holds as numbers before it counts them.
HELD_IDS = 1 << 22
#: Kept terms, and their bytes, up to which the dictionary is sent to all tasks; a larger one is joined.
SENT_TERMS, SENT_BYTES = 1 << 19, 16 << 20
#: Terms of a chunk at most, and numbers that its vectors hold at most: with many sources a chunk has fewer terms.
CHUNK_TERMS, CHUNK_CELLS = 4096, 1 << 20


def _separators(terms: bytes) -> bytes:
    """A table for bytes.translate: A-Z become small, bytes outside `terms` spaces; bytes of characters past ASCII stay."""
    kept = {*terms, *range(128, 256)}
    return bytes((b + 32 if 65 <= b <= 90 else b) if b in kept or 65 <= b <= 90 else 32 for b in range(256))


#: Terms are runs of ASCII letters and of characters past ASCII.
TABLE = _separators(b"abcdefghijklmnopqrstuvwxyz")


def terms_of(text: str) -> list[bytes]:
    """The terms of a whole text in order, in UTF-8, only A-Z in small letters."""
    return text.encode().translate(TABLE).split()


def _rows(docs: DataFrame) -> DataFrame:
    """lang, source, text; nulls are empty."""
    small_batches(docs.sparkSession)
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def kept_terms(rows: DataFrame, least: int) -> DataFrame:
    """``lang, term, id``: the terms that `least` documents of a language have or more, numbered from 0 in UTF-8 order.

    Tasks count documents by language and term before the shuffle.  The terms
    are sorted by ranges; a range numbers its own, from what the ranges before
    it hold of the language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        size = 0

        def taken() -> Iterator[pa.RecordBatch]:
            for lang, own in held.items():
                terms, docs = pa.array(list(own), pa.binary()).cast(pa.string()), pa.array(list(own.values()), pa.int64())
                whole = pa.RecordBatch.from_arrays([pa.repeat(lang, len(own)).cast(pa.string()), terms, docs], ["lang", "term", "docs"])
                for at in range(0, len(own), 1 << 14):
                    yield whole.slice(at, 1 << 14)
            held.clear()

        for b in batches:
            for lang, text in zip(*(b.column(c).to_pylist() for c in ("lang", "text"))):
                own = held.setdefault(lang, Counter())
                before = len(own)
                own.update(set(terms_of(text)))
                size += len(own) - before
                if size >= HELD_TERMS:
                    yield from taken()
                    size = 0
        yield from taken()

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seen = TaskContext.get().partitionId(), Counter()
        for b in batches:
            at = b.groupby("lang", sort=False).cumcount() + b["lang"].map(seen).fillna(0).astype(np.int64)
            seen.update(b["lang"])
            yield pd.DataFrame({"lang": b["lang"], "term": b["term"], "part": part, "at": at})

    found = rows.select("lang", "text").mapInArrow(frugal(count), "lang string, term string, docs long").groupBy("lang", "term").agg(F.sum("docs").alias("docs"))
    kept = saved(found.where(F.col("docs") >= least).select("lang", "term"), "kept")
    placed = saved(kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").mapInPandas(number, "lang string, term string, part int, at long"), "placed")
    w = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = placed.groupBy("lang", "part").agg(F.count("*").alias("n")).select("lang", "part", (F.sum("n").over(w) - F.col("n")).alias("before"))
    out = saved(placed.join(before, ["lang", "part"]).select("lang", "term", (F.col("before") + F.col("at")).alias("id")), "dictionary")
    dropped(kept, placed)
    return out


def _counted(rows: DataFrame, take: Callable[[str, str, Counter], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """take(lang, source, counts of terms) for each group of a task, HELD_TERMS different terms at a time."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, str], Counter] = {}
        size = 0
        for b in batches:
            for lang, source, text in zip(b["lang"], b["source"], b["text"]):
                own = held.setdefault((lang, source), Counter())
                before = len(own)
                own.update(terms_of(text))
                size += len(own) - before
                if size >= HELD_TERMS:
                    for key, found in held.items():
                        yield from take(*key, found)
                    held, size = {}, 0
        for key, found in held.items():
            yield from take(*key, found)

    return rows.mapInPandas(frugal(count), schema)


def _coded(rows: DataFrame, sent: Broadcast) -> DataFrame:
    """``lang, source, id, count`` of the terms that ``sent`` has numbers of, by language; id null and count 0 for each group that occurs.

    A task keeps its occurrences as numbers (group << 32 | id), counts them when
    there are HELD_IDS, and hands its counts on when HELD_TERMS different ones
    have come together.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], int] = {}
        raw: list[np.ndarray] = []
        keys, counts, size = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            own, n = np.unique(np.concatenate([np.empty(0, dtype=np.int64), *raw]), return_counts=True)
            raw.clear()
            if not len(keys):
                return own, n
            both, at = np.unique(np.concatenate([keys, own]), return_inverse=True)
            total = np.zeros(len(both), dtype=np.int64)
            np.add.at(total, at, np.concatenate([counts, n]))
            return both, total

        def out(group: np.ndarray, ids: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            names = list(groups)
            langs, sources = (pa.array([g[i] for g in names], pa.string()) for i in (0, 1))
            for i in range(0, len(group), 1 << 14):
                part = slice(i, i + (1 << 14))
                own = pa.array(group[part])
                yield pa.RecordBatch.from_arrays([langs.take(own), sources.take(own), ids[part], pa.array(n[part])], ["lang", "source", "id", "count"])

        def taken() -> Iterator[pa.RecordBatch]:
            every = np.arange(len(groups))
            yield from out(keys >> 32, pa.array(keys & 0xFFFFFFFF), counts)
            yield from out(every, pa.nulls(len(every), pa.int64()), np.zeros(len(every), dtype=np.int64))

        known = sent.value
        for b in batches:
            for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text"))):
                group = groups.setdefault((lang, source), len(groups))
                if lang in known:
                    found = np.fromiter(map(known[lang].get, terms_of(text), repeat(-1)), dtype=np.int64)
                    found = found[found >= 0]
                    if len(found):
                        raw.append(found | group << 32)
                        size += len(found)
                if size >= HELD_IDS or len(groups) >= HELD_TERMS:
                    keys, counts = added()
                    size = 0
                    if max(len(keys), len(groups)) >= HELD_TERMS:
                        yield from taken()
                        groups.clear()
                        keys, counts = keys[:0], counts[:0]
        keys, counts = added()
        yield from taken()

    return rows.mapInArrow(frugal(count), "lang string, source string, id long, count long")


def group_counts(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``lang, source, id, count``: how often each group has each term of the dictionary; id null and count 0 once for each group that occurs.

    A dictionary of bounded size goes to all tasks as the numbers of terms, a
    language each: each occurrence becomes a number and numbers are counted.  A
    larger one is joined with the tasks' counts.
    """
    spark = rows.sparkSession
    n, size = dictionary.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    if n <= SENT_TERMS and size <= SENT_BYTES:
        every = dictionary.toPandas().sort_values(["lang", "id"])
        numbers = {lang: dict(zip((t.encode() for t in own["term"]), range(len(own)))) for lang, own in every.groupby("lang")}
        coded = _coded(rows, spark.sparkContext.broadcast(numbers))
    else:

        def take(lang: str, source: str, found: Counter) -> Iterator[pd.DataFrame]:
            terms, counts = [None, *(t.decode() for t in found)], [0, *found.values()]
            for i in range(0, len(terms), 1 << 14):
                yield pd.DataFrame({"lang": lang, "source": source, "term": terms[i : i + (1 << 14)], "count": counts[i : i + (1 << 14)]})

        every = _counted(rows, take, "lang string, source string, term string, count long").groupBy("lang", "source", "term").agg(F.sum("count").alias("count"))
        coded = every.join(dictionary, ["lang", "term"], "left").where("term is null or id is not null").select("lang", "source", "id", "count")
    return coded.groupBy("lang", "source", "id").agg(F.sum("count").alias("count"))


def parts(counts: np.ndarray, total: int, size: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * size)), exact: three digits of the quotient at a time, so that nothing passes 63 bits."""
    by = total + 2 * size
    whole, rest = np.divmod(counts.astype(np.int64) + 2, by)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, by)
        whole = whole * 1000 + more
    return 1 + whole


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)), in 64-bit whole numbers, which SCALE leaves room for."""
    return (p - q) ** 2 // (p + q)


def _measured(lang: str, terms: np.ndarray, ids: np.ndarray, sources: np.ndarray, counts: np.ndarray, every: list, totals: list, size: int) -> Iterator[pd.DataFrame]:
    """Sums of a chunk for each pair of sources, and each group's best terms there."""
    n, width = len(every), len(terms)
    names = np.array(every, dtype=object)
    group = np.searchsorted(names, sources)
    found = np.bincount(group * width + ids, weights=counts, minlength=n * width).reshape(n, width).astype(np.int64)  # exact below 2^53
    p = np.stack([parts(found[i], totals[i], size) for i in range(n)])
    q = parts(found.sum(axis=0), sum(totals), size)
    for i in range(n):
        apart = difference(p, p[i]).sum(axis=1)
        others = np.arange(n) != i
        if n > 1:
            yield pd.DataFrame({"lang": lang, "source": every[i], "part": "pair", "item": names[others], "value": apart[others]})
        own = np.flatnonzero((found[i] > 0) & (p[i] > q))
        value = difference(p[i][own], q[own])
        best = np.lexsort((own, -value))[:TOP]  # ids are in UTF-8 order
        if len(own):
            yield pd.DataFrame({"lang": lang, "source": every[i], "part": "term", "item": terms[own[best]], "value": value[best]})


def source_divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """Which sources of a language differ, and by which terms: ``lang, source, part, item, value, rank``.

    A language keeps the V terms that occur in at least `least` of its
    documents.  A group (lang, source) that occurs, with terms or without, gives
    each kept term p = 1 + floor(10^9 * (count + 2) / (N + 2 * V)), N being its
    sum of counts; the language as a whole likewise.  Part ``pair``: item is
    each other source of the language, value the sum of floor((p - q)^2 / (p +
    q)) over all kept terms, 0 if there are none.  Part ``term``: the group's
    terms that are likelier there than in the language, value the term's
    summand, the first `top` only.  Rank is by falling value, equal ones by
    rising item in UTF-8.

    Null text, lang and source count as empty; repeated rows count each time; no
    rows give no rows.  What is returned grows with the square of a language's
    sources, as asked for; what a task holds is bounded by CHUNK_CELLS, or by one
    term's counts for all sources if those are more.
    """
    if top > TOP:
        raise ValueError(f"top is {TOP} at most")
    rows = _rows(docs)
    dictionary = kept_terms(rows, least)
    counts = saved(group_counts(rows, dictionary), "counts")
    groups = counts.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = saved(groups, "groups")
    sizes = dictionary.groupBy("lang").agg(F.count("*").alias("size"))
    listed = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "total"))).alias("e")).join(sizes, "lang")
    listed = listed.select("lang", F.col("e.source").alias("every"), F.col("e.total").alias("totals"), "size")
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    chunk = F.expr(f"id div {max(1, min(CHUNK_TERMS, CHUNK_CELLS // most))}").alias("chunk")
    terms = dictionary.groupBy("lang", chunk).agg(F.array_sort(F.collect_list("term")).alias("terms"), F.min("id").alias("first"))
    entries = counts.where("id is not null").groupBy("lang", chunk).agg(*(F.collect_list(c).alias(c + "s") for c in ("id", "source", "count")))
    chunks = saved(terms.join(entries, ["lang", "chunk"]), "chunks")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                yield from _measured(r.lang, r.terms, r.ids - r.first, r.sources, r.counts, list(r.every), r.totals.tolist(), r.size)

    whole = spread_join(chunks, listed, "lang", chunks.groupBy("lang").agg(F.count("*").alias("n")), chunks.count(), by=["chunk"])
    whole = whole.select("lang", "terms", "first", "ids", "sources", "counts", "every", "totals", "size").repartition(F.xxhash64("lang", "first"))
    measured = saved(whole.mapInPandas(frugal(measure), "lang string, source string, part string, item string, value long"), "measured")
    apart = measured.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = pairs.join(apart, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(w))
    likelier = measured.where("part = 'term'").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return ranked.unionByName(likelier)
