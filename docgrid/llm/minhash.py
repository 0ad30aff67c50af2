"""Near-duplicate documents: BagMinHash signatures of five-word shingles, banding, exact multiset overlap."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, dropped, parted, private, saved, small_batches, spread_join
from .lsh import SKETCH_BITS, Segments, Signed, candidates, linked, mixed, sketches, slices

WORDS = 5
SIMILARITY = 0.8
#: Registers of a signature, and how they are banded: 25 bands of 5 find a pair of similarity 0.8 with 0.99995.
REGISTERS, BANDS, BAND_ROWS = 128, 25, 5
#: Words whose hashes a worker remembers.
KNOWN_WORDS = 100_000
U = np.uint64


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()


def shingles(texts: list[str], size: int = WORDS) -> Segments:
    """The multisets of `size` consecutive words (lower case, split at white space); a shorter text is one shingle, one without words none."""
    lengths, flat = [], []
    look = _hashes.__getitem__
    for t in texts:
        words = t.lower().split()
        lengths.append(len(words))
        flat.extend(map(look, words))
    h = np.array(flat, dtype=np.uint64)
    n = np.array(lengths, dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), n)
    end = np.cumsum(n)
    place = np.arange(len(h)) - np.repeat(end - n, n)
    size_of = np.minimum(n, size)
    out = np.zeros(len(h), dtype=np.uint64)
    for j in range(size):
        part = np.zeros(len(h), dtype=np.uint64)
        part[: max(0, len(h) - j)] = h[j:]
        short = np.repeat(size_of <= j, n)  # a short text's shingle ends with its last word
        part[short] = 0
        out = mixed(out ^ part)
    first = place <= np.repeat(n - size_of, n)
    return Segments(owner[first], out[first], len(texts))


def bag_minhash(bags: Segments, n: int, registers: int = REGISTERS, seed: int = 1) -> np.ndarray:
    """BagMinHash: n x registers values whose share of equal entries estimates the weighted Jaccard similarity.

    An element of weight w owns, for each register, the points (x, y) with
    y <= w of a unit-rate Poisson process; the register holds the least x over
    all elements.  Weights are whole numbers; the process is built over the
    interval (0, 1] and the doubled intervals (1, 2], (2, 4] ... separately, all
    registers at once (rate times `registers`, each point in a random one).  An
    interval that w only partly covers is thinned to the levels up to w, so the
    same points serve every weight.  Points are made in rising x, and no further
    than a limit by which all registers of a text are filled; where one stays
    empty, the limit is doubled.  Texts without elements get infinities.
    """
    sig = np.full((n, registers), np.inf)
    flat = sig.reshape(-1)
    total = np.zeros(n)
    np.add.at(total, bags.owner, bags.count)
    owner, seed_of, count, low = [], [], [], []
    level, upto = 0, np.ones(len(bags.count), dtype=bool)
    while upto.any():
        at = np.flatnonzero(upto)
        owner.append(bags.owner[at])
        seed_of.append(mixed(bags.value[at] ^ U((level << 56) ^ (seed << 48))))
        count.append(bags.count[at])
        low.append(np.full(len(at), 0 if level == 0 else 1 << (level - 1)))
        upto = bags.count > 1 << level
        level += 1
    if not owner:
        return sig
    owner, seed_of, count, low = (np.concatenate(x) for x in (owner, seed_of, count, low))
    width = np.maximum(low, 1)
    limit = np.where(total > 0, (math.log(registers) + 3) / np.maximum(total, 1), 0)
    todo = total > 0
    while todo.any():
        at = np.flatnonzero(todo[owner])
        o, s, c, lo, w = owner[at], seed_of[at], count[at], low[at], width[at]
        x = np.zeros(len(at))
        r = 0
        while len(o):
            r += 1
            p = mixed(s + U(r))
            x = x - np.log(((p >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / (registers * w)
            on = np.flatnonzero(x < limit[o])
            o, s, c, lo, w, x = o[on], s[on], c[on], lo[on], w[on], x[on]
            q = mixed(p[on] ^ U(0x5851F42D4C957F2D))
            y = lo + 1 + ((q >> U(40)).astype(np.int64) * w >> 24)  # the point's level, evenly within the interval
            hit = y <= c
            np.minimum.at(flat, o[hit] * registers + (q[hit] % U(registers)).astype(np.int64), x[hit])
        todo = todo & np.isinf(sig).any(axis=1)
        limit = limit * 2
    return sig


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """A 64-bit key for each text and band."""
    bits = np.ascontiguousarray(sig).view(np.uint64)[:, : bands * rows].reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sig), bands)).copy()
    for j in range(rows):
        key = mixed(key ^ bits[:, :, j])
    return key.view(np.int64)


def _signed(batch: pd.DataFrame) -> Iterator[Signed]:
    for part in slices(batch["text"].str.len().to_numpy()):
        b = batch.iloc[part]
        sig = bag_minhash(shingles(b["text"].tolist()), len(b))
        some = np.isfinite(sig).all(axis=1)
        sig = sig[some]
        yield b["id"].to_numpy()[some], band_keys(sig).view(np.uint64), sketches(mixed(sig[:, :SKETCH_BITS].view(np.uint64)) >> U(63)), None


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: ``doc_id, text_hash, class_id, kept``.

    Texts are near if their multisets of five-word shingles (lower case, split
    at white space) overlap by 0.8 or more; a class is a connected component of
    near texts, copies included, and class_id its smallest doc_id.  kept marks
    the row of that id.  Null texts count as empty; empty texts, and those of
    white space only, are near to nothing but their exact copies; texts of one
    to four words are one shingle.  Repeated rows have the same class and are
    all kept or all not.  A null id is carried along, and is the class id only
    where its class has no other.  Copies share one 64-bit hash of the whole
    text and are not multiplied out.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("id", F.xxhash64("text"))

    def texts(ids: DataFrame, n: int) -> DataFrame:
        return among(own.select("id", "text"), "id", ids, n).groupBy("id").agg(F.min("text").alias("text"))

    found = saved(candidates(own.select("id", "text"), _signed, SIMILARITY), "candidates")
    comp = linked(found, texts, shingles, True, SIMILARITY)
    dropped(found)
    rows = saved(own.select("doc_id", "id"), "ids")
    total = rows.count()
    single = rows.groupBy("id").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    single = saved(single.join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")), "texts")
    heads = single.groupBy("component").agg(F.min("low").alias("class_id"), F.count("*").alias("n"))
    single = spread_join(single, heads.drop("n"), "component", heads.select("component", "n"), total)
    out = spread_join(rows, single.select("id", "class_id"), "id", single.select("id", "n"), total)
    return out.select("doc_id", F.col("id").alias("text_hash"), "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without the near duplicates: of each class the row with the smallest doc_id, once if repeated; all columns stay.

    Of rows with the same doc_id and text whose other columns differ, the one
    whose columns have the smallest hash stays.
    """
    own, mark = F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit("")))
    rows = saved(near_duplicates(docs).groupBy("doc_id", "text_hash", "kept").agg(F.count("*").alias("n")), "classes")
    # only documents that go, or are there more than once, are looked up; the others pass as they are
    gone = rows.where("not kept or n > 1").select(F.xxhash64("doc_id", "text_hash").alias("m"))
    some, others = parted(docs, F.xxhash64(own, mark), gone)
    kept_id, kept_hash, row = (private(docs, n) for n in ("id", "hash", "row"))
    kept = rows.where("kept").select(F.col("doc_id").alias(kept_id), F.col("text_hash").alias(kept_hash), F.col("n").alias(row))
    on = own.eqNullSafe(F.col(kept_id)) & (mark == F.col(kept_hash))
    once, again = kept.where(F.col(row) == 1).drop(row), kept.where(F.col(row) > 1).drop(row)
    every = [F.col(f"`{c}`") for c in docs.columns]
    first = some.join(again, on, "left_semi").groupBy(own.alias(kept_id), mark.alias(kept_hash)).agg(F.min_by(F.struct(*every), F.xxhash64(*every)).alias(row))
    first = first.select(*(F.col(row).getField(c).alias(c) for c in docs.columns))
    return others.unionByName(some.join(once, on, "left_semi")).unionByName(first)
