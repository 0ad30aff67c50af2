"""Fuzzy line deduplication: character-shingle MinHash, high-recall banding, exact Jaccard, union-find."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, ids_of, keyed, parted, private, saved, small_batches, spread_join
from .lsh import MEMBER, Segments, Signed, candidates, linked, mixed, sketches, slices

CHARS = 5
SIMILARITY = 0.8
#: Lines shorter than this (normalised) have no run of their own: they are near only if they are equal.
MIN_CHARS = CHARS
#: 15 bands of 5 find a pair of similarity 0.8 with 0.997, one of 0.85 with 0.9998.
BANDS, BAND_ROWS = 15, 5
LINE = "doc_id long, whole long, line_no int, id long, check long"
_MULT = mixed(np.arange(1, (BANDS * BAND_ROWS + 1) // 2 + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)


def normalised(line: str) -> str:
    """Lower case, white space collapsed, none at the ends."""
    return " ".join(line.lower().split())


def shingle_values(lines: list[str], chars: int = CHARS, code: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Line number and hash of every run of `chars` (five to eight) characters; a shorter line is one run, an empty one has none.

    code: the characters of the lines joined by single characters, if they are at hand.
    """
    n = np.array([len(x) for x in lines], dtype=np.int64)
    code = _codes("\n".join(lines)) if code is None else code
    code = np.concatenate((code, np.zeros(2 * chars, dtype=np.uint32))).astype(np.uint64) + np.uint64(1)
    a, b, c = (np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in (1, 2, 3))
    two = code[:-1] * a + code[1:]
    four = two[:-2] * b + two[2:]
    h = four[: 4 - chars] * c + four[chars - 4 :]  # the middle ones in both halves
    runs = np.where(n >= chars, n - chars + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(lines)), runs)
    begin, stop = np.cumsum(n + 1) - n - 1, np.cumsum(runs)
    at = np.arange(len(owner)) + np.repeat(begin - (stop - runs), runs)
    value = mixed(h[at])
    for i in np.flatnonzero((n > 0) & (n < chars)):  # its characters only, none of the next line's
        value[stop[i] - 1] = xxhash.xxh3_64_intdigest(lines[i].encode("utf-8", "surrogatepass"))
    return owner, value


def signatures(lines: list[str], chars: int = CHARS) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (a row a line) and sketches of lines of `chars` characters or more."""
    n = np.array([len(x) for x in lines], dtype=np.int64)
    return _signatures(_codes("\n".join(lines)), np.cumsum(n + 1) - n - 1, n, chars)


def _signatures(code: np.ndarray, begin: np.ndarray, n: np.ndarray, chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and sketches from the MinHash signatures, over 32-bit shingle hashes, of the lines of n characters that begin at `begin`."""
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(n), BANDS)).copy()
    if not len(n):
        return key, np.zeros(0, dtype=np.uint64)
    code = np.concatenate((code, np.zeros(2 * chars, dtype=np.uint32)))
    a, b, c = (np.uint32(pow(0x9E3779B1, k, 1 << 32)) for k in (1, 2, 3))
    two = code[:-1] * a + code[1:]
    four = two[:-2] * b + two[2:]
    h = four[: 4 - chars] * c + four[chars - 4 :]
    for shift, factor in ((15, 0x2C1B3C6D), (12, 0x297A2D39)):
        h ^= h >> np.uint32(shift)
        h *= np.uint32(factor)
    h ^= h >> np.uint32(15)
    ends = np.stack((begin, begin + n - chars + 1), axis=1).ravel()  # a line's runs, then what lies between it and the next
    bits = np.empty((len(n), BANDS * BAND_ROWS), dtype=bool)
    product = np.empty_like(h)
    for i, factor in enumerate(_MULT):
        np.multiply(h, factor, out=product)
        # the least and the greatest value of one permutation are two registers
        for r, pick in ((i, np.minimum), (i + len(_MULT), np.maximum)):
            if r < BANDS * BAND_ROWS:
                found = pick.reduceat(product, ends)[::2]
                bits[:, r] = (found * np.uint32(0x9E3779B1)) >> np.uint32(31)
                key[:, r // BAND_ROWS] = mixed(key[:, r // BAND_ROWS] ^ found.astype(np.uint64))
    return key, sketches(bits)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def all_normalised(lines: list[str]) -> tuple[list[str], np.ndarray | None]:
    """:func:`normalised` of each line, and the characters of all joined by line ends; line by line (without the characters) only where a batch holds white space other than single spaces within lines."""
    whole = "\n".join(lines).lower()
    code = _codes(whole)
    odd = ((code < 32) & (code != 10)) | (code == 0x85) | (code == 0xA0) | ((code >= 0x1680) & (code <= 0x3000))
    blank = (code == 32) | (code == 10)
    if odd.any() or ((code[1:] == 32) & blank[:-1]).any() or ((code[:-1] == 32) & blank[1:]).any() or (len(code) and (code[0] == 32 or code[-1] == 32)):
        return [normalised(x) for x in lines], None
    return whole.split("\n"), code


def shingles(lines: list[str], chars: int = CHARS) -> Segments:
    """The sets of runs of `chars` characters of the normalised lines."""
    every, code = all_normalised(lines)
    return Segments(*shingle_values(every, chars, code), len(lines))


class _Lines:
    """The lines of some texts: their text's number, their number in it, their id, and themselves normalised, with their lengths and characters."""

    def __init__(self, texts: list[str]):
        split = [t.split("\n") for t in texts]
        n = np.array([len(x) for x in split], dtype=np.int64)
        raw = [x for own in split for x in own]
        self.lines, code = all_normalised(raw)
        self.code = _codes("\n".join(self.lines)) if code is None else code
        self.size = np.array([len(x) for x in self.lines], dtype=np.int64)
        self.owner = np.repeat(np.arange(len(texts)), n)
        self.place = np.arange(len(raw)) - np.repeat(np.cumsum(n) - n, n)
        named = (x if m >= MIN_CHARS else y for x, y, m in zip(raw, self.lines, self.size.tolist()))  # short ones that are equal share an id
        self.ids = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 42) for x in named], dtype=np.uint64).view(np.int64)


def _signed(chars: int, shortest: int) -> Callable[[pd.DataFrame], Iterator[Signed]]:
    """Entries of the lines of each batch, and its lines (doc_id, whole, line_no, id, check) themselves; whole is the hash of a line's text, which tells rows of one doc_id apart."""

    def signed(batch: pd.DataFrame) -> Iterator[Signed]:
        for part in slices(batch["text"].str.len().to_numpy()):
            b = batch.iloc[part]
            own = _Lines(b["text"].tolist())
            check = np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in own.lines], dtype=np.uint64).view(np.int64)
            rows = pd.DataFrame({"line_no": own.place, "id": own.ids, "check": check})
            whole = np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), 42) for t in b["text"]], dtype=np.uint64).view(np.int64)
            rows.insert(0, "doc_id", ids_of(b)[own.owner])
            rows.insert(1, "whole", whole[own.owner])
            _, at = np.unique(own.ids, return_index=True)
            at = np.sort(at[own.size[at] >= max(shortest, MIN_CHARS)])
            begin = np.cumsum(own.size + 1) - own.size - 1
            yield own.ids[at], *_signatures(own.code, begin[at], own.size[at], chars), rows[own.size >= shortest]

    return signed


def _marked(docs: DataFrame, id_col: str, text_col: str, chars: int, shortest: int) -> DataFrame:
    """``doc_id, whole, line_no, line_hash, component, kept`` of all lines.

    A line that is neither repeated nor near another stands for itself.  Of the
    lines that share an id the smallest second hash says which one it stands
    for; another line that happens to have it is left alone and stays.
    """
    small_batches(docs.sparkSession)
    own = keyed(docs, id_col, text_col)
    found = saved(candidates(own, _signed(chars, shortest), SIMILARITY, LINE), "lines")
    rows = found.where("line_no is not null").select("doc_id", "whole", "line_no", "id", "check")

    def texts(ids: DataFrame, n: int) -> DataFrame:
        lines = own.select(F.explode(F.split("text", "\n", -1)).alias("text")).where(F.length("text") >= MIN_CHARS)
        return among(lines.select(F.xxhash64("text").alias("id"), "text"), "id", ids, n).groupBy("id").agg(F.min("text").alias("text"))

    comp = linked(found.select(*MEMBER.names), texts, partial(shingles, chars=chars), False, SIMILARITY, hold=True)
    return _judged(rows, comp)


def _judged(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """Lines (doc_id, line_no, id, check, and what else they have) with their component (comp: node, component) and whether they stay."""
    per = rows.groupBy("id").agg(F.count("*").alias("n"), F.min(F.struct("check", "doc_id", "line_no")).alias("first"))
    several = per.join(comp.withColumnRenamed("node", "id"), "id", "left").where("n > 1 or component is not null")
    several = saved(several.select("id", "n", F.col("first.check").alias("of"), F.struct("first.doc_id", "first.line_no").alias("first"), F.coalesce("component", "id").alias("component")), "several")
    heads = several.groupBy("component").agg(F.min("first").alias("head"), F.count("*").alias("n"))
    total = rows.count()
    marks = spread_join(several.select("id", "of", "component"), heads.drop("n"), "component", heads.select("component", "n"), total)
    out = spread_join(rows, marks, "id", several.select("id", "n"), total, "left", ["doc_id", "line_no"])
    alone, other = F.col("component").isNull(), F.col("check") != F.col("of")
    component = F.when(alone, F.col("id")).when(other, F.xxhash64("id", "check")).otherwise(F.col("component"))
    kept = F.when(alone | other, True).otherwise(F.struct("doc_id", "line_no").eqNullSafe(F.col("head")))
    return out.select(*(c for c in rows.columns if c not in ("id", "check")), F.col("id").alias("line_hash"), component.alias("component"), kept.alias("kept"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars: int = CHARS, shortest: int = 1) -> DataFrame:
    """One row per line of `shortest` characters or more: ``doc_id, line_no, line_hash, component, kept``.

    Lines are compared in lower case with white space collapsed.  Two are near
    if their sets of runs of `chars` characters have a Jaccard similarity of 0.8 or
    more; a component holds all lines reachable by such links, copies included,
    and keeps its first line by (doc_id, line_no).  component is the smallest
    hash of its lines.  Lines of fewer than MIN_CHARS characters are near if they
    are equal, and only then; null and empty texts have no lines.  Rows repeated with the same doc_id keep their line in each.
    A null doc_id sorts first.
    """
    return _marked(docs, id_col, text_col, chars, shortest)


def without_repeats(docs: DataFrame, chars: int = CHARS, shortest: int = 1) -> DataFrame:
    """docs with each repeated line left in its first place only; other columns stay, but for n_chars, which is counted anew.

    A document all of whose text went is dropped: the document that keeps those
    lines stands for it.  Documents that were empty or null to begin with stay.
    Rows of one doc_id, or of none, lose only lines of their own text; a line
    that such rows have at the same place stays in each.
    """
    gone_doc, gone_whole, gone, left_text = (private(docs, n) for n in ("doc", "whole", "gone", "left"))
    lines = _marked(docs, "doc_id", "text", chars, shortest).where("not kept")
    lost = lines.groupBy(F.col("doc_id").alias(gone_doc), F.col("whole").alias(gone_whole)).agg(F.collect_set("line_no").alias(gone))
    lost = saved(lost, "gone")
    # whole texts are shuffled of documents that lose lines only
    own, whole = F.col("doc_id").cast("long"), F.xxhash64("text")
    some, others = parted(docs, F.xxhash64(own, whole), lost.select(F.xxhash64(gone_doc, gone_whole).alias("m")))
    both = some.join(lost, F.col(gone_doc).eqNullSafe(own) & (F.col(gone_whole) == whole), "left")
    same = F.col(gone).isNull()

    @F.pandas_udf("string")
    def left(texts: pd.Series, numbers: pd.Series) -> pd.Series:
        out = []
        for t, drop in zip(texts, numbers):
            some = set(() if drop is None else drop.tolist())
            out.append(None if t is None else "\n".join([x for i, x in enumerate(t.split("\n")) if i not in some]))
        return pd.Series(out, dtype=object)

    both = both.withColumn(left_text, left(F.when(same, F.lit(None)).otherwise(F.col("text")), F.col(gone)))  # texts that stay as they are aren't sent
    values = {"text": F.when(same, F.col("text")).otherwise(F.col(left_text))}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(same, F.col("n_chars")).otherwise(F.length(left_text).cast("long"))
    both = both.where(same | (F.trim(F.regexp_replace(left_text, r"\s+", " ")) != "")).select(*(values.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))
    return others.unionByName(both)
