"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, frugal, ids_of, keyed, saved, small_batches

#: Labelled rows that the model is fitted on, about: more are sampled by a hash of their ids.
SAMPLE_ROWS = 20_000
#: Words and stems that the lexicon may hold.
LEXICON_SIZE = 4000
STEMS = (4, 5, 6, 7, 8)
#: Least log-likelihood gain, in nats, for a word or stem to enter the lexicon; a chance word of a large vocabulary stays below.
GAIN = 12.0
#: Fingerprints by which near copies among the labelled rows are found, so that each counts once in the lexicon.
PRINTS = 4
THRESHOLD = 0.3
#: Second-person words of the languages served (fixed values).
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos usted ustedes tú ti tus vosotros os".split()
)
#: Characters that stand for letters in disguised words (fixed values).
LEET = str.maketrans("013457@$!€", "oieastasie")
WORD = re.compile(r"[^\W\d_]+")
DISGUISED = re.compile(r"(?<![^\W\d_])[^\W\d_]++[0134578@$!*€][0134578@$!*€\w]*[^\W\d_]|\b[^\W\d_](?:[.\-_*][^\W\d_]){2,}\b")
FEATURES = ("word_density", "stem_density", "hits", "disguised_hits", "near_second_person", "second_person", "capitals", "capital_words", "punctuation", "exclamations", "disguised", "symbols", "words", "longest_run", "weight", "weight_density")


@dataclass
class Model:
    """What scoring needs: lexicon, trees over binned features, calibration steps."""

    words: dict = field(default_factory=dict)
    stems: dict = field(default_factory=dict)
    edges: list = field(default_factory=list)
    trees: list = field(default_factory=list)
    base: float = 0.0
    steps: tuple = (np.zeros(1), np.zeros(1))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        raw = _boosted(self.trees, self.base, binned(x, self.edges))
        at = np.interp(raw, *self.steps)
        return np.clip(at, 0.0, 1.0)


class Flags(dict):
    """What each word is: 1 in the lexicon, 2 of a lexicon stem, 4 second person, 0 else, with its lexicon weight; remembers a bounded number."""

    def __init__(self, words: dict, stems: dict):
        super().__init__()
        self.words, self.stems = words, stems

    def weight(self, w: str) -> float:
        return max(self.words.get(w, 0.0), *(self.stems.get(w[:k], 0.0) for k in STEMS if len(w) >= k), 0.0)

    def __missing__(self, w: str) -> int:
        if len(self) > 200_000:
            self.clear()
        v = 1 if w in self.words else 2 if any(w[:k] in self.stems for k in STEMS if len(w) >= k) else 4 if w in SECOND_PERSON else 0
        self[w] = v
        return v


def features(text: str, flags: Flags) -> list[float]:
    """The dense features of one whole text; all 0 for an empty one."""
    if not text:
        return [0.0] * len(FEATURES)
    found = WORD.findall(text.lower())
    n = max(1, len(found))
    kinds = bytes(map(flags.__getitem__, found))
    words, stems, second = kinds.count(1), kinds.count(2), kinds.count(4)
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    byte = np.bincount(raw, minlength=256)
    capitals, small = int(byte[65:91].sum()), int(byte[97:123].sum())
    disguised = DISGUISED.findall(text)
    plain = 0
    for d in disguised:
        w = re.sub(r"[\W\d_]+", "", d.lower().translate(LEET))
        plain += flags[w] in (1, 2)
    near = 0.0
    if second and words + stems:
        a = np.frombuffer(kinds, dtype=np.uint8)
        hit, you = np.flatnonzero((a == 1) | (a == 2)), np.flatnonzero(a == 4)
        at = np.searchsorted(you, hit)
        gap = np.minimum(np.abs(hit - you[np.minimum(at, len(you) - 1)]), np.abs(hit - you[np.maximum(at - 1, 0)]))
        near = float(np.mean(1.0 / (1.0 + gap)))
    weight = sum(flags.weight(w) for w, k in zip(found, kinds) if k in (1, 2)) if words + stems else 0.0
    marks = int(byte[33:48].sum() + byte[58:65].sum() + byte[91:97].sum() + byte[123:127].sum())
    symbols = int(byte[[35, 36, 37, 38, 42, 64, 94, 126]].sum())
    upper = sum(1 for w in re.findall(r"\b[A-Z]{3,}\b", text))
    runs = max((len(m.group()) for m in re.finditer(r"([!?*])\1+", text)), default=0)
    return [words / n, stems / n, float(min(words + stems, 50)), float(plain), near, second / n, capitals / max(1, capitals + small), upper / n, marks / len(raw), byte[33] / n, len(disguised) / n, symbols / n, math.log1p(len(found)), float(min(runs, 20)), min(weight, 100.0), weight / n]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1).astype(np.int64)


def _boosted(trees: list, base: float, b: np.ndarray) -> np.ndarray:
    raw = np.full(len(b), base)
    rows = np.arange(len(b))
    for feature, cut, leaf in trees:
        node = np.zeros(len(b), dtype=np.int64)
        for _ in range(int(math.log2(len(leaf)))):
            node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
        raw += leaf[node - (len(leaf) - 1)]
    return raw


def boost(b: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0, bins: int = 32) -> tuple[list, float]:
    """Second-order gradient boosting of logistic loss by histograms: whole binary trees of one depth as (feature, cut, leaf value) arrays."""
    p = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = math.log(p / (1 - p))
    raw, trees = np.full(len(y), base), []
    n, d = b.shape
    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-raw))
        g, h = prob - y, prob * (1 - prob)
        inner = (1 << depth) - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, bins)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            local = node - first
            best = np.full(width, 1e-6)
            for j in range(d):
                at = local * bins + b[:, j]
                gs = np.bincount(at, g, width * bins).reshape(width, bins).cumsum(axis=1)
                hs = np.bincount(at, h, width * bins).reshape(width, bins).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                k = gain.argmax(axis=1)
                top = gain[np.arange(width), k]
                better = top > best
                best[better], feature[first : first + width][better], cut[first : first + width][better] = top[better], j, k[better]
            node = 2 * node + 1 + (b[np.arange(n), feature[node]] > cut[node])
        local = node - inner
        leaf = -rate * np.bincount(local, g, inner + 1) / (np.bincount(local, h, inner + 1) + ridge)
        raw += leaf[local]
        trees.append((feature, cut, leaf))
    return trees, base


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: the rising function of x nearest to y, as points to interpolate between."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, v in zip(x[order], y[order]):
        blocks.append([v, 1.0, a, a])
        while len(blocks) > 1 and (blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][3] == blocks[-1][2]):
            s, n, _, high = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = high
    xs, ys = [], []
    for s, n, low, high in blocks:
        for a in (low, high) if high > low else (low,):
            xs.append(a)
            ys.append((s + 0.02) / (n + 0.2))  # drawn to a prior of 0.1 by a fifth of a row
    return np.array(xs), np.array(ys)


def remainder(doc_id: str = "doc_id"):
    """crc32(doc_id as text) mod 4."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns lexicon, trees and calibration from labelled rows whose remainder isn't 2.

    At most about `sample_rows` labelled rows are used, chosen by a hash of the
    id where there are more.  Words and stems enter the lexicon by the
    likelihood gain of their document counts by label, near copies counting once;
    counting is distributed,
    and what comes to the driver is the lexicon and one row of numbers for each
    sampled row.  Calibration uses scores of trees that haven't seen the row.
    Without labels, or with one label only, the model scores a constant.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select(F.col("doc_id").alias("_id"), (F.col("toxic") > 0).cast("int").alias("y"))
    marks = marks.groupBy("_id").agg(F.max("y").alias("y")).where(remainder("_id") != 2)
    n = marks.count()
    if n > sample_rows:
        marks = marks.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(1_000_000 * sample_rows / n))
    rows = docs.select(F.col("doc_id").alias("_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).join(marks, "_id")
    rows = saved(rows.select("_id", "text", "y"), "labelled")
    counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = counts.get(1, 0), counts.get(0, 0)
    if not pos or not neg:
        return Model(edges=[np.zeros(0)] * len(FEATURES), steps=(np.zeros(1), np.array([1.0 if pos else 0.0])))

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for t, y in zip(b["text"], b["y"]):
                own = set(WORD.findall(t.lower()))
                seen[y].update(own)
                seen[y].update({w[:k] + "*" for w in own for k in STEMS if len(w) >= k})
            every = sorted(seen[0] | seen[1])
            yield pd.DataFrame({"term": every, "p": [seen[1][t] for t in every], "q": [seen[0][t] for t in every]}).astype({"term": str, "p": "int64", "q": "int64"})

    base = pos / (pos + neg)
    share = (F.col("p") + 0.5 * base) / (F.col("p") + F.col("q") + 0.5)
    gain = F.col("p") * F.log(share / base) + F.col("q") * F.log((1 - share) / (1 - base))
    single = rows.select("_id", "text", "y").withColumn("k", F.pandas_udf(_prints, "array<long>")("text"))  # copies of one text would make all of its words telling
    for i in range(PRINTS):  # of those that share a print the one of the smallest id stays, so that a task run again learns the same
        single = single.groupBy(F.col("k")[i].alias("p")).agg(F.min(F.struct("_id", "text", "y", "k")).alias("r")).select("r.*")
    found = single.select("text", "y").mapInPandas(terms, "term string, p long, q long").groupBy("term").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    found = found.where((share > 0.4) & (gain > GAIN)).select("term", gain.alias("gain"), F.log(share / base).alias("w")).orderBy(F.desc("gain"), "term").limit(LEXICON_SIZE).collect()
    words = {r.term: r.w for r in found if not r.term.endswith("*")}
    stems = {r.term[:-1]: r.w for r in found if r.term.endswith("*")}
    data = rows.select("text", "y", F.crc32(F.col("_id").cast("string").cast("binary")).alias("c")).mapInPandas(_featured(words, stems), "x array<double>, y int, c long").collect()
    x, y = np.array([r.x for r in data]), np.array([r.y for r in data], dtype=np.float64)
    half = np.array([(r.c // 4) % 2 for r in data])
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 32)[1:-1])) for j in range(x.shape[1])]
    edges = [np.unique(np.concatenate((e, [0.0])))[:31] for e in edges]
    b = binned(x, edges)
    own = np.zeros(len(y))
    for k in (0, 1):
        train, test = half != k, half == k
        if train.any() and test.any():
            own[test] = _boosted(*boost(b[train], y[train]), b[test])
        else:
            own[test] = _boosted(*boost(b, y), b[test])
    trees, start = boost(b, y)
    return Model(words, stems, edges, trees, start, isotonic(own, y))


def _prints(texts: pd.Series) -> pd.Series:
    """Least hashes of a text's three-word runs, by PRINTS hash functions: near copies share some."""
    out = []
    for t in texts:
        w = t.lower().split()
        h = np.array([xxhash.xxh3_64_intdigest(" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))], dtype=np.uint64)
        out.append([int(np.bitwise_xor(h * np.uint64(2 * i + 0x9E3779B97F4A7C15), h >> np.uint64(31 + i)).min() >> np.uint64(1)) for i in range(PRINTS)])
    return pd.Series(out)


def _featured(words: dict, stems: dict):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flags = Flags(words, stems)
        for b in batches:
            yield pd.DataFrame({"x": [features(t, flags) for t in b["text"]], "y": b["y"], "c": b["c"]})

    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score``: docs' rows with the score of each whole text, 0 to 1; null texts count as empty, which get a score too."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flags = Flags(sent.value.words, sent.value.stems)
        for b in batches:
            x = np.array([features(t, flags) for t in b["text"]]).reshape(len(b), len(FEATURES))
            yield pd.DataFrame({"doc_id": ids_of(b), "score": sent.value.score(x)})

    return keyed(docs).mapInPandas(frugal(run), "doc_id long, score double")


def toxic_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Scores depend on the text alone.  held_out says crc32(doc_id as text) mod 4
    is 2 (such labels are never learned from; false for a null id), predicted is
    1 from a score of 0.3 on.  Repeated rows give a row each.
    """
    small_batches(docs.sparkSession)
    out = scored(docs, fit(docs, labels))
    return out.select("doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs whose text scores below 0.3; all columns stay."""
    small_batches(docs.sparkSession)
    model = fit(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        flags = Flags(sent.value.words, sent.value.stems)
        for b in batches:
            yield pd.Series(sent.value.score(np.array([features(t, flags) for t in b.fillna("")]).reshape(len(b), len(FEATURES))))
        freed()

    return docs.where(score(F.col("text")) < THRESHOLD)
