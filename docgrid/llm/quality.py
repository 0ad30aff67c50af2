"""Quality classifier without labels: heuristic labellers, their accuracies by EM, a hashed linear scorer."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_of, keyed, small_batches

#: Documents that the scorer is fitted on, about; chosen by a hash of text and id where there are more.
SAMPLE_ROWS = 6000
BUCKETS = 1 << 15
THRESHOLD = 0.5
#: Features of a text that training takes at most.
TRAIN_WIDTH = 2048
#: Frequent short words of the languages served (fixed values).
STOP = frozenset("the of and to in that is was for with on as at be by der die das und in zu den von mit des im für ist le la les de et un une des que qui en el los las una con por y se su".split())
#: Labellers that look for one defect: they say bad or nothing, and their thresholds are ones that prose hardly ever reaches.
DEFECTS = ("symbols", "word_length", "shouting", "repeated_words", "separators", "word_variety")
FALSE_ALARMS = 0.003
LABELLERS = ("stop_words", "symbols", "word_length", "shouting", "repeated_words", "line_ends", "separators", "word_variety", "alphabetic")
_MARKS = re.compile(r"[#*$%&|<>{}\\^~=_]")


def votes(text: str) -> list[int]:
    """Each labeller's vote on a whole text: 1 good, 0 bad, -1 none; all -1 for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [-1] * len(LABELLERS)
    low = [w.lower().strip(".,;:!?\"'()") for w in words]
    stops = sum(w in STOP for w in low) / n
    marks = len(_MARKS.findall(text)) / n
    size = sum(map(len, words)) / n
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    capital, small = int(((raw >= 65) & (raw <= 90)).sum()), int(((raw >= 97) & (raw <= 122)).sum())
    same = sum(a == b for a, b in zip(low, low[1:])) / max(1, n - 1)
    lines = [x.rstrip() for x in text.split("\n") if x.strip()]
    ends = sum(x[-1] in ".!?…\"'" for x in lines) / max(1, len(lines))
    bars = sum(w in ("|", "-", "•", "::") for w in words) / n
    variety = len(set(low)) / n
    alpha = sum(w.isalpha() for w in low) / n
    long = n >= 12
    return [
        1 if stops > 0.08 else 0 if n >= 20 and stops < 0.02 else -1,
        0 if marks > 0.15 else -1,
        0 if long and not 2.5 <= size <= 10 else -1,
        0 if long and capital > 0.3 * (capital + small) else -1,
        0 if long and same > 0.2 else -1,
        1 if long and ends > 0.6 else 0 if n >= 20 and ends < 0.2 else -1,
        0 if bars > 0.1 else -1,
        0 if n > 60 and variety < 0.12 else 1 if long and variety > 0.3 else -1,
        1 if alpha > 0.9 else 0 if long and alpha < 0.6 else -1,
    ]


def accuracies(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, defects: tuple | None = None) -> tuple[np.ndarray, float, np.ndarray]:
    """EM over vote patterns (rows of -1, 0, 1) with counts.

    Each labeller votes rightly with its own rate for good and for bad
    documents; abstaining tells nothing.  Defect labellers may be wrong about
    good documents in FALSE_ALARMS of the cases at most, bad votes being counted
    among all documents for them.  Returns (rates: labeller x class,
    share of good documents, posterior of good for each pattern).  Starts from
    the labellers being mostly right, which fixes the meaning of the classes.
    """
    rate, prior = np.full((patterns.shape[1], 2), 0.8), 0.8
    post = np.full(len(patterns), prior)
    voted = patterns >= 0
    if defects is None:
        defects = tuple(name in DEFECTS for name in LABELLERS) if patterns.shape[1] == len(LABELLERS) else (False,) * patterns.shape[1]
    defect = np.array(defects)
    for _ in range(rounds):
        good = np.where(voted, np.where(patterns == 1, np.log(rate[:, 0]), np.log(1 - rate[:, 0])), 0).sum(axis=1) + math.log(prior)
        bad = np.where(voted, np.where(patterns == 0, np.log(rate[:, 1]), np.log(1 - rate[:, 1])), 0).sum(axis=1) + math.log(1 - prior)
        new = 1 / (1 + np.exp(np.clip(bad - good, -60, 60)))
        g, b = counts * new, counts * (1 - new)
        right = np.stack([(g[:, None] * (patterns == 1)).sum(axis=0), (b[:, None] * (patterns == 0)).sum(axis=0)], axis=1)
        seen = np.stack([(g[:, None] * voted).sum(axis=0), (b[:, None] * voted).sum(axis=0)], axis=1)
        rate = np.clip((right + 8) / (seen + 10), 0.05, 0.995)
        every = np.array([g.sum(), b.sum()])
        alarms = np.stack([(g[:, None] * (patterns == 0)).sum(axis=0), (b[:, None] * (patterns == 0)).sum(axis=0)], axis=1)
        share = (alarms + [0, 1]) / (every + 5)
        rate[defect, 0] = 1 - np.clip(share[defect, 0], 1e-4, FALSE_ALARMS)
        rate[defect, 1] = np.clip(share[defect, 1], 0.05, 0.9)
        prior = float(np.clip((g.sum() + 4) / (counts.sum() + 5), 0.02, 0.98))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return rate, prior, new if len(patterns) else post


def hashed(text: str) -> np.ndarray:
    """Hashed feature numbers of a text: word and ending forms, shapes of words, repeats of the last word."""
    out: list[int] = []
    before = None
    for w in text.split():
        out.append(_buckets[w])
        out.append(_shapes[w])
        if w == before:
            out.append(BUCKETS - 1)
        before = w
    return np.array(out, dtype=np.int64)


class _Bucket(dict):
    def __init__(self, name):
        super().__init__()
        self.name = name

    def __missing__(self, w: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[w] = v = xxhash.xxh3_64_intdigest(self.name(w)) % (BUCKETS - 2)
        return v


def _shape(w: str) -> str:
    core = w.strip(".,;:!?\"'()")
    kind = "A" if core.isupper() and len(core) > 1 else "a" if core.isalpha() else "m" if core else "p"
    tail = re.sub(r"[^\W\d_]+", "", w)[-3:]
    return f"s {kind}{min(len(core), 16) // 4} {tail}"


_buckets, _shapes = _Bucket(lambda w: "w " + w.lower()[-12:]), _Bucket(_shape)


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], passes: int = 12, rate: float = 0.5, ridge: float = 1e-4) -> np.ndarray:
    """Logistic regression of soft labels on feature shares: AdaGrad over batches; the last weight is the constant."""
    w, g2 = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-8)
    r = np.random.default_rng(0)
    order = np.arange(len(rows))
    for _ in range(passes):
        r.shuffle(order)
        for start in range(0, len(order), 64):
            part = [rows[i] for i in order[start : start + 64]]
            idx = np.concatenate([p[0] for p in part])
            val = np.concatenate([p[1] for p in part])
            own = np.repeat(np.arange(len(part)), [len(p[0]) for p in part])
            z = np.bincount(own, w[idx] * val, len(part)) + w[-1]
            err = 1 / (1 + np.exp(-z)) - np.array([p[2] for p in part])
            g = np.bincount(idx, err[own] * val, BUCKETS + 1) / len(part)
            g[-1] = err.mean()
            at = np.flatnonzero(g)
            g2[at] += g[at] ** 2
            w[at] -= rate * (g[at] / np.sqrt(g2[at]) + ridge * w[at])
    return w


def _shares(text: str) -> tuple[np.ndarray, np.ndarray]:
    idx, n = np.unique(hashed(text), return_counts=True)
    return idx, np.sqrt(n / max(1, n.sum()))


def _pattern(text: str) -> str:
    return "".join("-01"[v + 1] for v in votes(text))


def weak_labels(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """For each pattern of votes that occurs in docs, the probability that such a text is good; rows without words have none.

    Every whole text is voted on; how often each pattern occurs goes into EM.
    Patterns are 3^9 at most, so what the driver gathers is bounded.
    """

    def vote(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([_pattern(t) for t in b])

    voted = docs.select(F.pandas_udf(vote, "string")(F.coalesce(F.col(text_col), F.lit(""))).alias("pattern"))
    seen = [r for r in voted.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect() if r.pattern.strip("-")]
    if not seen:
        return {}
    patterns = np.array([["-01".index(c) - 1 for c in r.pattern] for r in seen], dtype=np.int64)
    post = accuracies(patterns, np.array([r.n for r in seen], dtype=np.float64))[2]
    return {r.pattern: float(p) for r, p in zip(seen, post)}


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: ``doc_id, score, keep``.

    Overlapping heuristic labellers vote on every whole text; :func:`weak_labels`
    estimates their accuracies by EM over all documents, which gives each text a
    posterior label.  The labels of about `sample_rows` documents, chosen by a
    hash, train a hashed linear scorer, which alone scores every text; keep says
    that the score is THRESHOLD or more.  A text of the sample is learned from by
    its TRAIN_WIDTH most frequent features, so what the driver gathers is
    bounded; scoring uses all.  Null texts count as empty; a text without words
    scores 0 and isn't kept.  Repeated rows give a row each.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = keyed(docs, id_col, text_col)
    weak = weak_labels(own)
    total = own.count()
    some = own
    if total > sample_rows:
        some = own.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < max(1, 1_000_000 * sample_rows // total))

    def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b["text"]:
                if (y := weak.get(_pattern(t))) is not None:
                    idx, val = _shares(t)
                    top = np.sort(np.argsort(-val, kind="stable")[:TRAIN_WIDTH])
                    out.append((idx[top].astype("<u2").tobytes(), val[top].astype("<f4").tobytes(), y))
            yield pd.DataFrame(out, columns=["i", "v", "y"])

    found = some.select("text").mapInPandas(shares, "i binary, v binary, y double").collect()
    rows = [(np.frombuffer(r.i, dtype="<u2").astype(np.int64), np.frombuffer(r.v, dtype="<f4").astype(np.float64), r.y) for r in found]
    sent = spark.sparkContext.broadcast(train(rows) if rows else np.zeros(BUCKETS + 1))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = sent.value
        for b in batches:
            out = np.zeros(len(b))
            for k, t in enumerate(b["text"]):
                idx, val = _shares(t)
                if len(idx):
                    out[k] = 1 / (1 + math.exp(-max(-50.0, min(50.0, float((w[idx] * val).sum() + w[-1])))))
            yield pd.DataFrame({"doc_id": ids_of(b), "score": out, "keep": out >= THRESHOLD})

    return own.mapInPandas(score, "doc_id long, score double, keep boolean")
