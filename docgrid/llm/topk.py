"""Exact top-k search by inner product: no-random-access aggregation over sorted lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries of one broadcast block: with d components it is QUERY_BLOCK * d * 8 bytes, whatever the table's size.
QUERY_BLOCK = 2048
#: Values of one candidate block, each block with its own sorted lists.
LIST_VALUES = 1 << 19
#: Depths, as shares of a list, at which the bounds are looked at.
DEPTHS = (1 / 32, 1 / 16, 1 / 8, 3 / 16, 1 / 4, 3 / 8, 1 / 2, 3 / 4, 1.0)
LONG = (-(2**63), 2**63 - 1)
#: Sums below this are whole numbers in double precision, partial ones too.
WHOLE = 2.0**50


def quantised(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """``vec_id, v``: v holds floor(scale * x) of each component x, as doubles (whole numbers).

    Vectors that are null or hold a null or non-finite component, and rows of a null id, are left out.
    """
    v = F.col(vector_col)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(F.col(id_col).isNotNull() & v.isNotNull() & whole).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: _floor(x.cast("double") * scale)).alias("v")
    )


def _floor(y: Column) -> Column:
    """floor(y) as double; doubles of 2^52 or more are whole already, and would not fit a long."""
    return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(F.greatest(F.least(y, F.lit(1.7e308)), F.lit(-1.7e308)))


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k candidates of highest integer inner product for each query; ties go to the smaller id.

    Both sides hold ``vec_id long, v array<double>`` of whole numbers
    (:func:`quantised`).  A query meets every candidate of another id and of as
    many components.  Each task reads its candidates in blocks; a block has one
    sorted list per component, which :func:`contenders` reads from the end that
    helps the query until only a few candidates can still be among the k best of
    the blocks so far; their scores are then resolved.  Queries go out in
    broadcast blocks of QUERY_BLOCK rows, so what is sent is bounded, and a task
    returns k rows a query at most.

    Returns ``query_id, rank, vec_id, score``: fewer than k rows where there
    are fewer candidates, none for an empty table.  Repeated rows: an id that
    occurs n times as a candidate takes n ranks, a repeated query answers once,
    with its smallest vector.  Sums beyond the range of long stand at its end.
    """
    spark = candidates.sparkSession
    n = queries.select("vec_id").distinct().count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    found = None
    for part in range(blocks):
        # ids are dealt by their hash; a block that came out larger goes out in slices of QUERY_BLOCK
        own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == part).groupBy("vec_id").agg(F.min("v").alias("v"))
        for sent in _slices(own.toLocalIterator()):
            shared = spark.sparkContext.broadcast(sent)

            def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
                best = {d: [Best(i, k) for i in ids] for d, (ids, _) in shared.value.items()}
                for ids, x in _blocks(batches):
                    if x.shape[1] in best:
                        _search(ids, x, shared.value[x.shape[1]][1], best[x.shape[1]], k)
                yield from (b.rows() for own in best.values() for b in own)

            some = candidates.select("vec_id", "v").mapInPandas(search, "query_id long, vec_id long, score long")
            found = some if found is None else found.unionByName(some)
    if found is None:
        found = spark.createDataFrame([], "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _slices(rows) -> Iterator[dict]:
    """Query blocks by number of components: {d: (ids, matrix)}."""
    held: list = []
    for row in rows:
        held.append(row)
        if len(held) == QUERY_BLOCK:
            yield _by_length(held)
            held = []
    if held:
        yield _by_length(held)


def _by_length(rows: list) -> dict:
    size = np.array([len(r.v) for r in rows])
    return {int(d): (np.array([r.vec_id for r, n in zip(rows, size) if n == d]), np.array([r.v for r, n in zip(rows, size) if n == d], dtype=np.float64).reshape(-1, d)) for d in np.unique(size)}


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates of one number of components, LIST_VALUES values or a little more at once."""
    held: dict[int, list] = {}
    for b in batches:
        size = b["v"].str.len().to_numpy()
        for d in np.unique(size).tolist():
            part = b[size == d]
            held.setdefault(d, []).append((part["vec_id"].to_numpy(), np.stack(part["v"].to_list()).reshape(-1, d)))
            if sum(len(i) for i, _ in held[d]) * max(1, d) >= LIST_VALUES:
                yield tuple(np.concatenate(x) for x in zip(*held.pop(d)))
    for own in held.values():
        yield tuple(np.concatenate(x) for x in zip(*own))


class Best:
    """The k best candidates of one query so far."""

    def __init__(self, query: int, k: int):
        self.query, self.k = query, k
        self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        some = ids != self.query
        ids, scores = np.concatenate((self.ids, ids[some])), np.concatenate((self.scores, scores[some]))
        order = np.lexsort((ids, ~scores))[: self.k]  # ~ turns the order of longs without overflow
        self.ids, self.scores = ids[order], scores[order]

    def floor(self) -> float:
        """No candidate below this qualifies."""
        if len(self.ids) < self.k:
            return -np.inf
        last = float(self.scores[-1])
        return last if abs(last) < 2**53 else np.nextafter(last, -np.inf)

    def rows(self) -> pd.DataFrame:
        return pd.DataFrame({"query_id": np.full(len(self.ids), self.query), "vec_id": self.ids, "score": self.scores})


def _search(ids: np.ndarray, x: np.ndarray, q: np.ndarray, best: list[Best], k: int) -> None:
    """One block of candidates for all queries."""
    d = x.shape[1]
    top = np.abs(q).max(initial=0.0)
    with np.errstate(over="ignore"):
        large = np.abs(x).max(axis=1, initial=0.0) * top * max(1, d) >= WHOLE  # doubles would round
    if large.any():
        _rounded(ids[large], x[large], q, best, k)
        ids, x = ids[~large], x[~large]
    if not len(ids):
        return
    lists = Lists(x)
    for own, b in zip(q, best):
        some, _ = contenders(lists, own, k, b.floor(), ids == b.query)
        b.add(ids[some], (x[some] @ own).astype(np.int64))


class Lists:
    """For each component the candidates' numbers and values, lowest value first."""

    def __init__(self, x: np.ndarray):
        self.size = len(x)
        self.order = np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T)
        self.values = np.take_along_axis(np.ascontiguousarray(x.T), self.order, axis=1)


def contenders(lists: Lists, q: np.ndarray, k: int, floor: float = -np.inf, barred: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """Numbers of the candidates that can be among the k best and score `floor` or more, by no-random-access aggregation, and how many list values were read.

    All lists are read to the same depth, in the order in which their values
    help the query.  A value read adds to its candidate's partial sum; one not
    read yet lies between the last value read from its list (upper bound) and the
    list's far end (lower bound).  Candidates whose upper bound is below the k-th
    lower bound, or below floor, cannot qualify; reading stops when few others
    are left.  barred: candidates that don't count.
    """
    n, use = lists.size, np.flatnonzero(q)
    barred = np.zeros(n, dtype=bool) if barred is None else barred
    weight, ways = q[use], np.where(q[use] > 0, -1, 1)
    far = np.where(ways < 0, lists.values[use, 0], lists.values[use, -1]) * weight
    lower = np.full(n, far.sum())
    depth = 0
    for share in DEPTHS:
        before, depth = depth, max(1, int(n * share))
        seen = np.zeros(n)
        last = np.empty(len(use))
        for side in (-1, 1):
            at = np.flatnonzero(ways == side)
            span = slice(n - depth, n - before) if side < 0 else slice(before, depth)
            whole = slice(n - depth, n) if side < 0 else slice(0, depth)
            if not len(at):
                continue
            value = lists.values[use[at], span] * weight[at, None]
            last[at] = value[:, 0 if side < 0 else -1] if depth > before else last[at]
            lower += np.bincount(lists.order[use[at], span].ravel(), (value - far[at, None]).ravel(), n)
            seen += np.bincount(lists.order[use[at], whole].ravel(), np.repeat(last[at] - far[at], depth), n)
        upper = lower + (last - far).sum() - seen
        known = lower[~barred]
        limit = max(floor, np.partition(known, len(known) - k)[len(known) - k]) if len(known) > k else floor
        can = (upper >= limit) & ~barred
        if depth == n or can.sum() <= max(4 * k, n // 64):
            break
    return np.flatnonzero(can), depth * len(use)


def _rounded(ids: np.ndarray, x: np.ndarray, q: np.ndarray, best: list[Best], k: int) -> None:
    """Candidates whose sums doubles would round: bounds by the rounding error, whole numbers for those that can qualify."""
    with np.errstate(all="ignore"):
        near, slack = x @ q.T, (np.abs(x) @ np.abs(q).T) * (x.shape[1] + 2) * 2.0**-52
        sure = np.isfinite(near) & np.isfinite(slack)
        low = np.clip(np.where(sure, near - slack, -np.inf), *map(float, LONG))
        high = np.clip(np.where(sure, near + slack, np.inf), *map(float, LONG))
    for j, (own, b) in enumerate(zip(q, best)):
        barred = ids == b.query
        known = low[~barred, j]
        limit = max(b.floor(), np.nextafter(np.partition(known, len(known) - k)[len(known) - k], -np.inf)) if len(known) > k else b.floor()
        some = np.flatnonzero((high[:, j] >= limit) & ~barred)
        scores = []
        for i in some:
            if low[i, j] == high[i, j] and abs(low[i, j]) >= 2.0**63:
                scores.append(LONG[int(low[i, j] > 0)])
            else:
                scores.append(min(max(sum(int(a) * int(c) for a, c in zip(x[i].tolist(), own.tolist())), LONG[0]), LONG[1]))
        b.add(ids[some], np.array(scores, dtype=np.int64))
