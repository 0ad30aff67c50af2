"""Near-duplicate embeddings: collision-counting projections, exact cosine verification."""

from __future__ import annotations

from math import comb, erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, dropped, saved, spread_join

COSINE = 0.93
PROJECTIONS = 48
#: Half a window's width, in standard deviations of the projected distance of two vectors at the limit.
HALF_WIDTH = 1.5
#: Share of pairs at the limit that may fall short of the count.
MISS = 1e-5
#: Vectors of a block: a task holds two blocks.
BLOCK = 4096
SEED = 20260101


def least_collisions(projections: int = PROJECTIONS, half_width: float = HALF_WIDTH, miss: float = MISS) -> int:
    """The count of window collisions that a pair at the cosine limit reaches with probability 1 - miss; nearer pairs reach it more often."""
    p = erf(half_width / sqrt(2))
    below, c = 0.0, 0
    while (below := below + comb(projections, c) * p**c * (1 - p) ** (projections - c)) <= miss:
        c += 1
    return c


def _directions(d: int) -> np.ndarray:
    return np.random.default_rng(SEED + d).standard_normal((d, PROJECTIONS))


def candidate_pairs(x: np.ndarray, y: np.ndarray | None, least: float = COSINE) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of unit vectors of x and y (of x with itself, i < j, if y is None) whose window collisions reach the calibrated count.

    Each random projection of y's block is sorted; the window of a query is the
    run of ranks whose projections lie within HALF_WIDTH deviations of its own.
    Only what lies in a window is looked at: the vectors in a query's windows
    are read off the sorted orders and counted.
    """
    other = x if y is None else y
    g = _directions(x.shape[1])
    half = HALF_WIDTH * sqrt(2 - 2 * least)
    p, q = x @ g, (other @ g).T
    order = np.argsort(q, axis=1, kind="stable")
    low, high = np.empty(p.shape, np.int64), np.empty(p.shape, np.int64)
    for j in range(PROJECTIONS):
        line = q[j, order[j]]
        low[:, j], high[:, j] = np.searchsorted(line, p[:, j] - half, "left"), np.searchsorted(line, p[:, j] + half, "right")
    need, left, right = least_collisions(), [], []
    for i, (a, b) in enumerate(zip(low.tolist(), high.tolist())):
        met = np.bincount(np.concatenate([order[j, a[j] : b[j]] for j in range(PROJECTIONS)]), minlength=len(other))
        k = np.flatnonzero(met >= need)
        k = k[k > i] if y is None else k
        left.append(np.full(len(k), i))
        right.append(k)
    return np.concatenate(left) if left else np.zeros(0, int), np.concatenate(right) if right else np.zeros(0, int)


def _link_blocks(b: pd.DataFrame) -> pd.DataFrame:
    """Links within a block pair: for each vector how many vectors it links with, and one link to each local component's head."""
    i, j = int(b["i"].iloc[0]), int(b["j"].iloc[0])
    ids, copies = b["head"].to_numpy(), b["copies"].to_numpy()
    x = np.stack([np.asarray(v, dtype=np.float64) for v in b["v"]])
    unit = x / np.abs(x).max(axis=1)[:, None]  # first by the largest component, so that squares neither overflow nor vanish
    unit /= np.sqrt((unit * unit).sum(axis=1))[:, None]
    mine = b["block"].to_numpy() == i
    at, to = np.flatnonzero(mine), np.flatnonzero(~mine)
    if i == j:
        p, q = candidate_pairs(unit, None)
    elif len(to):
        p, q = candidate_pairs(unit[at], unit[to])
        p, q = at[p], to[q]
    else:
        p = q = np.zeros(0, int)
    near = np.concatenate([(unit[p[s : s + 65536]] * unit[q[s : s + 65536]]).sum(axis=1) >= COSINE for s in range(0, len(p), 65536)] or [np.zeros(0, bool)])
    p, q = p[near], q[near]
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, p, copies[q])
    np.add.at(links, q, copies[p])
    root = np.arange(len(ids))
    while True:  # hook and jump until all ends of a link have one root
        a, c = root[p], root[q]
        if (a == c).all():
            break
        np.minimum.at(root, np.maximum(a, c), np.minimum(a, c))
        while (root[root] != root).any():
            root = root[root]
    some = links > 0
    return pd.DataFrame({"head": ids[some], "links": links[some], "to": ids[root[some]]})


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Two vectors link if their labels are equal and not null, they have as many
    components, and their cosine in double precision is 0.93 or more.  A link is
    looked for where enough of 48 random projections put the pair into one
    window, a count that a pair at the limit misses with probability 1e-5.
    Null, empty and zero vectors, and those with a null or non-finite component,
    link with nothing.  Equal vectors of a label are compared once and counted
    each; repeated ids count as vectors of their own.  component_id is the
    smallest vec_id reachable by links, kept says vec_id = component_id.  A row
    of a null id comes back with nulls and 0 links, and has no part in links.
    """
    v = F.col(vector_col)
    whole = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.when(whole, F.transform(v, lambda x: x.cast("double") + 0.0)).alias("v"))
    use = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
    rows = saved(rows.withColumn("mark", F.when(use, F.xxhash64(F.col("label").cast("string"), "v"))), "vectors")
    classes = rows.where("mark is not null").groupBy("mark").agg(F.min("vec_id").alias("head"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = saved(classes.withColumn("d", F.size("v")), "classes")
    group = classes.withColumn("l", F.xxhash64(F.col("label").cast("string"), "d"))
    sizes = group.groupBy("l").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n"))
    dealt = spread_join(group, sizes.drop("n"), "l", sizes.select("l", "n"), classes.count(), by=["mark"]).withColumn("block", F.pmod(F.xxhash64("mark"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", "d", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "mark", "copies", "v")
    dealt = dealt.withColumnRenamed("mark", "head")
    found = saved(dealt.groupBy("label", "d", "i", "j").applyInPandas(_link_blocks, "head long, links long, to long"), "links")
    n = found.groupBy("head").agg(F.sum("links").alias("n"))
    comp = components(found, "head", "to")
    known = classes.select("mark", "head", "copies").join(n.withColumnRenamed("head", "mark"), "mark", "left").join(comp.withColumnRenamed("node", "mark"), "mark", "left")
    known = saved(known.select("mark", "head", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "mark").alias("component")), "known")
    dropped(classes, found, comp)
    total = rows.count()
    least = known.groupBy("component").agg(F.min("head").alias("component_id"), F.count("*").alias("n"))
    known = spread_join(known, least.drop("n"), "component", least.select("component", "n"), total)
    # rows that take no part have marks of their own, so that they don't all meet in one task
    rows = rows.withColumn("mark", F.coalesce("mark", F.xxhash64("vec_id", "label")))
    out = spread_join(rows.withColumn("whole", use), known.select("mark", "n_links", "component_id"), "mark", known.select("mark", F.col("copies").alias("n")), total, "left", ["vec_id"])
    own = lambda c, other: F.coalesce(F.when(F.col("whole"), F.col(c)), other)
    out = out.select("vec_id", own("n_links", F.lit(0)).cast("long").alias("n_links"), own("component_id", F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
