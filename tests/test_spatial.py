"""Joins by grid cells and greedy leaders against loops over all pairs."""

import random
import time

import pytest
from pyspark.sql import functions as F

from docgrid.operators import elements, spatial

BOXES = "doc_id long, page_number int, seq int, x0 double, y0 double, x1 double, y1 double, level int, cell int, text string"


def page(seed, n, kind):
    """Boxes of one kind of page: words in lines, sizes over many powers of two, corners on whole numbers, a chain, points, or one above another."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        if kind == "words":
            x, y = r.uniform(0, 550), r.uniform(0, 780)
            out.append((x, y, x + r.uniform(2, 60), y + 12))
        elif kind == "sizes":
            x, y, s = r.uniform(-200, 600), r.uniform(-200, 800), 2 ** r.uniform(-8, 11)
            out.append((x, y, x + s, y + s * r.uniform(0, 1)))
        elif kind == "whole":
            x, y = r.randrange(-4, 16), r.randrange(-4, 16)
            out.append((x, y, x + r.randrange(0, 5), y + r.randrange(-1, 5)))
        elif kind == "chain":
            out.append((10.0 * i, 0.0, 10.0 * i + 10.0, 5.0))
        elif kind == "points":
            x, y = r.randrange(6), r.randrange(6)
            out.append((x, y, x, y))
        else:
            out.append((1.0, 1.0, 2.0 + i, 2.0))
    r.shuffle(out) if kind not in ("chain",) else None
    return [tuple(map(float, b)) for b in out]


KINDS = [("words", 120), ("sizes", 90), ("whole", 90), ("chain", 300), ("points", 60), ("same", 25), ("words", 1)]
PAGES = [(d, p, i, *b) for d in (1, 2) for p, (kind, n) in enumerate(KINDS, 1) for i, b in enumerate(page(10 * d + p, n, kind))]
INF, NAN = float("inf"), float("nan")
ODD = [(3, 1, 0, None, 0.0, 1.0, 1.0), (3, 1, 1, 0.0, 0.0, 1.0, 1.0), (3, 1, 2, NAN, 0.0, 1.0, 1.0), (3, 1, 3, -INF, 0.0, INF, 1.0), (3, 1, 4, 1.0, 1.0, 0.5, 0.5), (3, 1, 5, 0.0, 0.0, 1e300, 1.0)]


def meets(a, b):
    return a[5] >= b[3] and b[5] >= a[3] and a[6] >= b[4] and b[6] >= a[4]


def by_page(rows):
    out = {}
    for r in rows:
        out.setdefault(r[:2], []).append(r)
    return out


@pytest.fixture(scope="module")
def boxes(spark):
    return spark.createDataFrame([(*r, 1, 2, "t") for r in PAGES + ODD], BOXES)


def test_pairs_that_meet(boxes):
    got = sorted(tuple(r) for r in elements.overlap_pairs(boxes).collect())
    want = [(*k, a[2], b[2]) for k, own in by_page(PAGES + [ODD[1], ODD[4]]).items() for a in own for b in own if a[2] < b[2] and meets(a, b)]
    assert got == sorted(want)  # each once; boxes without finite bounds meet nothing


def test_groups_as_the_sequential_rule(boxes):
    want = []
    for k, own in by_page(PAGES).items():
        heads = []
        for e in own:
            for g in heads:
                if meets(g[0], e):
                    g.append(e)
                    break
            else:
                heads.append([e])
        want += [(*k, i, e[2]) for i, g in enumerate(heads) if len(g) > 1 for e in g]
    assert sorted(tuple(r) for r in elements.overlap_groups(boxes).where("doc_id < 3").collect()) == sorted(want)


def test_regions(spark, boxes):
    r = random.Random(4)
    regions = [(d, p, *b) for d in (1,) for p in (1, 2, 3, 5) for b in page(d + p, 6, "sizes")] + [(2, 1, 0.0, 0.0, 600.0, 800.0), (2, 2, None, 0.0, 1.0, 1.0), (2, 3, 3.0, 3.0, 3.0, 3.0)]
    regions += [(1, 1, *e[3:]) for e in r.sample([e for e in PAGES if e[:2] == (1, 1)], 20)]
    df = spark.createDataFrame(regions, "doc_id long, page_number int, x0 double, y0 double, x1 double, y1 double")
    inside = lambda e: any(e[:2] == g[:2] and None not in g and g[2] <= (e[3] + e[5]) / 2 <= g[4] and g[3] <= (e[4] + e[6]) / 2 <= g[5] for g in regions)
    got = sorted(tuple(x) for x in elements.outside_regions(boxes.where("doc_id < 3"), df).select("doc_id", "page_number", "seq").collect())
    assert got == sorted(e[:3] for e in PAGES if not inside(e)) and len(got) < len(PAGES)
    assert elements.outside_regions(boxes, df.limit(0)).count() == len(PAGES) + len(ODD)


def test_a_page_of_a_hundred_thousand_boxes(spark):
    n = 100_000
    one = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.lit(1).alias("page_number"), F.col("id").cast("int").alias("seq"), (F.col("id") % 400 * 3.0).alias("x0"), (F.floor(F.col("id") / 400) * 3.0).alias("y0"))
    one = one.withColumn("x1", F.col("x0") + 2.0 + (F.col("seq") % 10 == 0).cast("double")).withColumn("y1", F.col("y0") + 2.0)
    pairs = elements.overlap_pairs(one)
    assert "cell" in next(x for x in pairs._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x and "first" not in x and "cell" in x)
    began = time.time()
    assert pairs.count() == n / 10  # every tenth reaches its neighbour
    groups = elements.overlap_groups(one)
    assert groups.count() == 2 * n / 10
    assert time.time() - began < 120


def test_long_chains_and_many_leaders(spark):
    pairs = spark.createDataFrame([(7, i, i + 1) for i in range(5000)] + [(8, 0, 5), (8, 1, 5), (8, 5, 6), (8, 2, 6)], "k long, first int, second int")
    got = {(r.k, r.second): r.head for r in spatial.greedy_heads(pairs, ["k"]).collect()}
    assert got == {**{(7, i): i - 1 for i in range(1, 5001, 2)}, (8, 5): 0, (8, 6): 2}
    assert spatial.greedy_heads(pairs.limit(0), ["k"]).count() == 0


def test_region_order_of_unbounded_regions(spark, boxes):
    side = spark.createDataFrame([(1, 1, None, None, 100.0, None)], "doc_id long, page_number int, x0 double, y0 double, x1 double, y1 double")
    body = side.select("doc_id", "page_number", F.lit(100.0).alias("x0"), "y0", F.lit(300.0).alias("x1"), "y1")
    got = {r.seq: r.bucket for r in elements.region_order(boxes.where("doc_id = 1 and page_number = 1"), side, body).collect()}
    for e in by_page(PAGES)[(1, 1)]:
        x, y = (e[3] + e[5]) / 2, (e[4] + e[6]) / 2
        assert got[e[2]] == (2 if 0 <= x <= 100 and 0 <= y else 0 if 100 <= x <= 300 and 0 <= y else 1)
