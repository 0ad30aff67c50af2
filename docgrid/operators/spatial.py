"""Joins of boxes and points by grid cells, and greedy leaders on the pairs that they give."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Boxes of a level have sides up to four to its power, between these; cells are twice as wide.
LEAST_LEVEL, MOST_LEVEL = -3, 20
BOX = ("x0", "y0", "x1", "y1")


def _span(box: Column) -> dict[str, Column]:
    """A box's bounds in rising order."""
    return {f"{side}{axis}": f(box[f"{axis}0"], box[f"{axis}1"]) for axis in "xy" for side, f in (("low_", F.least), ("high_", F.greatest))}


def level(box: Column) -> Column:
    """The power of four that a box's longer side does not exceed: of the cells of that level it meets two in each direction at most, and mostly one."""
    s = _span(box)
    side = F.greatest(s["high_x"] - s["low_x"], s["high_y"] - s["low_y"], F.lit(4.0**LEAST_LEVEL))
    return F.least(F.ceil(F.log2(side) / 2).cast("int"), F.lit(MOST_LEVEL))


def _size(at: Column) -> Column:
    return F.pow(F.lit(2.0), 2 * at + 1)


def is_finite(box: Column) -> Column:
    """Whether all bounds are numbers up to 2^55 in size, since cells are numbered by longs; boxes with other bounds, null or NaN meet nothing."""
    most = 2.0**55
    return F.coalesce(box["x0"].between(-most, most) & box["y0"].between(-most, most) & box["x1"].between(-most, most) & box["y1"].between(-most, most), F.lit(False))


def cells(box: Column, at: Column) -> Column:
    """The cells of a level that a box meets, as an array of (level, x, y)."""
    s, size = _span(box), _size(at)
    reach = lambda axis: F.sequence(F.floor(s[f"low_{axis}"] / size), F.floor(s[f"high_{axis}"] / size))
    return F.flatten(F.transform(reach("x"), lambda x: F.transform(reach("y"), lambda y: F.struct(at.alias("level"), x.alias("x"), y.alias("y")))))


def _boxed(df: DataFrame, keys: Sequence[str], box: Sequence[str], name: str, also: Sequence[str] = ()) -> DataFrame:
    """keys, also, the box as a struct and its level; rows whose box meets nothing are left out."""
    whole = F.struct(*(F.col(c).cast("double").alias(n) for c, n in zip(box, BOX)))
    rows = df.select(*keys, *also, whole.alias(name)).where(is_finite(F.col(name)))
    return rows.withColumn(f"{name}_level", level(F.col(name)))


def _probes(rows: DataFrame, name: str, least: Column) -> DataFrame:
    """rows once for each cell that their box meets at each of their ``_levels`` from `least` up."""
    found = F.flatten(F.transform(F.filter("_levels", lambda v: v >= least), lambda v: cells(F.col(name), v)))
    return _in_cells(rows, found).drop("_levels")


def _placed(rows: DataFrame, name: str) -> DataFrame:
    """rows once for each cell, four at most, that their box meets at its own level."""
    return _in_cells(rows, cells(F.col(name), F.col(f"{name}_level"))).withColumnRenamed(f"{name}_level", "level")


CELL = ["cell_level", "cell_x", "cell_y"]


def _in_cells(rows: DataFrame, found: Column) -> DataFrame:
    """rows once for each of an array of cells, whose parts are columns: plain numbers make cheaper join keys than structs."""
    return rows.withColumn("_cell", F.explode(found)).select("*", *(F.col(f"_cell.{c}").alias(f"cell_{c}") for c in ("level", "x", "y"))).drop("_cell")


def _first_cell(a: Column, b: Column) -> Column:
    """The one cell of a pair's cells that has the lower corner of what both boxes cover: there, and nowhere else, the pair counts."""
    size, p, q = _size(F.col("cell_level")), _span(a), _span(b)
    return (F.floor(F.greatest(p["low_x"], q["low_x"]) / size) == F.col("cell_x")) & (F.floor(F.greatest(p["low_y"], q["low_y"]) / size) == F.col("cell_y"))


def meets(a: Column, b: Column) -> Column:
    """Whether two closed boxes meet."""
    return (a["x1"] >= b["x0"]) & (b["x1"] >= a["x0"]) & (a["y1"] >= b["y0"]) & (b["y1"] >= a["y0"])


def self_pairs(df: DataFrame, keys: Sequence[str], order: str, box: Sequence[str] = BOX) -> DataFrame:
    """Pairs of rows under equal keys whose boxes meet: keys, ``first``, ``second``, their `order` values, the smaller one first.

    `order` tells the rows of a key apart.  A box lies in the cells of a grid that
    is wider than itself, four at most and mostly one, and looks in the cells that it meets of each
    wider grid in use under its keys.  Keys and cell are the join key, so that
    boxes far apart never meet each other in a task, and a page of many small
    boxes is as many small groups.  A pair is found in one cell only, without a
    distinct.  Null, NaN or infinite bounds
    meet nothing.
    """
    own = _boxed(df, keys, box, "a", [order])
    own = own.withColumn("_levels", F.collect_set("a_level").over(Window.partitionBy(*keys)))
    held = _placed(own.drop("_levels").withColumnRenamed("a", "b").withColumnRenamed("a_level", "b_level").withColumnRenamed(order, "_b"), "b")
    looking = _probes(own.withColumnRenamed(order, "_a"), "a", F.col("a_level"))
    pairs = looking.join(held, [*keys, *CELL])
    # boxes of one level find each other twice
    once = (F.col("_a") < F.col("_b")) | ((F.col("a_level") < F.col("level")) & (F.col("_a") != F.col("_b")))
    found = pairs.where(once & meets(F.col("a"), F.col("b")) & _first_cell(F.col("a"), F.col("b")))
    return found.select(*keys, F.least("_a", "_b").alias("first"), F.greatest("_a", "_b").alias("second"))


def centred_in(df: DataFrame, regions: DataFrame, keys: Sequence[str], order: str, box: Sequence[str] = BOX, region: Sequence[str] = BOX) -> DataFrame:
    """Keys and `order` of the rows whose box has its centre in a region under equal keys, bounds included, once each.

    A centre looks in one cell of each level that regions of its keys have; a
    region lies in four cells at most.
    """
    point = [((F.col(box[0]) + F.col(box[2])) / 2).alias("_px"), ((F.col(box[1]) + F.col(box[3])) / 2).alias("_py")]
    points = _boxed(df.select(*keys, order, *point), keys, ("_px", "_py", "_px", "_py"), "a", [order])
    held = _placed(_boxed(regions, keys, region, "b"), "b")
    levels = held.groupBy(*keys).agg(F.collect_set("level").alias("_levels"))
    looking = _probes(points.join(levels, list(keys)), "a", F.lit(LEAST_LEVEL))
    x, y = F.col("p.a.x0"), F.col("p.a.y0")
    inside = x.between(F.col("r.b.x0"), F.col("r.b.x1")) & y.between(F.col("r.b.y0"), F.col("r.b.y1"))
    on = [F.col(f"p.{k}") == F.col(f"r.{k}") for k in [*keys, *CELL]] + [inside]
    same = on[0]
    for c in on[1:]:
        same = same & c
    return looking.alias("p").join(held.alias("r"), same, "left_semi").select(*keys, order).distinct()


def greedy_heads(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whom greedy grouping puts each member with: keys, ``second``, ``head``.

    pairs: keys, ``first``, ``second`` (first < second), rows that are near each
    other.  In rising order a row joins the first leader that it is near to and
    becomes a leader if there is none; leaders have no row here.

    A row that is second in no pair leads.  The others of a key are told apart
    by a fold over their earlier neighbours' numbers, in rising order, which
    keeps a bit for each row: it leads if no earlier neighbour does.  So chains
    of any length take one pass, and a key holds the numbers of its near rows
    only.
    """
    keys = list(keys)
    seconds = pairs.select(*keys, "second").distinct()
    numbered = seconds.withColumn("_no", F.row_number().over(Window.partitionBy(*keys).orderBy("second")) - 1)
    known = pairs.join(numbered.select(*keys, F.col("second").alias("first"), F.col("_no").alias("_first_no")), [*keys, "first"], "left")
    near = known.groupBy(*keys, "second").agg(F.collect_list(F.struct("first", F.coalesce("_first_no", F.lit(-1)).alias("no"))).alias("near"))
    per = near.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("second", "near"))).alias("rows"))
    state = "struct<full:array<bigint>,now:bigint,n:int>"

    def leads(full: Column, now: Column, no: Column) -> Column:
        word = F.when(F.shiftright(no, 6) < F.size(full), F.get(full, F.shiftright(no, 6))).otherwise(now)
        return F.getbit(word, no.bitwiseAND(F.lit(63)))

    def step(acc: Column, row: Column) -> Column:
        member = F.exists(row["near"], lambda e: (e["no"] < 0) | (leads(acc["full"], acc["now"], e["no"]) == 1))
        bit = F.when(member, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), acc["n"].bitwiseAND(F.lit(63))))
        now = acc["now"].bitwiseOR(bit)
        whole = acc["n"].bitwiseAND(F.lit(63)) == 63
        return F.struct(F.when(whole, F.concat(acc["full"], F.array(now))).otherwise(acc["full"]).alias("full"), F.when(whole, F.lit(0).cast("long")).otherwise(now).alias("now"), (acc["n"] + 1).alias("n"))

    start = F.struct(F.array().cast("array<bigint>").alias("full"), F.lit(0).cast("long").alias("now"), F.lit(0).alias("n")).cast(state)
    done = per.withColumn("bits", F.aggregate("rows", start, step))
    head = lambda near: F.array_min(F.transform(F.filter(near, lambda e: (e["no"] < 0) | (leads(F.col("bits.full"), F.col("bits.now"), e["no"]) == 1)), lambda e: e["first"]))
    out = done.select(*keys, F.explode(F.transform("rows", lambda r: F.struct(r["second"].alias("second"), head(r["near"]).alias("head")))).alias("r"))
    return out.select(*keys, "r.second", "r.head").where("head is not null")
