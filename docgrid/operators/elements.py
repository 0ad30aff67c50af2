"""Text elements: from characters, reading order, merging, statistics, region filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CALLOUT_STARTS, CAPTION_STARTS, _c, colour_hex, is_blank, starts_with_any, strip, word_count
from . import spatial

PAGE = ["doc_id", "page_number"]
LINE_GAP, MERGE_GAP, SIZE_GAP, SPACE_GAP = 10.0, 50.0, 2.0, 5.0


def element_of(char: Column) -> Column:
    """One character (or word) of the page source as an element: top becomes y0, bottom y1."""
    font = F.lower(F.coalesce(char["fontname"], F.lit("")))
    return F.struct(
        char["seq"].alias("seq"), char["text"].alias("text"), char["x0"].alias("x0"), char["top"].alias("y0"), char["x1"].alias("x1"), char["bottom"].alias("y1"),
        char["fontname"].alias("font_name"), F.coalesce(char["size"], F.lit(0.0)).alias("font_size"), colour_hex(char["color"]).alias("font_color"),
        font.contains("bold").alias("is_bold"), (font.contains("italic") | font.contains("oblique")).alias("is_italic"),
    )


def elements_from_chars(pages: DataFrame) -> DataFrame:
    """Elements of pages with a ``chars`` array, a row each; pages without characters have none."""
    return pages.select(*PAGE, F.explode(F.transform("chars", element_of)).alias("e")).select(*PAGE, "e.*")


def plain_elements(pages: DataFrame) -> DataFrame:
    """Text and place of each character only, neither sorted nor merged."""
    return pages.select(*PAGE, F.explode("chars").alias("c")).select(*PAGE, "c.seq", "c.text", "c.x0", F.col("c.top").alias("y0"), "c.x1", F.col("c.bottom").alias("y1"))


def once(value: Column | str, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is taken once a row: a column that a plan names once is put in its place by the planner, which inside a function of elements would take it once an element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def width() -> Column:
    return F.col("x1") - F.col("x0")


def height() -> Column:
    return F.col("y1") - F.col("y0")


def is_heading(min_font_size: float = 14.0) -> Column:
    return (F.col("font_size") >= min_font_size) & F.col("is_bold") & (F.length(strip("text")) < 100)


def is_centered(page_width, tolerance: float = 0.1) -> Column:
    w = _c(page_width) if not isinstance(page_width, float | int) else F.lit(float(page_width))
    return F.abs((F.col("x0") + F.col("x1")) / 2 - w / 2) < w * tolerance


def _is_caption(e: Callable[[str], Column], t: Column, low: Column) -> Column:
    small = (e("font_size") > 0) & (e("font_size") < 12) & ~e("is_bold") & (F.length(t) < 200)
    return starts_with_any(low, CAPTION_STARTS) | small


def _is_callout(e: Callable[[str], Column], t: Column, low: Column) -> Column:
    marked = e("is_bold") & (e("font_size") > 0) & (e("font_size") < 14)
    return (F.length(t) < 50) & (starts_with_any(low, CALLOUT_STARTS) | marked)


def is_caption() -> Column:
    return _is_caption(F.col, strip("text"), F.lower(strip("text")))


def is_callout() -> Column:
    return _is_callout(F.col, strip("text"), F.lower(strip("text")))


def caption_or_callout() -> Column:
    """caption, callout or remaining: the first that holds."""
    return F.when(is_caption(), "caption").when(is_callout(), "callout").otherwise("remaining")


def kinds_in(array: str) -> Column:
    """An array's elements as struct(kind, e) by :func:`caption_or_callout`; what that asks for many times is taken once an element, since functions of array elements share nothing."""
    stripped = F.transform(array, lambda e: F.struct(e.alias("e"), strip(e["text"]).alias("t")))
    lower = F.transform(stripped, lambda k: F.struct(k["e"].alias("e"), k["t"].alias("t"), F.lower(k["t"]).alias("low")))

    def kind(k: Column) -> Column:
        says = (k["e"].getField, k["t"], k["low"])
        return F.when(_is_caption(*says), "caption").when(_is_callout(*says), "callout").otherwise("remaining")

    return F.transform(lower, lambda k: F.struct(kind(k).alias("kind"), k["e"].alias("e")))


def leaders(values: Column, gap: Column | float, strict: bool = False) -> Column:
    """The leader of each group when rising values are grouped greedily: a value joins the group whose first value is no more than `gap` below it.

    strict: it has to be nearer than `gap`.
    """
    g = gap if isinstance(gap, Column) else F.lit(float(gap))
    far = (lambda d: d >= g) if strict else (lambda d: d > g)
    start = F.array().cast("array<double>")
    return F.aggregate(
        F.array_sort(F.array_distinct(values)), start, lambda acc, v: F.when((F.size(acc) == 0) | far(v - F.element_at(acc, -1)), F.concat(acc, F.array(v))).otherwise(acc)
    )


def with_lines(df: DataFrame, y: str = "y0", gap: Column | float = LINE_GAP, strict: bool = False, keys: list[str] | None = None) -> DataFrame:
    """df with ``line_y``, the leader of each row's line on its page: one aggregate of distinct heights a page, then a lookup."""
    keys = keys or PAGE
    gap_col = gap if isinstance(gap, Column) else F.lit(float(gap))
    per = df.groupBy(*keys).agg(F.collect_set(F.col(y).cast("double")).alias("_ys"), F.first(gap_col, ignorenulls=True).alias("_gap"))
    per = per.select(*keys, leaders(F.col("_ys"), F.col("_gap"), strict).alias("_lead"))
    return df.join(per, keys).withColumn("line_y", F.array_max(F.filter("_lead", lambda v: v <= F.col(y)))).drop("_lead")


def reading_order(elements: DataFrame) -> DataFrame:
    """elements with ``order_no`` from 1 on each page: lines by rising leader, within a line by x0; ties keep their sequence."""
    w = Window.partitionBy(*PAGE).orderBy("line_y", "x0", "seq")
    return with_lines(elements).withColumn("order_no", F.row_number().over(w))


def lined(sheets: DataFrame, y: str = "y0", gap: float = LINE_GAP, strict: bool = False, array: str = "words") -> DataFrame:
    """:func:`with_lines` for pages that hold their elements in an array: a row an element with ``line_y``, each page by itself, nothing is shuffled."""
    led = sheets.select(*PAGE, array, leaders(F.transform(array, lambda e: e[y].cast("double")), gap, strict).alias("_lead"))
    rows = led.select(*PAGE, "_lead", F.inline_outer(array))
    return rows.withColumn("line_y", F.array_max(F.filter("_lead", lambda v: v <= F.col(y)))).drop("_lead").where("seq is not null")


def _numbered(sheets: DataFrame, ranks: Column) -> DataFrame:
    """``seq`` and ``order_no`` of each page's elements by rising structs that end in their seq."""
    rows = sheets.select(*PAGE, F.posexplode(F.array_sort(ranks)["seq"]).alias("at", "seq"))
    return rows.select(*PAGE, "seq", (F.col("at") + 1).alias("order_no"))


def reading_order_of(sheets: DataFrame, array: str = "words") -> DataFrame:
    """The numbers of :func:`reading_order` for pages that hold their elements in an array."""
    led = sheets.select(*PAGE, array, leaders(F.transform(array, lambda e: e["y0"].cast("double")), LINE_GAP).alias("_lead"))
    line = lambda e: F.array_max(F.filter("_lead", lambda v: v <= e["y0"]))
    return _numbered(led, F.transform(array, lambda e: F.struct(line(e).alias("line_y"), e["x0"].alias("x0"), e["seq"].alias("seq"))))


def standard_order_of(sheets: DataFrame, array: str = "words") -> DataFrame:
    """The numbers of :func:`standard_order` for pages that hold their elements in an array."""
    return _numbered(sheets, F.transform(array, lambda e: F.struct((-e["y0"]).alias("down"), e["x0"].alias("x0"), e["seq"].alias("seq"))))


def joined_lines_of(sheets: DataFrame, array: str = "words") -> DataFrame:
    """:func:`joined_lines` for pages that hold their elements in an array."""
    rows = F.transform(array, lambda e: F.struct(tenths(e["y0"]).alias("ykey"), e["x0"].alias("x0"), e["seq"].alias("seq"), e["text"].alias("text")))
    return sheets.where(F.size(array) > 0).select(*PAGE, F.array_sort(rows).alias("_e")).select(*PAGE, _joined("_e").alias("text"))


def _joined(rows: str) -> Column:
    """Text of an array of (ykey, text) in order: those of one ykey are a line."""
    before = lambda e, i: F.when(i == 0, "").when(F.get(rows, i - 1)["ykey"] == e["ykey"], " ").otherwise("\n")
    return F.array_join(F.transform(rows, lambda e, i: F.concat(before(e, i), e["text"])), "")


def upper_median(values: Column) -> Column:
    """The element of index n div 2 of the sorted values; 0 for none."""
    return F.coalesce(F.get(F.array_sort(values), (F.size(values) / 2).cast("int")), F.lit(0.0))


def column_boundary(elements: DataFrame) -> DataFrame:
    """Pages with ``boundary``, where columns part: the gap of middle rank among at least two wide gaps between sorted left edges; null for one column."""
    w = Window.partitionBy(*PAGE).orderBy("x0", "seq")
    gaps = elements.select(*PAGE, "x0", "x1", "seq", F.lag("x0").over(w).alias("before"), F.max("x1").over(Window.partitionBy(*PAGE)).alias("right"))
    gaps = gaps.withColumn("gap", F.col("x0") - F.col("before")).where((F.col("gap") > 50) & (F.col("gap") > 0.05 * F.col("right")))
    by = Window.partitionBy(*PAGE)
    ranked = gaps.withColumn("n", F.count("*").over(by)).withColumn("k", F.row_number().over(by.orderBy(F.desc("gap"), "x0", "seq")))
    found = ranked.where((F.col("n") >= 2) & (F.col("k") == F.floor(F.col("n") / 2) + 1)).select(*PAGE, ((F.col("before") + F.col("x0")) / 2).alias("boundary"))
    return elements.select(*PAGE).distinct().join(found, PAGE, "left")


def adaptive_order(elements: DataFrame) -> DataFrame:
    """elements with ``order_no``: lines grouped by 0.8 of the page's mean font size, ordered by their upper median height; in a line by column, then x0."""
    mean = F.avg(F.when(F.col("font_size") > 0, F.col("font_size")))
    size = elements.groupBy(*PAGE).agg(mean.alias("_mean"), F.min_by("font_size", F.struct("y0", "seq")).alias("_first"))
    gap = F.when(F.col("_first") > 0, F.col("_mean")).otherwise(12.0) * 0.8
    lined = with_lines(elements.join(size, PAGE), gap=gap).drop("_mean", "_first")
    lined = lined.join(column_boundary(elements), PAGE, "left")
    mid = lined.groupBy(*PAGE, "line_y").agg(upper_median(F.collect_list(F.col("y0").cast("double"))).alias("line_median"))
    lined = lined.join(mid, [*PAGE, "line_y"]).withColumn("column_no", F.when(F.col("boundary") <= F.col("x0"), 1).otherwise(0))
    w = Window.partitionBy(*PAGE).orderBy("line_median", "line_y", "column_no", "x0", "seq")
    return lined.withColumn("order_no", F.row_number().over(w))


def _line_starts(rows: str, gap: Column) -> Column:
    """Places at which lines begin among an array's elements by rising y0: those :func:`leaders` gives, in one fold and without a lookup an element."""
    kind = "struct<first:array<int>,at:double,i:int>"
    start = F.struct(F.array().cast("array<int>"), F.lit(None).cast("double"), F.lit(0)).cast(kind)

    def step(acc: Column, e: Column) -> Column:
        y = e["y0"]
        begins = (acc["i"] == 0) | (acc["at"].isNull() & y.isNotNull()) | ((y - acc["at"] > gap) & (y != acc["at"]))
        return F.when(begins, F.struct(F.concat(acc["first"], F.array(acc["i"])), y, acc["i"] + 1).cast(kind)).otherwise(F.struct(acc["first"], acc["at"], acc["i"] + 1).cast(kind))

    return F.aggregate(rows, start, step, lambda acc: acc["first"])


def in_reading_order(sheets: DataFrame, array: str = "words") -> DataFrame:
    """Pages with ``ordered``: the elements (seq, text, box, font size) of an array in :func:`reading_order`."""
    held = lambda e, cs: F.struct(*(e[c].cast("double").alias(c) if c == "y0" else e[c].alias(c) for c in cs))
    by_height = lambda e: held(e, ("y0", "x0", "seq", "text", "x1", "y1", "font_size"))
    rows = sheets.select(*PAGE, F.array_sort(F.transform(array, by_height)).alias("_e"))
    rows = rows.withColumn("_first", _line_starts("_e", F.lit(LINE_GAP)))
    line = lambda own: F.array_sort(F.transform(own, lambda e: held(e, ("x0", "seq", "text", "y0", "x1", "y1", "font_size"))))
    return rows.select(*PAGE, F.flatten(F.transform(parts("_e", "_first"), line)).alias("ordered"))


def merge_adjacent_of(sheets: DataFrame, array: str = "words") -> DataFrame:
    """``merged_no, seq, text`` and box of :func:`merge_adjacent` in reading order, for pages that hold their elements in an array: each page by itself, nothing is shuffled."""
    rows = merged_in(in_reading_order(sheets, array)).select(*PAGE, F.posexplode_outer("merged").alias("merged_no", "m")).where("m is not null")
    return rows.select(*PAGE, "merged_no", "m.*")


def adaptive_order_of(sheets: DataFrame, array: str = "words") -> DataFrame:
    """``seq, order_no`` of :func:`adaptive_order` for pages that hold their elements (seq, box, font size) in an array: each page by itself, nothing is shuffled."""
    element = lambda e: F.struct(e["y0"].cast("double").alias("y0"), e["seq"].alias("seq"), e["x0"].alias("x0"), e["font_size"].alias("font_size"))
    right = F.array_max(F.col(array)["x1"])
    rows = sheets.select(*PAGE, F.array_sort(F.transform(array, element)).alias("_e"), F.array_sort(F.array_distinct(F.col(array)["x0"])).alias("_xs"), right.alias("_right"))
    sizes = F.filter(F.col("_e")["font_size"], lambda v: v > 0)
    # elements of one left edge have no gap between them, so that edges need to be looked at once each
    gap = lambda x, i: F.struct((F.get("_xs", i - 1) - x).alias("less"), x.alias("x0"), F.get("_xs", i - 1).alias("before"))
    wide = once("_right", lambda right: F.filter(F.transform("_xs", gap), lambda g: (-g["less"] > 50) & (-g["less"] > 0.05 * right)))
    rows = rows.select(*PAGE, F.filter("_e", lambda e: e["y0"].isNotNull()).alias("_e"), F.get("_e", F.lit(0))["font_size"].alias("_size"), sizes.alias("_sizes"), F.array_sort(wide).alias("_wide"))
    mean = F.try_divide(F.aggregate("_sizes", F.lit(0.0), lambda acc, v: acc + v), F.size("_sizes"))
    middle = F.get("_wide", (F.size("_wide") / 2).cast("int"))
    rows = rows.select(*PAGE, "_e", (F.when(F.col("_size") > 0, mean).otherwise(12.0) * 0.8).alias("_gap"), F.when(F.size("_wide") >= 2, (middle["before"] + middle["x0"]) / 2).alias("_boundary"))
    rows = rows.withColumn("_first", once("_gap", lambda gap: _line_starts("_e", gap)))

    def line(own: Column, boundary: Column) -> Column:
        placed = F.transform(own, lambda e: F.struct(F.when(boundary <= e["x0"], 1).otherwise(0).alias("column_no"), e["x0"].alias("x0"), e["seq"].alias("seq")))
        return F.struct(F.get(own, (F.size(own) / 2).cast("int"))["y0"].alias("line_median"), F.get(own, F.lit(0))["y0"].alias("line_y"), F.array_sort(placed)["seq"].alias("seqs"))

    lines = F.array_sort(once("_boundary", lambda boundary: F.transform(parts("_e", "_first"), lambda own: line(own, boundary))))
    rows = rows.select(*PAGE, F.posexplode_outer(F.flatten(lines["seqs"])).alias("at", "seq")).where("at is not null")
    return rows.select(*PAGE, "seq", (F.col("at") + 1).alias("order_no"))


def can_merge(a: Column, b: Column) -> Column:
    """Whether element b continues element a: same line, near, like sizes, no sentence break between."""
    ends, starts = F.right(strip(a["text"]), F.lit(1)).rlike("[.!?。！？;；：]"), strip(b["text"]).rlike(r"^[\p{Lu}\p{Nd}]")
    sizes = (a["font_size"] > 0) & (b["font_size"] > 0) & (F.abs(a["font_size"] - b["font_size"]) > SIZE_GAP)
    return (
        (F.length(a["text"]) > 0) & (F.length(b["text"]) > 0) & (F.abs(a["y0"] - b["y0"]) <= LINE_GAP) & (b["x0"] - a["x1"] <= MERGE_GAP)
        & ~is_blank(a["text"]) & ~(ends & starts) & ~sizes
    )


def needs_space(a: Column, b: Column) -> Column:
    """A gap above 5, or Latin letters or digits on both sides."""
    letters = F.right(a["text"], F.lit(1)).rlike("[A-Za-z0-9]") & F.substring(b["text"], 1, 1).rlike("[A-Za-z0-9]")
    return (b["x0"] - a["x1"] > SPACE_GAP) | letters


def _marks(rows: str) -> Column:
    """A letter for each of an array's elements in order: n for one that begins a merged element, j for one that joins it, s for one that joins it after a space.

    Both rules ask a merged text for its end only, so what they ask of texts is
    taken once an element, before the fold.
    """

    def seen(e: Column) -> Column:
        own = F.struct(F.length(e["text"]) > 0, F.coalesce(e["t"], F.lit("")) == "", F.right(e["t"], F.lit(1)).rlike("[.!?。！？;；：]"), e["t"].rlike(r"^[\p{Lu}\p{Nd}]"), F.substring(e["text"], 1, 1).rlike("[A-Za-z0-9]"), F.right(e["text"], F.lit(1)).rlike("[A-Za-z0-9]"))
        return F.struct(*(e[c].cast("double").alias(c) for c in ("x0", "x1", "y0", "font_size")), own.cast("struct<some:boolean,blank:boolean,ends:boolean,starts:boolean,head:boolean,tail:boolean>").alias("says"))

    kind = "struct<x1:double,y0:double,font_size:double,full:boolean,ends:boolean,tail:boolean,marks:string>"

    def step(a: Column, b: Column) -> Column:
        says = b["says"]
        sizes = (a["font_size"] > 0) & (b["font_size"] > 0) & (F.abs(a["font_size"] - b["font_size"]) > SIZE_GAP)
        joins = a["full"] & says["some"] & (F.abs(a["y0"] - b["y0"]) <= LINE_GAP) & (b["x0"] - a["x1"] <= MERGE_GAP) & ~(a["ends"] & says["starts"]) & ~sizes
        spaced = (b["x0"] - a["x1"] > SPACE_GAP) | (a["tail"] & says["head"])
        ends = F.when(says["blank"], a["ends"]).otherwise(says["ends"])
        joined = F.struct(F.greatest(a["x1"], b["x1"]), F.least(a["y0"], b["y0"]), a["font_size"], F.lit(True), ends, says["tail"], F.concat(a["marks"], F.when(spaced, "s").otherwise("j")))
        return F.when(joins, joined.cast(kind)).otherwise(F.struct(b["x1"], b["y0"], b["font_size"], ~says["blank"], says["ends"], says["tail"], F.concat(a["marks"], F.lit("n"))).cast(kind))

    start = F.struct(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(False), F.lit(False), F.lit(False), F.lit("")).cast(kind)
    stripped = F.transform(rows, lambda e: F.struct(*(e[c].alias(c) for c in ("text", "x0", "x1", "y0", "font_size")), strip(e["text"]).alias("t")))
    return F.split(F.aggregate(F.transform(stripped, seen), start, step, lambda a: a["marks"]), "")


def parts(rows: str, firsts: str) -> Column:
    """An array in pieces that begin at the places `firsts`."""
    return F.transform(firsts, lambda f, i: F.slice(rows, f + 1, F.coalesce(F.get(firsts, i + 1), F.size(rows)) - f))


def merged_in(sheets: DataFrame, array: str = "ordered", keep: tuple[str, ...] = ()) -> DataFrame:
    """Pages with ``merged``: :func:`merge_adjacent` for pages that hold their elements in order in an array (seq, text, box), the merged ones likewise; keep: further columns."""
    rows = sheets.select(*PAGE, array, *keep, _marks(array).alias("_marks"))
    begins = F.array_compact(F.transform("_marks", lambda m, i: F.when(m == "n", i)))
    part = lambda e, i: F.struct(*(e[c].alias(c) for c in ("seq", "x0", "y0", "x1", "y1")), F.concat(F.when(F.get("_marks", i) == "s", " ").otherwise(""), e["text"]).alias("p"))
    rows = rows.select(*PAGE, *keep, F.transform(array, part).alias("_e"), begins.alias("_first"))

    def one(own: Column) -> Column:
        low, high = ({c: f(own[c]) for c in cs} for f, cs in ((F.array_min, ("x0", "y0")), (F.array_max, ("x1", "y1"))))
        return F.struct(F.get(own, F.lit(0))["seq"].alias("seq"), F.array_join(own["p"], "").alias("text"), *(v.alias(c) for c, v in (low | high).items()))

    return rows.select(*PAGE, *keep, F.transform(parts("_e", "_first"), one).alias("merged"))


def merge_adjacent(ordered: DataFrame) -> DataFrame:
    """Merges each element into the one before it where :func:`can_merge` holds: a left fold over a page's ordered elements.

    ordered: has ``order_no``. A merged element keeps the first one's font and
    the union of the boxes. The fold over a page's array carries the last merged
    element's bounds and end and writes one letter an element: new, joined or
    joined with a space. The groups that these letters make are then aggregated
    within the page, without another shuffle.
    """
    types = {"order_no": "int", "seq": "int", "text": "string", "x0": "double", "y0": "double", "x1": "double", "y1": "double", "font_size": "double", "is_bold": "boolean"}
    per = ordered.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(*(F.col(c).cast(t).alias(c) for c, t in types.items())))).alias("e"))
    marked = per.select(*PAGE, "e", _marks("e").alias("marks"))
    rows = marked.select(*PAGE, "marks", F.posexplode("e").alias("at", "m")).select(*PAGE, F.element_at("marks", F.col("at") + 1).alias("mark"), "m.*")
    w = Window.partitionBy(*PAGE).orderBy("order_no")
    rows = rows.withColumn("merged_no", F.count_if(F.col("mark") == "n").over(w).cast("int") - 1)
    part = F.concat(F.when(F.col("mark") == "s", " ").otherwise(""), "text")
    first = lambda c: F.min_by(c, "order_no").alias(c)
    return rows.groupBy(*PAGE, "merged_no").agg(
        F.min("order_no").alias("order_no"), first("seq"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order_no", part.alias("p")))), lambda e: e["p"]), "").alias("text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), first("font_size"), first("is_bold"),
    )


def tenths(value) -> Column:
    """A double rounded to tenths by its binary value, halves to the even tenth (0.15, which is a little less, to 0.1); exact, from built-in operations.

    Ten times the value is taken in two parts that add up without rounding.
    """
    y = _c(value)
    big = y * 134217729.0
    high = big - (big - y)
    ten = y * 10.0
    rest = (high * 10.0 - ten) + (y - high) * 10.0
    low = F.floor(ten)
    over = ten - low
    up = (over > 0.5) | ((over == 0.5) & ((rest > 0) | ((rest == 0) & (low % 2 != 0))))
    return (low + F.when(up, 1).otherwise(0)) / F.lit(10.0)


def joined_lines(elements: DataFrame) -> DataFrame:
    """Text of each page: elements of one height, rounded to tenths, form a line, joined by spaces in x order, lines by line breaks."""
    lines = elements.groupBy(*PAGE, tenths("y0").alias("ykey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "seq", "text"))), lambda e: e["text"]), " ").alias("line"))
    return lines.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ykey", "line"))), lambda e: e["line"]), "\n").alias("text"))


def in_box(elements: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Text of the elements wholly inside a box, by falling y0 and rising x0, a row for each page that has some."""
    inside = elements.where((F.col("x0") >= x0) & (F.col("y0") >= y0) & (F.col("x1") <= x1) & (F.col("y1") <= y1))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("y0")).alias("k"), "x0", "seq", "text")))
    return inside.groupBy(*PAGE).agg(F.array_join(F.transform(rows, lambda e: e["text"]), "\n").alias("text"))


def outside_regions(elements: DataFrame, regions: DataFrame) -> DataFrame:
    """Elements whose centre lies in no region of their page, bounds included: a join by grid cells, then an anti join by place."""
    return elements.join(spatial.centred_in(elements, regions, PAGE, "seq"), [*PAGE, "seq"], "left_anti")


def body_text(pages: DataFrame, elements: DataFrame, regions: DataFrame) -> DataFrame:
    """``doc_id, page_number, body_text``: raw text of pages without regions, else the lines of the elements outside them."""
    with_regions = regions.select(*PAGE).distinct().withColumn("has", F.lit(True))
    kept = joined_lines(outside_regions(elements, regions)).withColumnRenamed("text", "kept")
    both = pages.select(*PAGE, "raw_text").join(with_regions, PAGE, "left").join(kept, PAGE, "left")
    return both.select(*PAGE, F.when(F.col("has"), F.coalesce("kept", F.lit(""))).otherwise(F.coalesce("raw_text", F.lit(""))).alias("body_text"))


def outside_of(array: str = "lines", regions: str = "edges") -> Column:
    """:func:`outside_regions` for pages that hold their elements and regions in arrays: the array of the elements outside."""
    known = F.filter(regions, spatial.is_finite)
    middle = lambda e, a: (e[f"{a}0"] + e[f"{a}1"]) / 2
    inside = lambda e, r: middle(e, "x").between(r["x0"], r["x1"]) & middle(e, "y").between(r["y0"], r["y1"])
    return F.when(F.size(regions) > 0, F.filter(array, lambda e: ~F.coalesce(F.exists(known, lambda r: inside(e, r)), F.lit(False)))).otherwise(F.col(array))


def body_text_of(sheets: DataFrame, array: str = "lines", regions: str = "edges", keep: tuple[str, ...] = ()) -> DataFrame:
    """:func:`body_text` for pages that hold their elements and regions in arrays beside their ``raw_text``: each page by itself, nothing is shuffled; keep: further columns."""
    some = F.size(regions) > 0
    rows = F.transform(outside_of(array, regions), lambda e: F.struct(tenths(e["y0"]).alias("ykey"), e["x0"].alias("x0"), e["seq"].alias("seq"), e["text"].alias("text")))
    kept = sheets.select(*PAGE, "raw_text", some.alias("_some"), F.when(some, F.array_sort(rows)).alias("_e"), *keep)
    return kept.select(*PAGE, *keep, F.when(F.col("_some"), _joined("_e")).otherwise(F.coalesce("raw_text", F.lit(""))).alias("body_text"))


def text_statistics(pages: DataFrame, elements: DataFrame) -> DataFrame:
    """Per page: characters, words, lines (distinct whole y0), mean font size, whether a font is 16 or larger; zeros without elements."""
    size = F.when(F.col("font_size") > 0, F.col("font_size"))
    per = elements.groupBy(*PAGE).agg(
        F.sum(F.length("text")).alias("char_count"), F.count_distinct(F.col("y0").cast("int")).alias("line_count"), F.avg(size).alias("avg_font_size"), F.bool_or(F.col("font_size") >= 16).alias("has_large_font")
    )
    out = pages.select(*PAGE, "raw_text").join(per, PAGE, "left")
    some = F.col("char_count").isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        *PAGE, zero("char_count").cast("long").alias("char_count"), F.when(some, word_count("raw_text")).otherwise(0).cast("long").alias("word_count"),
        zero("line_count").cast("long").alias("line_count"), F.coalesce("avg_font_size", F.lit(0.0)).alias("avg_font_size"), F.coalesce("has_large_font", F.lit(False)).alias("has_large_font"),
    )


def text_statistics_of(sheets: DataFrame, array: str = "lines") -> DataFrame:
    """:func:`text_statistics` for pages that hold their elements in an array beside their ``raw_text``: each page by itself, nothing is shuffled."""
    some = F.size(array) > 0
    sizes = F.filter(F.transform(array, lambda e: e["font_size"].cast("double")), lambda v: v > 0)
    mean = F.try_divide(F.aggregate(sizes, F.lit(0.0), lambda acc, v: acc + v), F.size(sizes))
    chars = F.aggregate(array, F.lit(0).cast("long"), lambda acc, e: acc + F.coalesce(F.length(e["text"]), F.lit(0)))
    lines = F.size(F.array_distinct(F.array_compact(F.transform(array, lambda e: e["y0"].cast("int")))))
    zero = lambda c: F.when(some, c).otherwise(0).cast("long")
    return sheets.select(
        *PAGE, zero(chars).alias("char_count"), zero(word_count("raw_text")).alias("word_count"), zero(lines).alias("line_count"),
        F.coalesce(mean, F.lit(0.0)).alias("avg_font_size"), F.coalesce(F.exists(array, lambda e: e["font_size"] >= 16), F.lit(False)).alias("has_large_font"),
    )


def overlap_pairs(elements: DataFrame) -> DataFrame:
    """Pairs of elements of a page whose boxes meet, the earlier first: a join by page and grid cell."""
    return spatial.self_pairs(elements, PAGE, "seq").select(*PAGE, F.col("first").alias("first_seq"), F.col("second").alias("second_seq"))


def overlap_groups(elements: DataFrame) -> DataFrame:
    """Greedy groups of two or more: an element joins the first group whose first member its box meets; groups are numbered from 0 on each page, those of one member too."""
    heads = spatial.greedy_heads(spatial.self_pairs(elements, PAGE, "seq"), PAGE).withColumnRenamed("second", "seq")
    rows = elements.select(*PAGE, "seq").join(heads, [*PAGE, "seq"], "left").withColumn("head", F.coalesce("head", "seq"))
    page = Window.partitionBy(*PAGE)
    rows = rows.withColumn("group_no", F.dense_rank().over(page.orderBy("head")) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*PAGE, "head")))
    return rows.where("n >= 2").select(*PAGE, "group_no", "seq")


def _met(sheets: DataFrame, array: str) -> DataFrame:
    """Pages with ``_seqs`` of their elements and ``_pairs`` (second, first) of those whose boxes meet, in rising order.

    A fold over the page's boxes by rising y0 keeps those that the next box can
    still meet, so a page costs its boxes times those that share a height.
    """
    box = lambda e: F.struct(e["y0"].cast("double").alias("y0"), e["seq"].alias("seq"), *(e[c].cast("double").alias(c) for c in ("x0", "x1", "y1")))
    boxes = F.array_sort(F.transform(F.filter(array, spatial.is_finite), box))
    rows = sheets.select(*PAGE, F.col(array)["seq"].alias("_seqs"), boxes.alias("_b"))
    kind = rows.schema["_b"].dataType
    pair = f"array<struct<second:{kind.elementType['seq'].dataType.simpleString()},first:{kind.elementType['seq'].dataType.simpleString()}>>"
    start = F.struct(F.array().cast(kind).alias("open"), F.array().cast(pair).alias("pairs"))

    def step(acc: Column, b: Column) -> Column:
        met = F.filter(acc["open"], lambda a: spatial.meets(a, b))
        found = F.transform(met, lambda a: F.struct(F.greatest(a["seq"], b["seq"]).alias("second"), F.least(a["seq"], b["seq"]).alias("first")))
        return F.struct(F.concat(F.filter(acc["open"], lambda a: a["y1"] >= b["y0"]), F.array(b)).alias("open"), F.concat(acc["pairs"], found).alias("pairs"))

    return rows.select(*PAGE, "_seqs", F.aggregate("_b", start, step, lambda acc: F.array_sort(acc["pairs"])).alias("_pairs"))


def overlap_pairs_of(sheets: DataFrame, array: str = "words") -> DataFrame:
    """:func:`overlap_pairs` for pages that hold their elements in an array: each page by itself, nothing is shuffled."""
    # outer, here and below: the inner form would meet all boxes once more to look for empty arrays
    rows = _met(sheets, array).select(*PAGE, F.inline_outer("_pairs"))
    return rows.where("second is not null").select(*PAGE, F.col("first").alias("first_seq"), F.col("second").alias("second_seq"))


def overlap_groups_of(sheets: DataFrame, array: str = "words") -> DataFrame:
    """:func:`overlap_groups` for pages that hold their elements in an array.

    A fold over the page's pairs by their later element: it joins the earlier
    one, unless that one has joined another, or it has joined one itself.
    """
    rows = _met(sheets, array)
    seq = rows.schema["_seqs"].dataType.elementType.simpleString()
    start = F.array().cast(f"array<struct<head:{seq},seq:{seq}>>")

    def step(acc: Column, p: Column) -> Column:
        known = F.exists(acc, lambda j: (j["seq"] == p["second"]) | (j["seq"] == p["first"]))
        return F.when(known, acc).otherwise(F.concat(acc, F.array(F.struct(p["first"].alias("head"), p["second"].alias("seq")))))

    rows = rows.select(*PAGE, "_seqs", F.aggregate("_pairs", start, step).alias("_joined"))
    number = lambda head: F.size(F.filter("_seqs", lambda s: s < head)) - F.size(F.filter("_joined", lambda j: j["seq"] < head))
    heads = F.transform(F.array_distinct(F.col("_joined")["head"]), lambda h: F.struct(h.alias("head"), h.alias("seq")))
    members = F.transform(F.concat(heads, "_joined"), lambda m: F.struct(number(m["head"]).alias("group_no"), m["seq"].alias("seq")))
    return rows.select(*PAGE, F.inline_outer(members)).where("seq is not null")


def standard_order(elements: DataFrame) -> DataFrame:
    """elements with ``order_no``: by falling y0, then rising x0."""
    return elements.withColumn("order_no", F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.desc("y0"), "x0", "seq")))


def region_order(elements: DataFrame, sidebars: DataFrame, bodies: DataFrame) -> DataFrame:
    """elements with ``bucket`` and ``order_no``: what lies in a body first, then the rest, then sidebars; in each by falling y0 and rising x0."""

    def inside(regions: DataFrame, name: str) -> DataFrame:
        whole = regions.select(*PAGE, F.coalesce("x0", F.lit(0.0)).alias("x0"), F.coalesce("y0", F.lit(0.0)).alias("y0"), F.coalesce("x1", F.lit(999999.0)).alias("x1"), F.coalesce("y1", F.lit(999999.0)).alias("y1"))
        return spatial.centred_in(elements, whole, PAGE, "seq").withColumn(name, F.lit(True))

    both = elements.join(inside(sidebars, "_side"), [*PAGE, "seq"], "left").join(inside(bodies, "_body"), [*PAGE, "seq"], "left")
    both = both.withColumn("bucket", F.when(F.col("_side"), 2).when(F.col("_body"), 0).otherwise(1)).drop("_side", "_body")
    return both.withColumn("order_no", F.row_number().over(Window.partitionBy(*PAGE).orderBy("bucket", F.desc("y0"), "x0", "seq")))


def merge_complex(elements: DataFrame, sidebars: DataFrame, bodies: DataFrame) -> DataFrame:
    """Elements other than captions and callouts in region order and merged, then the captions, then the callouts."""
    kind = elements.withColumn("kind", caption_or_callout())
    main = merge_adjacent(region_order(kind.where("kind = 'remaining'").drop("kind"), sidebars, bodies)).select(*PAGE, F.lit(0).alias("part"), F.col("merged_no").alias("n"), "text")
    rest = kind.where("kind <> 'remaining'").select(*PAGE, F.when(F.col("kind") == "caption", 1).otherwise(2).alias("part"), F.col("seq").alias("n"), "text")
    return main.unionByName(rest).withColumn("order_no", F.row_number().over(Window.partitionBy(*PAGE).orderBy("part", "n"))).select(*PAGE, "order_no", "part", "text")


def _known(regions: str) -> Column:
    """The regions of an array that may hold something, as :func:`region_order` takes them."""
    far = {"x0": 0.0, "y0": 0.0, "x1": 999999.0, "y1": 999999.0}
    return F.filter(F.transform(regions, lambda r: F.struct(*(F.coalesce(r[c], F.lit(v)).alias(c) for c, v in far.items()))), spatial.is_finite)


def _bucketed(array: str | Column, sidebars: str, bodies: str) -> Column:
    """Elements of an array (seq, text, box, font size and weight) in the order of :func:`region_order`, with their ``bucket``."""
    middle = lambda e, a: (e[f"{a}0"] + e[f"{a}1"]) / 2
    inside = lambda e, regions: F.coalesce(F.exists(regions, lambda r: middle(e, "y").between(r["y0"], r["y1"]) & middle(e, "x").between(r["x0"], r["x1"])), F.lit(False))
    bucket = lambda e, side, body: F.when(inside(e, side), 2).when(inside(e, body), 0).otherwise(1)
    row = lambda e, side, body: F.struct(bucket(e, side, body).alias("bucket"), (-e["y0"]).alias("down"), *(e[c].alias(c) for c in ("x0", "seq", "text", "y0", "x1", "y1", "font_size", "is_bold")))
    regions = F.struct(_known(sidebars).alias("side"), _known(bodies).alias("body"))
    return F.array_sort(once(regions, lambda r: F.transform(array, lambda e: row(e, r["side"], r["body"]))))


def region_order_of(sheets: DataFrame, array: str = "lines", sidebars: str = "edges", bodies: str = "bodies") -> DataFrame:
    """``seq, bucket, order_no`` of :func:`region_order` for pages that hold their elements and regions in arrays: each page by itself, nothing is shuffled."""
    rows = sheets.select(*PAGE, F.posexplode_outer(_bucketed(array, sidebars, bodies)).alias("at", "e")).where("e is not null")
    return rows.select(*PAGE, "e.seq", "e.bucket", (F.col("at") + 1).alias("order_no"))


def merge_complex_of(sheets: DataFrame, array: str = "lines", sidebars: str = "edges", bodies: str = "bodies") -> DataFrame:
    """:func:`merge_complex` for pages that hold their elements and regions in arrays: each page by itself, nothing is shuffled."""
    rows = sheets.select(*PAGE, sidebars, bodies, kinds_in(array).alias("_kinds"))
    of = lambda kind: F.filter("_kinds", lambda k: k["kind"] == kind)["e"]
    rows = rows.select(*PAGE, _bucketed(of("remaining"), sidebars, bodies).alias("ordered"), of("caption").alias("_captions"), of("callout").alias("_callouts"))
    rows = merged_in(rows, keep=("_captions", "_callouts"))
    main = F.transform("merged", lambda m: F.struct(F.lit(0).alias("part"), m["text"].alias("text")))
    rest = lambda c, part: F.transform(F.array_sort(F.transform(c, lambda e: F.struct(e["seq"].alias("seq"), e["text"].alias("text")))), lambda e: F.struct(F.lit(part).alias("part"), e["text"].alias("text")))
    whole = rows.select(*PAGE, F.posexplode_outer(F.concat(main, rest("_captions", 1), rest("_callouts", 2))).alias("at", "e")).where("e is not null")
    return whole.select(*PAGE, (F.col("at") + 1).alias("order_no"), "e.part", "e.text")


def has_content(raw_text="raw_text", n_images="n_images", n_tables="n_tables", ocr_text="ocr_text") -> Column:
    return (F.coalesce(_c(raw_text), F.lit("")) != "") | (F.coalesce(_c(n_images), F.lit(0)) > 0) | (F.coalesce(_c(n_tables), F.lit(0)) > 0) | (F.coalesce(_c(ocr_text), F.lit("")) != "")


def all_text(body="body_text", ocr_text="ocr_text") -> Column:
    """Body and recognised text, an empty line between."""
    ocr = F.coalesce(_c(ocr_text), F.lit(""))
    return F.concat_ws("\n\n", F.nullif(_c(body), F.lit("")), F.when(ocr != "", F.concat(F.lit("[OCR]\n"), ocr)))
