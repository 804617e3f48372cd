"""Captions to figure boxes: caption search, grouping by height, side-by-side splits, crops by graphics and gaps.

One page's arrays are folded in order where a rule depends on what was kept before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import center_inside, holds_nested

from .tables import is_genuine

#: Fixed values.
CAPTION = r"(?i)Figure\s+[\d\-]+\s*[:.]|Fig\.?\s*[\d\-]+|图\s*[\d\-]+(?:[（(]\s*[A-Za-z0-9]\s*[）)])?"
LIST_OF_FIGURES = r"(?im)^\s*List\s+of\s+figures\s*$"
LEFT, RIGHT_MARGIN, RIGHT, TOP, FOOTER = 55.0, 45.0, 545.0, 84.0, 70
GENERIC = "插图"


def caption_parts(text: Column) -> Column:
    """(start, end, text) of every caption in a line; none where something stands before the first one."""
    marks = F.regexp_extract_all(text, F.lit("(?i)(" + CAPTION[4:] + ")"), F.lit(1))
    rest = F.split(text, CAPTION, -1)
    lengths = F.transform(rest, F.length)
    upto = lambda k: F.aggregate(F.slice(lengths, 1, k + 1), F.lit(0), lambda a, v: a + v) + F.aggregate(F.slice(marks, 1, k), F.lit(0), lambda a, m: a + F.length(m))
    parts = F.transform(marks, lambda m, k: F.struct(upto(k).alias("start"), (upto(k) + F.length(m)).alias("stop"), F.btrim(F.concat(m, F.get(rest, k + 1))).alias("text")))
    return F.when((F.size(marks) > 0) & (F.btrim(F.get(rest, 0)) == ""), parts).otherwise(F.array().cast("array<struct<start:int,stop:int,text:string>>"))


def captions(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """doc_id, caption_no, text, x0, y0, x1, y1 of captions outside genuine tables.

    lines (doc_id, line_no, text, box); tables (doc_id, box_no, box, rows, cells).
    """
    real = tables.where(is_genuine(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.size("rows"), F.col("cells")))
    outer = real.alias("o").join(tables.alias("i"), (F.col("o.doc_id") == F.col("i.doc_id")) & (F.col("o.box_no") != F.col("i.box_no")) & holds_nested("o", "i"), "left_anti")
    free = lines.alias("l").join(outer.alias("b"), (F.col("l.doc_id") == F.col("b.doc_id")) & center_inside("l", "b"), "left_anti")
    parts = free.where(F.col("text").rlike(CAPTION)).withColumn("parts", caption_parts(F.col("text"))).withColumn("n", F.size("parts"))
    each = parts.select("doc_id", "line_no", "x0", "y0", "x1", "y1", F.greatest(F.length("text"), F.lit(1)).alias("len"), "n", "parts", F.posexplode("parts").alias("k", "p"))
    width = F.greatest(F.lit(1.0), F.col("x1").cast("double") - F.col("x0"))
    left = F.when(F.col("k") == 0, F.col("x0").cast("double")).otherwise(F.col("x0") + width * (F.get("parts", F.col("k") - 1)["stop"] / F.col("len")))
    right = F.when(F.col("k") == F.col("n") - 1, F.col("x1").cast("double")).otherwise(F.col("x0") + width * (F.get("parts", F.col("k") + 1)["start"] / F.col("len")))
    order = Window.partitionBy("doc_id").orderBy("line_no", "k")
    named = each.select("doc_id", "line_no", "k", F.col("p.text").alias("text"), left.alias("x0"), F.col("y0").cast("double").alias("y0"), right.alias("x1"), F.col("y1").cast("double").alias("y1")).where("text <> ''")
    return named.withColumn("caption_no", (F.row_number().over(order) - 1).cast("long")).drop("line_no", "k")


def height_groups(found: Column) -> Column:
    """Group number of each caption of a page, in order: the first group whose first member's middle is within 12 points."""
    kind = "struct<firsts:array<double>,groups:array<int>>"
    middle = lambda c: (c["y0"] + c["y1"]) / 2

    def step(a: Column, c: Column) -> Column:
        hit = F.array_min(F.filter(F.transform(a["firsts"], lambda f, k: F.when(F.abs(middle(c) - f) <= 12, k)), lambda k: k.isNotNull()))
        return F.struct(F.when(hit.isNull(), F.concat(a["firsts"], F.array(middle(c)))).otherwise(a["firsts"]).alias("firsts"), F.concat(a["groups"], F.array(F.coalesce(hit, F.size(a["firsts"])))).alias("groups")).cast(kind)

    start = F.struct(F.array().cast("array<double>").alias("firsts"), F.array().cast("array<int>").alias("groups"))
    return F.aggregate(found, start, step, lambda a: a["groups"])


def first_run_bottom(centers: Column, gap: float = 60.0) -> Column:
    """The last of the sorted values before the first gap."""
    ordered = F.array_sort(centers)
    step = lambda a, v: F.when(a["open"] & (v - a["last"] <= gap), F.struct(v.alias("last"), F.lit(True).alias("open"))).otherwise(F.struct(a["last"].alias("last"), F.lit(False).alias("open")))
    return F.aggregate(ordered, F.struct(F.get(ordered, 0).alias("last"), F.lit(True).alias("open")), step, lambda a: F.coalesce(a["last"], F.lit(0.0)))


def grouped_captions(found: DataFrame, rect: tuple) -> DataFrame:
    """Captions with group_no, the x-range of their crop, and the bottom of the group before and the top of the group after."""
    page = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("caption_no", "text", "x0", "y0", "x1", "y1"))).alias("all"))
    rows = page.withColumn("g", height_groups(F.col("all"))).select("doc_id", F.explode(F.transform("all", lambda c, k: F.struct(c.alias("c"), F.get("g", k).alias("group_no")))).alias("e")).select("doc_id", "e.c.*", "e.group_no")
    lowest, highest = max(LEFT, rect[0]), min(rect[2] - RIGHT_MARGIN, RIGHT)
    center = (F.col("x0") + F.col("x1")) / 2
    side = Window.partitionBy("doc_id", "group_no").orderBy(center, "caption_no")
    before, after = F.lag(center).over(side), F.lead(center).over(side)
    left = F.when(before.isNull(), F.lit(float(lowest))).otherwise(F.greatest(F.lit(float(lowest)), (before + center) / 2 - 5))
    right = F.when(after.isNull(), F.lit(float(highest))).otherwise(F.least(F.lit(float(highest)), (after + center) / 2 + 5))
    members = Window.partitionBy("doc_id", "group_no")
    placed = rows.withColumn("box_x0", left).withColumn("box_x1", right).withColumn("group_bottom", F.max("y1").over(members)).withColumn("group_top", F.min("y0").over(members))
    groups = placed.select("doc_id", "group_no", "group_bottom", "group_top").distinct()
    order = Window.partitionBy("doc_id").orderBy("group_no")
    around = groups.select("doc_id", "group_no", F.lag("group_bottom", 1, TOP).over(order).alias("previous_bottom"), F.lead("group_top", 1, float(rect[3] - rect[1])).over(order).alias("next_top"))
    return placed.join(around, ["doc_id", "group_no"])


def figure_boxes(pages: DataFrame, lines: DataFrame, tables: DataFrame, graphics: DataFrame, rect: tuple) -> DataFrame:
    """doc_id, caption, x0, y0, x1, y1, sort_y of figures.

    pages (doc_id, text) of which lists of figures are left out; graphics (doc_id, kind image or
    drawing, x0, y0, x1, y1).
    """
    height = float(rect[3] - rect[1])
    wanted = pages.where(~F.col("text").rlike(LIST_OF_FIGURES)).select("doc_id")
    found = grouped_captions(captions(lines.join(wanted, "doc_id", "left_semi"), tables), rect)
    drawn = graphics.groupBy("doc_id").agg(F.collect_list(F.struct(((F.col("y0") + F.col("y1")) / 2).cast("double").alias("center"), F.col("y0").cast("double").alias("top"), (F.col("y1") - F.col("y0")).cast("double").alias("high"), (F.col("kind") == "image").alias("image"))).alias("drawn"))
    written = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.bround(F.col("y0").cast("double"), 1).alias("o"), F.col("x0").cast("double").alias("x0"), F.col("line_no"), F.col("y0").cast("double").alias("y0"), F.col("y1").cast("double").alias("y1")))).alias("written"))
    d = found.join(drawn, "doc_id").join(written, "doc_id")
    content = lambda low, high: F.transform(F.filter("drawn", lambda g: (g["center"] > low) & (g["center"] < high) & (g["center"] < height - FOOTER)), lambda g: g["center"])
    d = d.withColumn("above", content(F.col("previous_bottom"), F.col("y0") - 5)).withColumn("below", content(F.col("y1") + 5, F.col("next_top") - 10)).where((F.size("above") > 0) | (F.size("below") > 0))
    prose = F.filter("written", lambda w: (w["y0"] > F.col("previous_bottom")) & (w["y0"] < F.col("y0") - 20.0))
    d = d.withColumn("prose", prose)
    gaps = F.filter(F.transform("prose", lambda w, k: F.struct((F.get("prose", k + 1)["y0"] - w["y1"]).alias("gap"), (w["y1"] + 8.0).alias("at"))), lambda g: g["gap"] >= 18.0)
    floor = F.greatest(F.lit(TOP), F.col("previous_bottom") + 10.0)
    top = F.greatest(floor, F.col("y0") - 480.0)
    top = F.greatest(top, F.coalesce(F.array_max(gaps)["at"], top))
    d = d.withColumn("top", F.greatest(floor, F.least(top, F.col("y0") - 200.0, F.array_min("above") - 8.0)))
    near = F.array_min(F.transform(F.filter("drawn", lambda g: g["image"] & g["top"].between(F.col("top") - 20, F.col("y0") - 5) & (g["high"] >= 20)), lambda g: g["top"]))
    d = d.withColumn("top", F.when(F.size("above") > 0, F.coalesce(near, F.col("top"))).otherwise(F.greatest(F.col("y1") + 3.0, F.col("y0") + 10.0)))
    bottom = F.when(F.size("above") > 0, F.greatest(F.col("top") + 20.0, F.col("y0") - 3.0)).otherwise(F.least(F.col("next_top") - 5.0, first_run_bottom(F.col("below")) + 10.0))
    captioned = d.select("doc_id", F.col("text").alias("caption"), F.col("box_x0").alias("x0"), F.col("top").alias("y0"), F.col("box_x1").alias("x1"), bottom.alias("y1"), (F.col("y0") - 0.1).alias("sort_y")).where(F.col("y1") - F.col("y0") >= 35)
    images = graphics.where("kind = 'image'").join(wanted, "doc_id", "left_semi").where(is_content_image(rect))
    alone = images.alias("i").join(captioned.alias("f"), (F.col("i.doc_id") == F.col("f.doc_id")) & center_inside("i", "f"), "left_anti")
    lowest, highest = float(max(LEFT, rect[0])), float(min(rect[2] - RIGHT_MARGIN, RIGHT))
    return captioned.unionByName(
        alone.select("doc_id", F.lit(GENERIC).alias("caption"), F.greatest(F.lit(lowest), F.col("x0") - 5.0).alias("x0"), (F.col("y0") - 5.0).alias("y0"), F.least(F.lit(highest), F.col("x1") + 5.0).alias("x1"), (F.col("y1") + 5.0).alias("y1"), (F.col("y0") - 0.1).alias("sort_y"))
    )


def is_content_image(rect: tuple) -> Column:
    """Big enough, no background of the page, not in its head or foot."""
    wide, high = rect[2] - rect[0], rect[3] - rect[1]
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return (width >= 60) & (height >= 60) & ~((width > wide * 0.85) & (height > high * 0.85)) & (F.col("y0") >= high * 0.08) & (F.col("y1") <= high * 0.95)
