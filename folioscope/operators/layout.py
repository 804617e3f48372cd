"""Spans to lines, lines to reading order, lines and boxes to Markdown, detections and regions.

Tables are keyed by doc_id; every join has that key, so a page's rows meet after one exchange by
doc_id and box conditions are residuals of an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrays import apart, let, slices
from ..functions.geometry import center_inside, holds_nested, page_to_unit, touching

SMALL, TIGHT, SAME_LINE, RAISED = 0.78, 1.7, 3.0, 0.5
CELL_LINES = 7.0


def join_span_texts(spans: Column) -> Column:
    """Spans (text, x0, y0, x1, y1, size) of one line as text: small ones join without a space, raised ones with a caret."""
    by_place = lambda a, b: F.when(a["x0"] < b["x0"], -1).when(a["x0"] > b["x0"], 1).when(a["y0"] < b["y0"], -1).when(a["y0"] > b["y0"], 1).otherwise(0)

    def piece(ordered: Column, largest: Column, s: Column, k: Column) -> Column:
        def joined(before: Column) -> Column:
            small = s["size"] < largest * SMALL
            middle, middle_before = (s["y0"] + s["y1"]) / 2, (before["y0"] + before["y1"]) / 2
            tight = small | ((s["x0"] - before["x1"] < TIGHT) & (F.abs(middle_before - middle) < SAME_LINE))
            raised = small & (middle < middle_before - RAISED)
            spaced = F.endswith(before["text"], F.lit(" ")) | F.startswith(s["text"], F.lit(" ")) | F.startswith(s["text"], F.lit("\xa0"))
            return F.when(raised, F.concat(F.lit("^"), s["text"])).when(tight | spaced, s["text"]).otherwise(F.concat(F.lit(" "), s["text"]))

        return F.when(k == 0, s["text"]).otherwise(let(F.get(ordered, k - 1), joined))

    def whole(ordered: Column) -> Column:
        largest = F.array_max(F.transform(ordered, lambda s: s["size"]))
        return let(largest, lambda most: F.array_join(F.transform(ordered, lambda s, k: piece(ordered, most, s, k)), ""))

    visible = lambda c: F.ascii(c).between(33, 126)
    squeezed = lambda t: F.when(t.contains("  "), F.regexp_replace(t, " {2,}", " ")).otherwise(t)
    stripped = lambda t: F.when(visible(t) & visible(F.right(t, F.lit(1))), t).otherwise(T.strip(t))
    return F.coalesce(let(let(let(F.array_sort(spans, by_place), whole), squeezed), stripped), F.lit(""))


def join_cell_text(spans: Column) -> Column:
    """Spans of one table cell in reading order: lines by clustered middles, wrapped small lines glued to the line before.

    A span belongs to every line whose center is nearest to its middle. Lines are runs of sorted middles, so that is its own run's
    or a neighbour's, and its ends tell whether a run has any nearer to a neighbour: but for sorting, the work is in proportion to the spans.
    """
    def members(runs: Column, k: Column) -> Column:
        """Middles and places of line k's spans; runs (own, center, low, high)."""
        of = lambda at: F.get(runs, at)
        away = lambda m, at: F.abs(m - of(at)["center"])
        nearest = lambda at: lambda p: away(p["middle"], k) == F.least(away(p["middle"], at - 1), away(p["middle"], at), away(p["middle"], at + 1))
        chosen = lambda at: F.coalesce(F.filter(of(at)["own"], nearest(at)), F.slice(of(k)["own"], 1, 0))
        down = lambda at: away(of(at)["low"], at - 1) <= away(of(at)["low"], at)
        up = lambda at: away(of(at)["high"], at + 1) <= away(of(at)["high"], at)
        return F.when(down(k) | up(k) | up(k - 1) | down(k + 1), F.concat(chosen(k - 1), chosen(k), chosen(k + 1))).otherwise(of(k)["own"])

    def whole(own: Column) -> Column:
        marked = F.filter(F.transform(own, lambda s, k: F.struct(((s["y0"] + s["y1"]) / 2).alias("middle"), k.alias("place"))), lambda p: p["middle"].isNotNull())
        cut = slices(F.sort_array(marked), lambda a, b: apart(a["middle"], b["middle"], CELL_LINES))
        runs = F.transform(cut, lambda g: F.struct(g.alias("own"), (F.aggregate(g, F.lit(0.0), lambda t, p: t + p["middle"]) / F.size(g)).alias("center"), F.get(g, 0)["middle"].alias("low"), F.get(g, F.size(g) - 1)["middle"].alias("high")))
        # Lines are places in own until they are joined: what a transform gives is copied, spans with their texts as well.
        found = let(runs, lambda r: F.transform(r, lambda _, k: F.sort_array(F.transform(members(r, k), lambda p: p["place"]))))
        largest = F.array_max(F.transform(own, lambda s: s["size"]))
        small = lambda g, most: F.coalesce((F.size(g) > 0) & F.forall(g, lambda at: F.get(own, at)["size"] < most * SMALL), F.lit(False))
        merged = F.transform(let(largest, lambda most: slices(found, lambda _, g: ~small(g, most))), F.flatten)
        return F.array_join(F.transform(F.filter(merged, lambda g: F.size(g) > 0), lambda g: join_span_texts(F.transform(g, lambda at: F.get(own, at)))), " ")

    return F.coalesce(let(spans, whole), F.lit(""))


def lines_from_spans(spans: DataFrame) -> DataFrame:
    """Lines of pages from spans (doc_id, block_no, line_no, span_no, text, x0, y0, x1, y1, size, font, lx0, ly0, lx1, ly1), in reading order.

    Blank spans do not count for the text; size and boldness take all spans of a line.
    """
    text = T.normalize_private_use(F.col("text"))
    span = F.when(T.strip(text) != "", F.struct(text.alias("text"), *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1", "size"))))
    rows = spans.groupBy("doc_id", "block_no", "line_no").agg(
        F.sort_array(F.collect_list(F.when(span.isNotNull(), F.struct("span_no", span.alias("s"))))).alias("spans"), F.max("size").alias("size"), F.bool_or(F.lower("font").contains("bold")).alias("bold"), *(F.first(f"l{c}").alias(c) for c in ("x0", "y0", "x1", "y1"))
    )
    named = rows.withColumn("text", join_span_texts(F.transform("spans", lambda x: x["s"]))).where("text <> ''").drop("spans")
    return reading_order(named, "block_no", "line_no").withColumnRenamed("place", "order_no")


def block_counts(lines: DataFrame) -> DataFrame:
    """doc_id, text_blocks: blocks with any text."""
    return lines.groupBy("doc_id").agg(F.count_distinct("block_no").alias("text_blocks"))


def reading_order(lines: DataFrame, *ties: str) -> DataFrame:
    """Adds place, from 0: by the top edge to a tenth of a point, then by the left edge."""
    order = Window.partitionBy("doc_id").orderBy(F.bround(F.col("y0").cast("double"), 1), "x0", *ties)
    return lines.withColumn("place", (F.row_number().over(order) - 1).cast("long"))


def outside(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """Lines whose middle is in none of their page's boxes."""
    return lines.alias("l").join(boxes.alias("b"), (F.col("l.doc_id") == F.col("b.doc_id")) & center_inside("l", "b"), "left_anti")


def inside_tables(spans: DataFrame, tables: DataFrame) -> DataFrame:
    """Spans with box_no of every table of their page that they touch."""
    return spans.alias("s").join(tables.alias("t"), (F.col("s.doc_id") == F.col("t.doc_id")) & touching("s", "t")).select("s.*", "t.box_no")


def outer_tables(tables: DataFrame, figures: DataFrame) -> DataFrame:
    """Tables that hold no nested table and whose middle is in no figure."""
    keep = tables.alias("o").join(tables.alias("i"), (F.col("o.doc_id") == F.col("i.doc_id")) & (F.col("o.box_no") != F.col("i.box_no")) & holds_nested("o", "i"), "left_anti")
    return keep.alias("t").join(figures.alias("f"), (F.col("t.doc_id") == F.col("f.doc_id")) & center_inside("t", "f"), "left_anti")


def clusters(values: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """keys, cluster_no, n, total, center: runs of values whose neighbours are tolerance apart at most."""
    order = Window.partitionBy(*keys).orderBy(value)
    marked = values.where(F.col(value).isNotNull()).withColumn("new", (F.col(value) - F.lag(value).over(order) > tolerance).cast("int"))
    numbered = marked.withColumn("cluster_no", F.sum(F.coalesce("new", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "cluster_no").agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("center"))


def nearest_centers(values: DataFrame, centers: DataFrame, keys: list[str], value: str) -> DataFrame:
    """values with every center of their keys (of ``clusters``) at the least distance; ties give several rows.

    Distances are abs(value * n - total) / n, one rounding at the end: a center that was rounded before would part ties.
    """
    met = values.join(centers.select(*keys, "cluster_no", "n", "total", "center"), keys)
    order = Window.partitionBy(*values.columns).orderBy(F.abs(F.col(value) * F.col("n") - F.col("total")) / F.col("n"))
    return met.withColumn("r", F.rank().over(order)).where("r = 1").drop("r", "n", "total")


def is_heading(text: Column, bold: Column, size: Column) -> Column:
    return (F.lower(text) == "index of contents") | text.rlike(r"\A\d+(?:\.\d+)*\s+[A-Z]") | (bold & (size >= 12) & (F.length(text) < 120))


def items(lines: DataFrame, tables: DataFrame, figures: DataFrame) -> DataFrame:
    """Lines outside boxes, tables and figures of pages in layout order: doc_id, place, kind, text, and box.

    lines (doc_id, line_no, text, x0, y0, x1, y1, size, bold), tables (doc_id, box_no, box, text,
    markdown), figures (doc_id, box_no, box, caption, sort_y).
    """
    free = outside(outside(lines, tables), figures)
    kind = lambda name, df, y, **more: df.select("doc_id", F.lit(name).alias("kind"), y.cast("double").alias("y"), *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")), *(v.alias(k) for k, v in more.items()))
    all_of = (
        kind("line", free, F.col("y0"), no=F.col("line_no").cast("long"), text=F.col("text"), markdown=F.lit(None).cast("string"), heading=is_heading(F.col("text"), F.col("bold"), F.col("size")))
        .unionByName(kind("table", tables, F.col("y0"), no=F.col("box_no").cast("long"), text=F.col("text"), markdown=F.col("markdown"), heading=F.lit(False)))
        .unionByName(kind("figure", figures, F.col("sort_y"), no=F.col("box_no").cast("long"), text=F.col("caption"), markdown=F.lit(None).cast("string"), heading=F.lit(False)))
    )
    rank = F.when(F.col("kind") == "line", 1).when(F.col("kind") == "table", 2).otherwise(0)
    order = Window.partitionBy("doc_id").orderBy(F.bround("y", 1), "x0", F.when(F.col("kind") == "figure", 0).otherwise(1), rank, "no")
    return all_of.withColumn("place", (F.row_number().over(order) - 1).cast("long"))


def layout_pages(ordered: DataFrame, rect: tuple, session: Column, page_num: Column) -> DataFrame:
    """doc_id, markdown, detections of each page from ordered items."""
    box = page_to_unit([F.col(c) for c in ("x0", "y0", "x1", "y1")], [F.lit(float(v)) for v in rect])
    coords = F.array_join(box.cast("array<string>"), ",")
    link = F.when(session != "", F.concat(F.lit("/api/region-image/"), T.quote_path(session), F.lit("/"), page_num.cast("string"), F.lit("/"), T.quote_path(coords))).otherwise(coords)
    part = (
        F.when(F.col("kind") == "table", F.concat(F.lit("\n"), F.col("markdown"), F.lit("\n")))
        .when(F.col("kind") == "figure", F.concat(F.lit("\n!["), F.col("text"), F.lit("]("), link, F.lit(")\n")))
        .when(F.col("heading"), F.concat(F.lit("\n## "), F.col("text")))
        .otherwise(F.col("text"))
    )
    kind = F.when(F.col("kind") == "table", "table").when(F.col("kind") == "figure", "image").when(F.col("heading"), "title").otherwise("text")
    detection = F.struct(kind.alias("type"), box.alias("bbox"), F.col("text"))
    pages = ordered.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("place", part.alias("part"), detection.alias("d")))).alias("all"), F.first(page_num).alias("page"))
    markdown = T.squeeze_blank_lines(F.array_join(F.transform("all", lambda x: x["part"]), "\n"))
    return pages.select("doc_id", T.convert_math(markdown, F.col("page")).alias("markdown"), F.transform("all", lambda x: x["d"]).alias("detections"))


def regions(lines: DataFrame, tables: DataFrame, figures: DataFrame, rect: tuple) -> DataFrame:
    """Regions of pages: tables and figures by number, lines by their number before any is left out."""
    box = page_to_unit([F.col(c) for c in ("x0", "y0", "x1", "y1")], [F.lit(float(v)) for v in rect])
    region = lambda name, df, number, kind, content: df.select("doc_id", F.concat(F.lit(f"{name}-"), number.cast("string")).alias("region_id"), kind.alias("type"), *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")), box.alias("normalized_bbox"), F.lit("native").alias("source"), content.alias("content"), F.lit(None).cast("double").alias("confidence"))
    numbered = reading_order(lines, "line_no")
    free = outside(outside(numbered, tables), figures)
    heading = F.when(is_heading(F.col("text"), F.col("bold"), F.col("size")), F.lit("title")).otherwise(F.lit("text"))
    return (
        region("table", tables, F.col("box_no") + 1, F.lit("table"), F.col("markdown"))
        .unionByName(region("figure", figures, F.col("box_no") + 1, F.lit("figure"), F.col("caption")))
        .unionByName(region("text", free, F.col("place") + 1, heading, F.col("text")))
    )
