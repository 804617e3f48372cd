"""Detected tables to grids of text: gates, column and row bounds, cell assignment, clean-up.

Every step is an array expression over one row of a table with its page's spans and strokes, so
after the page's rows have met by doc_id there is no further exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrays import cluster, count, dedupe_bounds, doubles, let, mean, neighbours
from .layout import join_cell_text, outer_tables

#: Header words of specification tables, and the header given to tables of seven columns. Fixed values.
HEADER_WORDS = ("parameter", "symbol", "condition", "min", "typ", "max", "unit")
HEADER = ("Parameter", "Symbol", "Condition", "Min", "Typ", "Max", "Unit")
BIT_CHARACTERS = "01XSPRWACK…"
#: Wording of titles inside table bodies. Fixed value.
TITLE = r"(?i)OPERATING\s*C?\s*ONDITIONS|OUTPUT SIGNAL|PERATING CONDITIONS|(?<![A-Za-z])CCELEROMETER|TYPICAL CURRENT CONSUMPTION|NUMBER OF AVERAGING CYCLES"
#: Text that suggests a table. Fixed value.
TABULAR = (
    r"(?i)\bTable\s+\d+\b|\bParameter\b[\s\S]{0,500}\bSymbol\b|\bRegister Name\b|\bBit\b[\s\S]{0,300}\bDescription\b|"
    r"\bcutoff frequency\b|评分标准|满分|主要内容|项\s*目|合计|\bBit\b\s+\d+(?:\s+\d+){2,}[\s\S]{0,150}\b(?:Content|Read/Write)\b"
)
GLYPH, OVERLAP_OF = 8, 0.5


def looks_tabular(text: Column) -> Column:
    return text.rlike(TABULAR)


def quality(content: Column) -> Column:
    """0..1: share of rows with the most frequent number of cells, and of cells that are filled."""

    def score(widths: Column) -> Column:
        rows = F.size(widths)
        modal = F.array_max(F.transform(F.array_distinct(widths), lambda w: count(widths, lambda v: v == w))) / rows
        fill = F.aggregate(widths, F.lit(0), lambda a, v: a + v) / (F.array_max(widths) * rows)
        return F.when(rows > 0, let(modal, lambda m: F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), m * 0.5 + fill * 0.3 + m * 0.2)), 3))).otherwise(F.lit(0.0))

    def whole(lines: Column) -> Column:
        widths = F.filter(F.transform(lines, lambda s: count(F.split(s, r"\|"), lambda c: T.strip(c) != "")), lambda n: n > 0)
        return F.when(F.size(lines) < 2, F.lit(0.0)).otherwise(let(widths, score))

    return let(F.filter(T.split_lines(T.strip(F.coalesce(content, F.lit("")))), lambda s: T.strip(s) != ""), whole)


def filled(row: Column) -> Column:
    return count(row, lambda c: F.coalesce(T.strip(c) != "", F.lit(False)))


def is_genuine(x0: Column, y0: Column, x1: Column, y1: Column, n_rows: Column, cells: Column) -> Column:
    return (y1 - y0 >= 25) & (x1 - x0 >= 180) & (n_rows >= 2) & (count(cells, lambda r: filled(r) >= 2) >= 2)


def is_real(x0: Column, y0: Column, x1: Column, y1: Column, n_rows: Column, cells: Column) -> Column:
    return is_genuine(x0, y0, x1, y1, n_rows, cells) & (F.aggregate(cells, F.lit(0), lambda a, r: a + filled(r)) >= 6)


def is_bit_pattern(cells: Column) -> Column:
    joined = F.transform(cells, lambda r: F.array_join(F.filter(r, lambda c: F.coalesce(T.strip(c) != "", F.lit(False))), ""))
    return count(joined, lambda s: s.rlike(rf"\A[{BIT_CHARACTERS}{T.WS}]+\z")) >= 2


def is_header_band(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Too small to be a table, or a band at the top of the page."""
    return ((y0 < 84) & (y1 - y0 < 45)) | (x1 - x0 < 180) | (y1 - y0 < 18)


def is_spec_header(row: Column) -> Column:
    cells = F.transform(row, lambda c: F.lower(T.strip(c)))
    return F.size(F.array_intersect(F.array(*map(F.lit, HEADER_WORDS)), cells)) >= 4


def to_markdown(rows: Column) -> Column:
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))

    def whole(own: Column) -> Column:
        def wide(width: Column) -> Column:
            rendered = F.transform(own, lambda r: line(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))))
            return let(rendered, lambda x: F.array_join(F.concat(F.slice(x, 1, 1), F.array(line(F.array_repeat(F.lit("---"), width))), F.slice(x, 2, F.greatest(F.lit(0), F.size(x) - 1))), "\n"))

        return F.when(F.size(own) > 0, let(F.array_max(F.transform(own, F.size)), wide)).otherwise(F.lit(""))

    return let(rows, whole)


def without_titles(grid: Column) -> Column:
    """Without the leading rows that are titles inside the table."""

    def is_title(row: Column) -> Column:
        some = F.filter(row, lambda c: T.strip(c) != "")
        joined = F.array_join(some, " ")
        plain = (F.length(joined) <= 60) & ~joined.rlike(r"[0-9]|=|LSB|LSb|Default value")
        return ((F.size(some) <= 1) & plain) | ((F.size(some) <= 3) & joined.rlike(TITLE))

    first = F.array_min(F.filter(F.transform(grid, lambda r, k: F.when(~is_title(r), k)), lambda k: k.isNotNull()))
    return F.when(first.isNull(), F.slice(grid, 1, 0)).otherwise(F.slice(grid, first + 1, F.greatest(F.lit(0), F.size(grid) - first)))


def merge_row_label(grid: Column) -> Column:
    """A sparse first column in one run of rows becomes the header of the next one."""
    first = F.transform(grid, lambda r: T.strip(F.get(r, 0)))
    some = F.filter(first, lambda c: c != "")
    places = F.filter(F.transform(first, lambda c, k: F.when(c != "", k)), lambda k: k.isNotNull())
    run = (F.size(places) >= 3) & (F.array_max(places) - F.array_min(places) + 1 == F.size(places))
    merges = (F.size(grid) >= 3) & (F.size(F.get(grid, 0)) >= 3) & (F.size(some) > 0) & (F.size(some) <= F.size(grid) * 0.6) & run
    cut = F.transform(grid, lambda r: F.slice(r, 2, F.greatest(F.lit(0), F.size(r) - 1)))
    label = F.array_join(some, " ")
    named = F.transform(cut, lambda r, k: F.when((k == 0) & (F.get(r, 0) == ""), F.concat(F.array(label), F.slice(r, 2, F.greatest(F.lit(0), F.size(r) - 1)))).otherwise(r))
    return F.when(merges, named).otherwise(grid)


def kept_columns(grid: Column) -> Column:
    """Without columns that are empty in every row; null if fewer than two are left."""
    width = F.size(F.get(grid, 0))
    keep = F.filter(F.sequence(F.lit(0), width - 1), lambda k: F.exists(grid, lambda r: F.get(r, k) != ""))
    return F.when(F.size(keep) >= 2, F.transform(grid, lambda r: F.transform(keep, lambda k: F.get(r, k))))


def assign_column(span: Column, bounds: Column) -> Column:
    """The column of a span, -1 for none: of several, the last one, unless it is wider than two usual columns."""
    inner = F.array_sort(F.transform(F.slice(neighbours(bounds), 2, F.greatest(F.lit(0), F.size(bounds) - 2)), lambda p: p["b"] - p["a"]))
    median = let(inner, lambda w: F.get(w, F.floor(F.size(w) / 2).cast("int")))
    wide = F.coalesce(span["x1"] - span["x0"] > median * 2.0, F.lit(False))
    columns = F.filter(F.sequence(F.lit(0), F.size(bounds) - 2), lambda k: (span["x0"] <= F.get(bounds, k + 1)) & (span["x1"] >= F.get(bounds, k)))
    return let(columns, lambda c: F.when(F.size(c) == 0, -1).when(F.size(c) == 1, F.get(c, 0)).when(wide, -1).otherwise(F.try_element_at(c, F.lit(-1))))


def middle(s: Column) -> Column:
    return (s["y0"] + s["y1"]) / 2


def vertical_bounds(x0: Column, x1: Column, strokes: Column) -> Column:
    """Column bounds by the table's vertical rulings: strokes (kind, x0, y0, x1, y1) that touch it."""
    upright = F.filter(strokes, lambda s: ((s["kind"] == "l") & (s["x1"] - s["x0"] < 0.5) & (s["y1"] - s["y0"] > 2)) | ((s["kind"] == "re") & (s["y1"] - s["y0"] > (s["x1"] - s["x0"]) * 2)))
    found = F.filter(cluster(F.transform(upright, lambda s: (s["x0"] + s["x1"]) / 2), 6.0), lambda c: (c > x0 + 2) & (c < x1 - 2))
    return dedupe_bounds(F.concat(F.array(x0), found, F.array(x1)), 4)


def text_bounds(x0: Column, y0: Column, x1: Column, y1: Column, inside: Column) -> Column:
    """Column bounds by left edges that spans of two rows or more share."""
    own = F.filter(inside, lambda s: (s["size"] >= GLYPH) & s["x0"].between(x0 - 2, x1 + 2) & middle(s).between(y0, y1))
    rows = lambda edge: F.array_distinct(F.transform(F.filter(own, lambda s: F.abs(s["x0"] - edge) <= 4.0), lambda s: F.bround(middle(s), 1)))
    starts = F.filter(cluster(F.transform(own, lambda s: s["x0"]), 4.0), lambda edge: F.size(rows(edge)) >= 2)
    return F.when(F.size(starts) >= 2, dedupe_bounds(F.array_distinct(F.concat(F.array(x0), starts, F.array(x1))), 4)).otherwise(doubles())


def row_rulings(x0: Column, y0: Column, x1: Column, y1: Column, strokes: Column, spans: Column) -> Column:
    """Heights of horizontal rulings: strokes of one height together cover a third of the width, and short ones cut no text."""
    kind = "array<struct<sum_y:double,width:double,n:int,lo:double,hi:double,last:double>>"
    flat = F.filter(strokes, lambda s: (s["x1"] - s["x0"] > 5) & (((s["kind"] == "l") & (s["y1"] - s["y0"] < 0.5)) | ((s["kind"] == "re") & (s["y1"] - s["y0"] < 0.7))))
    ordered = F.array_sort(F.transform(flat, lambda s: F.struct(((s["y0"] + s["y1"]) / 2).alias("y"), (s["x1"] - s["x0"]).alias("w"), s["x0"].alias("lo"), s["x1"].alias("hi"))))

    def step(groups: Column, s: Column) -> Column:
        last = F.try_element_at(groups, F.lit(-1))
        joins = F.coalesce(s["y"] - last["last"] <= 5.0, F.lit(False))
        longer = F.struct((last["sum_y"] + s["y"]).alias("sum_y"), (last["width"] + s["w"]).alias("width"), (last["n"] + 1).alias("n"), F.least(last["lo"], s["lo"]).alias("lo"), F.greatest(last["hi"], s["hi"]).alias("hi"), s["y"].alias("last"))
        new = F.struct(s["y"].alias("sum_y"), s["w"].alias("width"), F.lit(1).alias("n"), s["lo"].alias("lo"), s["hi"].alias("hi"), s["y"].alias("last"))
        return F.when(joins, F.concat(F.slice(groups, 1, F.greatest(F.lit(0), F.size(groups) - 1)), F.array(longer))).otherwise(F.concat(groups, F.array(new))).cast(kind)

    groups = F.aggregate(ordered, F.array().cast(kind), step)
    center = lambda g: g["sum_y"] / g["n"]
    cuts = lambda g: F.exists(spans, lambda s: s["x0"].between(x0, x1) & (s["y0"] - OVERLAP_OF < center(g)) & (center(g) < s["y1"] + OVERLAP_OF))
    kept = F.filter(groups, lambda g: (g["width"] >= (x1 - x0) * 0.35) & (center(g) > y0 + 2) & (center(g) < y1 - 2) & ~((g["hi"] - g["lo"] < (x1 - x0) * 0.6) & cuts(g)))
    return F.transform(kept, center)


def column_stats(y0: Column, y1: Column, spans: Column, bounds: Column) -> Column:
    """For inner columns with two glyph rows or more: column, centers, variation of their gaps, coverage of the height."""

    def one(k: Column) -> Column:
        own = F.filter(spans, lambda s: (s["x0"] <= F.get(bounds, k + 1) + 1) & (s["x1"] >= F.get(bounds, k) - 1) & (s["size"] >= GLYPH))
        return F.struct(k.alias("column"), cluster(F.transform(own, middle), 4.0).alias("centers"))

    def variation(gaps: Column) -> Column:
        return let(mean(gaps), lambda m: F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda a, g: a + (g - m) * (g - m)) / F.size(gaps)) / m)

    def measured(e: Column) -> Column:
        cv = let(F.transform(neighbours(e["centers"]), lambda p: p["b"] - p["a"]), variation)
        last, first = F.try_element_at(e["centers"], F.lit(-1)), F.get(e["centers"], 0)
        return F.struct(e["column"].alias("column"), e["centers"].alias("centers"), cv.alias("cv"), F.when(y1 > y0, (last - first) / (y1 - y0)).otherwise(F.lit(0.0)).alias("coverage"))

    columns = F.when(F.size(bounds) > 2, F.sequence(F.lit(1), F.size(bounds) - 2)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(F.transform(columns, one), lambda e: F.size(e["centers"]) >= 2), measured)


def anchor_column(stats: Column, n_bounds: Column, n_rulings: Column) -> Column:
    """The column whose glyphs stand for the rows."""
    default = F.when(n_bounds >= 3, 1).otherwise(-1)
    expected = n_rulings + 1
    off = lambda e: F.abs(F.size(e["centers"]) - expected)
    covered = F.filter(stats, lambda e: e["coverage"] >= 0.6)
    second = F.exists(stats, lambda e: (e["column"] == 1) & (F.size(e["centers"]) <= expected + 1))
    close = F.array_min(F.transform(F.filter(covered, lambda e: off(e) <= 2), lambda e: F.struct(off(e).alias("a"), e["cv"].alias("b"), e["column"].alias("c"))))["c"]
    even = F.array_min(F.transform(covered, lambda e: F.struct(e["cv"].alias("a"), e["column"].alias("c"))))["c"]
    dense = F.array_min(F.transform(covered, lambda e: F.struct(e["cv"].alias("a"), (-F.get(e["centers"], 0)).alias("b"), e["column"].alias("c"))))["c"]
    ruled = F.when(second, 1).otherwise(F.coalesce(close, even))
    return F.when(F.size(stats) == 0, default).otherwise(F.coalesce(F.when(n_rulings > 0, ruled), dense, default))


def anchor_centers(spans: Column, bounds: Column, anchor: Column) -> Column:
    own = F.filter(spans, lambda s: s["x0"].between(F.get(bounds, anchor) - 2, F.get(bounds, anchor + 1) + 2) & (s["size"] >= GLYPH))
    return F.when((F.size(bounds) >= 3) & (anchor >= 0), cluster(F.transform(own, middle), 4.0)).otherwise(doubles())


def bands(values: Column) -> Column:
    return F.transform(neighbours(values), lambda p: F.struct(p["a"].alias("top"), p["b"].alias("bottom")))


def midpoints(values: Column) -> Column:
    return F.transform(neighbours(values), lambda p: (p["a"] + p["b"]) / 2)


def without_slivers(found: Column) -> Column:
    """Bands under 5 points are joined to the one before."""
    kind = "array<struct<top:double,bottom:double>>"

    def step(done: Column, b: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.concat(F.slice(done, 1, F.greatest(F.lit(0), F.size(done) - 1)), F.array(F.struct(last["top"].alias("top"), b["bottom"].alias("bottom"))))
        return F.when((F.size(done) > 0) & (b["bottom"] - b["top"] < 5), longer).otherwise(F.concat(done, F.array(b))).cast(kind)

    return F.aggregate(found.cast(kind), F.array().cast(kind), step)


def ruled_bands(y0: Column, y1: Column, rulings: Column, centers: Column) -> Column:
    """Rows between rulings; a band with several anchors is split between them."""

    def splits(b: Column) -> Column:
        own = F.filter(centers, lambda c: c.between(b["top"], b["bottom"]))
        return F.filter(midpoints(own), lambda m: (m > b["top"] + 3) & (m < b["bottom"] - 3))

    def whole(edges: Column) -> Column:
        extra = F.flatten(F.transform(bands(edges), splits))
        return without_slivers(bands(dedupe_bounds(F.array_distinct(F.concat(edges, extra)), 3)))

    return let(dedupe_bounds(F.concat(F.array(y0), rulings, F.array(y1)), 3), whole)


def row_bands(x0: Column, y0: Column, x1: Column, y1: Column, inside: Column, rulings: Column, centers: Column, detector_rows: Column) -> Column:
    """The rows of a table by rulings, else by anchors, else by the detector's full-width rows, else by baselines."""
    framed = lambda values: bands(F.concat(F.array(y0), midpoints(values), F.array(y1)))
    high = lambda found: F.filter(found, lambda b: b["bottom"] - b["top"] >= 8)
    full = F.filter(detector_rows, lambda r: (F.get(r, 0) <= x0 + 3) & (F.get(r, 2) >= x1 - 3))
    reported = F.array_sort(F.array_distinct(F.transform(full, lambda r: F.struct(F.get(r, 1).alias("top"), F.get(r, 3).alias("bottom")))))
    return (
        F.when(F.size(rulings) >= 2, ruled_bands(y0, y1, rulings, centers))
        .when(F.size(centers) >= 2, framed(centers))
        .when(F.size(full) > 0, high(reported))
        .otherwise(high(framed(cluster(F.transform(inside, middle), 4.0))))
    )


def bind(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that later steps use as it is: an explode of one element keeps the optimiser from writing it out at every use."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def extract(tables: DataFrame, figures: DataFrame, spans: DataFrame, strokes: DataFrame) -> DataFrame:
    """doc_id, box_no, box, rows, markdown, text of the tables that are real.

    tables (doc_id, box_no, x0, y0, x1, y1, rows array<array<double>>, cells array<array<string>>),
    figures (doc_id, x0, y0, x1, y1), spans (doc_id, text, box, size), strokes (doc_id, kind, box, rx0,
    ry0, rx1, ry1: the rectangle of the drawing that the stroke belongs to).
    """
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    gated = tables.where(~is_header_band(x0, y0, x1, y1) & ~is_bit_pattern(F.col("cells"))).select("doc_id", "box_no")
    own = outer_tables(tables, figures).join(gated, ["doc_id", "box_no"], "left_semi")
    page_spans = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("y0", "x0", "x1", "y1", "text", F.col("size").cast("double").alias("size")))).alias("spans"))
    page_strokes = strokes.groupBy("doc_id").agg(F.collect_list(F.struct("kind", "x0", "y0", "x1", "y1", "rx0", "ry0", "rx1", "ry1")).alias("strokes"))
    met = own.join(page_spans, "doc_id").join(page_strokes, "doc_id", "left")
    touches = lambda s: (s["x0"] <= x1) & (s["x1"] >= x0) & (s["y0"] <= y1) & (s["y1"] >= y0)
    near = lambda s: ~((s["rx1"] < x0) | (s["rx0"] > x1) | (s["ry1"] < y0) | (s["ry0"] > y1))
    spanned = F.transform(F.col("given"), lambda s: F.struct(*(s[c].cast("double").alias(c) if c != "text" else s[c].alias(c) for c in ("text", "x0", "y0", "x1", "y1", "size"))))
    stroked = F.coalesce(F.filter(F.col("drawn"), near), F.array().cast("array<struct<kind:string,x0:double,y0:double,x1:double,y1:double,rx0:double,ry0:double,rx1:double,ry1:double>>"))
    d = bind(met.withColumnRenamed("spans", "given").withColumnRenamed("strokes", "drawn"), "own_spans", spanned)
    d = bind(bind(d, "own_strokes", stroked), "inside", F.filter("own_spans", touches)).where(F.size("inside") > 0)
    d = bind(d, "ruled", vertical_bounds(x0, x1, F.col("own_strokes")))
    d = bind(d, "bounds", F.when(F.size("ruled") >= 3, F.col("ruled")).otherwise(text_bounds(x0, y0, x1, y1, F.col("inside")))).where(F.size("bounds") >= 3)
    d = bind(d, "rulings", row_rulings(x0, y0, x1, y1, F.col("own_strokes"), F.col("own_spans")))
    d = bind(d, "stats", column_stats(y0, y1, F.col("inside"), F.col("bounds")))
    d = bind(d, "anchor", anchor_column(F.col("stats"), F.size("bounds"), F.size("rulings")))
    d = bind(d, "centers", anchor_centers(F.col("inside"), F.col("bounds"), F.col("anchor")))
    d = bind(d, "bands", row_bands(x0, y0, x1, y1, F.col("inside"), F.col("rulings"), F.col("centers"), F.col("rows")))
    d = bind(d, "placed", F.transform("inside", lambda s: F.struct(s.alias("s"), assign_column(s, F.col("bounds")).alias("column"))))
    columns = F.sequence(F.lit(0), F.size("bounds") - 2)
    cell = lambda b, k: join_cell_text(F.transform(F.filter("placed", lambda p: (p["column"] == k) & middle(p["s"]).between(b["top"] - OVERLAP_OF, b["bottom"] + OVERLAP_OF)), lambda p: p["s"]))
    d = bind(d, "cells_of", F.transform("bands", lambda b: F.transform(columns, lambda k: cell(b, k))))
    d = bind(d, "grid", F.filter("cells_of", lambda r: F.exists(r, lambda c: c != ""))).where(F.size("grid") >= 2)
    d = bind(d, "kept", kept_columns(F.col("grid"))).where("kept is not null")
    d = bind(bind(d, "body", without_titles(F.col("kept"))), "merged", merge_row_label(F.col("body"))).where(F.size("merged") >= 2)
    head = F.get("merged", 0)
    d = bind(d, "table", F.when(~is_spec_header(head) & (F.size(head) == 7), F.concat(F.array(F.array(*map(F.lit, HEADER))), F.col("merged"))).otherwise(F.col("merged")))
    text = F.array_join(F.transform("table", lambda r: F.array_join(r, " | ")), "\n")
    return d.select("doc_id", "box_no", "x0", "y0", "x1", "y1", F.col("table").alias("rows"), to_markdown(F.col("table")).alias("markdown"), text.alias("text"))
