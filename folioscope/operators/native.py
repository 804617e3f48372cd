"""Native pages: from a decoder's spans, graphics, strokes and table candidates to Markdown, detections, regions and analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.geometry import image_coverage
from . import figures, layout, routing, tables

#: Pages with less text than this and without images have no tables or figures. Fixed value.
LEAST_TEXT = 60


def page_lines(spans: DataFrame) -> DataFrame:
    """Lines in reading order, numbered by it, from spans (``sources.providers.SPANS``)."""
    found = layout.lines_from_spans(spans)
    return found.select("doc_id", "block_no", F.col("order_no").alias("line_no"), "text", "x0", "y0", "x1", "y1", "size", "bold")


def extract_pages(pages: DataFrame, spans: DataFrame, candidates: DataFrame, graphics: DataFrame, strokes: DataFrame, rect: tuple, session: str = "", page_num: str | None = None) -> DataFrame:
    """doc_id, text, markdown, detections, regions, tables, figures, analysis of every page of pages (doc_id, text).

    spans: ``SPANS``; candidates (doc_id, box_no, box, rows, cells): detected tables; graphics (doc_id,
    kind image or drawing, box); strokes: ``STROKES``. session is for links, page_num
    the column of pages that has their numbers (1 without one). A page's rows meet by doc_id alone. Lines,
    figures and tables are persisted, as several parts of the result read them; what an executor loses of
    them is computed again. Pages without anything have empty results.
    """
    number = F.col(page_num) if page_num else F.lit(1)
    own = pages.select("doc_id", number.cast("int").alias("number"), T.strip(T.normalize_private_use(F.coalesce("text", F.lit("")))).alias("text"))
    lines = page_lines(spans).persist()
    seen = graphics.groupBy("doc_id").agg(
        F.count_if(F.col("kind") == "image").alias("images"), F.count_if(F.col("kind") == "drawing").alias("drawings"),
        F.collect_list(F.when(F.col("kind") == "image", F.array(*(F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1"))))).alias("boxes"),
    )
    known = own.join(seen, "doc_id", "left")
    rich = known.where((F.length("text") >= LEAST_TEXT) | (F.col("images") > 0))
    only = lambda df: df.join(rich.select("doc_id"), "doc_id", "left_semi")
    order = Window.partitionBy("doc_id").orderBy("sort_y", "x0", "y0")
    found = figures.figure_boxes(rich, only(lines), only(candidates), only(graphics), rect).withColumn("box_no", F.row_number().over(order) - 1).persist()
    real = tables.extract(only(candidates), found, spans.select("doc_id", "text", "x0", "y0", "x1", "y1", "size"), strokes).persist()
    made = layout.layout_pages(layout.items(lines, real, found).join(own.select("doc_id", "number"), "doc_id"), rect, F.lit(session), F.col("number"))
    region = F.struct("region_id", "type", "x0", "y0", "x1", "y1", "normalized_bbox", "source", "content", "confidence")
    regions = layout.regions(lines, real, found, rect).groupBy("doc_id").agg(F.sort_array(F.collect_list(region)).alias("regions"))
    counted = [df.groupBy("doc_id").agg(F.count("*").alias(n)) for df, n in ((real, "tables"), (found, "figures"))]
    shape = lines.groupBy("doc_id").agg(F.count_distinct("block_no").alias("text_blocks"), routing.column_count(F.collect_list("x0")).alias("columns"))
    joined = known
    for part in (made, regions, *counted, shape):
        joined = joined.join(part, "doc_id", "left")
    # Graphics are looked at only where figures are.
    looked = ((F.length("text") >= LEAST_TEXT) | (F.col("images") > 0)) & ~F.col("text").rlike(figures.LIST_OF_FIGURES)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int")
    when = lambda c: F.when(looked, zero(c)).otherwise(0)
    markdown = F.coalesce("markdown", F.lit(""))
    covered = F.when(looked & (F.size("boxes") > 0), image_coverage(F.col("boxes"), [F.lit(float(v)) for v in rect])).otherwise(0.0)
    values = {
        "text_chars": T.dense_length(F.col("text")), "text_blocks": zero("text_blocks"), "image_count": when("images"), "image_coverage": covered, "drawing_count": when("drawings"), "table_count": zero("tables"),
        "figure_count": zero("figures"), "suspicious_char_ratio": T.suspicious_ratio(F.col("text")), "column_count": F.coalesce("columns", F.lit(1)), "native_markdown_chars": T.dense_length(markdown),
    }
    analysis = F.struct(*(v.alias(k) for k, v in values.items())).cast(routing.ANALYSIS)
    return joined.select(
        "doc_id", "text", markdown.alias("markdown"), F.coalesce("detections", F.array().cast("array<struct<type:string,bbox:array<int>,text:string>>")).alias("detections"),
        "regions", zero("tables").alias("tables"), zero("figures").alias("figures"), analysis.alias("analysis"),
    )
