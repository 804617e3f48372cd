"""Detections to logical blocks and to HTML, one row at a time: pages stay where they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

BLOCK = "array<struct<block_type:string,text:string,bbox:array<int>,level:int>>"
EMPTY_PAGE = '<div class="ocr-page empty"><p class="muted">No content detected</p></div>'
IMAGE_MARK = '<span class="image-placeholder">🖼 图片区域</span>'
LEVEL_HEIGHT = 60


def level(bbox: Column) -> Column:
    return F.when(F.coalesce((F.size(bbox) >= 4) & (F.get(bbox, 3) - F.get(bbox, 1) > LEVEL_HEIGHT), F.lit(False)), 1).otherwise(2)


def blocks(dets: Column) -> Column:
    """Headings, images, page numbers and tables stand alone; runs of anything else are paragraphs with the first one's box."""

    def step(done: Column, d: Column) -> Column:
        alone = F.create_map(*(F.lit(x) for x in ("title", "heading", "image", "image", "page_number", "page_number", "table", "table")))
        kind = F.coalesce(F.try_element_at(alone, d["type"]), F.lit("paragraph"))
        new = F.struct(kind.alias("block_type"), d["text"].alias("text"), d["bbox"].alias("bbox"), F.when(d["type"] == "title", level(d["bbox"])).cast("int").alias("level"))
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["block_type"].alias("block_type"), F.concat(last["text"], F.lit("\n"), d["text"]).alias("text"), last["bbox"].alias("bbox"), last["level"].alias("level"))
        joins = (kind == "paragraph") & F.coalesce(last["block_type"] == "paragraph", F.lit(False))
        return F.when(joins, F.concat(F.slice(done, 1, F.greatest(F.lit(0), F.size(done) - 1)), F.array(longer))).otherwise(F.concat(done, F.array(new))).cast(BLOCK)

    return F.aggregate(dets, F.array().cast(BLOCK), step)


def detection_html(d: Column, index: Column) -> Column:
    at = F.concat(F.lit('data-detection-index="'), index.cast("string"), F.lit('"'))
    body = T.escape_html(F.coalesce(d["text"], F.lit("")))
    tag = F.concat(F.lit("h"), level(d["bbox"]).cast("string"))
    edit = F.lit('contenteditable="true" ')
    return (
        F.when(d["type"] == "title", F.concat(F.lit("<"), tag, F.lit(' class="ocr-heading" '), edit, at, F.lit(">"), body, F.lit("</"), tag, F.lit(">")))
        .when(d["type"] == "image", F.concat(F.lit('<div class="ocr-image" '), at, F.lit(">" + IMAGE_MARK + "</div>")))
        .when(d["type"] == "table", F.concat(F.lit('<div class="ocr-table" '), edit, at, F.lit(">"), body, F.lit("</div>")))
        .when(d["type"] == "page_number", F.concat(F.lit('<span class="ocr-page-number" '), at, F.lit(">"), body, F.lit("</span>")))
        .otherwise(F.concat(F.lit('<p class="ocr-text" '), edit, at, F.lit(">"), body, F.lit("</p>")))
    )


def page_html(dets: Column, page: Column) -> Column:
    parts = F.concat(F.array(F.concat(F.lit('<div class="ocr-page" data-page="'), page.cast("string"), F.lit('">'))), F.transform(dets, detection_html), F.array(F.lit("</div>")))
    return F.when(F.coalesce(F.size(dets), F.lit(0)) > 0, F.array_join(parts, "\n")).otherwise(F.lit(EMPTY_PAGE))
