"""Hybrid pages: poor tables are read again by a provider, failures become warnings, results override by id."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text as T
from ..functions.geometry import crop_to_page
from .records import detections
from .tables import quality

THRESHOLD = 0.70


def merge_regions(native: DataFrame, replacements: DataFrame, keys: list[str], order: str) -> DataFrame:
    """native with every region whose id a replacement has exchanged for the last such one (by ``order``); place is the order by (y, x)."""
    last = Window.partitionBy(*keys, "region_id").orderBy(F.col(order).desc())
    chosen = replacements.where("region_id is not null and region_id <> ''").withColumn("r", F.row_number().over(last)).where("r = 1").drop("r", order)
    columns = [c for c in native.columns if c not in (*keys, "region_id")]
    right = chosen.select(*keys, "region_id", F.struct(*(F.col(c) if c in chosen.columns else F.lit(None).alias(c) for c in columns)).alias("new"))
    merged = native.join(right, [*keys, "region_id"], "left")
    own = merged.select(*keys, "region_id", *(F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in columns))
    visual = Window.partitionBy(*keys).orderBy(F.coalesce("y0", F.lit(0)), F.coalesce("x0", F.lit(0)), "region_id")
    return own.withColumn("place", (F.row_number().over(visual) - 1).cast("long"))


def read_regions(regions: DataFrame, provider, keys: list[str], max_length: int = 8192) -> DataFrame:
    """regions (keys, region_id, image, normalized_bbox and any others) with raw and error columns from provider.read(image, box, max_length).

    One provider for each Python worker, asked once for each region; an exception is that region's error, never the task's.
    """
    schema = StructType([*regions.schema.fields, StructField("raw", StringType()), StructField("error", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = provider() if isinstance(provider, type) else provider
        for batch in batches:
            raw, error = [], []
            for image, box in zip(batch["image"], batch["normalized_bbox"], strict=True):
                try:
                    raw.append(engine.read(image, list(box), max_length))
                    error.append(None)
                except Exception as e:  # noqa: BLE001  any failure of a provider is data
                    raw.append(None)
                    error.append(str(e))
            yield batch.assign(raw=raw, error=error)

    return regions.mapInPandas(run, schema)


def reread(regions: DataFrame, images: DataFrame, provider, keys: list[str], max_length: int = 8192) -> DataFrame:
    """keys, region_id, new (text, confidence) and warning of the poor tables among regions: what a second reading gave, or why it gave nothing."""
    poor = regions.where("type = 'table'").withColumn("score", quality(F.col("content"))).where(F.col("score") < THRESHOLD)
    asked = poor.join(images, keys).select(*keys, "region_id", "image", "normalized_bbox", "score")
    got = read_regions(asked, provider, keys, max_length).withColumn("local", F.when(F.col("error").isNull(), detections(F.col("raw"))))
    text = F.array_join(F.transform("local", lambda d: d["text"]), "\n")
    empty = F.col("error").isNull() & ((F.size("local") == 0) | (T.strip(text) == ""))
    failed = F.struct(F.lit("region_ocr_failed").alias("type"), "region_id", F.col("error").alias("message"))
    nothing = F.struct(F.lit("region_ocr_empty").alias("type"), "region_id", F.lit("VLM returned no detections for region").alias("message"))
    warning = F.when(F.col("error").isNotNull(), failed).when(empty, nothing)
    return got.select(*keys, "region_id", F.when(F.col("error").isNull() & ~empty, F.struct(text.alias("text"), F.col("score").alias("confidence"))).alias("new"), warning.alias("warning"))


def hybrid_pages(regions: DataFrame, images: DataFrame, provider, session: Column, keys: list[str] | None = None, max_length: int = 8192) -> DataFrame:
    """keys, detections, markdown, warnings, source of pages whose poor tables the provider reads again.

    regions as ``layout.regions`` gives them; images (keys, image) are the pages' pictures or paths; the
    last key is the page in links. Every region is asked for once, and pages are put together in one exchange.
    """
    keys = keys or ["doc_id"]
    met = regions.join(reread(regions, images, provider, keys, max_length), [*keys, "region_id"], "left")
    is_new = F.col("new").isNotNull()
    content = T.strip(F.coalesce(F.when(is_new, F.col("new.text")).otherwise(F.col("content")), F.lit("")))
    source = F.when(is_new, "vlm").otherwise(F.col("source"))
    unit = F.coalesce("normalized_bbox", F.array().cast("array<int>"))
    link = F.concat(F.lit("/api/region-image/"), session, F.lit("/"), F.col(keys[-1]).cast("string"), F.lit("/"), F.array_join(unit.cast("array<string>"), ","))
    kind = F.when(F.col("type") == "table", "table").when(F.col("type") == "figure", "image").when(F.col("type") == "title", "title").otherwise("text")
    part = (
        F.when((F.col("type") == "table") & (content != ""), F.concat(F.lit("\n"), content, F.lit("\n")))
        .when((F.col("type") == "figure") & (F.size(unit) == 4), F.concat(F.lit("\n!["), content, F.lit("]("), link, F.lit(")\n")))
        .when(F.col("type").isin("table", "figure"), F.lit(None))
        .when((F.col("type") == "title") & (content != ""), F.concat(F.lit("## "), content))
        .otherwise(content)
    )
    detection = F.struct(kind.alias("type"), unit.alias("bbox"), content.alias("text"), source.alias("source"))
    # Regions in the order of (y, x, id).
    placed = F.struct(F.coalesce("y0", F.lit(0.0)).alias("y"), F.coalesce("x0", F.lit(0.0)).alias("x"), "region_id", part.alias("part"), detection.alias("d"))
    pages = met.groupBy(*keys).agg(F.sort_array(F.collect_list(placed)).alias("all"), F.sort_array(F.collect_list("warning")).alias("said"))
    joined = F.array_join(F.filter(F.transform("all", lambda x: x["part"]), lambda p: p.isNotNull()), "\n")
    warnings = F.when(F.size("said") > 0, F.col("said"))
    return pages.select(*keys, F.transform("all", lambda x: x["d"]).alias("detections"), T.convert_math(T.squeeze_blank_lines(joined)).alias("markdown"), warnings.alias("warnings"), F.lit("hybrid").alias("source"))


def map_detections(local: Column, region_box: Column) -> Column:
    """Detections of a crop in page coordinates, marked as the model's."""
    return F.transform(local, lambda d: F.struct(d["type"].alias("type"), F.when(F.size(d["bbox"]) == 4, crop_to_page(d["bbox"], region_box)).otherwise(d["bbox"]).alias("bbox"), d["text"].alias("text"), F.lit("vlm").alias("source")))
