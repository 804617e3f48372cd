"""What a user asks for: ingest, scan, rescan, edit, translate, export, audit, status.

Pages are rows: session_id, page_num, text (the page's text layer), and optionally markdown,
detections, analysis and image. Results are rows as well; the last attempt of a page counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from .functions import geometry
from .functions import text as T
from .operators import audit as _audit
from .operators import blocks, hybrid, native, records, routing, sequences, state
from .operators.translate import EchoClient
from .operators.translate import translate as _translate
from .sources import sinks
from .sources.providers import images, numbered_pages, page_counts, page_rows, scan_images, uploads

DETECTIONS = "array<struct<type:string,bbox:array<int>,text:string>>"
REGION = "struct<region_id:string,type:string,x0:double,y0:double,x1:double,y1:double,normalized_bbox:array<int>,source:string,content:string,confidence:double>"
WARNINGS = "array<struct<type:string,region_id:string,message:string>>"
KEYS = ["session_id", "page_num"]


def ingest(spark: SparkSession, path: str) -> DataFrame:
    """Files under path with their kinds; rejected ones are rows too."""
    return uploads(spark, path)


def read_images(spark: SparkSession, directory: str) -> DataFrame:
    return images(spark, directory)


def progress(pages: DataFrame, expected: Column) -> DataFrame:
    """session_id, processed, percent of pages against the expected number of each session."""
    rows = pages.groupBy("session_id").agg(F.count("*").alias("processed"), F.first(expected).alias("total"))
    return rows.select("session_id", "processed", F.least(F.lit(100), F.floor(F.col("processed") / F.col("total") * 100 + 0.5)).cast("int").alias("percent"))


def _read(pages: DataFrame, engine, max_length: int) -> DataFrame:
    """pages (image and any others) with raw, truncated, error by the engine; one for each worker, failures are rows.

    Every page is asked for once; its columns come along. An engine's answer is a text, or (text,
    truncated) if it knows that it hit its cap.
    """
    more = [StructField("raw", StringType()), StructField("truncated", BooleanType()), StructField("error", StringType())]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = engine() if isinstance(engine, type) else engine
        for batch in batches:
            rows = []
            for image in batch["image"]:
                try:
                    answer = own.read(image, [0, 0, 1000, 1000], max_length)
                    rows.append((*(answer if isinstance(answer, tuple) else (answer, False)), None))
                except Exception as e:  # noqa: BLE001  a page's failure is data
                    rows.append((None, False, str(e)))
            raw, truncated, error = zip(*rows, strict=True) if rows else ((), (), ())
            yield batch.assign(raw=list(raw), truncated=list(truncated), error=list(error))

    return pages.mapInPandas(run, StructType([*pages.schema.fields, *more]))


def snapshots(pages: DataFrame, engine, max_length: int = 8192) -> DataFrame:
    """session_id, page_num, seq, text, tokens, done, truncated: an engine's growing answers, one row for each."""
    keys = [pages.schema[k] for k in KEYS]
    fields = [("seq", IntegerType()), ("text", StringType()), ("tokens", IntegerType()), ("done", BooleanType()), ("truncated", BooleanType())]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = engine() if isinstance(engine, type) else engine
        for batch in batches:
            for session, page, image in zip(batch["session_id"], batch["page_num"], batch["image"], strict=True):
                rows = [(session, page, k, i["text"], i.get("tokens", 0), bool(i.get("done")), bool(i.get("truncated"))) for k, i in enumerate(own.snapshots(image, max_length))]
                yield pd.DataFrame(rows, columns=["session_id", "page_num", "seq", "text", "tokens", "done", "truncated"])

    return pages.select(*KEYS, "image").mapInPandas(run, StructType([*keys, *(StructField(n, t) for n, t in fields)]))


def live_markdown(snaps: DataFrame) -> DataFrame:
    """snapshots with markdown, the last one up to there that was no unstable draft; a final one always counts."""
    made = snaps.withColumn("draft", records.raw_markdown(F.col("text"), F.col("session_id").cast("string"), F.col("page_num")))
    found = sequences.stable(made, KEYS, ["seq"], "draft", ~records.is_repetitive(F.col("draft")), F.col("done"))
    return found.withColumn("markdown", F.coalesce("stable", F.lit(""))).drop("draft", "stable")


def scan(pages: DataFrame, engine, force_mode: str | None = None, max_length: int = 8192) -> DataFrame:
    """Results of pages: route, source, detections, markdown, truncated, warnings, error, html, blocks, status.

    Pages are (session_id, page_num, text) and optionally markdown, detections, analysis, image and
    regions (an array of REGION); keys may be of any type. Only pages that are routed to the engine
    reach it, each once; of hybrid pages their poor tables do, as far as regions are given, and the
    others are processed as native ones.
    """
    have = pages.columns
    optional = {"markdown": "string", "detections": DETECTIONS, "analysis": routing.ANALYSIS, "image": "string", "regions": f"array<{REGION}>"}
    rows = pages.select(*KEYS, F.coalesce("text", F.lit("")).alias("text"), *((F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in optional.items()))
    routed = rows.withColumn("chars", T.dense_length(F.col("text"))).withColumn("route", routing.route_page(F.col("analysis"), F.col("chars"), F.lit(force_mode).cast("string")))
    is_mixed = (F.col("route") == "hybrid") & F.coalesce(F.size("regions") > 0, F.lit(False))
    none, no_error = F.lit(None).cast(WARNINGS).alias("warnings"), F.lit(None).cast("string").alias("error")
    own_markdown, own_detections = F.coalesce("markdown", records.native_markdown(F.col("text"))), F.coalesce("detections", records.native_detections(F.col("text"))).cast(DETECTIONS)
    native = routed.where((F.col("route") != "vlm") & ~is_mixed).select(*KEYS, "route", F.col("route").alias("source"), own_detections.alias("detections"), own_markdown.alias("markdown"), F.lit(False).alias("truncated"), none, no_error)
    made = records.raw_markdown(F.col("raw"), F.col("session_id").cast("string"), F.col("page_num"))
    back = routing.use_native_fallback(F.col("chars"), T.dense_length(made))
    seen = _read(routed.where("route = 'vlm'").select(*KEYS, "route", "text", "chars", "image"), engine, max_length)
    vision = seen.select(
        *KEYS,
        "route",
        F.lit("vlm").alias("source"),
        F.when(F.col("error").isNotNull(), F.array().cast(DETECTIONS)).when(back, records.native_detections(F.col("text")).cast(DETECTIONS)).otherwise(records.detections(F.col("raw")).cast(DETECTIONS)).alias("detections"),
        F.when(F.col("error").isNotNull(), F.lit("")).when(back, records.native_markdown(F.col("text"))).otherwise(made).alias("markdown"),
        "truncated",
        none,
        "error",
    )
    both = native.unionByName(vision)
    if "regions" in have:
        mixed = routed.where(is_mixed)
        pieces = mixed.select(*KEYS, F.explode("regions").alias("r")).select(*KEYS, "r.*")
        read = hybrid.hybrid_pages(pieces, mixed.select(*KEYS, "image"), engine, F.col("session_id").cast("string"), KEYS, max_length)
        plain = F.transform("detections", lambda d: F.struct(d["type"].alias("type"), d["bbox"].alias("bbox"), d["text"].alias("text"))).cast(DETECTIONS)
        both = both.unionByName(read.select(*KEYS, F.lit("hybrid").alias("route"), "source", plain.alias("detections"), "markdown", F.lit(False).alias("truncated"), F.col("warnings").cast(WARNINGS).alias("warnings"), no_error))
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("truncated") | F.coalesce(F.size("warnings") > 0, F.lit(False)), "warning").otherwise("done")
    return both.select("*", blocks.page_html(F.col("detections"), F.col("page_num")).alias("html"), blocks.blocks(F.col("detections")).alias("blocks"), status.alias("status"))


def region_crops(results: DataFrame, sizes: DataFrame, padding: int = 8) -> DataFrame:
    """session_id, page_num, name, box, pixels of every picture region that the results' Markdown links to; sizes (session_id, page_num, width, height) of page images.

    A region that is nothing once it is cut to the image has null pixels; ``sources.providers.crop_images`` cuts the pictures.
    """
    linked = sinks.image_crops(results).join(sizes.select(*KEYS, "width", "height"), KEYS)
    name = F.concat(F.lit("page-"), F.col("page_num").cast("string"), F.lit("-"), F.array_join(F.col("box").cast("array<string>"), "-"), F.lit(".png"))
    return linked.select(*KEYS, name.alias("name"), "box", geometry.crop_pixels(F.col("box"), F.col("width"), F.col("height"), padding).alias("pixels"))


def controlled(events: DataFrame, controls: DataFrame, order: str = "at") -> DataFrame:
    """Events of scans that a pause or a stop does not hold back; controls (session_id, at, action)."""
    return state.pause_free(events, controls, order)


def rescan(results: DataFrame, pages: DataFrame, keys: DataFrame, engine, force_mode: str | None = None) -> DataFrame:
    """results (with attempt) with new attempts of the pages in keys in place of their old ones; other pages stay."""
    last = results.groupBy(*KEYS).agg(F.max("attempt").alias("before"))
    new = scan(pages.join(keys.select(*KEYS), KEYS, "left_semi"), engine, force_mode).join(last, KEYS, "left").withColumn("attempt", F.coalesce("before", F.lit(0)) + 1).drop("before")
    return state.last_results(results.unionByName(new.select(*results.columns)))


apply_edits = state.apply_edits


def translate(results: DataFrame, client=EchoClient, source: str = "auto", target: str = "zh-CN") -> DataFrame:
    """session_id, page_num, index, original, translated of the results' translatable detections."""
    items = results.select(*KEYS, F.posexplode("detections").alias("index", "d")).select(*KEYS, "index", "d.type", "d.text")
    return _translate(items, KEYS, client, source, target)


def export_markdown(results: DataFrame) -> DataFrame:
    return sinks.markdown_documents(results)


def export_docx(results: DataFrame, translations: DataFrame, mode: str = "original", pictures: DataFrame | None = None) -> DataFrame:
    """session_id, docx; pictures (session_id, name, content) are crops by their names, as ``region_crops`` gives them."""
    return sinks.docx_files(sinks.docx_plan(results, translations, mode), pictures)


def native_pages(files: DataFrame, decoder, rect: tuple, session: str = "") -> DataFrame:
    """path, page and what ``operators.native.extract_pages`` gives of every page of files (path) by a decoder; poor pages can go on to ``scan``."""
    pages = numbered_pages(page_counts(files, decoder))
    rows = {kind: page_rows(pages, decoder, kind) for kind in ("texts", "spans", "tables", "graphics", "strokes")}
    own = pages.select("doc_id", "path", "page").join(rows["texts"], "doc_id", "left")
    own = own.withColumn("page_num", F.col("page") + 1)
    made = native.extract_pages(own, rows["spans"], rows["tables"], rows["graphics"], rows["strokes"], rect, session, "page_num")
    return own.select("doc_id", "path", "page_num").join(made, "doc_id").drop("doc_id")


def ocr_directory(spark: SparkSession, directory: str, engine, max_length: int = 8192) -> DataFrame:
    """name, result (JSON) of a directory's images: text and parsed elements, or the error of an image."""
    scanned = scan_images(read_images(spark, directory), engine, max_length)
    good = F.struct("name", T.clean_generated(F.col("raw")).alias("text"), records.legacy_detections(F.col("raw")).alias("elements"))
    return scanned.select("name", F.when(F.col("error").isNull(), F.to_json(good)).otherwise(F.to_json(F.struct("error"))).alias("result"))


def ocr_image(spark: SparkSession, path: str, engine, max_length: int = 8192) -> DataFrame:
    """The same for one image."""
    return ocr_directory(spark, path, engine, max_length)


def audit(pages: DataFrame) -> DataFrame:
    """Verdicts of documents from pages (document, text, prose, markdown, real_tables, cells, content_images)."""
    found = _audit.problems(*(F.col(c) for c in ("text", "prose", "markdown", "real_tables", "cells", "content_images")))
    return _audit.verdicts(pages.select("document", found.alias("problems")), "document")


def status(spark: SparkSession, engine=None) -> DataFrame:
    """One row: whether an engine is set, its name, and the Spark version."""
    name = None if engine is None else getattr(engine, "__name__", type(engine).__name__)
    return spark.createDataFrame([(engine is not None, name, spark.version)], "loaded boolean, engine string, spark string")
