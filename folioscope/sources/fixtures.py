"""Deterministic views that give the layout operators something to work on, over plain tables.

Documents become pages of lines with geometry, boxes, grounded raw text and damaged text; events
become scans; embeddings become router scores; line items become numeric cells. The same rules are
stated as DuckDB CTEs in ``folioscope.plans.oracles``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

PAGE = (0.0, 0.0, 600.0, 1000.0)
LINE_TYPES = ("text", "title", "image", "table", "page_number", "display-formula", "figure")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no, text of all lines; a document is one page, as tall as its lines need."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", -1).alias("l"))
    return docs.select("doc_id", F.posexplode("l").alias("line_no", "text"))


def _geometry(doc: Column, no: Column, text: Column) -> dict[str, Column]:
    x0 = 50 + 250 * (no % 2) * (doc % 2) + (no * 7) % 11
    y0 = 90 + 14 * F.floor(no / (1 + doc % 2))
    return {"x0": x0.cast("long"), "y0": y0.cast("long"), "x1": (x0 + F.least(F.lit(240), 5 * F.length(text))).cast("long"), "y1": (y0 + 10 + 60 * (no % 14 == 1).cast("int")).cast("long"), "size": F.when(no % 17 == 0, 14).otherwise(10), "bold": no % 17 == 0}


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines with x0, y0, x1, y1 in page points, size and bold."""
    base = lines(spark, sf_dir)
    return base.select("doc_id", "line_no", "text", *(c.alias(n) for n, c in _geometry(F.col("doc_id"), F.col("line_no"), F.col("text")).items()))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of lines as spans of ``providers.SPANS``: every fifth small, every seventh raised, gaps of 1 or 4 points; four lines make a block."""
    words = F.filter(F.split("text", " ", -1), lambda w: T.strip(w) != "")
    each = geo(spark, sf_dir).select("doc_id", "line_no", "x0", "y0", "x1", "y1", "bold", F.posexplode(words).alias("span_no", "word"))
    k = F.col("span_no")
    left, up = (k * 20 + F.when(k % 3 == 2, 3).otherwise(0)).cast("double"), F.when(k % 7 == 4, 2.0).otherwise(0.0)
    line = [F.col(c).cast("double").alias("l" + c) for c in ("x0", "y0", "x1", "y1")]
    return each.select(
        "doc_id", F.floor(F.col("line_no") / 4).cast("int").alias("block_no"), "line_no", "span_no", F.col("word").alias("text"), left.alias("x0"), (F.col("y0") - up).cast("double").alias("y0"), (k * 20 + 19).cast("double").alias("x1"),
        (F.col("y0") + 10 - up).cast("double").alias("y1"), F.when(k % 5 == 4, 7.0).otherwise(10.0).alias("size"), F.when(F.col("bold"), "Sans-Bold").otherwise("Sans").alias("font"), *line,
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, kind, box_no, x0, y0, x1, y1: tables, nested tables and figures of some pages."""
    made = F.array(
        F.when(F.col("doc_id") % 3 == 0, F.struct(F.lit("table").alias("kind"), F.lit(0).alias("box_no"), *(F.lit(v).cast("long").alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (40, 118, 560, 160), strict=True)))),
        F.when(F.col("doc_id") % 6 == 0, F.struct(F.lit("table").alias("kind"), F.lit(1).alias("box_no"), *(F.lit(v).cast("long").alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (50, 125, 550, 153), strict=True)))),
        F.when(F.col("doc_id") % 5 == 0, F.struct(F.lit("figure").alias("kind"), F.lit(0).alias("box_no"), *(F.lit(v).cast("long").alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (40, 174, 560, 216), strict=True)))),
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(made).alias("b")).where("b is not null").select("doc_id", "b.*")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, raw: one grounded text for each document, some records malformed or truncated."""
    doc = F.col("doc_id")

    def record(text: Column, no: Column) -> Column:
        g = _geometry(doc, no, text)
        x1 = F.when(no % 19 == 0, F.lit(2000)).when(no % 13 == 0, g["x0"] - 5).otherwise(g["x1"] + 1)
        kind = F.get(F.array(*map(F.lit, LINE_TYPES)), (no % 7).cast("int"))
        return F.concat(F.lit("<|det|>"), kind, F.lit(" ["), g["x0"].cast("string"), F.lit(", "), g["y0"].cast("string"), F.lit(", "), x1.cast("string"), F.lit(", "), g["y1"].cast("string"), F.lit("]<|/det|>"), text)

    body = F.array_join(F.transform(F.split("text", "\n", -1), record), "\n")
    preface = F.when(doc % 7 == 0, F.lit("[non-text]\n")).when(doc % 7 == 1, F.lit("Loose words first\n")).otherwise(F.lit(""))
    tail = F.when(doc % 11 == 0, F.lit("\n<|det|>text [1, 2, 3")).when(doc % 11 == 1, F.lit("\n\nLoose words last")).otherwise(F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(preface, body, tail).alias("raw"))


def damaged(doc: Column, text: Column) -> Column:
    """A document's text with broken glyphs, a numbered heading or a caption line, by its id."""
    text = F.when(doc % 10 == 0, F.replace(text, F.lit("s"), F.lit(chr(0xF073)))).when(doc % 20 == 7, F.replace(text, F.lit("e"), F.lit("\N{REPLACEMENT CHARACTER}"))).otherwise(text)
    text = F.when(doc % 4 == 0, F.concat((doc % 9 + 1).cast("string"), F.lit(". SCOPE AND TERMS\n"), text)).otherwise(text)
    return F.when(doc % 5 == 0, F.concat(text, F.lit("\nFigure "), (doc % 7 + 1).cast("string"), F.lit(": a drawing"))).otherwise(text)


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: broken glyphs, numbered headings and caption lines in some documents."""
    return table(spark, sf_dir, "documents").select("doc_id", damaged(F.col("doc_id"), F.col("text")).alias("text"))


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, page_num, event_id, ts, event, value; the order of a page's events is (ts, event_id)."""
    names = F.create_map(*(F.lit(x) for x in ("signup", "page_start", "click", "token", "view", "det_result", "purchase", "page_done", "error", "error")))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), (F.col("event_id") % 5).alias("page_num"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.coalesce(F.try_element_at(names, F.col("event_type")), F.col("event_type")).alias("event"), "value")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, scores: router scores of as many experts as the vectors are wide."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("scores"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, row_no, part, supp, value: whole numbers; a page's rows are in the order of (row_no, part, supp)."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("row_no"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").alias("value"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "html")
