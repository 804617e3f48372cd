"""Parser cases: records, boxes, artifacts, bare text, Markdown, blocks, HTML."""

import pytest
from pyspark.sql import functions as F

from folioscope.functions import geometry as G
from folioscope.operators import blocks, records


def rows(spark, text, make):
    return spark.createDataFrame([(text,)], "raw string").select(make(F.col("raw")).alias("x")).first().x


def dets(spark, raw):
    return [(d.type, list(d.bbox), d.text) for d in rows(spark, raw, records.detections)]


D = "<|det|>{}<|/det|>{}"


@pytest.mark.parametrize(
    "raw,want",
    [
        ("", []),
        (None, []),
        (D.format("text [1,2,30,40]", "hello"), [("text", [1, 2, 30, 40], "hello")]),
        (D.format("table [10,20,900,500]", "|A|B|\n|-|-|\n|1|2|"), [("table", [10, 20, 900, 500], "|A|B|\n|-|-|\n|1|2|")]),
        (D.format("text [1,2,3,4]", "a") + D.format("title [5,6,7,8]", "b"), [("text", [1, 2, 3, 4], "a"), ("title", [5, 6, 7, 8], "b")]),
        (D.format("display-formula [1,1,10,10]", "x = 1\ny = 2"), [("display-formula", [1, 1, 10, 10], "x = 1\ny = 2")]),
        (D.format("text [a,b,c,d]", "kept"), [("text", [], "kept")]),
        (D.format("text [2000,1,3000,2]", "a") + D.format("text [50,50,10,10]", "b"), [("text", [], "a"), ("text", [], "b")]),
        (D.format("text [1,2,3,4]", "whole") + "<|det|>text [5,6", [("text", [1, 2, 3, 4], "whole")]),
        ("<|det|>text [5,6", []),
        ("preface\n" + D.format("text [1,2,3,4]", "body\n\ntrailing"), [("text", [], "preface"), ("text", [1, 2, 3, 4], "body"), ("text", [], "trailing")]),
        (D.format("text [1,2,3,4]", "one\n\nmiddle\n") + D.format("text [5,6,7,8]", "two"), [("text", [1, 2, 3, 4], "one"), ("text", [], "middle"), ("text", [5, 6, 7, 8], "two")]),
        ("[non-text]\n" + D.format("text [1,2,3,4]", "a"), [("text", [1, 2, 3, 4], "a")]),
        ("figure [1,2,3,4]", []),
        ("only bare text", [("text", [], "only bare text")]),
        ("<|det|> text [1, 2, 30, 40] <|/det|> hi", [("text", [1, 2, 30, 40], "hi")]),
        (D.format("", "no type"), [("text", [], "no type")]),
        (D.format("text", "no box"), [("text", [], "no box")]),
        (D.format("text [1,2,3,4]", "  \n "), []),
        (D.format("x<|det|>y [1,2,3,4]", "z"), [("x<|det|>y", [1, 2, 3, 4], "z")]),
    ],
)
def test_detections(spark, raw, want):
    assert dets(spark, raw) == want


@pytest.mark.parametrize(
    "values,want",
    [
        (["1", "2", "3", "4"], [1, 2, 3, 4]),
        (["33.5", "1", "40.9", "2"], [33, 1, 40, 2]),
        (["1", "2", "3"], []),
        (["1", "2", "3", "4", "5"], []),
        (["10", "2", "10", "4"], []),
        (["-0.5", "0", "1000.9", "1"], [0, 0, 1000, 1]),
        (["-1", "0", "5", "5"], []),
        (["nan", "1", "2", "3"], []),
        (["inf", "1", "2", "3"], []),
        (["5d", "1", "9", "3"], []),
        (["1_0", "1", "2e1", "3"], [10, 1, 20, 3]),
        ([], []),
    ],
)
def test_boxes(spark, values, want):
    got = spark.createDataFrame([(values,)], "v array<string>").select(G.valid_box(F.col("v")).alias("b")).first().b
    assert list(got) == want


@pytest.mark.parametrize("line,want", [("[non-text]", True), (" [Non Text] ", True), ("<|det|>open", True), ("figure [1,2,3,4]", True), ("text [1, 2]", True), ("a line", False), ("see [1]", True), ("see this [1]", False)])
def test_artifacts(spark, line, want):
    assert rows(spark, line, records.is_artifact) is want


def test_native_text(spark):
    text = "Index of contents\r\n\r\n\r\n1. GENERAL TERMS ..... 4\n2. SCOPE and more\n  plain  \n"
    assert rows(spark, text, records.native_markdown) == "# Index of contents\n\n## 1. GENERAL TERMS ..... 4\n2. SCOPE and more\nplain"
    assert [(d.type, d.text) for d in rows(spark, text, records.native_detections)] == [("title", "Index of contents"), ("title", "1. GENERAL TERMS ..... 4"), ("title", "2. SCOPE and more"), ("text", "plain")]


@pytest.mark.parametrize("text,want", [("a\na\na", True), ("a\na\nb", False), ("text [1] a\ntitle [2] a\na\nb\nc", True), ("a\na", False), ("", False), ("a\na\na\nb\nc\nd\ne", False)])
def test_repetition(spark, text, want):
    assert rows(spark, text, records.is_repetitive) is want


def test_markdown(spark):
    raw = D.format("image [1, 2, 3, 4]", "\n") + D.format("title [1,2,3,4]", "# Head\n") + D.format("formula [1,2,3,4]", "x=1\n") + D.format("text [1,2,3,4]", "body<｜end▁of▁sentence｜>\n[non_text]\nfigure [1,2]\n<|ref|>z")
    md = lambda session: rows(spark, raw, lambda c: records.raw_markdown(c, F.lit(session), F.lit(3)))
    assert md("a b") == "![图表或图片区域](/api/region-image/a%20b/3/1%2C2%2C3%2C4)\n\n# Head\n\nx=1\nbody\n\nz"
    assert md("").startswith("# Head") and "region-image" not in md("") and rows(spark, "", lambda c: records.raw_markdown(c, F.lit("s"), F.lit(1))) == ""


def test_blocks_and_html(spark):
    raw = D.format("title [1,1,10,90]", "Big") + D.format("text [1,2,3,4]", "a") + D.format("formula [1,2,3,5]", "b") + D.format("table [1,2,3,4]", "<t>") + D.format("text [1,2,3,4]", "c") + D.format("page_number [1,2,3,4]", "7") + D.format("title [1,1,10,20]", "small") + D.format("image [1,2,3,4]", "x")
    got = rows(spark, raw, lambda c: blocks.blocks(records.detections(c)))
    assert [(b.block_type, b.text, b.level) for b in got] == [("heading", "Big", 1), ("paragraph", "a\nb", None), ("table", "<t>", None), ("paragraph", "c", None), ("page_number", "7", None), ("heading", "small", 2), ("image", "x", None)]
    assert list(got[1].bbox) == [1, 2, 3, 4]
    html = rows(spark, raw, lambda c: blocks.page_html(records.detections(c), F.lit(4)))
    assert html.startswith('<div class="ocr-page" data-page="4">\n<h1 class="ocr-heading"') and "&lt;t&gt;" in html and 'data-detection-index="7"' in html and "<h2" in html
    assert rows(spark, "", lambda c: blocks.page_html(records.detections(c), F.lit(1))) == blocks.EMPTY_PAGE


def test_references(spark):
    text = "<|ref|>image<|/ref|><|det|>[[1, 2, 3, 4], [5, 6, 7, 8]]<|/det|> and <|det|> title [1, 2, 3, 4] <|/det|> and <|ref|>x<|/ref|><|det|>import os<|/det|>"
    got = [(r.label, r.boxes, r.is_image) for r in rows(spark, text, records.references)]
    assert got == [("image", [[1, 2, 3, 4], [5, 6, 7, 8]], True), ("x", None, False), ("title", [[1, 2, 3, 4]], False)]


def test_legacy_parser_keeps_the_last_record(spark):
    raw = D.format("text [1,2,3,4]", "a") + D.format("display-formula [1,2,3,4]", "b") + D.format("title [9999,2,3,4]", "c")
    assert [(d.type, d.text) for d in rows(spark, raw, records.legacy_detections)] == [("text", "a"), ("title", "c")]
