"""Native extraction, decoders, crops, pictures in documents, keys of any type, commands."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from folioscope import __main__ as commands
from folioscope import api
from folioscope.functions import arrays as A
from folioscope.functions import text as T
from folioscope.operators import audit, experts, figures, hybrid, layout, native, tables
from folioscope.sources import providers, sinks
from folioscope.sources.providers import FakeEngine

RECT = (0.0, 0.0, 600.0, 1000.0)
PROSE = "A line of prose that is long enough to count as text of a page."


def make_decoder():
    """A decoder of made-up documents, defined here so that workers get it by value."""

    class Document:
        def __init__(self, path):
            if "broken" in path:
                raise OSError("no such file")
            self.name = path.split("/")[-1]
            self.page_count = 2 if self.name == "two" else 1

        def texts(self, page):
            if page == 0:
                yield (f"1. SCOPE\n{PROSE}\nFigure 1: A drawing",)
            else:
                yield ("",)

        def _line(self, block, line, y, text, size=10.0, font="Sans"):
            box = (60.0, y, 60.0 + 5 * len(text), y + 10)
            yield (block, line, 0, text, *box, size, font, *box)

        def spans(self, page):
            if page == 0:
                yield from self._line(0, 0, 100.0, "1. SCOPE", 14.0, "Sans-Bold")
                yield from self._line(0, 1, 120.0, PROSE)
                for r in range(3):
                    for c in range(3):
                        x = 100.0 + 150 * c
                        yield (1, r, c, f"r{r}c{c}", x, 310.0 + 30 * r, x + 30, 320.0 + 30 * r, 10.0, "Sans", 100.0, 310.0 + 30 * r, 430.0, 320.0 + 30 * r)
                yield from self._line(2, 0, 900.0, "Figure 1: A drawing")

        def graphics(self, page):
            if page == 0:
                yield ("drawing", 100.0, 560.0, 500.0, 680.0)
            else:
                yield ("image", 100.0, 300.0, 400.0, 500.0)

        def strokes(self, page):
            if page == 0:
                for x in (95.0, 245.0, 395.0, 545.0):
                    yield ("l", x, 300.0, x, 390.0, 95.0, 300.0, 545.0, 390.0)
                for y in (330.0, 360.0):
                    yield ("l", 95.0, y, 545.0, y, 95.0, 300.0, 545.0, 390.0)

        def tables(self, page):
            if self.name == "two" and page == 1:
                raise RuntimeError("the finder failed")
            if page == 0:
                yield (0, 95.0, 300.0, 545.0, 390.0, [[95.0, 300.0, 545.0, 390.0]], [["r0c0", "r0c1", "r0c2"], ["r1c0", "r1c1", "r1c2"], ["r2c0", "r2c1", "r2c2"]])

        def render(self, page, dpi):
            return f"{self.name}-{page}-{dpi}".encode()

    return Document


def test_native_pages(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    request.addfinalizer(lambda: spark.conf.set("spark.sql.shuffle.partitions", before))
    files = spark.createDataFrame([("/x/one",), ("/x/two",), ("/x/broken",)], "path string")
    decoder = make_decoder()
    counts = {r.path: r.pages for r in providers.page_counts(files, decoder).collect()}
    assert counts == {"/x/one": 1, "/x/two": 2, "/x/broken": None}
    got = {(r.path, r.page_num): r for r in api.native_pages(files, decoder, RECT, "s").collect()}
    assert set(got) == {("/x/one", 1), ("/x/two", 1), ("/x/two", 2)}
    r = got["/x/one", 1]
    assert r.tables == 1 and r.figures == 1
    table = "| r0c0 | r0c1 | r0c2 |\n| --- | --- | --- |\n| r1c0 | r1c1 | r1c2 |\n| r2c0 | r2c1 | r2c2 |"
    assert r.markdown.startswith(f"## 1. SCOPE\n{PROSE}\n\n{table}\n\n![Figure 1: A drawing](/api/region-image/s/1/") and r.markdown.endswith(")\n\nFigure 1: A drawing")
    assert [d.type for d in r.detections] == ["title", "text", "table", "image", "text"]
    assert [(x.region_id, x.type) for x in r.regions] == [("figure-1", "figure"), ("table-1", "table"), ("text-1", "title"), ("text-2", "text"), ("text-6", "text")]
    a = r.analysis
    assert (a.text_blocks, a.image_count, a.image_coverage, a.drawing_count, a.table_count, a.figure_count, a.column_count) == (3, 0, 0.0, 1, 1, 1, 2)
    assert a.text_chars == len("".join(f"1. SCOPE\n{PROSE}\nFigure 1: A drawing".split())) and a.native_markdown_chars == len("".join(r.markdown.split()))
    picture = got["/x/two", 2]
    assert picture.markdown.startswith("![插图](/api/region-image/s/2/") and (picture.tables, picture.figures, picture.analysis.text_chars, picture.analysis.image_count) == (0, 1, 0, 1)
    assert picture.analysis.image_coverage == pytest.approx(60000 / 600000)


def test_rendered_opened_and_cropped(spark):
    pages = spark.createDataFrame([("/x/two", 0), ("/x/two", 1)], "path string, page int")
    assert [(r.name, bytes(r.image)) for r in providers.rendered(pages, make_decoder(), 72).orderBy("page").collect()] == [("page_0001.png", b"two-0-72"), ("page_0002.png", b"two-1-72")]

    def opener(content, upright):
        if content == b"bad" or (upright and content == b"odd"):
            raise ValueError("cannot open")
        return content.upper() if upright else content

    files = spark.createDataFrame([("a", bytearray(b"good")), ("b", bytearray(b"odd")), ("c", bytearray(b"bad"))], "path string, content binary")
    assert {r.path: r.image and bytes(r.image) for r in providers.open_images(files, opener).collect()} == {"a": b"GOOD", "b": b"odd", "c": None}
    results = spark.createDataFrame([("h1", 1, "x ![c](/api/region-image/h1/1/100%2C200%2C500%2C600) ![c](/api/region-image/h1/1/100%2C200%2C500%2C600) ![d](/api/region-image/h1/1/0,0,0,0)")], "session_id string, page_num int, markdown string")
    sizes = spark.createDataFrame([("h1", 1, 1000, 2000)], "session_id string, page_num int, width int, height int")
    crops = api.region_crops(results, sizes)
    got = {r.name: r.pixels for r in crops.collect()}
    assert got["page-1-100-200-500-600.png"] == [92, 392, 508, 1208] and len(got) == 2
    pictures = spark.createDataFrame([("h1", 1, bytearray(b"picture"))], "session_id string, page_num int, image binary")

    def cutter(image, pixels):
        if pixels[0] == 0:
            raise ValueError("too small")
        return image + bytes([len(pixels)])

    cut = {r.name: (r.content and bytes(r.content), r.error) for r in providers.crop_images(crops, pictures, cutter).collect()}
    assert cut == {"page-1-100-200-500-600.png": (b"picture\x04", None), "page-1-0-0-0-0.png": (None, "too small")}


def test_pictures_in_documents(spark):
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (200).to_bytes(4, "big") + (100).to_bytes(4, "big") + b"rest"
    results = spark.createDataFrame([("h", 1, [("image", [1, 2, 3, 4], "A"), ("image", [5, 6, 7, 8], "B"), ("text", [], "words")])], "session_id string, page_num int, detections array<struct<type:string,bbox:array<int>,text:string>>")
    none = spark.createDataFrame([], "session_id string, page_num int, index int, translated string")
    pictures = spark.createDataFrame([("h", "page-1-1-2-3-4.png", bytearray(png)), ("h", "page-1-5-6-7-8.png", bytearray(b"no picture"))], "session_id string, name string, content binary")
    with zipfile.ZipFile(io.BytesIO(bytes(api.export_docx(results, none, pictures=pictures).first().docx))) as z:
        body, links = z.read("word/document.xml").decode(), z.read("word/_rels/document.xml.rels").decode()
        assert z.read("word/media/image1.png") == png and body.count("<w:drawing>") == 1 and 'cx="5334000" cy="2667000"' in body
        assert body.count("[图片]") == 1 and 'Id="rId1"' in links and "words" in body


HYBRID = "session_id string, page_num int, text string, image string, regions array<struct<region_id:string,type:string,x0:double,y0:double,x1:double,y1:double,normalized_bbox:array<int>,source:string,content:string,confidence:double>>"


def test_scan_with_text_keys_and_hybrid_pages(spark):
    """Session ids are texts; poor tables of hybrid pages are read again, each once, and a failure is a warning."""
    poor, good = "|A|B|\n|1|", "|A|B|\n|-|-|\n|1|2|"
    regions = lambda content: [("text-1", "text", 0.0, 1.0, 9.0, 2.0, [0, 1, 9, 2], "native", "body", None), ("table-1", "table", 0.0, 5.0, 9.0, 9.0, [0, 5, 9, 9], "native", content, None)]
    words = "native words " * 20
    rows = [("a1b2c3d4", 1, words, "good", regions(poor)), ("a1b2c3d4", 2, words, "down", regions(poor)), ("a1b2c3d4", 3, words, "good", regions(good)), ("ffff", 1, "", "seen", None), ("ffff", 2, words, "x", None)]
    engine = FakeEngine({"good": "<|det|>table [0,0,9,9]<|/det|>read again", "down": RuntimeError("engine is down"), "seen": "<|det|>text [1,2,3,4]<|/det|>by eye"})
    pages = spark.createDataFrame(rows, HYBRID)
    got = {(r.session_id, r.page_num): r for r in api.scan(pages.where("page_num < 9"), engine, force_mode=None).collect()}
    assert {k: r.route for k, r in got.items()} == {("a1b2c3d4", 1): "native", ("a1b2c3d4", 2): "native", ("a1b2c3d4", 3): "native", ("ffff", 1): "vlm", ("ffff", 2): "native"}
    got = {(r.session_id, r.page_num): r for r in api.scan(pages.where("session_id = 'a1b2c3d4'"), engine, force_mode="hybrid").collect()}
    assert [got["a1b2c3d4", k].status for k in (1, 2, 3)] == ["done", "warning", "done"] and {r.source for r in got.values()} == {"hybrid"}
    assert got["a1b2c3d4", 1].markdown == "body\n\nread again" and [d.text for d in got["a1b2c3d4", 2].detections] == ["body", poor]
    assert [(w.type, w.region_id, w.message) for w in got["a1b2c3d4", 2].warnings] == [("region_ocr_failed", "table-1", "engine is down")]
    assert good in got["a1b2c3d4", 3].markdown
    results = api.scan(pages, engine).withColumn("attempt", F.lit(1))
    again = api.rescan(results, pages, spark.createDataFrame([("ffff", 1)], "session_id string, page_num int"), FakeEngine({"seen": "<|det|>text [1,2,3,4]<|/det|>better"}))
    assert {(r.session_id, r.page_num): (r.attempt, r.markdown) for r in again.where("session_id = 'ffff' and page_num = 1").collect()} == {("ffff", 1): (2, "better")}


def test_engine_is_asked_once(spark, tmp_path):
    log = str(tmp_path / "asked")

    def engine():
        class Counting:
            def read(self, image, box, max_length):
                with open(log, "a") as f:
                    f.write(image + "\n")
                return "<|det|>table [0,0,9,9]<|/det|>x"

        return Counting

    region = [("table-1", "table", 0.0, 5.0, 9.0, 9.0, [0, 5, 9, 9], "native", "|A|B|\n|1|", None)]
    pages = spark.createDataFrame([("s", 1, "", "one", None), ("s", 2, "words " * 40, "two", region)], HYBRID)
    made = api.scan(pages.where("page_num = 1"), engine()).collect() + api.scan(pages.where("page_num = 2"), engine(), force_mode="hybrid").collect()
    assert len(made) == 2 and sorted(open(log).read().split()) == ["one", "two"]


FORMULAS = [
    ("((theta_blk)6 * ((acc_z)SAT * (acc_z)SAT )6 )10 > ((acc_x)SAT * (acc_x)SAT)10 + ((acc_y)SAT * (acc_y)SAT)10", 0),
    ("[((theta_flat)6 * ((acc_z)SAT * (acc_z)SAT )6 )10 + (“000000” & int_flat_hy) < ((acc_x)SAT * (acc_x)SAT )10 + ((acc_y)SAT * (acc_y)SAT )10 ] OR NOT (no_movement)", 1),
    ("[((theta_flat)6 * ((acc_z)SAT * (acc_z)SAT )6 )10 – (“000000” & int_flat_hy) >= ((acc_x)SAT * (acc_x)SAT )10 + ((acc_y)SAT * (acc_y)SAT )10 AND (no_movement)", 2),
]


@pytest.mark.parametrize("text,k", FORMULAS)
def test_known_formulas(spark, text, k):
    got = spark.range(1).select(T.convert_math(F.lit(f"before {text} after")).alias("x")).first().x
    assert got.startswith("before " + T.MATH[k][1][:30]) and T.MATH[k][1] in got


def test_formulas_of_one_page(spark):
    text = f"intro {T.PAGE_30_ANCHOR}  (1)\n (2)\n (3) rest"
    got = spark.range(1).select(T.convert_math(F.lit(text), F.lit(30)).alias("a"), T.convert_math(F.lit(text), F.lit(29)).alias("b")).first()
    assert got.a == f"intro {T.PAGE_30_ANCHOR}\n\n{T.PAGE_30_FORMULAS} rest" and got.b == text


def test_line_centers(spark):
    raw = spark.createDataFrame([(1, 0, "The Begin ning of a line that goes on"), (1, 1, "nowhere to be seen at all"), (1, 2, "x")], "doc_id long, raw_no int, text string")
    lines = spark.createDataFrame([(1, 0, "other", 0.0, 10.0), (1, 1, "the beginning of a line that goes elsewhere", 20.0, 30.0), (1, 2, "xy", 40.0, 44.0)], "doc_id long, line_no int, text string, y0 double, y1 double")
    assert {r.raw_no: r.center for r in audit.line_centers(raw, lines).collect()} == {0: 25.0, 1: None, 2: 42.0}


def test_dispatch_and_back(spark):
    """Slots of an expert go from 0 in the order of keys, whatever the parts; answers come back to their rows."""
    rows = spark.range(500).select(F.col("id").alias("row"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: ((F.col("id") * 31 + k * k * 17) % 101).cast("double")).alias("scores"))
    routed = rows.select("row", experts.route(F.col("scores"), 3).alias("chosen"))
    for parts in (1, 7, 256):
        got = experts.dispatch(routed, "row", parts=parts).collect()
        by = {}
        for r in got:
            by.setdefault(r.expert, []).append((r.slot, r.row))
        assert all([k for k, _ in sorted(v)] == list(range(len(v))) and [x for _, x in sorted(v)] == sorted(x for _, x in v) for v in by.values()) and sum(map(len, by.values())) == 1500
    back = experts.collect_back(experts.dispatch(routed, "row").withColumn("v", F.lit(2.0)), "row", "v").count()
    assert back == 500 and experts.dispatch(routed.limit(0), "row").count() == 0


def test_repetitive_by_one_fold(spark):
    from folioscope.operators import records

    cases = {"a\na\na": True, "a\nb\na\nb\na": True, "a\na\nb": False, "a\na\na\nb\nc\nd\ne": False, "": False, "text [1,2] x\ntext [3,4] x\nx": True}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", records.is_repetitive(F.col("t")).alias("r")).collect()
    assert {r.t: r.r for r in got} == cases


def test_directory_tools_and_commands(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("a.png", "b.jpg", "c.txt"):
        (folder / name).write_bytes(b"x")
    engine = FakeEngine({"a.png": "<|det|>text [1,2,3,4]<|/det|>words", "b.jpg": RuntimeError("no")})
    got = {r.name: json.loads(r.result) for r in api.ocr_directory(spark, str(folder), engine).collect()}
    assert got["b.jpg"] == {"error": "no"} and got["a.png"]["elements"][0]["text"] == "words" and set(got) == {"a.png", "b.jpg"}
    assert json.loads(api.ocr_image(spark, str(folder / "a.png"), engine).first().result)["name"] == "a.png"
    assert commands.scan(spark, str(folder), str(tmp_path / "out"), engine, 100) == 1
    reports = {r.stem: r.report for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert reports["a"].startswith("# OCR result: a.png") and reports["b"] is None
    pages = spark.createDataFrame([("d1", "Some text of a page", ["Some text of a page"], "Some text of a page", 0, [], 0), ("d2", "Figure 1: gone " * 9, ["words"], "q", 0, [], 0)], "document string, text string, prose array<string>, markdown string, real_tables int, cells array<string>, content_images int")
    pages.write.parquet(str(tmp_path / "pages"))
    assert commands.audit(spark, str(tmp_path / "pages"), True) == 1


def test_small_functions(spark):
    one = spark.range(1).select(
        tables.is_real(F.lit(0), F.lit(0), F.lit(200), F.lit(30), F.lit(3), F.lit([["a", "b"], ["c", "d"], ["e", "f"]])).alias("real"), T.format_bytes(F.lit(5 * 2**20 // 2)).alias("size"),
        audit.table_blocks(F.lit("| a\n| b\nx\n| c |\n\n| d")).alias("blocks"), figures.caption_parts(F.lit("Fig. 1 left Fig. 2 right")).alias("parts"), A.longest_common_prefix(F.lit("abcd"), F.lit("abx")).alias("common"),
        hybrid.map_detections(F.lit([]).cast("array<struct<type:string,bbox:array<int>,text:string>>"), F.lit([0, 0, 9, 9])).alias("none"), sinks.saved_text(F.lit("a<|det|>image [1,2,3,4]<|/det|>b")).alias("saved"),
    ).first()
    assert one.real and one.size == "2.5 MB" and one.blocks == ["| a\n| b", "| c |", "| d"] and [p.text for p in one.parts] == ["Fig. 1 left", "Fig. 2 right"]
    assert one.common == 2 and one.none == [] and one.saved == "a![](images/0.jpg)b"


def test_spans_to_lines(spark):
    rows = [(1, 1, 0, 0, "second", 10.0, 50.0, 20.0, 60.0, 9.0, "Sans", 10.0, 50.0, 90.0, 60.0), (1, 0, 0, 1, "line", 60.0, 10.0, 80.0, 20.0, 11.0, "Sans", 10.0, 10.0, 90.0, 20.0), (1, 0, 0, 0, "First", 10.0, 10.0, 40.0, 20.0, 12.0, "Sans-BOLD", 10.0, 10.0, 90.0, 20.0), (1, 0, 1, 0, "  ", 0.0, 30.0, 5.0, 35.0, 9.0, "Sans", 0.0, 30.0, 5.0, 35.0)]
    got = layout.lines_from_spans(spark.createDataFrame(rows, providers.SPANS)).orderBy("order_no").collect()
    assert [(r.text, r.size, r.bold, r.block_no) for r in got] == [("First line", 12.0, True, 0), ("second", 9.0, False, 1)]
    assert [tuple(r) for r in layout.block_counts(layout.lines_from_spans(spark.createDataFrame(rows, providers.SPANS))).collect()] == [(1, 2)]
    assert native.page_lines(spark.createDataFrame(rows, providers.SPANS)).columns[:3] == ["doc_id", "block_no", "line_no"]
