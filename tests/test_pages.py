"""Routing, regions, hybrid pages, scans, limits, exports and providers, case by case."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from folioscope.functions import arrays as A
from folioscope.functions import geometry as G
from folioscope.functions import text as T
from folioscope.operators import audit, experts, figures, hybrid, layout, prompts, routing, sequences, state, tables, tiling, translate
from folioscope.sources import providers, sinks


def one(spark, **cols):
    return spark.range(1).select(*(v.alias(k) for k, v in cols.items())).first()


def value(spark, c):
    return one(spark, x=c).x


@pytest.mark.parametrize(
    "given,want",
    [
        ({"text_chars": 3000, "text_blocks": 40}, "native"), ({"text_chars": 10}, "vlm"), ({"text_chars": 79}, "vlm"), ({"text_chars": 2000, "table_count": 3}, "hybrid"),
        ({"text_chars": 1500, "image_coverage": 0.4}, "hybrid"), ({"text_chars": 5000, "suspicious_char_ratio": 0.1}, "vlm"), ({"text_chars": 3000, "column_count": 2}, "hybrid"),
        ({"text_chars": 80}, "native"), ({"text_chars": 80, "image_coverage": 0.099}, "native"), ({"text_chars": 80, "image_coverage": 0.10}, "hybrid"),
        ({"text_chars": 80, "suspicious_char_ratio": 0.04}, "vlm"), ({"text_chars": 10, "table_count": 3}, "vlm"), ({"text_chars": 3000, "unknown": 1}, "native"),
    ],
)
def test_routes(spark, given, want):
    a = routing.analysis_from_json(F.lit(json.dumps(given)))
    got = spark.range(1).select(a.alias("a")).select("a", routing.route_page(F.col("a"), F.lit(5), F.lit(None)).alias("r"), routing.route_page(F.col("a"), F.lit(5), F.lit("hybrid")).alias("f")).first()
    assert (got.r, got.f) == (want, "hybrid") and got.a.column_count == given.get("column_count", 1)


def test_route_without_analysis(spark):
    none = F.lit(None).cast(routing.ANALYSIS)
    assert [value(spark, routing.route_page(none, F.lit(n), F.lit(None).cast("string"))) for n in (3000, 10, 80)] == ["native", "vlm", "native"]


@pytest.mark.parametrize("text,low,high", [("", 0, 0), ("a\N{REPLACEMENT CHARACTER}b\N{REPLACEMENT CHARACTER}c", 0.4, 0.4), ("a\x01b", 0.2, 1), ("a\tb\nc\r", 0, 0), (chr(0xE000), 1, 1)])
def test_suspicious(spark, text, low, high):
    assert low <= value(spark, T.suspicious_ratio(F.lit(text))) <= high


@pytest.mark.parametrize("lefts,want", [([10, 20, 30, 40, 50], 1), ([10, 12, 15, 18, 520, 525, 530, 540], 2), ([], 1), ([10] * 8, 1)])
def test_columns(spark, lefts, want):
    assert value(spark, routing.column_count(F.lit([float(v) for v in lefts]) if lefts else A.doubles())) == want


@pytest.mark.parametrize("req,cap,want", [(8192, 8192, 8192), (16000, 8192, 8192), (512, 8192, 512), (10, 8192, 128), (-5, 8192, 128)])
def test_token_cap(spark, req, cap, want):
    assert value(spark, routing.token_cap(F.lit(req), F.lit(cap))) == want


@pytest.mark.parametrize("n,cap,stop,want", [(8192, 8192, None, True), (8191, 8192, None, False), (500, 8192, "length", True), (8192, 8192, "eos_token_id", False)])
def test_truncation(spark, n, cap, stop, want):
    assert value(spark, routing.is_truncated(F.lit(n), F.lit(cap), F.lit(stop).cast("string"))) is want


@pytest.mark.parametrize("content,low,high", [("|A|B|\n|-|-|\n|1|2|", 0.7, 1.0), ("|A|B|\n|1|", 0.575, 0.575), ("", 0, 0), ("|A|B|", 0, 0), (None, 0, 0), ("|\n|", 0, 0)])
def test_table_quality(spark, content, low, high):
    assert low <= value(spark, tables.quality(F.lit(content).cast("string"))) <= high


@pytest.mark.parametrize("local,region,want", [([100, 100, 500, 300], [100, 200, 900, 800], [180, 260, 500, 380]), ([1, 2, 3, 4], [0, 0, 1000, 1000], [1, 2, 3, 4]), ([1, 2, 3], [0, 0, 1, 1], []), ([0, 0, 1000, 1000], [900, 900, 1000, 1000], [900, 900, 1000, 1000])])
def test_remap(spark, local, region, want):
    assert value(spark, G.crop_to_page(F.lit(local), F.lit(region))) == want


@pytest.mark.parametrize("box,size,padding,want", [([0, 0, 500, 500], 100, 0, [0, 0, 50, 50]), ([0, 0, 1000, 1000], 100, 8, [0, 0, 100, 100]), ([5, 5, 5, 5], 100, 0, None)])
def test_crop(spark, box, size, padding, want):
    assert value(spark, G.crop_pixels(F.lit(box), F.lit(size), F.lit(size), padding)) == want


REGION = "doc_id long, region_id string, type string, x0 double, y0 double, x1 double, y1 double, normalized_bbox array<int>, source string, content string, confidence double"


def regions(spark, bad="|A|B|\n|1|"):
    rows = [(1, "table-1", "table", 100.0, 200.0, 900.0, 700.0, [100, 200, 900, 700], "native", bad, None), (1, "text-2", "text", 50.0, 20.0, 600.0, 40.0, [50, 20, 600, 40], "native", "body line 2", None), (1, "figure-1", "figure", 1.0, 800.0, 9.0, 900.0, [1, 800, 9, 900], "native", "cap", None)]
    return spark.createDataFrame(rows, REGION)


@pytest.mark.parametrize(
    "bad,answer,source,text,warning",
    [
        ("|A|B|\n|1|", "<|det|>table [0,0,500,500]<|/det|>read", "vlm", "read", None),
        ("|A|B|\n|1|", RuntimeError("down"), "native", "|A|B|\n|1|", "region_ocr_failed"),
        ("|A|B|\n|1|", "", "native", "|A|B|\n|1|", "region_ocr_empty"),
        ("|A|B|\n|-|-|\n|1|2|", RuntimeError("never called"), "native", "|A|B|\n|-|-|\n|1|2|", None),
    ],
)
def test_hybrid(spark, bad, answer, source, text, warning):
    images = spark.createDataFrame([(1, "p1")], "doc_id long, image string")
    r = hybrid.hybrid_pages(regions(spark, bad), images, providers.FakeEngine({"p1": answer}), F.lit("s")).first()
    assert [d.type for d in r.detections] == ["text", "table", "image"] and (r.detections[1].source, r.detections[1].text) == (source, text)
    assert ([w.type for w in r.warnings] if r.warnings else [None]) == [warning]
    assert "![cap](/api/region-image/s/1/1,800,9,900)" in r.markdown


def test_merge_last_replacement_wins_and_unknown_ids_are_ignored(spark):
    new = regions(spark).where("region_id = 'table-1'").withColumn("content", F.lit("first")).withColumn("n", F.lit(1))
    new = new.unionByName(new.withColumn("content", F.lit("last")).withColumn("n", F.lit(2))).unionByName(new.withColumn("region_id", F.lit("table-9"))).unionByName(new.withColumn("region_id", F.lit("")))
    got = hybrid.merge_regions(regions(spark), new, ["doc_id"], "n").orderBy("place").collect()
    assert [(r.region_id, r.content) for r in got] == [("text-2", "body line 2"), ("table-1", "last"), ("figure-1", "cap")]


EVENTS = "session_id long, page_num long, seq int, event string, truncated boolean, warnings int, message string"


def test_page_states(spark):
    rows = [(1, 1, 0, "page_start", None, None, None), (1, 1, 1, "page_done", False, 0, None), (1, 2, 0, "page_start", None, None, None), (1, 2, 1, "error", None, None, "boom"), (1, 3, 0, "page_start", None, None, None), (1, 3, 1, "page_done", True, 0, None),
            (1, 4, 0, "token", None, None, None), (1, 5, 0, "page_start", None, None, None), (1, 6, 0, "page_start", None, None, None), (1, 6, 1, "cancelled", None, None, None), (1, 7, 0, "page_start", None, None, None), (1, 7, 1, "page_done", None, 2, None)]
    events = spark.createDataFrame(rows, EVENTS)
    states = state.page_states(events, ["seq"])
    assert {(r.page_num, r.state, r.attempts, r.error) for r in states.collect()} == {(1, "done", 1, None), (2, "failed", 1, "boom"), (3, "warning", 1, None), (4, "pending", 0, None), (5, "processing", 1, None), (6, "cancelled", 1, None), (7, "warning", 1, None)}
    assert tuple(state.summary(states).first()) == (1, 7, 3, 1)
    retried = events.unionByName(spark.createDataFrame([(1, 2, 2, "page_start", None, None, None), (1, 2, 3, "page_done", False, 0, None)], EVENTS))
    after = {r.page_num: r for r in state.page_states(retried, ["seq"]).collect()}
    assert (after[2].state, after[2].attempts, after[2].error) == ("done", 2, None) and after[3].state == "warning"


def test_pause_and_stop(spark):
    events = spark.createDataFrame([(1, k, f"e{k}") for k in range(10)], "session_id long, seq int, event string")
    controls = spark.createDataFrame([(1, 2, "pause"), (1, 5, "resume"), (1, 8, "stop")], "session_id long, at int, action string")
    assert sorted(r.event for r in state.pause_free(events, controls, "seq").collect()) == ["e0", "e1", "e5", "e6", "e7"]
    assert state.cut_off(events, ["seq"], F.col("event") == "e4").count() == 4


def test_edits(spark):
    pages = spark.createDataFrame([(1, 1, [("title", [1, 1, 5, 5], "a"), ("text", [], "b")], "h", None, "m"), (1, 2, [("text", [], "c")], "h2", None, "m2")], "session_id long, page_num int, detections array<struct<type:string,bbox:array<int>,text:string>>, html string, blocks array<struct<block_type:string,text:string,bbox:array<int>,level:int>>, markdown string")
    edits = spark.createDataFrame([(1, 1, 1, "old", 1), (1, 1, 1, "new", 2), (1, 1, 9, "past", 3)], "session_id long, page_num int, det_index int, new_text string, edit_no int")
    for refresh, markdown in ((True, "## a\n\nnew"), (False, "m")):
        got = {r.page_num: r for r in state.apply_edits(pages, edits, refresh_markdown=refresh).collect()}
        assert got[1].detections[1].text == "new" and "new" in got[1].html and got[1].blocks[1].text == "new" and got[1].markdown == markdown
        assert got[2].html == "h2" and got[2].markdown == "m2"


def test_frames_round_trip(spark):
    made = value(spark, state.frame(F.lit("token"), F.struct(F.lit(1).alias("a"), F.lit(None).cast("string").alias("b"), F.lit("é").alias("c"))))
    assert made == 'event: token\ndata: {"a":1,"b":null,"c":"é"}\n\n'
    got = value(spark, state.parse_frames(F.lit(made + "event: x\ndata: {broken\n\n: note\n\nevent: y\r\ndata: 3\r\n\r\n")))
    assert [(p.event, p.data) for p in got] == [("token", '{"a":1,"b":null,"c":"é"}'), ("y", "3")]


def test_page_events_and_reducer(spark):
    pages = spark.createDataFrame([(1, 1, "x" * 700, [("text", [], "a")]), (1, 2, "", [])], "session_id long, page_num long, markdown string, detections array<struct<type:string,bbox:array<int>,text:string>>")
    got = state.page_events(pages).orderBy("page_num", "seq").collect()
    assert [r.event for r in got] == ["page_start", "page_progress", "token", "token", "token", "det_result", "page_done", "page_image", "page_start", "page_progress", "page_done", "page_image"]
    assert [(len(r.text), r.tokens, r.done) for r in got if r.event == "token"] == [(320, 80, False), (640, 160, False), (700, 175, True)]


def test_span_joining(spark):
    s = lambda t, x0, x1, y=10.0, size=10.0: (t, float(x0), y, float(x1), y + size, size)
    kind = "array<struct<text:string,x0:double,y0:double,x1:double,y1:double,size:double>>"
    join = lambda spans: spark.createDataFrame([(spans,)], f"s {kind}").select(layout.join_span_texts(F.col("s")).alias("x"), layout.join_cell_text(F.col("s")).alias("y")).first()
    assert join([s("V", 0, 5), s("DD", 5, 9, 14.0, 6.0)]).x == "VDD"
    assert join([s("2", 0, 5), s("n", 5, 7, 8.0, 5.0)]).x == "2^n"
    assert join([s("one", 0, 10), s("two", 20, 30)]).x == "one two"
    assert join([s("one ", 0, 10), s("two", 20, 30)]).x == "one two"
    assert join([s("b", 20, 30), s("a", 0, 10), s("c", 30.5, 35)]).x == "a bc"
    assert join([s("second", 0, 10, 30.0), s("first", 0, 10, 10.0)]).y == "first second"
    assert join([]).x == ""


def test_folds(spark):
    assert value(spark, A.dedupe_bounds(F.lit([11.0, 1.0, 3.0, 6.0, 7.0]), 4)) == [1, 6, 11]
    assert value(spark, A.cluster(F.lit([1.0, 2.0, 9.0, 3.0, 20.0]), 1.5)) == [2, 9, 20]
    assert value(spark, A.longest_common_prefix(F.lit("abcd"), F.lit("abxd"))) == 2
    assert value(spark, tables.without_slivers(tables.bands(F.lit([0.0, 10.0, 12.0, 30.0])))) == [(0.0, 12.0), (12.0, 30.0)]


def test_table_clean_up(spark):
    grid = lambda rows: F.array(*(F.array(*map(F.lit, r)) for r in rows))
    assert value(spark, tables.without_titles(grid([["OPERATING CONDITIONS", ""], ["a", "1"], ["b", ""]]))) == [["a", "1"], ["b", ""]]
    assert value(spark, tables.without_titles(grid([["Title only", ""], ["Other", ""]]))) == []
    label = [["", "h", "i"], ["x", "1", "2"], ["y", "3", "4"], ["z", "5", "6"], ["", "7", "8"]]
    assert value(spark, tables.merge_row_label(grid(label))) == [["h", "i"], ["1", "2"], ["3", "4"], ["5", "6"], ["7", "8"]]
    assert value(spark, tables.to_markdown(grid([["a", "b"], ["1", "2"]]))) == "| a | b |\n| --- | --- |\n| 1 | 2 |"
    assert value(spark, tables.kept_columns(grid([["a", "", "b"], ["c", "", ""]]))) == [["a", "b"], ["c", ""]]


def test_captions(spark):
    got = value(spark, figures.caption_parts(F.lit("Figure 1. A   Figure 2. B")))
    assert [(p.start, p.text) for p in got] == [(0, "Figure 1. A"), (14, "Figure 2. B")]
    assert value(spark, figures.caption_parts(F.lit("see Figure 14. here"))) == []
    assert value(spark, figures.first_run_bottom(F.lit([10.0, 50.0, 200.0, 100.0]))) == 100.0


def test_audit(spark):
    assert value(spark, audit.table_blocks(F.lit("| a |\n| b |\nx\n| c |"))) == ["| a |\n| b |", "| c |"]
    assert value(spark, audit.missing_digits(F.array(F.lit("123, 45 678.")), F.lit("12 678"), F.lit(True))) == []
    assert value(spark, audit.missing_digits(F.array(F.lit("123 45")), F.lit("678"), F.lit(False))) == ["123"]
    assert value(spark, audit.caption_count(F.lit("Figure 1: a\n see Figure 2: b\nFig. 3"))) == 2
    got = value(spark, audit.problems(F.lit("Figure 1: alpha"), F.array(F.lit("zzzz")), F.lit("no"), F.lit(1), F.array(F.lit("4567")), F.lit(0)))
    assert [p.split(" ")[0] for p in got] == ["text", "1", "table", "figures:"]


def test_translation(spark):
    rows = spark.createDataFrame([(1, k, "text" if k % 3 else "image", f"t{k}") for k in range(70)], "page long, index int, type string, text string")
    got = translate.translate(rows, ["page"], translate.EchoClient).orderBy("index").collect()
    assert len(got) == 46 and all(r.translated == r.original.upper() for r in got)

    class Cut:
        def complete(self, system, user):
            return '```json\n{"translations": [{"index": 1, "translated": "[text] one"}, {"index": 2, "transl'

    assert [r.translated for r in translate.translate(rows.where("index < 5"), ["page"], Cut()).orderBy("index").collect()] == ["one", "t2", "t4"]


def test_prompts(spark):
    m = F.array(*(F.struct(F.lit(r).alias("role"), F.lit(t).cast("string").alias("text")) for r, t in (("User", " hi "), ("Assistant", "yo"), ("User", None))))
    assert value(spark, prompts.render(m, prompts.TEMPLATES["deepseek"], F.lit("sys"))) == "sys\n\nUser: hi\n\nAssistant: yo<｜end▁of▁sentence｜>User:"
    assert value(spark, prompts.render(m, prompts.TEMPLATES["plain"])) == "hiyo"
    assert value(spark, prompts.render(m, prompts.TEMPLATES["alignment"])) == "<image>\nyo"
    with pytest.raises(ValueError):
        prompts.Templates().register("plain", "PLAIN", "", ("", ""), "", "")
    assert [(x.role, x.content) for x in value(spark, prompts.api_messages(m, F.lit("s")))] == [("system", "s"), ("user", " hi "), ("assistant", "yo"), ("user", None)]
    assert [tuple(x) for x in value(spark, prompts.chatbot_pairs(m))] == [(" hi ", "yo"), (None, None)]


def test_sequences(spark):
    assert value(spark, sequences.banned(F.lit([1, 2, 3, 1, 2]), 3, 10)) == [3]
    assert value(spark, sequences.banned(F.lit([1, 2, 3, 1, 2]), 3, 4)) == []
    assert value(spark, sequences.banned(F.lit([1, 2, 3, 1, 2]), 3, 10, [3])) == []
    assert value(spark, sequences.positions(F.lit([0, 1, 1]))) == [1, 0, 1]
    assert tuple(value(spark, sequences.unpadded(F.lit([0, 1, 1])))) == (2, [1, 2])
    assert [tuple(x) for x in value(spark, sequences.shifted(F.lit([1, 2, 3])))] == [(1, 2), (2, 3)]
    assert value(spark, sequences.filled_slots(F.lit([True, False, True]), F.lit([7, 8]), F.lit([1, 2, 3]))) == [7, 2, 8]


def test_experts(spark):
    chosen = value(spark, experts.route(F.lit([0.1, 0.9, 0.5, 0.9]), 2, normalize=True))
    assert [(round(c.weight, 6), c.expert) for c in chosen] == [(0.5, 1), (0.5, 3)]
    grouped = value(spark, experts.route(F.lit([0.9, 0.0, 0.6, 0.7]), 2, "noaux_tc", 4, 2, 1))
    assert sorted(c.expert for c in grouped) == [2, 3]


def test_tiles(spark):
    assert tuple(value(spark, tiling.closest_ratio(F.lit(1000), F.lit(500)))) == (2, 1)
    assert value(spark, tiling.tile_boxes(F.lit(2), F.lit(1), 10, True)) == [[0, 0, 10, 10], [10, 0, 20, 10], [0, 0, 10, 10]]
    assert value(spark, tiling.layout_tokens(F.lit(1), F.lit(1))) == 273


def test_exports(spark):
    pages = spark.createDataFrame([(1, 2, "b ![x](/api/region-image/s/2/1%2C2%2C3%2C4.5)"), (1, 1, " a "), (2, 1, "solo")], "session_id long, page_num int, markdown string")
    docs = {r.session_id: r.markdown for r in sinks.markdown_documents(pages).collect()}
    assert docs == {1: "<!-- 第 1 页 -->\n\na\n\n---\n\n<!-- 第 2 页 -->\n\nb ![x](images/page-2-1-2-3-4.png)\n", 2: "solo\n"}
    assert [(r.page_num, r.box) for r in sinks.image_crops(pages).collect()] == [(2, [1, 2, 3, 4])]
    bundle = sinks.markdown_bundles(spark.createDataFrame([(1, "/x/My.File.pdf", "md", [("b.png", bytearray(b"2")), ("a.png", bytearray(b"1"))])], "session_id long, source_name string, markdown string, images array<struct<name:string,content:binary>>")).first()
    assert bundle.name == "My.File_ocr_markdown.zip" and zipfile.ZipFile(io.BytesIO(bundle.bundle)).namelist() == ["My.File_ocr.md", "images/a.png", "images/b.png"]
    own = spark.createDataFrame([(1, 1, [("title", [1, 1, 9, 90], "T"), ("text", [], " "), ("text", [], "a<b"), ("image", [], "i")]), (1, 2, [("page_number", [], "7")])], "session_id long, page_num int, detections array<struct<type:string,bbox:array<int>,text:string>>")
    new = spark.createDataFrame([(1, 1, 2, "neu")], "session_id long, page_num int, index int, translated string")
    plan = lambda mode: [(r.style, r.text) for r in sinks.docx_plan(own, new, mode).orderBy("page_num", "para_no").collect()]
    assert plan("original") == [("heading", "T"), ("paragraph", "a<b"), ("image", "[图片]"), ("page_number", "7")]
    assert plan("translated")[1] == ("paragraph", "neu") and plan("bilingual")[1:3] == [("paragraph", "a<b"), ("translation", "neu")]
    xml = zipfile.ZipFile(io.BytesIO(sinks.docx_files(sinks.docx_plan(own, new, "bilingual")).first().docx)).read("word/document.xml").decode()
    assert "a&lt;b" in xml and xml.count('w:type="page"') == 1
    assert value(spark, sinks.saved_text(F.lit("a<|det|>image [1,2,3,4]<|/det|>b<|det|>text [1,2,3,4]<|/det|>\\coloneqq"))) == "a![](images/0.jpg)b:="
    assert value(spark, sinks.page_pieces(F.lit("x<PAGE>1<PAGE>2"))) == ["1", "2"]


def test_inputs(spark, tmp_path):
    for name in ("b.PNG", "a.jpg", "c.pdf", "d.txt"):
        (tmp_path / name).write_bytes(b"x")
    kinds = {r.path.rsplit("/", 1)[1]: r.kind for r in providers.uploads(spark, str(tmp_path)).collect()}
    assert kinds == {"b.PNG": "image", "a.jpg": "image", "c.pdf": "pdf", "d.txt": "rejected"}
    scanned = providers.scan_images(providers.images(spark, str(tmp_path)), providers.FakeEngine({"a.jpg": "raw", "b.PNG": ValueError("bad")}))
    assert tuple(providers.batch_counts(scanned).first()) == (2, 1, 1)
    lines = spark.createDataFrame([(" # note",), ("",), ("A=1=2",), ("B = x ",), ("none",)], "value string")
    assert {(r.name, r.value) for r in providers.environment(lines, spark.createDataFrame([("B",)], "name string")).collect()} == {("A", "1=2")}
    assert providers.batch_argument(str(tmp_path))[0] == "image_dir" and providers.page_name(7) == "page_0007.png"
