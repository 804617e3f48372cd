"""The user-facing functions: scans, failures, retries, exports."""

from pyspark.sql import functions as F

from folioscope import api
from folioscope.operators import sequences, state
from folioscope.sources.providers import FakeEngine

PAGES = "session_id long, page_num long, text string, image string"


def pages(spark):
    return spark.createDataFrame([(1, 1, "native words " * 20, "p1"), (1, 2, "", "p2"), (1, 3, "short", "p3"), (1, 4, "", "p4")], PAGES)


ANSWERS = {"p2": "<|det|>title [1,2,30,400]<|/det|>Head\n<|det|>text [1,2,3,4]<|/det|>body", "p3": "", "p4": RuntimeError("boom")}


def test_scan_isolates_failures_and_retries(spark):
    first = api.scan(pages(spark), FakeEngine(ANSWERS)).withColumn("attempt", F.lit(1)).cache()
    got = {r.page_num: r for r in first.collect()}
    assert [got[k].route for k in (1, 2, 3, 4)] == ["native", "vlm", "vlm", "vlm"] and [got[k].status for k in (1, 2, 3, 4)] == ["done", "done", "done", "failed"]
    assert got[4].error == "boom" and got[2].blocks[0].level == 1 and got[2].markdown == "## Head\nbody"
    keys = spark.createDataFrame([(1, 4)], "session_id long, page_num long")
    after = {r.page_num: r for r in api.rescan(first, pages(spark), keys, FakeEngine({"p4": "<|det|>text [1,2,3,4]<|/det|>now"})).collect()}
    assert (after[4].status, after[4].attempt, after[4].error, after[4].markdown) == ("done", 2, None, "now") and after[2].attempt == 1
    forced = api.scan(pages(spark).where("page_num = 1"), FakeEngine({"p1": "<|det|>text [1,2,3,4]<|/det|>seen"}), force_mode="vlm").first()
    assert forced.source == "vlm" and forced.markdown.startswith("native words")  # far shorter than the page's own text
    assert api.export_markdown(first).first().markdown.count("---") == 3
    assert [r.translated for r in api.translate(first.where("page_num = 2")).orderBy("index").collect()] == ["HEAD", "BODY"]
    assert api.export_docx(first, api.translate(first), "bilingual").count() == 1
    assert api.progress(first, F.lit(8)).first().percent == 50


def test_requests_and_status(spark):
    sessions = spark.createDataFrame([(1, 3)], "session_id long, total_pages int")
    asked = spark.createDataFrame([(1, 1, None), (1, 9, None), (2, 1, None), (1, 2, "magic")], "session_id long, page_num int, force_mode string")
    assert sorted(r.reason for r in state.invalid_requests(asked, sessions).collect()) == ["Invalid force_mode", "Page not found", "Session not found"]
    assert api.status(spark, FakeEngine).first().engine == "FakeEngine"


def test_norms_and_grids(spark):
    r = spark.range(1).select(sequences.rms_norm(F.lit([3.0, 4.0])).alias("a"), sequences.layer_norm(F.lit([1.0, 3.0])).alias("b"), sequences.grid_rows(F.lit(1), F.lit(2)).alias("c")).first()
    assert [round(v, 4) for v in r.a] == [0.8485, 1.1314] and [round(v, 3) for v in r.b] == [-1.0, 1.0] and [tuple(x) for x in r.c] == [(0, 0), (0, 1), (0, -1), (-1, -1)]


def typist():
    """An engine whose answers grow; its first drafts repeat one line. Made here so that workers get it by value."""

    class Typist:
        def read(self, image, box, max_length):
            return "<|det|>text [1,2,3,4]<|/det|>cut", True

        def snapshots(self, image, max_length):
            yield {"text": "a\na\na", "tokens": 4}
            yield {"text": "a fine line", "tokens": 8}
            yield {"text": "b\nb\nb", "tokens": 12}
            yield {"text": "c\nc\nc", "tokens": 16, "done": True, "truncated": True}

    return Typist


def test_truncation_is_a_warning_and_drafts_are_held_back(spark):
    one = pages(spark).where("page_num = 2")
    r = api.scan(one, typist()).first()
    assert (r.status, r.truncated) == ("warning", True)
    live = api.live_markdown(api.snapshots(one, typist())).orderBy("seq").collect()
    assert [x.markdown for x in live] == ["", "a fine line", "a fine line", "c\nc\nc"] and [x.truncated for x in live] == [False, False, False, True]


def test_events_of_vision_and_failed_pages(spark):
    rows = [(1, 1, "m", [("text", [], "a")], "vlm", [("a", 4, False), ("ab", 8, True)], None), (1, 2, "", [], "vlm", None, "boom"), (1, 3, "x", [], "native", None, None)]
    table = spark.createDataFrame(rows, "session_id long, page_num long, markdown string, detections array<struct<type:string,bbox:array<int>,text:string>>, source string, snapshots array<struct<text:string,tokens:int,done:boolean>>, error string")
    got = {}
    for r in state.page_events(table).orderBy("page_num", "seq").collect():
        got.setdefault(r.page_num, []).append(r.event)
    assert got == {1: ["page_start", "page_progress", "token", "token", "page_progress", "det_result", "page_done", "page_image"], 2: ["page_start", "page_progress", "error"], 3: ["page_start", "page_progress", "token", "page_done", "page_image"]}


def test_closing_events(spark):
    states = spark.createDataFrame([(1, 1, "done"), (1, 2, "failed"), (2, 1, "warning")], "session_id long, page_num long, state string")
    got = {r.session_id: tuple(r)[1:] for r in state.scan_events(states, spark.createDataFrame([(2,), (2,)], "session_id long")).collect()}
    assert got == {1: ("scan_complete", 2, 1, 1), 2: ("scan_stopped", 1, 1, 0)}
