"""Scans as event tables: page states, results, edits, summaries, stops, frames, and the events of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .blocks import blocks, detection_html, page_html
from .sequences import chunks

STATES = ("pending", "processing", "done", "warning", "failed", "cancelled")
PAGE = ["session_id", "page_num"]


def page_states(events: DataFrame, order: list[str]) -> DataFrame:
    """The batch form of the page state machine: session_id, page_num, state, attempts, error.

    events (session_id, page_num, event, truncated, warnings, message): every page_start is an
    attempt and clears the error; the last deciding event tells the state.
    """
    at = F.struct(*(F.col(c) for c in order))
    deciding = F.when(F.col("event").isin("page_start", "page_done", "error", "cancelled"), at)
    flagged = F.coalesce("truncated", F.lit(False)) | F.coalesce(F.col("warnings") > 0, F.lit(False))
    named = F.when(F.col("event") == "page_start", "processing").when(F.col("event") == "error", "failed").when(F.col("event") == "cancelled", "cancelled").when(flagged, "warning").otherwise("done")
    rows = events.groupBy(*PAGE).agg(F.max(F.when(deciding.isNotNull(), F.struct(at.alias("at"), named.alias("state"), F.when(F.col("event") == "error", F.col("message")).alias("error")))).alias("last"), F.count_if(F.col("event") == "page_start").alias("attempts"))
    return rows.select(*PAGE, F.coalesce("last.state", F.lit("pending")).alias("state"), "attempts", F.col("last.error").alias("error"))


def summary(states: DataFrame) -> DataFrame:
    """session_id, total_pages, done_pages (warnings included), failed_pages."""
    return states.groupBy("session_id").agg(F.count("*").alias("total_pages"), F.count_if(F.col("state").isin("done", "warning")).alias("done_pages"), F.count_if(F.col("state") == "failed").alias("failed_pages"))


def last_results(results: DataFrame, order: str = "attempt") -> DataFrame:
    """The last attempt's result of every page."""
    w = Window.partitionBy(*PAGE).orderBy(F.col(order).desc())
    return results.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def cut_off(events: DataFrame, order: list[str], stop: Column) -> DataFrame:
    """Events of each session before its first stop marker."""
    first = Window.partitionBy("session_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("stopped", F.max(F.coalesce(stop, F.lit(False)).cast("int")).over(first)).where("stopped = 0").drop("stopped")


def pause_free(events: DataFrame, controls: DataFrame, order: str) -> DataFrame:
    """Events that a pause does not hold back: those whose last control before them is not a pause.

    controls (session_id, at, action pause, resume or stop); a stop holds back everything after it.
    """
    both = events.withColumn("action", F.lit(None).cast("string")).withColumn("at", F.col(order)).unionByName(controls.select("session_id", "action", "at"), allowMissingColumns=True)
    w = Window.partitionBy("session_id").orderBy("at", F.col("action").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    said = both.withColumn("now", F.last("action", ignorenulls=True).over(w)).withColumn("stopped", F.max((F.col("action") == "stop").cast("int")).over(w))
    return said.where("action is null and coalesce(now, 'resume') = 'resume' and coalesce(stopped, 0) = 0").select(*events.columns)


def apply_edits(results: DataFrame, edits: DataFrame, order: str = "edit_no", refresh_markdown: bool = True) -> DataFrame:
    """results (session_id, page_num, detections, html, blocks, markdown) with the last edit of every detection.

    Edits past the end change nothing. HTML and blocks are made again; Markdown as well, unless the
    older behaviour is asked for, which leaves it.
    """
    last = edits.groupBy(*PAGE, "det_index").agg(F.max_by("new_text", order).alias("text"))
    by_page = last.groupBy(*PAGE).agg(F.map_from_entries(F.collect_list(F.struct("det_index", "text"))).alias("edits"))
    joined = results.join(by_page, PAGE, "left")
    new = F.transform("detections", lambda d, k: F.struct(*(F.coalesce(F.try_element_at("edits", k), d["text"]).alias("text") if c == "text" else d[c].alias(c) for c in results.schema["detections"].dataType.elementType.names)))
    hit = F.col("edits").isNotNull()
    out = joined.withColumn("detections", F.when(hit, new).otherwise(F.col("detections"))).withColumn("html", F.when(hit, page_html(F.col("detections"), F.col("page_num"))).otherwise(F.col("html"))).withColumn("blocks", F.when(hit, blocks(F.col("detections"))).otherwise(F.col("blocks")))
    if refresh_markdown:
        out = out.withColumn("markdown", F.when(hit, detections_markdown(F.col("detections"))).otherwise(F.col("markdown")))
    return out.drop("edits")


def detections_markdown(dets: Column) -> Column:
    """Markdown of detections: headings marked, tables set off, the rest line by line."""
    part = lambda d: F.when(d["type"] == "title", F.concat(F.lit("\n## "), d["text"], F.lit("\n"))).when(d["type"] == "table", F.concat(F.lit("\n"), d["text"], F.lit("\n"))).otherwise(d["text"])
    return T.squeeze_blank_lines(F.array_join(F.transform(dets, part), "\n"))


def frame(event: Column, data: Column) -> Column:
    """A server-sent event frame; nulls stay in the JSON."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), F.to_json(data, {"ignoreNullFields": "false"}), F.lit("\n\n"))


def parse_frames(stream: Column) -> Column:
    """(event, data) of the frames of a text; frames without both or with data that is no JSON are left out."""
    frames = F.split(stream, r"\r\n\r\n|\n\n")
    field = lambda f, name: F.btrim(F.regexp_extract(f, rf"(?m)^{name}:([^\r\n]*)", 1))
    pairs = F.transform(frames, lambda f: F.struct(field(f, "event").alias("event"), field(f, "data").alias("data")))
    return F.filter(pairs, lambda p: (p["event"] != "") & (p["data"] != "") & F.try_parse_json(p["data"]).isNotNull())


EVENT = "struct<event:string,text:string,tokens:int,det_index:int,html:string,done:boolean>"


def _event(event, text=None, tokens=None, det_index=None, html=None, done=None) -> Column:
    return F.struct(*(v if isinstance(v, Column) else F.lit(v) for v in (event, text, tokens, det_index, html, done))).cast(EVENT)


def page_events(pages: DataFrame) -> DataFrame:
    """The events of pages in order: session_id, page_num, seq, event, text, tokens, det_index, html, done.

    pages (session_id, page_num, markdown, detections): start, progress, tokens, one event for each
    detection, done, image. Where pages has a source column, vision pages say that they are parsing
    and take their tokens from snapshots (text, tokens, done); where it has an error column, pages with
    an error end with it.
    """
    own = F.transform(chunks(F.col("markdown")), lambda c: _event("token", c["text"], c["tokens"], done=c["done"]))
    if "source" in pages.columns and "snapshots" in pages.columns:
        seen = F.transform("snapshots", lambda c: _event("token", c["text"], c["tokens"], done=c["done"]))
        own = F.when(F.col("source") == "vlm", F.concat(F.coalesce(seen, F.array().cast(f"array<{EVENT}>")), F.array(_event("page_progress", "parsing")))).otherwise(own)
    found = F.transform("detections", lambda d, k: _event("det_result", d["text"], None, k, detection_html(d, k)))
    rest = F.concat(own, found, F.array(_event("page_done", F.col("markdown"), html=page_html(F.col("detections"), F.col("page_num"))), _event("page_image")))
    if "error" in pages.columns:
        rest = F.when(F.col("error").isNotNull(), F.array(_event("error", F.col("error")))).otherwise(rest)
    everything = F.concat(F.array(_event("page_start"), _event("page_progress", "scanning")), rest)
    return pages.select(*PAGE, F.posexplode(everything).alias("seq", "e")).select(*PAGE, "seq", "e.*")


def scan_events(states: DataFrame, stopped: DataFrame | None = None) -> DataFrame:
    """session_id, event, total_pages, done_pages, failed_pages: the closing event of every scan.

    Sessions in stopped end as scan_stopped, all others as scan_complete.
    """
    rows = summary(states)
    if stopped is None:
        return rows.select("session_id", F.lit("scan_complete").alias("event"), "total_pages", "done_pages", "failed_pages")
    marked = rows.join(stopped.select("session_id").distinct().withColumn("s", F.lit(True)), "session_id", "left")
    return marked.select("session_id", F.when(F.col("s"), "scan_stopped").otherwise("scan_complete").alias("event"), "total_pages", "done_pages", "failed_pages")


def reduce_events(events: DataFrame, order: list[str]) -> DataFrame:
    """What a client shows of each page: the last attempt's detections, last Markdown, sticky truncation, last error.

    events (session_id, page_num, attempt, event, det_index, text, truncated). Detections are keyed
    by index within the attempt, so a retry does not double them.
    """
    last = Window.partitionBy(*PAGE)
    own = events.withColumn("last_attempt", F.max("attempt").over(last))
    at = F.struct(*(F.col(c) for c in order))
    is_text = F.col("event").isin("token", "page_done")
    return own.groupBy(*PAGE).agg(
        F.max("attempt").alias("attempts"),
        F.count_distinct(F.when((F.col("event") == "det_result") & (F.col("attempt") == F.col("last_attempt")), F.col("det_index"))).alias("detections"),
        F.max(F.when(is_text, F.struct(at.alias("at"), F.col("text")))).alias("t"),
        F.bool_or(F.coalesce("truncated", F.lit(False))).alias("truncated"),
        F.max(F.when(F.col("event").isin("error", "page_done"), F.struct(at.alias("at"), F.when(F.col("event") == "error", F.col("text")).alias("message")))).alias("e"),
    ).select(*PAGE, "attempts", "detections", F.col("t.text").alias("markdown"), "truncated", F.col("e.message").alias("error"))


def invalid_requests(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """requests (session_id, page_num, force_mode) with a reason why they cannot be served; good ones are left out.

    sessions (session_id, total_pages).
    """
    joined = requests.join(sessions.select("session_id", "total_pages"), "session_id", "left")
    mode = F.col("force_mode").isNotNull() & ~F.col("force_mode").isin("native", "hybrid", "vlm")
    reason = F.when(F.col("total_pages").isNull(), "Session not found").when(~F.col("page_num").between(1, F.col("total_pages")), "Page not found").when(mode, "Invalid force_mode")
    return joined.withColumn("reason", reason).where("reason is not null").drop("total_pages")
