"""Grounded records: ``<|det|>TYPE [x1, y1, x2, y2]<|/det|>CONTENT`` text to typed, boxed detections.

All of it is one projection over a row's text, so parsing needs no exchange; the place in the
array is the detection's index.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrays import let
from ..functions.geometry import valid_box

#: Metadata up to the first closing tag, content up to the next opening tag; possessive, so that long texts need no stack.
RECORD = r"<\|det\|>([^<]*+(?:<(?!\|/det\|>)[^<]*+)*+)<\|/det\|>([^<]*+(?:<(?!\|det\|>)[^<]*+)*+)"
NON_TEXT = ("[non-text]", "[non text]", "[non_text]")
#: Patterns of one line: a label with coordinates that is no text, a numbered heading in capitals (and what may
#: follow it on a whole line), and the label that a partial decode puts before its lines. Fixed values.
ARTIFACT_LINE = rf"(?i)\A[a-z][\w-]*[{T.WS}]*\[[\d{T.WS},.-]*\]\z"
HEADING_LINE, HEADING_END = r"\A\d+\.\s+[A-Z][A-Z\s,&/()\-]+", r"(?:\.{2,}\s*\d+)?\z"
LABEL = r"(?i)\A(?:text|title|image|figure|chart|diagram|table|formula|page_number)\s*\[[^\]]*\]\s*"
#: Records and references in generated text: the narrow notation, references in the old and the new one, any tag. Fixed values.
NARROW_RECORD = r"(?s)<\|det\|>(\w+)\s*\[([^\]]+)\]<\|/det\|>(.*?)(?=<\|det\|>|\z)"
OLD_REFERENCE = r"(?s)<\|ref\|>(.*?)<\|/ref\|><\|det\|>(.*?)<\|/det\|>"
NEW_REFERENCE = r"(?s)<\|det\|>\s*([A-Za-z_][\w-]*)\s*(\[[^\]]+\])\s*<\|/det\|>"
ANY_TAG = r"<\|det\|>[^\s\[\]]+\s*\[[^\]]*\]<\|/det\|>"
#: What is left of grounding once tags are gone, in the order of its removal. Fixed values.
REMAINS = (
    r"(?im)^\s*\[non[-_ ]?text\]\s*$",
    r"(?im)^\s*<\|det\|>[^\n]*(?:<\|/det\|>)?\s*$",
    r"(?im)^\s*[a-z][\w-]*\s*\[[\d\s,.-]*\]\s*$",
    r"<\|/?det\|>",
    r"<\|/?(?:ref|grounding)\|>",
)
DOUBLED_HEADING = r"(?m)^(#{1,6})\s+(#{1,6})\s+"
#: Types whose records become image links, and types set off by blank lines. Fixed values.
PICTURES, SET_OFF = "image|figure|chart|diagram", "table|formula|display-formula|figure_caption"
HEADING_PHRASE = "index of contents"


def is_artifact(line: Column) -> Column:
    """Placeholders and remains of grounding that are no text of the document."""
    s = T.strip(line)
    return F.lower(s).isin(*NON_TEXT) | (s.contains("<|det|>") & ~s.contains("<|/det|>")) | s.rlike(ARTIFACT_LINE)


def metadata_type(meta: Column) -> Column:
    m = T.strip(meta)
    before = T.strip(F.substring_index(m, "[", 1))
    return F.when(before == "", F.lit("text")).otherwise(before)


def metadata_box(meta: Column) -> Column:
    body = F.regexp_extract(meta, r"(?s)\A[^\[]*\[([^\]]*)\]", 1)
    return valid_box(F.filter(F.split(body, rf"[,;{T.WS}]+"), lambda v: v != ""))


def records(raw: Column) -> Column:
    """Every record and piece of bare text in order: array of (meta, content); meta is null for bare text."""
    raw = F.coalesce(raw, F.lit(""))
    item = lambda meta, content: F.struct(meta.cast("string").alias("meta"), content.alias("content"))
    preface = item(F.lit(None), T.strip(F.substring_index(raw, "<|det|>", 1)))

    def parts(r: Column) -> Column:
        def cut(content: Column) -> Column:
            def at(blank: Column) -> Column:
                main = F.when(blank > 0, T.rstrip(F.substring(content, F.lit(1), blank - 1))).otherwise(content)
                tail = F.when(blank > 0, T.strip(F.substring(content, blank + 2, F.length(content)))).otherwise(F.lit(""))
                return F.array(item(r["0"], main), item(F.lit(None), tail))

            return let(F.locate("\n\n", content), at)

        return let(T.rstrip(r["1"]), cut)

    def opened(match: Column) -> Column:
        meta = F.substring_index(F.substring(match, F.lit(8), F.length(match)), "<|/det|>", 1)
        return F.struct(meta.alias("0"), F.substring(match, F.length(meta) + 16, F.length(match)).alias("1"))

    pairs = F.transform(F.regexp_extract_all(raw, F.lit(RECORD), F.lit(0)), opened)
    return F.concat(F.array(preface), F.flatten(F.transform(pairs, parts)))


def detections(raw: Column) -> Column:
    """array of (type, bbox, text): records with content, and bare text that is no artifact as type text."""
    kept = F.filter(records(raw), lambda r: (T.strip(r["content"]) != "") & (r["meta"].isNotNull() | ~is_artifact(r["content"])))
    return F.transform(
        kept,
        lambda r: F.struct(
            F.when(r["meta"].isNull(), F.lit("text")).otherwise(metadata_type(r["meta"])).alias("type"),
            F.when(r["meta"].isNull(), F.array().cast("array<int>")).otherwise(metadata_box(r["meta"])).alias("bbox"),
            T.strip(r["content"]).alias("text"),
        ),
    )


def legacy_detections(raw: Column) -> Column:
    """The narrower parser of the batch tools: word-character types, unchecked non-empty boxes.

    Its source loses the last record by a slip in a pattern; ``detections`` is what to use, and this
    keeps the last record.
    """
    got = F.arrays_zip(*(F.regexp_extract_all(raw, F.lit(NARROW_RECORD), F.lit(k)) for k in (1, 2, 3)))
    box = lambda t: F.transform(F.filter(F.split(t, r"[,\s]+"), lambda v: v != ""), lambda v: v.try_cast("double").cast("int"))
    return F.transform(got, lambda r: F.struct(r["0"].alias("type"), box(r["1"]).alias("bbox"), T.strip(r["2"]).alias("text")))


def references(text: Column) -> Column:
    """All grounded references in a text, old and new notation: array of (label, boxes, is_image)."""

    def found(pattern: str) -> Column:
        return F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)))

    def one(r: Column) -> Column:
        label = T.strip(r["0"])
        return F.struct(label.alias("label"), reference_boxes(r["1"]).alias("boxes"), (label == "image").alias("is_image"))

    return F.transform(F.concat(found(OLD_REFERENCE), found(NEW_REFERENCE)), one)


def reference_boxes(literal: Column) -> Column:
    """Boxes of a list literal: a list of boxes, or one box; null where it is neither."""
    many = F.from_json(literal, "array<array<double>>")
    single = F.from_json(literal, "array<double>")
    return F.when(literal.rlike(r"\A\s*\[\s*\["), many).otherwise(F.when(F.size(F.filter(single, lambda v: v.isNotNull())) > 0, F.array(single)))


def native_heading(line: Column, whole: bool) -> Column:
    """A numbered heading in capitals; ``whole`` asks for nothing but a page number behind it."""
    return (F.lower(line) == HEADING_PHRASE) | line.rlike(HEADING_LINE + (HEADING_END if whole else ""))


def native_markdown(text: Column) -> Column:
    """A text layer as conservative Markdown: stripped lines, single blank lines, headings marked."""
    stripped = F.transform(F.split(F.regexp_replace(text, r"\r\n|\r", "\n"), "\n", -1), T.strip)
    mark = lambda s: F.when(F.lower(s) == HEADING_PHRASE, F.concat(F.lit("# "), s)).when(native_heading(s, True), F.concat(F.lit("## "), s)).otherwise(s)
    joined = F.array_join(F.transform(stripped, mark), "\n")
    return T.strip(F.regexp_replace(joined, r"\n{3,}", "\n\n"))


def native_detections(text: Column) -> Column:
    lines = F.filter(F.transform(T.split_lines(text), T.strip), lambda s: s != "")
    return F.transform(lines, lambda s: F.struct(F.when(native_heading(s, False), F.lit("title")).otherwise(F.lit("text")).alias("type"), F.array().cast("array<int>").alias("bbox"), s.alias("text")))


def is_repetitive(markdown: Column) -> Column:
    """An unstable partial decode: one line is at least three times there and half of all lines. Equal lines are neighbours once sorted, so one fold counts them."""
    lines = F.filter(F.transform(T.split_lines(markdown), T.strip), lambda s: s != "")
    plain = F.filter(F.transform(lines, lambda s: T.strip(F.regexp_replace(s, LABEL, ""))), lambda s: s != "")
    state = lambda last, run, most: F.struct(last.alias("last"), run.alias("run"), most.alias("most"))

    def step(done: Column, s: Column) -> Column:
        run = F.when(done["last"] == s, done["run"] + 1).otherwise(F.lit(1))
        return state(s, run, F.greatest(done["most"], run))

    def judge(own: Column) -> Column:
        most = F.aggregate(F.array_sort(own), state(F.lit(""), F.lit(0), F.lit(0)), step, lambda d: d["most"])
        return (F.size(own) >= 3) & (most >= 3) & (2 * most >= F.size(own))

    return F.coalesce((F.size(lines) >= 3) & let(plain, judge), F.lit(False))


def raw_markdown(raw: Column, session: Column, page: Column) -> Column:
    """Generated Markdown without grounding: record tags by type, then remains, doubled headings, blank lines."""
    tag = lambda types: rf"(?i)<\|det\|>(?:{types})\s*\[([^\]]*)\]<\|/det\|>"
    # Pictures first: their coordinates are freed of white space around commas and percent-encoded.
    marked = F.regexp_replace(raw, tag(PICTURES), "\x01$1\x02")
    piece = lambda s: F.concat(
        F.lit("\n\n![图表或图片区域](/api/region-image/"), T.quote_path(session), F.lit("/"), page.cast("string"), F.lit("/"),
        T.quote_path(F.array_join(F.transform(F.split(F.substring_index(s, "\x02", 1), ",", -1), T.strip), ",")), F.lit(")\n\n"), F.substring(s, F.locate("\x02", s) + 1, F.length(s)),
    )
    pieces = F.split(marked, "\x01", -1)
    with_links = F.concat(F.get(pieces, 0), F.array_join(F.transform(F.slice(pieces, 2, F.greatest(F.lit(0), F.size(pieces) - 1)), piece), ""))
    out = F.when(session != "", with_links).otherwise(raw)
    for pattern, to in ((tag("title"), "\n\n## "), (tag(SET_OFF), "\n\n"), (ANY_TAG, ""), *((p, "") for p in REMAINS)):
        out = F.regexp_replace(out, pattern, to)
    out = F.regexp_replace(F.replace(out, F.lit(T.END_OF_SENTENCE), F.lit("")), DOUBLED_HEADING, "$2 ")
    return F.when(F.coalesce(raw, F.lit("")) == "", F.lit("")).otherwise(T.squeeze_blank_lines(out))
