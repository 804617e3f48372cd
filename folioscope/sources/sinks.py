"""Exports: Markdown documents and bundles, DOCX plans and files, batch reports, overlay boxes.

Text is put together by expressions; bytes of ZIP containers are made with the standard library, one
document at a time on the executors.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.blocks import level

REGION_LINK = r"!\[([^\]]*)\]\(/api/region-image/[^/]+/(\d+)/([^)]*)\)"
PICTURES = ("image", "figure", "chart", "diagram")
MODES = ("original", "translated", "bilingual")


def local_images(markdown: Column) -> Column:
    """Region links as links to exported image files; links whose coordinates are no four numbers stay."""
    number = r"\s*(-?\d+)(?:\.\d*)?\s*"
    comma = "(?:,|%2C)"
    pattern = r"!\[([^\]]*)\]\(/api/region-image/[^/]+/(\d+)/" + comma.join([number] * 4) + r"\)"
    return F.regexp_replace(markdown, pattern, r"![$1](images/page-$2-$3-$4-$5-$6.png)")


def image_crops(pages: DataFrame) -> DataFrame:
    """session_id, page_num, box of every region that Markdown links to, once each; for an image sink."""
    found = pages.select("session_id", F.explode(F.arrays_zip(F.regexp_extract_all("markdown", F.lit(REGION_LINK), F.lit(2)), F.regexp_extract_all("markdown", F.lit(REGION_LINK), F.lit(3)))).alias("r"))
    box = F.transform(F.split(F.url_decode(F.col("r.1")), ","), lambda v: F.btrim(v).try_cast("double").cast("int"))
    return found.select("session_id", F.col("r.0").cast("int").alias("page_num"), box.alias("box")).where(F.size("box") == 4).dropDuplicates()


def markdown_documents(pages: DataFrame, key: str = "session_id") -> DataFrame:
    """key, markdown: pages (key, page_num, markdown) in order with rules between; several pages are marked with their numbers."""
    rows = pages.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("page_num", local_images(T.strip(F.coalesce("markdown", F.lit("")))).alias("md")))).alias("p"))
    marked = F.transform("p", lambda x: F.when(F.size("p") > 1, F.concat(F.lit("<!-- 第 "), x["page_num"].cast("string"), F.lit(" 页 -->\n\n"), x["md"])).otherwise(x["md"]))
    return rows.select(key, F.concat(F.array_join(marked, "\n\n---\n\n"), F.lit("\n")).alias("markdown"))


def markdown_bundles(documents: DataFrame, key: str = "session_id") -> DataFrame:
    """key, name, bundle: a ZIP of each document (key, source_name, markdown, images array<struct<name,content>>)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, name, text, images in zip(batch[key], batch["stem"], batch["markdown"], batch["images"], strict=True):
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(f"{name}_ocr.md", text)
                    for image in sorted(images if images is not None else [], key=lambda i: i["name"]):
                        z.writestr(f"images/{image['name']}", bytes(image["content"]))
                out.append((k, f"{name}_ocr_markdown.zip", data.getvalue()))
            yield pd.DataFrame(out, columns=[key, "name", "bundle"])

    kind = dict(documents.dtypes)[key]
    return documents.select(key, T.stem(F.col("source_name")).alias("stem"), "markdown", "images").mapInPandas(run, f"{key} {kind}, name string, bundle binary")


def docx_plan(pages: DataFrame, translations: DataFrame, mode: str = "original") -> DataFrame:
    """session_id, page_num, para_no, style, level, text, picture: the paragraphs of a DOCX export; picture is the name of an image's crop.

    pages (session_id, page_num, detections), translations (session_id, page_num, index, translated).
    Blank detections are left out; ``bilingual`` puts a translation behind its original.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    each = pages.select("session_id", "page_num", F.posexplode("detections").alias("index", "d"))
    joined = each.join(translations.select("session_id", "page_num", "index", "translated"), ["session_id", "page_num", "index"], "left")
    text, new, kind = T.strip(F.col("d.text")), F.coalesce("translated", F.lit("")), F.col("d.type")
    style = F.when(kind == "title", "heading").when(kind == "table", "table").when(kind == "image", "image").when(kind == "page_number", "page_number").otherwise("paragraph")
    translates = (new != "") & ~kind.isin("image", "page_number")
    shown = F.when(kind == "image", F.lit("[图片]")).when(F.lit(mode == "translated") & translates, new).otherwise(text)
    box = F.col("d.bbox")
    picture = F.when((kind == "image") & (F.size(box) == 4), F.concat(F.lit("page-"), F.col("page_num").cast("string"), F.lit("-"), F.array_join(box.cast("array<string>"), "-"), F.lit(".png")))
    first = F.struct(style.alias("style"), F.when(kind == "title", level(box)).alias("level"), shown.alias("text"), picture.alias("picture"))
    second = F.struct(F.lit("translation").alias("style"), F.when(kind == "title", level(box)).alias("level"), new.alias("text"), F.lit(None).cast("string").alias("picture"))
    paragraphs = F.when(F.lit(mode == "bilingual") & translates, F.array(first, second)).otherwise(F.array(first))
    rows = joined.where(text != "").select("session_id", "page_num", "index", F.posexplode(paragraphs).alias("k", "p"))
    return rows.select("session_id", "page_num", (F.col("index") * 2 + F.col("k")).cast("long").alias("para_no"), "p.style", "p.level", "p.text", "p.picture")


_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
_TYPES = (
    '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Default Extension="png" ContentType="image/png"/>'
    '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
)


def _paragraph(style: str, depth, text: str) -> str:
    """One paragraph of WordprocessingML; sizes are in half points, indents in twentieths of a point."""
    run, para = {
        "heading": (f'<w:b/><w:sz w:val="{36 if depth == 1 else 28}"/>', f'<w:outlineLvl w:val="{int(depth or 2) - 1}"/>' + ('<w:jc w:val="center"/>' if depth == 1 else "")),
        "table": ('<w:rFonts w:ascii="Courier New" w:hAnsi="Courier New"/><w:sz w:val="20"/>', ""),
        "image": ('<w:i/><w:color w:val="808080"/>', ""),
        "page_number": ('<w:color w:val="808080"/><w:sz w:val="18"/>', '<w:jc w:val="center"/>'),
        "translation": (('<w:b/><w:color w:val="4F46E5"/><w:sz w:val="26"/>' if depth == depth and depth else '<w:color w:val="4F46E5"/><w:sz w:val="22"/>'), '<w:spacing w:after="120"/><w:ind w:left="240"/>'),
        "break": ("", ""),
    }.get(style, ('<w:rFonts w:ascii="SimSun" w:hAnsi="SimSun" w:eastAsia="SimSun"/><w:sz w:val="24"/>', ""))
    body = '<w:r><w:br w:type="page"/></w:r>' if style == "break" else "<w:r><w:rPr>" + run + "</w:rPr>" + "<w:br/>".join(f'<w:t xml:space="preserve">{escape(x)}</w:t>' for x in text.split("\n")) + "</w:r>"
    return f"<w:p><w:pPr>{para}</w:pPr>{body}</w:p>"


#: A picture in a paragraph: its number, width and height in English metric units (12,700 a point), and relationship.
_PICTURE = (
    '<w:p><w:r><w:drawing><wp:inline xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"><wp:extent cx="{w}" cy="{h}"/><wp:docPr id="{n}" name="Picture {n}"/>'
    '<a:graphic xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:graphicData uri="http://schemas.openxmlformats.org/drawingml/2006/picture"><pic:pic xmlns:pic="http://schemas.openxmlformats.org/drawingml/2006/picture">'
    '<pic:nvPicPr><pic:cNvPr id="{n}" name="Picture {n}"/><pic:cNvPicPr/></pic:nvPicPr><pic:blipFill><a:blip xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" r:embed="rId{n}"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill>'
    '<pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="{w}" cy="{h}"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr></pic:pic></a:graphicData></a:graphic></wp:inline></w:drawing></w:r></w:p>'
)
PICTURE_WIDTH = 420


def _png_size(content: bytes) -> tuple[int, int] | None:
    """Width and height of a PNG file, None for anything else."""
    if content[:8] != b"\x89PNG\r\n\x1a\n" or content[12:16] != b"IHDR":
        return None
    return int.from_bytes(content[16:20], "big"), int.from_bytes(content[20:24], "big")


def docx_files(plan: DataFrame, pictures: DataFrame | None = None) -> DataFrame:
    """session_id, docx: the file of each session's plan; pages begin on new sheets.

    pictures (session_id, name, content): PNG crops that take the place of their paragraphs' placeholders, 420 points wide.
    """
    kind = dict(plan.dtypes)["session_id"]
    rows = plan.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("page_num", "para_no", "style", "level", "text", "picture"))).alias("p"))
    if pictures is None:
        rows = rows.withColumn("i", F.array().cast("array<struct<name:string,content:binary>>"))
    else:
        rows = rows.join(pictures.where("content is not null").groupBy("session_id").agg(F.collect_list(F.struct("name", "content")).alias("i")), "session_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for session, paragraphs, images in zip(batch["session_id"], batch["p"], batch["i"], strict=True):
                known = {i["name"]: bytes(i["content"]) for i in images} if images is not None else {}
                parts, media, page = [], [], None
                for p in paragraphs:
                    if page is not None and p["page_num"] != page:
                        parts.append(_paragraph("break", None, ""))
                    page = p["page_num"]
                    size = _png_size(known.get(p["picture"] or "", b""))
                    if size and size[0]:
                        media.append(known[p["picture"]])
                        parts.append(_PICTURE.format(n=len(media), w=PICTURE_WIDTH * 12_700, h=round(PICTURE_WIDTH * 12_700 * size[1] / size[0])))
                    else:
                        parts.append(_paragraph(p["style"], p["level"], p["text"]))
                document = '<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>' + "".join(parts) + "</w:body></w:document>"
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("[Content_Types].xml", _TYPES)
                    z.writestr("_rels/.rels", _RELS.format('<Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/>'))
                    z.writestr("word/document.xml", document)
                    if media:
                        links = (f'<Relationship Id="rId{n}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/image" Target="media/image{n}.png"/>' for n in range(1, len(media) + 1))
                        z.writestr("word/_rels/document.xml.rels", _RELS.format("".join(links)))
                        for n, content in enumerate(media, 1):
                            z.writestr(f"word/media/image{n}.png", content)
                out.append((session, data.getvalue()))
            yield pd.DataFrame(out, columns=["session_id", "docx"])

    return rows.mapInPandas(run, f"session_id {kind}, docx binary")


def batch_report(name: Column, raw: Column, tool: bool = True) -> Column:
    """The file of a batch scan: a title and the fenced raw text."""
    return F.concat(F.lit("# OCR: " if tool else "# OCR result: "), name, F.lit("\n\n```\n"), raw, F.lit("\n```\n"))


def saved_text(raw: Column) -> Column:
    """A model's result as saved: image records as links by number, other records gone, two operators spelled out."""
    images = F.split(raw, r"<\|det\|>\s*image\s*\[[^\]]*\]\s*<\|/det\|>", -1)
    linked = F.concat(F.get(images, 0), F.array_join(F.transform(F.slice(images, 2, F.greatest(F.lit(0), F.size(images) - 1)), lambda s, k: F.concat(F.lit("![](images/"), k.cast("string"), F.lit(".jpg)"), s)), ""))
    plain = F.regexp_replace(linked, r"(?s)<\|ref\|>.*?<\|/ref\|><\|det\|>.*?<\|/det\|>|<\|det\|>\s*[A-Za-z_][\w-]*\s*\[[^\]]+\]\s*<\|/det\|>", "")
    return F.replace(F.replace(plain, F.lit("\\coloneqq"), F.lit(":=")), F.lit("\\eqqcolon"), F.lit("=:"))


def page_pieces(raw: Column) -> Column:
    """Pages of a result of several pages: what follows each page mark."""
    pieces = F.split(raw, "<PAGE>", -1)
    return F.slice(pieces, 2, F.greatest(F.lit(0), F.size(pieces) - 1))


def text_statistics(detections: Column) -> Column:
    """(count, characters) of detections, characters counted in UTF-16 units."""
    units = lambda s: F.length(s) + F.regexp_count(s, F.lit(r"[\x{10000}-\x{10ffff}]"))
    return F.struct(F.size(detections).alias("count"), F.aggregate(detections, F.lit(0), lambda a, d: a + units(d["text"])).alias("characters"))
