"""Inputs: directories of images and uploads, environment files, event streams, and pluggable engines.

Models and page decoders stay outside. An engine is any object with ``read(image, box, max_length)``
and, for streams, ``snapshots(image, max_length)``; a page decoder yields spans, strokes, images and
table candidates as rows of ``SPANS`` and so on. ``FakeEngine`` answers from a dictionary.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as T

IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".webp", ".bmp")
SPANS = "doc_id long, block_no int, line_no int, span_no int, text string, x0 double, y0 double, x1 double, y1 double, size double, font string, lx0 double, ly0 double, lx1 double, ly1 double"
STROKES = "doc_id long, kind string, x0 double, y0 double, x1 double, y1 double, rx0 double, ry0 double, rx1 double, ry1 double"


GRAPHICS = "doc_id long, kind string, x0 double, y0 double, x1 double, y1 double"
CANDIDATES = "doc_id long, box_no int, x0 double, y0 double, x1 double, y1 double, rows array<array<double>>, cells array<array<string>>"
PAGE_TEXT = "doc_id long, text string"


class Decoder(Protocol):
    """An opened document: pages are numbered from 0; every method but page_count gives plain tuples without doc_id, in the order of its schema."""

    page_count: int

    def texts(self, page: int) -> Iterator[tuple]: ...

    def spans(self, page: int) -> Iterator[tuple]: ...

    def graphics(self, page: int) -> Iterator[tuple]: ...

    def strokes(self, page: int) -> Iterator[tuple]: ...

    def tables(self, page: int) -> Iterator[tuple]: ...

    def render(self, page: int, dpi: int) -> bytes: ...


class Engine(Protocol):
    def read(self, image: str, box: list[int], max_length: int) -> str: ...


class FakeEngine:
    """Answers by image; an exception among the answers is raised."""

    def __init__(self, answers: dict):
        self.answers = answers

    def read(self, image: str, box: list[int], max_length: int) -> str:
        answer = self.answers.get(image, "")
        if isinstance(answer, Exception):
            raise answer
        return answer


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """path, suffix, kind (pdf, image, rejected), content of files under path."""
    files = spark.read.format("binaryFile").load(path)
    end = T.suffix(F.col("path"))
    kind = F.when(end == ".pdf", "pdf").when(end.isin(*IMAGE_SUFFIXES), "image").otherwise("rejected")
    return files.select("path", end.alias("suffix"), kind.alias("kind"), "length", "content")


def images(spark: SparkSession, directory: str) -> DataFrame:
    """path, name, content of a directory's images, not of folders in it."""
    return uploads(spark, directory).where("kind = 'image'").select("path", F.regexp_extract("path", r"([^/]*)\z", 1).alias("name"), "content")


def page_counts(files: DataFrame, decoder) -> DataFrame:
    """path, pages of files (path), without rendering; null where a file cannot be opened."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = []
            for path in batch["path"]:
                try:
                    counts.append(decoder(path).page_count)
                except Exception:  # noqa: BLE001  a file that cannot be opened is data
                    counts.append(None)
            yield pd.DataFrame({"path": batch["path"], "pages": pd.array(counts, "Int32")})

    return files.select("path").mapInPandas(run, "path string, pages int")


def numbered_pages(counted: DataFrame) -> DataFrame:
    """path, page (from 0), doc_id of every page of counted (path, pages), dealt evenly; doc_id comes from path and page."""
    pages = counted.where("pages > 0").select("path", F.explode(F.sequence(F.lit(0), F.col("pages") - 1)).alias("page"))
    return pages.withColumn("doc_id", F.xxhash64("path", "page")).repartition("doc_id")


def page_rows(pages: DataFrame, decoder, kind: str) -> DataFrame:
    """Rows of one kind (texts, spans, graphics, strokes, tables) of pages (path, page, doc_id); a document is opened once for neighbouring pages.

    A table finder that fails gives no rows for its page; any other failure is an error.
    """
    schema = {"texts": PAGE_TEXT, "spans": SPANS, "graphics": GRAPHICS, "strokes": STROKES, "tables": CANDIDATES}[kind]
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened, document = None, None
        for batch in batches:
            out = []
            for path, page, doc_id in zip(batch["path"], batch["page"], batch["doc_id"], strict=True):
                if path != opened:
                    opened, document = path, decoder(path)
                try:
                    out += [(doc_id, *row) for row in getattr(document, kind)(page)]
                except Exception:
                    if kind != "tables":
                        raise
            yield pd.DataFrame(out, columns=names)

    return pages.select("path", "page", "doc_id").mapInPandas(run, schema)


def rendered(pages: DataFrame, decoder, dpi: int = 200) -> DataFrame:
    """path, page, name, image of pages (path, page) as pictures at a resolution."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened, document = None, None
        for batch in batches:
            for path, page in zip(batch["path"], batch["page"], strict=True):  # a picture at a time
                if path != opened:
                    opened, document = path, decoder(path)
                yield pd.DataFrame([(path, page, page_name(page + 1), document.render(page, dpi))], columns=["path", "page", "name", "image"])

    return pages.select("path", "page").mapInPandas(run, "path string, page int, name string, image binary")


def open_images(files: DataFrame, opener) -> DataFrame:
    """path, image of files (path, content) by opener(content, upright): turned upright where that works, else as they are, else null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for content in batch["content"]:
                image = None
                for upright in (True, False):
                    try:
                        image = opener(bytes(content), upright)
                        break
                    except Exception:  # noqa: BLE001, S112  the next way is tried
                        continue
                out.append(image)
            yield pd.DataFrame({"path": batch["path"], "image": out})

    return files.select("path", "content").mapInPandas(run, "path string, image binary")


def crop_images(crops: DataFrame, pictures: DataFrame, cutter) -> DataFrame:
    """session_id, page_num, name, content, error of crops (session_id, page_num, name, pixels) out of pictures (session_id, page_num, image) by cutter(image, pixels).

    Every (page, box) is cut once; a failure is that crop's error.
    """
    keys = ["session_id", "page_num"]
    met = crops.where("pixels is not null").dropDuplicates([*keys, "name"]).join(pictures.select(*keys, "image"), keys)
    schema = ", ".join(f"{k} {dict(met.dtypes)[k]}" for k in keys) + ", name string, content binary, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            content, error = [], []
            for image, pixels in zip(batch["image"], batch["pixels"], strict=True):
                try:
                    content.append(cutter(bytes(image), list(pixels)))
                    error.append(None)
                except Exception as e:  # noqa: BLE001
                    content.append(None)
                    error.append(str(e))
            yield batch[[*keys, "name"]].assign(content=content, error=error)

    return met.select(*keys, "name", "image", "pixels").mapInPandas(run, schema)


def data_uri(content: Column, kind: str = "image/png") -> Column:
    """A file's bytes as base64 in a URI; null for null."""
    return F.concat(F.lit(f"data:{kind};base64,"), F.base64(content))


def scan_images(files: DataFrame, engine, max_length: int = 8192) -> DataFrame:
    """name, raw, error of images by an engine: one for each worker, failures are rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = engine() if isinstance(engine, type) else engine
        for batch in batches:
            rows = []
            for name in batch["name"]:
                try:
                    rows.append((name, own.read(name, [0, 0, 1000, 1000], max_length), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((name, None, str(e)))
            yield pd.DataFrame(rows, columns=["name", "raw", "error"])

    return files.select("name").mapInPandas(run, "name string, raw string, error string")


def batch_counts(scanned: DataFrame) -> DataFrame:
    return scanned.agg(F.count("*").alias("files"), F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def environment(lines: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """name, value of environment-file lines (value): comments and lines without = go, names that are known already stay as they are."""
    line = T.strip(F.col("value"))
    rows = lines.select(line.alias("line")).where((F.col("line") != "") & ~F.startswith("line", F.lit("#")) & F.contains("line", F.lit("=")))
    pair = F.split("line", "=", 2)
    found = rows.select(T.strip(F.get(pair, 0)).alias("name"), T.strip(F.get(pair, 1)).alias("value"))
    return found.join(known.select("name"), "name", "left_anti") if known is not None else found


def batch_argument(path: str) -> tuple[str, str]:
    """How a positional argument is read: a file is one image, a folder a folder of them, anything else goes on."""
    return ("image" if os.path.isfile(path) else "image_dir" if os.path.isdir(path) else "pass", path)


def page_name(number: int) -> str:
    return f"page_{number:04d}.png"


class PageRange(InputPartition):
    def __init__(self, path: str, page: int):
        self.path, self.page = path, page


class PagesSource(DataSource):
    """A table of pages by a decoder: ``spark.read.format("pages").option("decoder", "module:name").load(path)``.

    The decoder is a callable ``decode(path) -> object`` with ``page_count`` and ``spans(page)``; each
    page is a partition of its own.
    """

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SPANS

    def reader(self, schema) -> DataSourceReader:
        return PagesReader(self.options)


class PagesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.decoder = options["path"], options["decoder"]

    def _open(self):
        from importlib import import_module

        module, name = self.decoder.split(":")
        return getattr(import_module(module), name)(self.path)

    def partitions(self) -> list[InputPartition]:
        return [PageRange(self.path, k) for k in range(self._open().page_count)]

    def read(self, partition: PageRange) -> Iterator[tuple]:
        yield from self._open().spans(partition.page)
