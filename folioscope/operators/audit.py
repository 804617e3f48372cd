"""Source against output: character coverage, tables, digits, figures and formulas that were lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrays import let
from .figures import CAPTION, LIST_OF_FIGURES

COVERAGE, LONG_DIGITS, MATH_TOKENS, MATH_LOSS = 0.82, 3, 6, 0.4


def coverage(source: Column, markdown: Column) -> Column:
    """Share of the source's characters that occur anywhere in the Markdown; null for an empty source."""
    src = T.norm(source)
    return F.when(F.length(src) > 0, 1 - uncovered(src, T.norm(markdown)) / F.length(src))


def uncovered(source: Column, markdown: Column) -> Column:
    """Characters of one text that the other does not have."""
    return F.length(F.call_function("translate", source, markdown, F.lit(""))).cast("long")


def table_blocks(markdown: Column) -> Column:
    """Runs of lines that begin with a bar and a space: between other lines, joined by a character that no line holds."""
    starts = lambda s: F.startswith(s, F.lit("| "))
    marked = F.transform(T.split_lines(markdown), lambda s: F.when(starts(s), s).otherwise(F.lit("\x0b")))
    return F.transform(F.filter(F.split(F.array_join(marked, "\n"), "\x0b", -1), lambda r: F.btrim(r, F.lit("\n")) != ""), lambda r: F.btrim(r, F.lit("\n")))


def has_footnotes(text: Column) -> Column:
    return text.rlike(r"(?m)^\s*\d+\s+[A-Za-z(]")


def missing_digits(cells: Column, markdown: Column, footnotes: Column) -> Column:
    """Numeric tokens of table cells that the Markdown has not; with footnotes a last digit may be a mark."""
    got = T.digit_tokens(F.regexp_replace(markdown, r"\^\d+", ""))
    expected = F.array_distinct(F.flatten(F.transform(cells, T.digit_tokens)))
    lost = F.filter(F.array_except(expected, got), lambda t: F.length(t) >= LONG_DIGITS)
    marked = lambda t: t.rlike(r"\d\z") & F.array_contains(got, F.substring(t, F.lit(1), F.length(t) - 1))
    return F.array_sort(F.filter(lost, lambda t: ~(footnotes & marked(t))))


def caption_count(text: Column) -> Column:
    found = F.regexp_count(text, F.lit(r"(?im)^\s*(?:" + CAPTION[4:] + ")"))
    return F.when(text.rlike(LIST_OF_FIGURES), 0).otherwise(found)


def image_count(markdown: Column) -> Column:
    return F.regexp_count(markdown, F.lit(r"!\["))


def lost_math(lines: Column, markdown: Column) -> Column:
    """Lines with formulas of which more than two fifths of six tokens or more are not in the Markdown."""

    def missing(kept: Column, tokens: Column) -> Column:
        return (F.size(tokens) >= MATH_TOKENS) & (F.size(F.filter(tokens, lambda t: ~F.contains(kept, t))) > MATH_LOSS * F.size(tokens))

    def is_lost(kept: Column, s: Column) -> Column:
        return T.math_like(s) & let(F.regexp_extract_all(T.significant(s), F.lit(r"[0-9a-zA-Z\x{4e00}-\x{9fff}]+"), F.lit(0)), lambda tokens: missing(kept, tokens))

    lost = let(T.significant(markdown), lambda kept: F.filter(lines, lambda s: is_lost(kept, s)))
    return F.transform(lost, lambda s: F.substring(T.strip(s), 1, 60))


def preview(items: Column, n: int) -> Column:
    """The first n items, and an ellipsis if there are more."""
    return F.concat(F.lit("["), F.array_join(F.slice(items, 1, n), ", "), F.lit("]"), F.when(F.size(items) > n, F.lit("…")).otherwise(F.lit("")))


def problems(text: Column, prose: Column, markdown: Column, real_tables: Column, cells: Column, content_images: Column) -> Column:
    """The problems of a page as texts.

    text: the page's text layer; prose: its lines outside figures; real_tables, content_images:
    counts; cells: all cells of the real tables.
    """
    share = coverage(F.array_join(prose, "\n"), markdown)
    digits = missing_digits(cells, markdown, has_footnotes(text))
    math = lost_math(prose, markdown)
    captions, images = caption_count(text), image_count(markdown)
    checks = F.array(
        F.when(share < COVERAGE, F.concat(F.lit("text coverage "), F.bround(share * 100).cast("int").cast("string"), F.lit("% < 82%"))),
        F.when((real_tables > 0) & (F.size(table_blocks(markdown)) == 0), F.concat(real_tables.cast("string"), F.lit(" table(s) lost"))),
        F.when((real_tables > 0) & (F.size(digits) > 0), F.concat(F.lit("table digits missing: "), preview(digits, 12))),
        F.when((captions > 0) & (images < captions), F.concat(F.lit("figures: "), captions.cast("string"), F.lit(" caption(s) but "), images.cast("string"), F.lit(" image(s) in md"))),
        F.when((content_images > 0) & (images == 0) & (captions == 0), F.concat(content_images.cast("string"), F.lit(" content image(s) without caption not extracted"))),
        F.when(F.size(math) > 0, F.concat(F.lit("math lines lost: "), preview(math, 4))),
    )
    return F.filter(checks, lambda p: p.isNotNull())


def verdicts(pages: DataFrame, document: str) -> DataFrame:
    """Per document: pages, pages with problems, problems, failed; pages has a problems array."""
    n = F.size("problems")
    return pages.groupBy(document).agg(F.count("*").alias("pages"), F.count_if(n > 0).alias("pages_with_problems"), F.sum(n).cast("long").alias("problems"), F.bool_or(n > 0).alias("failed"))


def line_centers(raw_lines: DataFrame, page_lines: DataFrame) -> DataFrame:
    """doc_id, raw_no, center: the middle of the first page line that begins with the raw line's first 20 characters, null for none."""
    probe = raw_lines.select("doc_id", "raw_no", F.substring(T.norm(F.col("text")), 1, 20).alias("probe"))
    lines = page_lines.select("doc_id", "line_no", T.norm(F.col("text")).alias("normal"), ((F.col("y0") + F.col("y1")) / 2).alias("center"))
    # Lines meet by their page; the prefix is a residual of that equi-join.
    met = probe.alias("p").join(lines.alias("l"), (F.col("p.doc_id") == F.col("l.doc_id")) & F.startswith(F.col("l.normal"), F.col("p.probe")), "left")
    return met.groupBy(F.col("p.doc_id").alias("doc_id"), "raw_no").agg(F.min_by("center", "line_no").alias("center"))
