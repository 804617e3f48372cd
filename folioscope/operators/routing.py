"""Page features and the choice of native, hybrid or vision processing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
MIN_TEXT_CHARS, MAX_SUSPICIOUS, HYBRID_COVERAGE = 80, 0.03, 0.10
FALLBACK_CHARS, FALLBACK_SHARE = 120, 0.35

ANALYSIS = (
    "struct<text_chars:int,text_blocks:int,image_count:int,image_coverage:double,drawing_count:int,table_count:int,figure_count:int,"
    "suspicious_char_ratio:double,column_count:int,native_markdown_chars:int>"
)
DEFAULTS = {"column_count": 1}


def analysis(given: Column, names: list[str]) -> Column:
    """A page analysis of the named fields of a struct: unknown fields go, missing ones get defaults."""
    fields = [f.split(":") for f in ANALYSIS[7:-1].split(",")]
    return F.struct(*((F.coalesce(given[n].cast(t), F.lit(DEFAULTS.get(n, 0)).cast(t)) if n in names else F.lit(DEFAULTS.get(n, 0)).cast(t)).alias(n) for n, t in fields))


def analysis_from_json(text: Column) -> Column:
    fields = [f.split(":") for f in ANALYSIS[7:-1].split(",")]
    got = F.from_json(text, ANALYSIS[7:-1].replace(":", " "))
    return F.struct(*(F.coalesce(got[n], F.lit(DEFAULTS.get(n, 0)).cast(t)).alias(n) for n, t in fields))


def column_count(lefts: Column) -> Column:
    """1 or 2 columns from the left edges of a page's lines."""
    s = F.array_sort(lefts.cast("array<double>"))
    n, half = F.size(s), F.floor(F.size(s) / 2).cast("int")
    at = lambda k: F.get(s, k)
    span = F.greatest(F.lit(1.0), at(n - 1) - at(F.lit(0)))
    two = (at(half) - at(half - 1) > 0.25 * span) & (at(half - 1) - at(F.lit(0)) < 0.5 * span) & (at(n - 1) - at(half) < 0.5 * span)
    return F.when((n >= 6) & two, 2).otherwise(1)


def route(text_chars: Column, suspicious: Column, tables: Column, figures: Column, coverage: Column, columns: Column) -> Column:
    return (
        F.when((text_chars < MIN_TEXT_CHARS) | (suspicious > MAX_SUSPICIOUS), "vlm")
        .when((tables > 0) | (figures > 0) | (coverage >= HYBRID_COVERAGE) | (columns >= 2), "hybrid")
        .otherwise("native")
    )


def route_page(given: Column, native_chars: Column, force: Column) -> Column:
    """A forced mode wins; then the analysis; without one the number of characters alone."""
    by_analysis = route(given["text_chars"], given["suspicious_char_ratio"], given["table_count"], given["figure_count"], given["image_coverage"], given["column_count"])
    return F.coalesce(force, F.when(given.isNotNull(), by_analysis), F.when(native_chars < MIN_TEXT_CHARS, "vlm").otherwise("native"))


def use_native_fallback(native_chars: Column, generated_chars: Column) -> Column:
    """A vision result that is far shorter than the page's own text gives way to it."""
    return (native_chars >= FALLBACK_CHARS) & (generated_chars < native_chars * FALLBACK_SHARE)


def is_truncated(n_ids: Column, cap: Column, stop: Column) -> Column:
    return F.when(stop.isNotNull(), stop == "length").otherwise(n_ids >= cap)


def token_cap(requested: Column, cap: Column) -> Column:
    return F.greatest(F.lit(128), F.least(F.greatest(F.lit(0), requested.cast("int")), cap))
