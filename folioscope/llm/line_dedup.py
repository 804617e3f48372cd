"""Repeated runs of lines across documents, by winnowing over line hashes.

A line counts by its words (A-Z as a-z); lines without words are passed over. A gram is the shortest
run of whole lines from a line on that has GRAM_WORDS words; a window is the shortest run from a line
on that has WINDOW_WORDS words. Of every window the gram with the least hash (the last of equal ones)
is a fingerprint, so any two equal runs of WINDOW_WORDS words share a fingerprint at the same place
(winnowing, with windows measured in words). Fingerprints are joined with their earliest position in
the order of (doc_id, row, line); every later position is extended by whole lines both ways against
that earliest document, and the lines of the run are deleted from the later one. So no run of
WINDOW_WORDS words that occurs earlier stays whole, and what is deleted occurs earlier by
GRAM_WORDS words at least.

How far two positions agree is found for all positions of a document at once, by bisection over
hashes of ranges of lines, so a document of n lines costs about n log n however often it repeats.
Of the earliest document only the lines that the later one can meet go to the worker. Earliest
positions come from a combined minimum, and a hot fingerprint or first document is the single row on
one side of its join, which adaptive execution can split.

Defined results: a null text stays null; a null doc_id comes last; a document whose lines all go has
an empty text; runs repeat inside one document as well; other columns pass through, and where one has
the name of an added column, the added one's name gets an underscore; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HASH_RUN_BYTES, Keyed, byte_sizes, column, documents, filled, free_name, join_measured, materialize, release, row_type, runs
from .textkit import WORD_BASE, RangeHash, Texts

QUERY = "op6_line_dedup"
GRAM_WORDS, WINDOW_WORDS = 40, 50
GRAM_BASE = 0xAF251AF3B0F025B5 | 1

LINES = "row {}, doc_id long, hashes array<long>, numbers array<int>, words array<int>, grams array<long>, places array<int>"


def fingerprints(hashes: np.ndarray, words: np.ndarray, gram: int = GRAM_WORDS, window: int = WINDOW_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Gram hashes and first lines of the fingerprints of one document, by the hashes and words of its lines."""
    before = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    gram_end = np.searchsorted(before, before[:-1] + gram)  # one past the gram's last line; n + 1 if there is none
    window_end = np.searchsorted(before, before[:-1] + window)
    n_windows = int(np.count_nonzero(window_end <= n))
    if not n_windows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts = np.flatnonzero(gram_end <= n)
    values = RangeHash(hashes, GRAM_BASE)(starts, gram_end[starts])
    # Grams inside window i begin at i ... last[i].
    last = np.searchsorted(gram_end[: len(starts)], window_end[:n_windows], "right") - 1
    best = np.arange(n_windows)
    width = int((last - best).max()) + 1
    for k in range(1, width):
        at = np.minimum(np.arange(n_windows) + k, last)
        best = np.where(values[at] <= values[best], at, best)
    best = np.unique(best)
    return values[best], best


def line_table(docs: DataFrame) -> DataFrame:
    """LINES of docs (row, doc_id, text)."""
    kind = LINES.format(row_type(docs))
    names = ["row", *(x.split(" ")[0] for x in LINES.split(", ")[1:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = filled(column(batch, "text"))
            for i, j in runs(byte_sizes(texts), HASH_RUN_BYTES):
                t = Texts(texts[i:j].to_pylist())
                t.lines()
                owner = np.repeat(np.arange(t.n), np.diff(t.line_at))
                number = np.arange(len(owner)) - t.line_at[:-1][owner]
                words = np.diff(t.line_word)
                worded = np.flatnonzero(words)
                hashes = RangeHash(t.word_hashes(), WORD_BASE)(t.line_word[worded], t.line_word[worded + 1])
                words, number = words[worded], number[worded]
                at = np.append(np.searchsorted(owner[worded], np.arange(t.n)), len(worded))
                found = [fingerprints(hashes[a:b], words[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                marks = np.concatenate([[0], np.cumsum([len(p) for _, p in found])])
                lists = lambda offsets, values, kind: pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(kind)))
                grams, places = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                arrays = [lists(at, hashes.view(np.int64), np.int64), lists(at, number, np.int32), lists(at, words, np.int32), lists(marks, grams.view(np.int64), np.int64), lists(marks, places, np.int32)]
                yield pa.RecordBatch.from_arrays([column(batch, "row")[i:j], column(batch, "doc_id")[i:j], *arrays], names)

    return docs.mapInArrow(run, kind)


def agreement(a: RangeHash, b: RangeHash, p: np.ndarray, q: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """For each pair of places how many values agree from there on (step 1) or before them (step -1), most at most: bisection over range hashes."""
    low, high = np.zeros(len(p), np.int64), most.astype(np.int64)
    while (low < high).any():
        middle = (low + high + 1) // 2
        equal = a(p, p + middle) == b(q, q + middle) if step > 0 else a(p - middle, p) == b(q - middle, q)
        low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
    return low


def repeated_runs(mine: np.ndarray, first: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of mine that repeat first, by matched places p and q; first may be mine as well, at earlier places."""
    a, b = RangeHash(mine, GRAM_BASE), RangeHash(first, GRAM_BASE)
    begin = p - agreement(a, b, p, q, np.minimum(p, q), -1)
    end = p + agreement(a, b, p, q, np.minimum(len(mine) - p, len(first) - q), 1)
    cover = np.zeros(len(mine) + 1, np.int64)
    np.add.at(cover, begin, 1)
    np.add.at(cover, end, -1)
    turns = np.diff((np.cumsum(cover) > 0).astype(np.int8), prepend=np.int8(0))
    return np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)


def values_of(lists: pa.Array, row: int) -> np.ndarray:
    """One row of a list array as numpy values."""
    return lists.slice(row, 1).flatten().to_numpy(zero_copy_only=False)


def extend(matched: DataFrame) -> DataFrame:
    """row, runs (begins and ends of places of lines) of each row by the matched places of fingerprints and both documents' lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            mine, first, p, q = (column(batch, c) for c in ("hashes", "first_hashes", "places", "first_places"))
            for k in range(batch.num_rows):
                begin, end = repeated_runs(*(values_of(x, k).view(np.uint64) for x in (mine, first)), *(values_of(x, k).astype(np.int64) for x in (p, q)))
                out.append(np.stack([begin, end], 1).reshape(-1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([column(batch, "row"), pa.array(out, pa.list_(pa.int32()))], ["row", "runs"])

    return matched.mapInArrow(run, f"row {row_type(matched)}, runs array<int>")


def numbered(found: DataFrame) -> DataFrame:
    """row, gone (numbers of the lines to delete, ascending), gone_words of found (row, runs, numbers, words); lines without words between two deleted neighbours go as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, n_words = [], []
            for k in range(batch.num_rows):
                runs_of, number, words = (values_of(column(batch, c), k).astype(np.int64) for c in ("runs", "numbers", "words"))
                cover = np.zeros(len(number) + 1, np.int64)
                np.add.at(cover, runs_of[::2], 1)
                np.add.at(cover, runs_of[1::2], -1)
                hit = np.cumsum(cover)[:-1] > 0
                places = np.flatnonzero(hit)
                more = np.where(np.append(hit[1:], False)[places], np.append(number[1:], 0)[places] - number[places], 1)
                first = np.repeat(number[places] - np.cumsum(more) + more, more)
                gone.append((first + np.arange(len(first))).astype(np.int32))
                n_words.append(int(words[places].sum()))
            yield pa.RecordBatch.from_arrays([column(batch, "row"), pa.array(gone, pa.list_(pa.int32())), pa.array(n_words, pa.int64())], ["row", "gone", "gone_words"])

    return found.mapInArrow(run, f"row {row_type(found)}, gone array<int>, gone_words long")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """A written table of row, gone (line numbers to delete) and gone_words of the documents of docs (row, doc_id, text) that repeat earlier runs."""
    lines = materialize(line_table(docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text")), "line-table")
    marks = lines.select("row", "doc_id", F.explode(F.arrays_zip("grams", "places")).alias("g")).select(F.col("g.grams").alias("gram"), "row", "doc_id", F.col("g.places").alias("place"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "place")
    firsts = marks.groupBy("gram").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("gram", F.col("first.row").alias("first_row"), F.col("first.place").alias("first_place"))
    later = marks.join(firsts, "gram").where("row != first_row or place != first_place")
    pairs = later.groupBy("row", "first_row").agg(F.collect_list(F.struct("place", "first_place")).alias("pairs"))
    both = pairs.join(lines.select("row", "hashes"), "row").join(lines.select(F.col("row").alias("first_row"), F.col("hashes").alias("first_hashes")), "first_row")
    # The later document's line p can only meet the line p + shift of the first one.
    shifts = F.transform("pairs", lambda x: x["first_place"] - x["place"])
    low = both.withColumn("low", F.greatest(F.lit(0), F.array_min(shifts))).withColumn("high", F.least(F.size("first_hashes"), F.array_max(shifts) + F.size("hashes")))
    met = low.select(
        "row", "hashes", F.slice("first_hashes", F.col("low") + 1, F.col("high") - F.col("low")).alias("first_hashes"),
        F.transform("pairs", lambda x: x["place"]).alias("places"), F.transform("pairs", lambda x: x["first_place"] - F.col("low")).alias("first_places"),
    )
    gone = extend(met).groupBy("row").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    spans = materialize(numbered(gone.join(lines.select("row", "numbers", "words"), "row")), "line-spans")
    release(lines)
    return spans


def without_lines(text: Column, gone: Column) -> Column:
    """text without the lines of the given numbers, which ascend; unchanged where gone is null."""
    end = F.lit(2**31 - 1)

    def left(lines: Column) -> Column:
        # Runs of lines that stay: before the first deleted one, and after each.
        def kept(k: Column) -> Column:
            begin = F.when(k < 0, 0).otherwise(F.get(gone, k) + 1)
            return F.slice(lines, begin + 1, F.greatest(F.lit(0), F.coalesce(F.get(gone, k + 1), end - begin) - begin))

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(-1), F.size(gone) - 1), kept)), "\n")

    return F.when(gone.isNull() | (F.size(gone) == 0), text).otherwise(F.get(F.transform(F.array(F.split(text, "\n", -1)), left), 0))


def dedup(docs: DataFrame, in_files: bool = False) -> DataFrame:
    """docs (doc_id, text and any other columns) without later repeated runs; adds n_lines, removed_lines, removed_words. in_files: see ``Keyed``."""
    own = Keyed(docs, in_files)
    gone = repeated_lines(own.select("doc_id", "text"))
    text = own["text"]
    joined = join_measured(own.table, gone, "row", "left")
    new = without_lines(text, F.col("gone"))
    columns = [(new if c == "text" else F.col(f"c{k}")).alias(c) for k, c in enumerate(own.names)]
    added = {
        "n_lines": F.size(F.split(F.coalesce(text, F.lit("")), "\n", -1)).cast("long"),
        "removed_lines": F.coalesce(F.size("gone"), F.lit(0)).cast("long"),
        "removed_words": F.coalesce("gone_words", F.lit(0)).cast("long"),
    }
    taken = {c.lower() for c in own.names}
    return joined.select(*columns, *(c.alias(free_name(n, taken)) for n, c in added.items()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir, "doc_id", "text"))
