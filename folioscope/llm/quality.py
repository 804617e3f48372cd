"""Quality rules over whole texts, with line frequency across documents.

Lines are normalised (A-Z as a-z, words with single spaces between) and hashed. For each host and
line the distinct documents that hold it are counted; equal texts count as one document, so copies
do not make their own lines common. A line is above the limit when it is in more than
``max(least, share percent of the host's distinct documents)`` of them. Lines above the limit are
removed, and a document is rejected as depleted when more than ``depleted`` percent of its words go.

Every document gives one row for a (host, line) key at most, the counts are combined before they
are exchanged, and the few lines above a limit meet the documents' lines in a join by (host, line):
a hot host or line is spread by the other half of its key.

Defined results: a null or empty text has no words, fails the base rules and is not kept; a null
host is a host of its own; rows that share a doc_id are judged each on its own; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HASH_RUN_BYTES, Keyed, byte_sizes, column, documents, filled, join_measured, materialize, release, row_type, runs
from .line_dedup import without_lines
from .textkit import BASE, EXACT, WORD_BASE, RangeHash, Texts, any_equal, earlier_equal, sum_by

QUERY = "op8_line_frequency"
LEAST_DOCS, SHARE_PERCENT, DEPLETED_PERCENT = 10, 5, 70
WINDOW, MIN_WORDS, REPEAT_PERCENT = 8, 20, 30
#: Fixed set of symbols.
SYMBOLS = np.zeros(256, np.uint8)
SYMBOLS[list(b"#*$%&|<>")] = 1

FEATURES = (
    "row {}, doc_id long, host string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, line_hashes array<long>, line_words array<int>, lines array<int>"
)
NAMES = ["row", *(x.split(" ")[0] for x in FEATURES.split(", ")[1:])]


def measure(texts: list[str]) -> dict[str, np.ndarray]:
    """The base features of each text, and for each text the hash, words and number of every line with a word."""
    t = Texts(texts)
    exact = t.word_hashes(fold=False)
    counts = np.diff(t.word_at)
    owner = t.words_of()
    # Code points in words: bytes of words that do not continue a code point.
    heads = np.concatenate([[0], np.cumsum((t.bytes & 0xC0) != 0x80)])
    word_chars = sum_by(heads[t.word_end] - heads[t.word_begin], t.word_at)
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[t.bytes], dtype=np.int64)])
    # Words inside 8-word windows that are in the text twice or more.
    n_runs = np.maximum(counts - WINDOW + 1, 0)
    at = np.cumsum(n_runs) - n_runs
    begin = np.repeat(t.word_at[:-1], n_runs) + np.arange(int(n_runs.sum())) - np.repeat(at, n_runs)
    repeated = begin[any_equal(owner[begin], RangeHash(exact, WORD_BASE)(begin, begin + WINDOW))]
    cover = np.zeros(len(owner) + 1, np.int64)
    np.add.at(cover, repeated, 1)
    np.add.at(cover, repeated + WINDOW, -1)
    n_repeat = sum_by(np.cumsum(cover)[:-1] > 0, t.word_at)
    # Lines: exact ones for the base rule, normalised ones for the counts across documents.
    t.lines()
    line_owner = np.repeat(np.arange(t.n), np.diff(t.line_at))
    line_number = np.arange(len(line_owner)) - t.line_at[:-1][line_owner]
    line_words = np.diff(t.line_word)
    worded = np.flatnonzero(line_words)
    raw = RangeHash(EXACT[t.bytes], BASE)(t.line_begin[worded], t.line_end[worded])
    dup = earlier_equal(line_owner[worded], raw)
    n_dup = np.bincount(line_owner[worded], dup, t.n).astype(np.int64)
    normal = RangeHash(t.word_hashes(), WORD_BASE)(t.line_word[worded], t.line_word[worded + 1])
    whole = RangeHash(EXACT[t.bytes], BASE)(t.begins, t.ends)
    return {
        "text_hash": whole.view(np.int64), "n_words": counts.astype(np.int64), "word_chars": word_chars, "n_symbols": symbols[t.ends] - symbols[t.begins], "n_dup_lines": n_dup, "n_repeat_words": n_repeat,
        "lines_at": np.append(np.searchsorted(line_owner[worded], np.arange(t.n)), len(worded)), "line_hashes": normal.view(np.int64), "line_words": line_words[worded].astype(np.int32), "lines": line_number[worded].astype(np.int32),
    }


def features(docs: DataFrame, host: str = "source", numbered: bool = False) -> DataFrame:
    """FEATURES of every row of docs; row numbers are unique, and those of the input if it is numbered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = filled(column(batch, "text"))
            for i, j in runs(byte_sizes(texts), HASH_RUN_BYTES):
                m = measure(texts[i:j].to_pylist())
                failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * m["n_words"])
                lists = [pa.ListArray.from_arrays(pa.array(m["lines_at"].astype(np.int32)), pa.array(m[k])) for k in ("line_hashes", "line_words", "lines")]
                plain = [pa.array(m[k]) for k in ("text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                yield pa.RecordBatch.from_arrays([column(batch, "row")[i:j], column(batch, "doc_id")[i:j], column(batch, "host")[i:j], *plain, pa.array(failed), *lists], NAMES)

    number = F.col("row") if numbered else F.monotonically_increasing_id().alias("row")
    rows = docs.select(number, F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), "text")
    return materialize(rows.mapInArrow(run, FEATURES.format(row_type(rows))), "quality")


def common_lines(found: DataFrame, least: int, share: int) -> DataFrame:
    """c_host, c_line: the normalised lines above the limit of their host; a written table, small as a host has few such lines."""
    first = found.groupBy("host", "text_hash").agg(F.min("row").alias("row"))
    firsts = materialize(first.select("host", "row"), "quality-firsts")
    hosts = firsts.groupBy("host").agg(F.count("*").alias("host_docs"))
    once = found.select("row", "host", "line_hashes").join(firsts.select("row"), "row", "left_semi")
    lines = once.select("host", F.explode(F.array_distinct("line_hashes")).alias("line")).groupBy("host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") > least)
    above = lines.join(hosts, lines["host"].eqNullSafe(hosts["host"])).where(100 * F.col("docs") > share * F.col("host_docs"))
    found_lines = materialize(above.select(lines["host"].alias("c_host"), F.col("line").alias("c_line")), "quality-lines")
    release(firsts)
    return found_lines


def removals(found: DataFrame, common: DataFrame) -> DataFrame:
    """row, removed_words, removed_lines (numbers of the lines above a limit) of the documents that have such lines."""
    each = found.select("row", "host", F.explode(F.arrays_zip("line_hashes", "line_words", "lines")).alias("l"))
    gone = each.join(common, each["host"].eqNullSafe(common["c_host"]) & (F.col("l.line_hashes") == F.col("c_line")))
    return gone.groupBy("row").agg(F.sum("l.line_words").alias("removed_words"), F.sort_array(F.collect_list("l.lines")).alias("removed_lines"))


def rules(docs: DataFrame, host: str = "source", least: int = LEAST_DOCS, share: int = SHARE_PERCENT, depleted: int = DEPLETED_PERCENT, numbered: bool = False) -> DataFrame:
    """All rows of docs (doc_id, text, host) with base features, removed_words, removed_lines and kept."""
    return judged(features(docs, host, numbered), least, share, depleted)


def judged(found: DataFrame, least: int = LEAST_DOCS, share: int = SHARE_PERCENT, depleted: int = DEPLETED_PERCENT) -> DataFrame:
    """The verdicts on measured rows."""
    removed = removals(found, common_lines(found, least, share))
    rest = found.select(*NAMES[:10]).join(removed, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    return rest.withColumn("kept", ~F.col("base_failed") & (100 * F.col("removed_words") <= depleted * F.col("n_words")))


def clean(docs: DataFrame, host: str = "source", in_files: bool = False) -> DataFrame:
    """docs (any columns) without rejected rows, their texts without the lines above the limits. in_files: see ``Keyed``."""
    own = Keyed(docs, in_files)
    found = features(own.select("doc_id", "text", host), host, numbered=True)
    kept = materialize(judged(found).where("kept").select("row", "removed_lines"), "quality-kept")
    release(found)
    return own.restored(join_measured(own.table, kept, "row", "inner"), text=without_lines(own["text"], F.col("removed_lines")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules(documents(spark, sf_dir, "doc_id", "text", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words", F.coalesce(F.size("removed_lines"), F.lit(0)).cast("long").alias("removed_lines"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
b AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols FROM w),
g AS (SELECT doc_id, k, array_to_string(ws[k:k + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS k FROM w WHERE len(ws) >= 8)),
r AS (SELECT doc_id, count(DISTINCT k + o) AS n_repeat_words FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g), range(8) AS o(o) WHERE c > 1 GROUP BY doc_id),
l AS (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS line FROM d),
n AS (SELECT *, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS lw FROM l),
k AS (SELECT doc_id, source, t, line, array_to_string(lw, ' ') AS norm, len(lw) AS nw FROM n WHERE len(lw) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM k GROUP BY doc_id),
hosts AS (SELECT source, count(DISTINCT t) AS host_docs FROM d GROUP BY source),
common AS (SELECT k.source, norm FROM k JOIN hosts h ON h.source IS NOT DISTINCT FROM k.source GROUP BY k.source, norm, host_docs HAVING count(DISTINCT t) > 10 AND 100 * count(DISTINCT t) > 5 * host_docs),
gone AS (SELECT k.doc_id, sum(nw)::BIGINT AS removed_words, count(*) AS removed_lines FROM k JOIN common c ON c.source IS NOT DISTINCT FROM k.source AND c.norm = k.norm GROUP BY k.doc_id)
SELECT b.doc_id, b.n_words, b.word_chars, b.n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  n_words < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * n_words) AND 100 * coalesce(removed_words, 0) <= 70 * n_words AS kept,
  coalesce(removed_words, 0) AS removed_words, coalesce(removed_lines, 0) AS removed_lines
FROM b LEFT JOIN r USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id)
"""
