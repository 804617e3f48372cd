"""Concatenate and cut: documents packed into sequences of a fixed number of tokens.

Pass 1 tokenizes every document and writes its ids with its place in the partition; pass 2 adds
up the partitions' totals to global offsets, cuts the one long run of tokens into windows of
``window`` ids and returns a boundary record for each piece of a document inside a window. Only
the last window is not full. A piece's row has the document's ids before it (``start``), its
``length``, the ``sequence_id`` of its window and its ``offset`` there.

Defined results: a null or empty text is a document of the end id alone; rows that share a
doc_id are documents of their own; an empty table gives no rows; extra columns are ignored.
The order of documents in the run is that of the input's partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_sizes, column, documents, filled, join_bases, materialize, prefix_bases, runs
from .tokens import byte_encoder, tokenizer_path

QUERY = "op10_packing"
WINDOW = 2048
END_ID = 1

TOKENS = "doc_id long, part int, before long, n_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenize(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, part, before (ids of the partition's documents in front), n_tokens, ids (u2 or u4, little-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = byte_encoder(path)
        width, kind = (2, "<u2") if max(code.size, end_id + 1) <= 65536 else (4, "<u4")
        end = np.array([end_id], np.uint32)
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts, doc_ids = filled(column(batch, "text")), column(batch, "doc_id")
            for i, j in runs(byte_sizes(texts)):
                ids = code.encode_batch(texts[i:j].to_pylist())
                n = np.array([len(x) + 1 for x in ids], np.int64)
                at = before + np.cumsum(n) - n
                before += int(n.sum())
                joined = np.concatenate([y for x in ids for y in (x, end)]).astype(kind)
                ends = pa.array((width * np.concatenate([[0], np.cumsum(n)])).astype(np.int32))
                narrow = pa.Array.from_buffers(pa.binary(), j - i, [None, ends.buffers()[1], pa.py_buffer(joined.tobytes())])
                yield pa.RecordBatch.from_arrays([doc_ids[i:j], pa.array(np.full(j - i, part, np.int32)), pa.array(at), pa.array(n), narrow], ["doc_id", "part", "before", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, TOKENS)


def with_offsets(tokens: DataFrame) -> DataFrame:
    """Adds at, the ids of all documents before: partition totals, one row a partition, as a prefix sum."""
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    placed = join_bases(tokens, prefix_bases(totals, "part", "total"), "part")
    return placed.withColumn("at", F.col("base") + F.col("before"))


def cut(placed: DataFrame, window: int = WINDOW) -> DataFrame:
    """The boundary records: each document's pieces in windows of the run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = column(batch, "doc_id")
            at = column(batch, "at").to_numpy()
            n = column(batch, "n_tokens").to_numpy()
            first, last = at // window, (at + n - 1) // window
            pieces = last - first + 1
            row = np.repeat(np.arange(len(n)), pieces)
            k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = first[row] + k
            begin = np.maximum(sequence * window, at[row])
            length = np.minimum((sequence + 1) * window, (at + n)[row]) - begin
            start = begin - at[row]
            crc = np.empty(len(row), np.int64)
            ids, held, last_row = column(batch, "ids"), b"", -1
            for p, (r, s, m) in enumerate(zip(row.tolist(), start.tolist(), length.tolist(), strict=True)):
                if r != last_row:
                    raw = ids[r].as_py()
                    held, last_row = (raw if len(raw) == 4 * n[r] else np.frombuffer(raw, "<u2").astype("<u4").tobytes()), r
                crc[p] = zlib.crc32(memoryview(held)[4 * s : 4 * (s + m)])
            out = [doc_ids.take(pa.array(row)), *map(pa.array, (start, length, crc, n[row], sequence, begin - sequence * window))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return placed.select("doc_id", "at", "n_tokens", "ids").mapInArrow(run, PIECES)


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """All of docs (doc_id, text) as pieces of full windows."""
    return cut(with_offsets(materialize(tokenize(docs, path, end_id), "packing-tokens")), window)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir, "doc_id", "text"), tokenizer_path("byte_bpe_50k.json"))
