"""Directly addressable codes: token ids as byte chunks by level, any id readable on its own.

An id is split into 8-bit chunks, lowest first. Level 0 holds one chunk of every id; a bit in
the level's continuation bitmap says that the id goes on, and the id's next chunk is then at the
bit's rank in level 1, and so on. A rank directory holds the ones before each 512 bits, so a rank
costs one lookup and at most 64 bytes of counting. No block is ever decoded to reach an id.

A segment is one image: header, document directory, then codes, bitmap and directory of each level. A
file holds the segments of a run of documents one behind the other, as raw bytes without compression,
so any byte of it is reached by its offset: ``FileReader`` opens a file and reads the few bytes that an
id needs. Files are written through Spark's text writer (bytes pass as they are, a line feed ends the
file) and its commit protocol, so any store that Spark can write to holds them and a lost task leaves
nothing. A file's folder names tell its partition, its number there, and the ids before it and in it,
so global positions come from a listing. Documents are in ascending doc_id order.

The read-back takes every document by its own slice: the ranks of all documents' begins are looked up
together at each level, and every document's last id is taken on its own as a check.

Defined results: a null or empty text is a document of the end id alone; a null doc_id comes
first; rows that share a doc_id follow in the order of their texts' hashes; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_sizes, column, documents, filled, join_bases, prefix_bases, runs, shared_dir
from .tokens import tokenizer_path, word_encoder

QUERY = "op9_addressable_codes"
END_ID = 1
MAGIC = b"DAC1"
HEADER = "<4sIQB"
RANK_BITS = 512

#: Bytes of segments after which a file ends. A file is one value when it is written and when it is read back, and the JVM
#: holds several copies of such a value at a time.
FILE_BYTES = 4 << 20

FILES = "part int, file int, before long, ids long, payload binary"
READ_BACK = "part int, doc_id long, at long, n_tokens long, ids_crc32 long"


def build(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """The file image of ids, which belong to documents of the given lengths in a row."""
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([0 if d is None else d for d in doc_ids], "<i8")
    rest, levels = ids.astype(np.uint32), []
    while True:
        codes = rest.astype(np.uint8)
        rest = rest >> np.uint32(8)
        more = rest != 0
        levels.append((codes, more))
        rest = rest[more]
        if not len(rest):
            break
    out = [struct.pack(HEADER, MAGIC, len(doc_ids), len(ids), len(levels)), known.tobytes(), numbers.tobytes(), lengths.astype("<u8").tobytes()]
    for codes, more in levels:
        bits = np.packbits(more, bitorder="little")
        ones = np.bitwise_count(bits).astype(np.int64)
        step = RANK_BITS // 8
        by_block = np.add.reduceat(ones, np.arange(0, len(ones), step)) if len(ones) else np.zeros(0, np.int64)
        ranks = (np.cumsum(by_block) - by_block).astype("<u4")
        out += [struct.pack("<Q", len(codes)), codes.tobytes(), bits.tobytes(), ranks.tobytes()]
    return b"".join(out)


class Segment:
    """Reads an image in place, from an offset of a buffer; size is its bytes."""

    def __init__(self, image, at: int = 0):
        begin, (magic, n_docs, self.n_ids, n_levels) = at, struct.unpack_from(HEADER, image, at)
        if magic != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        at += struct.calcsize(HEADER)

        def array(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(image, kind, n, at)
            at += found.nbytes
            return found

        known = array("u1", n_docs)
        self.doc_ids = [d if k else None for d, k in zip(array("<i8", n_docs).tolist(), known.tolist(), strict=True)]
        self.lengths = array("<u8", n_docs).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", image, at)
            at += 8
            self.levels.append((array("u1", n), array("u1", -(-n // 8)), array("<u4", -(-n // RANK_BITS))))
        self.size = at - begin

    def rank(self, level: int, positions: np.ndarray) -> np.ndarray:
        """Ones in the level's bitmap before each position."""
        _, bits, ranks = self.levels[level]
        if not len(ranks):
            return np.zeros(len(positions), np.int64)
        block = np.minimum(positions // RANK_BITS, len(ranks) - 1)
        out = ranks[block].astype(np.int64)
        begin, byte = block * (RANK_BITS // 8), positions // 8
        for k in range(RANK_BITS // 8):
            inside = begin + k < byte
            if not inside.any():
                break
            out += np.where(inside, np.bitwise_count(bits[np.minimum(begin + k, len(bits) - 1)]), 0)
        last = bits[np.minimum(byte, len(bits) - 1)] & ((1 << (positions % 8)) - 1).astype(np.uint8)
        return out + np.where(byte < len(bits), np.bitwise_count(last), 0)

    def take(self, positions: np.ndarray) -> np.ndarray:
        """The ids at any positions, each reached on its own."""
        at, out, live = np.asarray(positions, np.int64), np.zeros(len(positions), np.uint32), np.arange(len(positions))
        for level, (codes, bits, _) in enumerate(self.levels):
            out[live] |= codes[at].astype(np.uint32) << np.uint32(8 * level)
            more = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            at, live = self.rank(level, at[more]), live[more]
            if not len(at):
                break
        return out

    def begins(self, positions: np.ndarray) -> list[np.ndarray]:
        """Where the chunks of the ids from each position on begin at every level."""
        out = [np.asarray(positions, np.int64)]
        for level in range(len(self.levels) - 1):
            out.append(self.rank(level, out[-1]))
        return out

    def slices(self, bounds: np.ndarray) -> Iterator[np.ndarray]:
        """The ids between neighbouring bounds, each slice on its own."""
        at = [x.tolist() for x in self.begins(bounds)]
        for k in range(len(bounds) - 1):
            out, live = self.levels[0][0][at[0][k] : at[0][k + 1]].astype(np.uint32), None
            for level in range(1, len(self.levels)):
                begin, end = at[level][k], at[level][k + 1]
                if begin == end:
                    break
                b, e = at[level - 1][k], at[level - 1][k + 1]
                more = np.flatnonzero(np.unpackbits(self.levels[level - 1][1][b >> 3 : (e + 7) >> 3], bitorder="little")[b & 7 : (b & 7) + e - b])
                live = more if live is None else live[more]
                out[live] |= self.levels[level][0][begin:end].astype(np.uint32) << np.uint32(8 * level)
            yield out

    def slice(self, begin: int, end: int) -> np.ndarray:
        """The ids of positions [begin, end)."""
        return next(self.slices(np.array([begin, end])))


def segments(content) -> Iterator[Segment]:
    """The segments of a file's bytes; the line feed at its end is none of them."""
    at = 0
    while len(content) - at > 1:
        found = Segment(content, at)
        at += found.size
        yield found


class FileReader:
    """Random access to the ids of a file: reads only the headers once, and then the bytes that an id needs.

    ``source`` is a seekable binary file. ``bytes_read`` counts what was read.
    """

    def __init__(self, source):
        self.source, self.bytes_read = source, 0
        source.seek(0, 2)
        size, at, ids = source.tell() - 1, 0, 0
        self.firsts: list[int] = []
        self.tables: list[list[tuple[int, int, int]]] = []  # of each segment and level: offsets of codes, bitmap, directory
        while at < size:
            magic, n_docs, n_ids, n_levels = struct.unpack(HEADER, self._read(at, struct.calcsize(HEADER)))
            if magic != MAGIC:
                raise ValueError("not a file of directly addressable codes")
            at += struct.calcsize(HEADER) + 17 * n_docs
            levels = []
            for _ in range(n_levels):
                (n,) = struct.unpack("<Q", self._read(at, 8))
                levels.append((at + 8, at + 8 + n, at + 8 + n + -(-n // 8)))
                at = levels[-1][2] + 4 * -(-n // RANK_BITS)
            self.firsts.append(ids)
            self.tables.append(levels)
            ids += n_ids
        self.n_ids = ids

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        self.bytes_read += n
        return self.source.read(n)

    def __getitem__(self, position: int) -> int:
        """The id at a position of the file."""
        if not 0 <= position < self.n_ids:
            raise IndexError(position)
        k = bisect_right(self.firsts, position) - 1
        at, out = position - self.firsts[k], 0
        for level, (codes, bits, ranks) in enumerate(self.tables[k]):
            out |= self._read(codes + at, 1)[0] << 8 * level
            block = at // RANK_BITS
            word = int.from_bytes(self._read(bits + block * (RANK_BITS // 8), at // 8 + 1 - block * (RANK_BITS // 8)), "little")
            place = at % RANK_BITS
            if not word >> place & 1:
                break
            at = int.from_bytes(self._read(ranks + 4 * block, 4), "little") + (word & ((1 << place) - 1)).bit_count()
        return out


def write(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Tokenize docs in ascending doc_id order and write their files; returns them as a table (path, content, part, file, before, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = word_encoder(path), TaskContext.get().partitionId()
        file, before, n_ids, images = 0, 0, 0, []

        def finished() -> pa.RecordBatch:
            row = ((part, pa.int32()), (file, pa.int32()), (before, pa.int64()), (n_ids, pa.int64()), (b"".join(images), pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in row], [x.split(" ")[0] for x in FILES.split(", ")])

        for batch in batches:
            texts, doc_ids = filled(column(batch, "text")), column(batch, "doc_id")
            for i, j in runs(byte_sizes(texts)):
                ids, counts = code.encode_run(texts[i:j].to_pylist())
                lengths = counts + 1
                images.append(build(doc_ids[i:j].to_pylist(), lengths, np.insert(ids, np.cumsum(counts), end_id)))
                n_ids += int(lengths.sum())
                if sum(map(len, images)) >= FILE_BYTES:
                    yield finished()
                    file, before, n_ids, images = file + 1, before + n_ids, 0, []
        if images:
            yield finished()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(*order).sortWithinPartitions(*order)
    spark, keys = docs.sparkSession, [x.split(" ")[0] for x in FILES.split(", ")][:-1]
    folder = f"{shared_dir(spark)}/addressable-{uuid.uuid4().hex}"
    files = ordered.mapInArrow(run, FILES)
    files.select(*keys, F.col("payload").cast("string").alias("value")).write.partitionBy(*keys).text(folder)
    return read_files(spark, folder)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files under a folder that ``write`` has made; of an empty table there are none."""
    kinds = FILES.rpartition(", ")[0]
    found = spark.read.format("binaryFile").load(folder)
    if "part" not in found.columns:
        return spark.createDataFrame([], f"path string, content binary, {kinds}")
    return found.select("path", "content", *(F.col(x.split(" ")[0]).cast(x.split(" ")[1]) for x in kinds.split(", ")))


def read_back(files: DataFrame, end_id: int = END_ID) -> DataFrame:
    """Each document of the written files, by its own slice. Contents go straight to the reader; the small rows that it gives meet the partitions' bases."""
    bases = prefix_bases(files.groupBy("part").agg(F.sum("ids").alias("total")), "part", "total")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, at = (column(batch, c)[k].as_py() for c in ("part", "before"))
                for s in segments(column(batch, "content")[k].as_buffer()):
                    bounds = np.concatenate([[0], np.cumsum(s.lengths)])
                    if (s.take(bounds[1:] - 1) != end_id).any():
                        raise ValueError("a document does not end with the end id")
                    crc = [zlib.crc32(ids.astype("<u4", copy=False).view(np.uint8)) for ids in s.slices(bounds)]
                    parts = pa.array(np.full(len(s.doc_ids), part, np.int32))
                    yield pa.RecordBatch.from_arrays([parts, pa.array(s.doc_ids, pa.int64()), pa.array(at + bounds[:-1]), pa.array(s.lengths), pa.array(crc, pa.int64())], [x.split(" ")[0] for x in READ_BACK.split(", ")])
                    at += s.n_ids

    placed = join_bases(files.select("part", "before", "content").mapInArrow(run, READ_BACK), bases, "part")
    return placed.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(write(documents(spark, sf_dir, "doc_id", "text"), tokenizer_path("word_bpe_49k.json")))
