"""Telephony audio in media columns: mu-law, A-law and IMA ADPCM in WAV, with numpy.

* ``encode``: bytes become the samples of a WAV file without loss: mu-law or A-law take each byte as
  one 8-bit sample, ADPCM takes it as two 4-bit codes inside blocks of 192 code bytes.
* ``decode``: the chunks of a stored file are parsed, 8-bit samples are expanded by lookup tables,
  ADPCM blocks are decoded in lockstep with one numpy lane for each block of a whole batch.
* ``resample``: PCM at another rate through a windowed-sinc polyphase filter.
* ``describe``: a stored media column read back: payload digests, features, and a ``pcm`` column of
  resampled 16-bit WAV files, which is stored wherever the result is written.
* ``store_pcm``: the same column for any media column.

Defined results: a null or empty text has a payload of 192 spaces; repeated texts have equal values;
an empty table gives no rows; extra columns are ignored; bytes that are not such a WAV file raise
ValueError in ``decode`` and become null in ``store_pcm``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_sizes, column, documents, filled, materialize, runs

QUERY = "op7_telephony_media"
UNIT = 192
RATE, TARGET_RATE = 8000, 16000
CODECS = ("mulaw", "alaw", "adpcm")
#: WAV format tags; fixed values.
TAGS = {"mulaw": 7, "alaw": 6, "adpcm": 0x11, "pcm": 1}
BLOCK_HEADER = 4
TAPS = 8

MEDIA = "doc_id long, n_bytes long, codec string, media binary"
RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, pcm binary"


@cache
def mulaw_table() -> np.ndarray:
    """Linear value of each mu-law byte (G.711): complemented sign, exponent and mantissa over a bias of 132."""
    code = ~np.arange(256, dtype=np.uint8)
    exponent, mantissa = (code >> 4 & 7).astype(np.int32), (code & 15).astype(np.int32)
    size = (((mantissa << 3) + 132) << exponent) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


@cache
def alaw_table() -> np.ndarray:
    """Linear value of each A-law byte (G.711): even bits toggled, first segment without hidden bit."""
    code = np.arange(256, dtype=np.uint8) ^ 0x55
    exponent, mantissa = (code >> 4 & 7).astype(np.int32), (code & 15).astype(np.int32)
    size = np.where(exponent == 0, (mantissa << 4) + 8, ((mantissa << 4) + 264) << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


@cache
def adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """Difference of each (step index, code), and the step index after it, for IMA ADPCM."""
    # The 89 step sizes of the IMA standard. Fixed values.
    steps = [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307,
        337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358,
        5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ]
    moves = [-1, -1, -1, -1, 2, 4, 6, 8] * 2
    step, code = np.array(steps)[:, None], np.arange(16)[None, :]
    size = (step >> 3) + np.where(code & 1, step >> 2, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 4, step, 0)
    after = np.clip(np.arange(89)[:, None] + np.array(moves)[None, :], 0, 88)
    return np.where(code & 8, -size, size).astype(np.int32).reshape(-1), (after * 16).astype(np.int32).reshape(-1)


def wav(tag: int, rate: int, bits: int, block: int, data: bytes, samples: int, per_block: int = 0) -> bytes:
    """A mono RIFF WAVE file image."""
    byte_rate = rate * block // per_block if per_block else rate * block
    extra = struct.pack("<HH", 2, per_block) if per_block else b"" if tag == 1 else struct.pack("<H", 0)
    form = struct.pack("<HHIIHH", tag, 1, rate, byte_rate, block, bits) + extra
    fact = b"" if tag == 1 else struct.pack("<4sII", b"fact", 4, samples)
    body = b"WAVE" + struct.pack("<4sI", b"fmt ", len(form)) + form + fact + struct.pack("<4sI", b"data", len(data)) + data + b"\0" * (len(data) & 1)
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def encode(payload: bytes, codec: str, rate: int = RATE) -> bytes:
    """Payload as the samples of a WAV file; ADPCM needs a multiple of UNIT bytes."""
    if codec != "adpcm":
        return wav(TAGS[codec], rate, 8, 1, payload, len(payload))
    codes = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    blocks = np.zeros((len(codes), BLOCK_HEADER + UNIT), np.uint8)
    blocks[:, BLOCK_HEADER:] = codes
    return wav(TAGS[codec], rate, 4, BLOCK_HEADER + UNIT, blocks.tobytes(), len(codes) * (1 + 2 * UNIT), 1 + 2 * UNIT)


def parse(media: bytes) -> tuple[str, int, int, memoryview]:
    """Codec, rate, block size and data of a stored file."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, view = 12, None, memoryview(media)
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data":
            codec = next((c for c, t in TAGS.items() if form and t == form[0]), None)
            if codec is None or form[1] != 1 or at + 8 + size > len(media):
                raise ValueError("not a mono telephony file")
            return codec, form[2], form[4], view[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def decode_blocks(blocks: np.ndarray) -> np.ndarray:
    """Samples of ADPCM blocks [block, header + code bytes]: one lane for each block, a step for each code."""
    change, after = adpcm_tables()
    n, width = blocks.shape
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32) * 16
    out = np.empty((1 + 2 * (width - BLOCK_HEADER), n), np.int16)
    out[0] = value
    by_step = np.ascontiguousarray(blocks[:, BLOCK_HEADER:].T)
    for k, codes in enumerate(by_step):
        for half, nibble in ((1, codes & 15), (2, codes >> 4)):
            at = index + nibble
            value += change[at]
            np.clip(value, -32768, 32767, out=value)
            index = after[at]
            out[2 * k + half] = value
    return np.ascontiguousarray(out.T)


def decode(files: list[bytes]) -> list[tuple[str, int, bytes, np.ndarray]]:
    """Of each stored file: codec, rate, payload bytes, PCM samples."""
    out: list = [None] * len(files)
    waiting: dict[int, list[tuple[int, np.ndarray]]] = {}
    rates = {}
    for k, media in enumerate(files):
        codec, rate, block, data = parse(media)
        if codec == "adpcm":
            waiting.setdefault(block, []).append((k, np.frombuffer(data, np.uint8).reshape(-1, block)))
            rates[k] = rate
        elif codec == "pcm":
            out[k] = codec, rate, bytes(data), np.frombuffer(data, "<i2")
        else:
            table = mulaw_table() if codec == "mulaw" else alaw_table()
            out[k] = codec, rate, bytes(data), table[np.frombuffer(data, np.uint8)]
    for found in waiting.values():
        samples = decode_blocks(np.concatenate([b for _, b in found]))
        at = 0
        for k, blocks in found:
            out[k] = "adpcm", rates[k], blocks[:, BLOCK_HEADER:].tobytes(), samples[at : at + len(blocks)].reshape(-1)
            at += len(blocks)
    return out


@cache
def phases(up: int, down: int) -> np.ndarray:
    """Windowed-sinc filters [up, 2 * TAPS] for resampling by up / down, each of unit gain."""
    t = np.arange(-TAPS + 1, TAPS + 1)[None, :] - (np.arange(up) / up)[:, None]
    cut = min(1.0, up / down)
    h = cut * np.sinc(cut * t) * (0.5 + 0.5 * np.cos(np.pi * np.clip(t / TAPS, -1, 1)))
    return (h / h.sum(1, keepdims=True)).astype(np.float32)


def resample(samples: np.ndarray, rate: int, target: int = TARGET_RATE) -> np.ndarray:
    """16-bit PCM at the target rate."""
    if rate == target or not len(samples):
        return samples.astype(np.int16)
    g = np.gcd(rate, target)
    up, down = target // g, rate // g
    h = phases(int(up), int(down))
    padded = np.pad(samples.astype(np.float32), (TAPS - 1, TAPS), "edge")
    n_out = -(-len(samples) * up // down)
    out = np.empty(n_out, np.float32)
    for first in range(min(up, n_out)):  # outputs first, first + up, ... have one filter, at every down-th input
        begin, phase = divmod(first * down, up)
        if h[phase].max() == 1.0 and np.count_nonzero(np.abs(h[phase]) > 1e-7) == 1:
            out[first::up] = padded[begin + TAPS - 1 :: down][: len(out[first::up])]
            continue
        m = len(out[first::up])
        total = np.zeros(m, np.float32)
        for k in range(2 * TAPS):
            total += h[phase, k] * padded[begin + k : begin + k + (m - 1) * down + 1 : down]
        out[first::up] = total
    return np.clip(np.rint(out), -32768, 32767).astype(np.int16)


def feature(codec: str, pcm: np.ndarray, stored: bytes) -> str:
    """Codec, samples, root mean square (of an exact sum of squares), peak, sign changes, and the crc of the resampled file."""
    x = pcm.astype(np.int64)
    rms = (int(np.dot(x, x)) / max(1, len(x))) ** 0.5
    peak = int(np.abs(x).max(initial=0))
    turns = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"{codec};n={len(pcm)};rms={rms:.1f};peak={peak};turns={turns};pcm={zlib.crc32(stored):08x}"


def to_payload(text: bytes) -> bytes:
    """Spaces fill text up to a positive multiple of UNIT."""
    return text + b" " * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def store(docs: DataFrame, codec: str | None = None) -> DataFrame:
    """A media column of docs (doc_id, text), written to the shared folder. Without a codec the payload's crc picks one of the three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, doc_ids = filled(column(batch, "text")), column(batch, "doc_id")
            sizes = byte_sizes(texts)
            for i, j in runs(sizes):
                payloads = [to_payload(t.encode()) for t in texts[i:j].to_pylist()]
                codecs = [codec or CODECS[zlib.crc32(p) % len(CODECS)] for p in payloads]
                media = [encode(p, c) for p, c in zip(payloads, codecs, strict=True)]
                yield pa.RecordBatch.from_arrays([doc_ids[i:j], pa.array(sizes[i:j]), pa.array(codecs), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "codec", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, MEDIA)
    return materialize(rows, "media", compression="zstd")


def describe(media: DataFrame, target: int = TARGET_RATE) -> DataFrame:
    """RESULT of a stored media column (doc_id, n_bytes, media): what is read back is decoded, resampled and described; pcm has the resampled files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, n_bytes, stored = (column(batch, c) for c in ("doc_id", "n_bytes", "media"))
            for i, j in runs(byte_sizes(stored)):
                files, rows = stored[i:j].to_pylist(), []
                for file, (codec, rate, payload, samples) in zip(files, decode(files), strict=True):
                    pcm = resample(samples, rate, target)
                    image = wav(1, target, 16, 2, pcm.tobytes(), len(pcm))
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(file), hashlib.sha256(file).hexdigest(), feature(codec, pcm, image), codec, image))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
                arrays = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([doc_ids[i:j], n_bytes[i:j], *arrays], [x.split(" ")[0] for x in RESULT.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, RESULT)


def store_pcm(media: DataFrame, target: int = TARGET_RATE) -> DataFrame:
    """media (doc_id, media) with a pcm column: resampled 16-bit WAV, null where media is null or not telephony audio."""

    def convert(file: bytes | None) -> bytes | None:
        try:
            ((_, rate, _, samples),) = decode([file]) if file else [(0, 0, 0, None)]
        except ValueError:
            return None
        return None if samples is None else wav(1, target, 16, 2, (pcm := resample(samples, rate, target)).tobytes(), len(pcm))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stored = column(batch, "media")
            for i, j in runs(byte_sizes(stored.fill_null(b""))):
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id")[i:j], stored[i:j], pa.array(map(convert, stored[i:j].to_pylist()), pa.binary())], ["doc_id", "media", "pcm"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, media binary, pcm binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(store(documents(spark, sf_dir, "doc_id", "text")))
