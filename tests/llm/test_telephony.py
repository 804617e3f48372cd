"""op7: tables and block decoding against scalar definitions, exact round trips, the query's columns."""

import hashlib
import zlib

import numpy as np
import pytest

from folioscope.llm import telephony as T


def test_companding_tables():
    # Known points of G.711.
    mu, a = T.mulaw_table(), T.alaw_table()
    assert (mu[0x00], mu[0x80], mu[0xFF], mu[0x7F]) == (-32124, 32124, 0, 0)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256


def scalar_adpcm(block):
    change, after = T.adpcm_tables()
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            value = max(-32768, min(32767, value + int(change[index * 16 + code])))
            index = int(after[index * 16 + code]) // 16
            out.append(value)
    return out


def test_blocks_against_one_by_one():
    blocks = np.random.default_rng(5).integers(0, 256, (7, 40), dtype=np.uint8)
    assert T.decode_blocks(blocks).tolist() == [scalar_adpcm(b.tobytes()) for b in blocks]


@pytest.mark.parametrize("codec", T.CODECS)
@pytest.mark.parametrize("size", [192, 384, 192 * 50])
def test_round_trip(codec, size):
    payload = np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8).tobytes()
    (got,) = T.decode([T.encode(payload, codec)])
    assert got[0] == codec and got[2] == payload and len(got[3]) == (size if codec != "adpcm" else size // 192 * 385)


def test_resample_keeps_a_tone():
    t = np.arange(4000)
    tone = (8000 * np.sin(2 * np.pi * 300 * t / 8000)).astype(np.int16)
    for target in (16000, 12000, 8000, 4000):
        got = T.resample(tone, 8000, target)
        want = 8000 * np.sin(2 * np.pi * 300 * np.arange(len(got)) / target)
        assert len(got) == 4000 * target // 8000 and np.abs(got - want)[50:-50].max() < 150


def test_query_columns(spark):
    texts = [(1, "short"), (2, None), (3, ""), (None, "é" * 200), (5, "x" * 192), (6, "long " * 5000), (7, "short"), (7, "short")]
    docs = spark.createDataFrame([(*r, "c", 1) for r in texts], "doc_id long, text string, codec string, n_bytes int")
    for codec in (None, *T.CODECS):
        got = T.describe(T.store(docs, codec)).collect()
        by = {}
        for r in got:
            by.setdefault(r.doc_id, []).append(r)
        for d, t in texts:
            raw = (t or "").encode()
            payload = T.to_payload(raw)
            r = by[d][0]
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
            assert r.media_bytes > r.payload_bytes and f";n={2 * len(payload)};" in r.feature or r.codec == "adpcm"
        assert by[1][0][1:] == by[7][0][1:] == by[7][1][1:] and by[2][0][1:] == by[3][0][1:]
    assert T.describe(T.store(docs.limit(0))).count() == 0


def test_store_pcm(spark):
    good = T.encode(b" " * 192, "alaw")
    rows = T.store_pcm(spark.createDataFrame([(1, bytearray(good)), (2, None), (3, bytearray(b"no"))], "doc_id long, media binary")).orderBy("doc_id").collect()
    assert T.parse(bytes(rows[0].pcm))[:2] == ("pcm", 16000) and rows[1].pcm is None and rows[2].pcm is None


def test_query_stores_pcm(spark, tmp_path):
    """The result, written and read again, holds the resampled files that its features describe."""
    spark.createDataFrame([(k, "some text " * k * k) for k in range(20)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    T.query(spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    stored = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(stored) == 20
    for r in stored:
        pcm = bytes(r.pcm)
        assert T.parse(pcm)[:2] == ("pcm", T.TARGET_RATE)
        samples = [int.from_bytes(T.parse(pcm)[3][k : k + 2], "little", signed=True) for k in range(0, len(T.parse(pcm)[3]), 2)]
        rms = (sum(x * x for x in samples) / len(samples)) ** 0.5
        turns = sum((a < 0) != (b < 0) for a, b in zip(samples, samples[1:], strict=False))
        assert r.feature == f"{r.codec};n={len(samples)};rms={rms:.1f};peak={max(map(abs, samples))};turns={turns};pcm={zlib.crc32(pcm):08x}"


def plain_resample(samples, up, down):
    """Each output sample as a sum over its filter's taps."""
    h, n = T.phases(up, down), len(samples)
    out = []
    for k in range(-(-n * up // down)):
        begin, phase = divmod(k * down, up)
        total = sum(float(h[phase, t]) * samples[min(max(begin + t - T.TAPS + 1, 0), n - 1)] for t in range(2 * T.TAPS))
        out.append(max(-32768, min(32767, total)))
    return out


@pytest.mark.parametrize("target", [16000, 12000, 11025])
def test_resample_against_plain_sums(target):
    samples = np.random.default_rng(target).integers(-9000, 9000, 300).astype(np.int16)
    g = int(np.gcd(8000, target))
    got, want = T.resample(samples, 8000, target), plain_resample(samples.tolist(), target // g, 8000 // g)
    assert len(got) == len(want) and max(abs(a - b) for a, b in zip(got.tolist(), want, strict=True)) <= 1


def test_one_root_mean_square_for_all_sizes():
    pcm = np.full(70_001, 32767, np.int16)
    assert ";rms=32767.0;peak=32767;turns=0;" in T.feature("alaw", pcm, b"") and ";rms=32767.0;" in T.feature("alaw", pcm[:60_000], b"")
