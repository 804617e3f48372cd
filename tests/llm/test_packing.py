"""op10: brute force against the tokenizers library."""

import zlib

import numpy as np
from tokenizers import Tokenizer

from folioscope.llm import packing
from folioscope.llm.tokens import ByteEncoder, tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
ROWS = [(1, "A word, two  words\n\nCafé 日本 😀 it's"), (2, ""), (3, None), (None, "x"), (7, "same"), (7, "same"), (9, "long text " * 9000), (10, "a<|endoftext|> b  <|endoftext|>")]


def test_encoder_on_every_character():
    library, ours = Tokenizer.from_file(PATH), ByteEncoder(PATH)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}b1{chr(c)} {chr(c)}\n" for c in points[k : k + 256]) for k in range(0, len(points), 256)]
    for want, got in zip(library.encode_batch_fast(texts, add_special_tokens=False), ours.encode_batch(texts), strict=True):
        assert want.ids == got.tolist()


def test_pieces(spark):
    library = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame([(*r, 5) for r in ROWS], "doc_id long, text string, length int").repartition(3)
    got = packing.pack(docs, PATH).collect()
    used = {}
    for r in got:
        assert 0 < r.length <= 2048 and r.offset + r.length <= 2048
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, places in used.items():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at == 2048 or k == max(used)
    want = []
    for d, t in ROWS:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((d, len(ids), ids))
    for d, n, ids in want:
        mine = [r for r in got if r.doc_id == d and r.doc_tokens == n]
        covered = np.zeros(n, int)
        for r in mine:
            covered[r.start : r.start + r.length] += 1
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        assert (covered == sum(x[:2] == (d, n) for x in want)).all()


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
